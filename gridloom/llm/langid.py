"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, all but letters become spaces, and n-grams of one to three characters are hashed. A
feature's value is its share of the text's n-grams times its inverse document frequency in the fitting sample.
The model is trained with follow-the-regularised-leader steps and elastic-net penalties, so most weights are
zero; a temperature, fitted on rows kept from training, calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import crc_mod
from gridloom.llm.samples import labelled_sample

BITS = 16
SCALE = 40.0
#: Characters that are looked at together; a longer text is taken in runs that overlap by two. A run takes about 40 bytes a character.
RUN = 1 << 16
NONE = "und"


def _letters() -> np.ndarray:
    table = np.full(0x110000, 32, np.uint32)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
    table[table == 1] = np.flatnonzero(table == 1)
    return table


_TABLE: list[np.ndarray] = []


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a whole text, in runs of bounded size."""
    if not _TABLE:
        _TABLE.append(_letters())
    text = f" {text.lower()} "
    mix = lambda h: (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
    for at in range(0, max(1, len(text) - 2), RUN):
        part = text[at : at + RUN + 2]
        c = _TABLE[0][np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        own = c[:RUN] if at + RUN + 2 < len(text) else c  # the two characters of overlap belong to the next run
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        three = two[:-1] * np.uint32(0x9E3779B1) + c[2:]
        if own is not c:
            two = two[:RUN]
        yield mix(np.concatenate([own * np.uint32(0xC2B2AE35), two + np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)]))


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter to Unicode (numbers such as a half or a circled one are not)."""
    return any(map(str.isalpha, text or ""))


def tally(text: str) -> np.ndarray:
    """How often each n-gram's hash occurs in a whole text."""
    total = np.zeros(1 << BITS, np.int64)
    for h in grams(text):
        total += np.bincount(h, minlength=1 << BITS)
    return total


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    total = tally(text)
    at = np.flatnonzero(total)
    return at, total[at] / total.sum()


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    live: np.ndarray  # the features that have a weight other than zero
    weights: np.ndarray  # live features x languages, inverse document frequencies and scale included
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        total = tally(text)
        return total[self.live] / total.sum() @ self.weights + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return NONE, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates and elastic-net penalties."""

    def __init__(self, features: int, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> None:
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, w: np.ndarray, gradient: np.ndarray) -> None:
        n = self.n[at]
        grown = n + gradient**2
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood on rows that training has not seen."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(rows: list[tuple[int, str, str]], epochs: int = 4) -> Model:
    """A model from (id, text, language) rows; every fifth row calibrates it."""
    rows = [r for r in rows if has_letter(r[1])]
    langs = sorted({r[2] for r in rows})
    if not rows:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 1.0)
    data = [(*counts(text), langs.index(lang)) for _, text, lang in rows]
    held = [d for i, d in enumerate(data) if i % 5 == 4]
    fit = [d for i, d in enumerate(data) if i % 5 != 4]
    frequency = np.zeros(1 << BITS)
    for at, _, _ in fit:
        frequency[at] += 1
    idf = np.where(frequency > 0, np.log((1 + len(fit)) / (1 + frequency)) + 1, 0) * SCALE
    ftrl = Ftrl((1 << BITS) + 1, len(langs))
    order = np.random.default_rng(11)
    add_bias = lambda at, share: (np.append(at, 1 << BITS), np.append(share * idf[at], 1.0))
    for _ in range(epochs):
        for i in order.permutation(len(fit)):
            at, share, y = fit[i]
            at, x = add_bias(at, share)
            w = ftrl.weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            ftrl.step(at, w, np.outer(x, p))
    w = ftrl.weights(slice(None))
    table, bias = w[:-1] * idf[:, None], w[-1]
    logits = np.array([share @ table[at] + bias for at, share, _ in held]).reshape(-1, len(langs))
    live = np.flatnonzero((table != 0).any(axis=1))
    return Model(langs, live, table[live], bias, temperature(logits, np.array([d[2] for d in held], int)))


def fit(docs: DataFrame, learn: DataFrame | None = None, per_lang: int = 400) -> Model:
    """Fit on at most per_lang whole texts of each language of the rows of docs that may be learned from.

    learn: narrow rows (doc_id, label) to learn from; by default all rows of docs with a lang. A text of an id
    whose rows name several languages counts for each.
    """
    labels = learn if learn is not None else docs.select("doc_id", F.col("lang").alias("label"))
    return train(labelled_sample(docs, labels, per_lang))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score for each row, from its whole text; `keep` columns come along.

    und with score 0 if the text is null or has no letter, or if the model has learned no language.
    Repeated rows stay repeated; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats at most for each language, of which few are not zero

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            got = [known.predict(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`doc_id` {kinds[id_col]}", *(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double"])
    return docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def learnable(docs: DataFrame) -> DataFrame:
    """(doc_id, label) of the documents whose crc32(doc_id) modulo 3 is not 1: the others are held out."""
    return docs.where((crc_mod("doc_id", 3) != 1) & F.col("lang").isNotNull()).select("doc_id", F.col("lang").alias("label"))


def identified(docs: DataFrame, per_lang: int = 400) -> DataFrame:
    """Fit on the documents that may be learned from and predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs, learnable(docs), per_lang)
    return identify(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
