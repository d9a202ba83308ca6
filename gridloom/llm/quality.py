"""Quality classifier: a convolutional network over the bytes of whole documents, in numpy.

Bytes are embedded; learned filters of eight bytes slide over them in steps of four. One more input channel, which
each filter weighs too, tells whether a window's eight bytes stood 2 to 24 places before as well, as in runs of a
repeated word: filters of a fixed width can't see that two windows are alike, and without the channel four times as
many bad documents pass. The filters' rectified responses are averaged over chunks of 256 bytes that overlap by half and cover the whole document, the chunks of a
document are max-pooled filter by filter, and a logistic unit combines the pooled responses into a probability.
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

EMBED, STEP, FILTERS = 4, 4, 16
#: Bytes in half a chunk; so many windows begin in it.
HALF = 128
WINDOWS = HALF // STEP
LAGS = range(2, 25)
#: Bytes that are looked at together; a longer text is taken in runs.
RUN = 1 << 18
THRESHOLD = 0.3


@dataclass
class Net:
    embed: np.ndarray  # 256 x EMBED
    first: np.ndarray  # STEP * EMBED x FILTERS: a window's first four bytes
    second: np.ndarray  # and its last four
    repeat: np.ndarray  # FILTERS: weights of the channel of repeated windows
    offset: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.first, self.second, self.repeat, self.offset, self.out, self.bias]


def fresh(rng: np.random.Generator) -> Net:
    draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    return Net(draw(256, EMBED, s=0.5), draw(STEP * EMBED, FILTERS, s=0.35), draw(STEP * EMBED, FILTERS, s=0.35), draw(FILTERS, s=0.35), np.zeros(FILTERS, np.float32), draw(FILTERS, s=0.3), np.zeros(1, np.float32))


def padded(raw: np.ndarray) -> np.ndarray:
    """Bytes padded with zeros to whole halves of a chunk, two at least, and the four that end the last window."""
    n = max(2, -(-len(raw) // HALF)) * HALF
    return np.concatenate([raw, np.zeros(n + STEP - len(raw), np.uint8)])


def repeated(raw: np.ndarray) -> np.ndarray:
    """For each window of padded bytes: 1 if its eight bytes stood a lag before as well. Padding doesn't count."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view(np.uint64).ravel()
    at = np.arange(0, len(words), STEP)
    out = np.zeros(len(raw) // STEP - 1, bool)
    own = words[at]
    for lag in LAGS:
        skip = -(-lag // STEP)
        out[skip : len(at)] |= own[skip:] == words[at[skip:] - lag]
    out[: len(at)] &= own != 0
    return out.astype(np.float32)


def groups(net: Net, raw: np.ndarray) -> np.ndarray:
    """The embedded bytes of padded texts, STEP bytes a row."""
    return net.embed[raw].reshape(-1, STEP * EMBED)


def responses(net: Net, e: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Each filter's response to the windows that begin with each group of bytes but the last; again: which of them repeat."""
    r = (e @ net.first)[:-1]
    r += (e @ net.second)[1:]
    r += np.outer(again, net.repeat)
    r += net.offset
    return r


def means(r: np.ndarray) -> np.ndarray:
    """Mean rectified response of each filter over each half chunk."""
    return np.ones(WINDOWS, r.dtype) @ np.maximum(r, 0).reshape(-1, WINDOWS, FILTERS) / WINDOWS


def pooled(net: Net, text: str) -> np.ndarray:
    """Largest mean response of each filter over all chunks of a whole text."""
    raw = padded(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
    best = np.zeros(FILTERS, np.float32)
    for at in range(0, len(raw) - STEP - HALF, RUN):
        end, before = at + RUN + HALF + STEP, min(at, HALF)  # one half more than the run: no chunk is lost between runs
        h = means(responses(net, groups(net, raw[at:end]), repeated(raw[at - before : end])[before // STEP :]))
        best = np.maximum(best, ((h[:-1] + h[1:]) / 2).max(axis=0))
    return best


def probability(net: Net, text: str | None) -> float:
    z = float(pooled(net, text or "") @ net.out + net.bias[0])
    return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def loss_gradient(net: Net, raws: list[np.ndarray], agains: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradient of the (weighted) logistic loss of a batch; only each filter's largest chunk passes it on.

    The texts' groups lie one after another, so that each layer is one product; the window that would begin with a
    text's last group is left out. agains: the texts' repeated windows.
    """
    raw = np.concatenate(raws)
    e = groups(net, raw)
    ends = np.cumsum([len(x) // STEP for x in raws])  # one past each text's last group
    begins = np.concatenate([[0], ends[:-1]])
    inside = np.ones(len(e) - 1, bool)
    inside[ends[:-1] - 1] = False
    again = np.concatenate([x for some in agains for x in (some, [0.0])])[:-1].astype(e.dtype)
    r = responses(net, e, again)
    h = means(r[inside])
    half_ends = np.cumsum((ends - begins - 1) // WINDOWS)
    at = np.zeros((len(raws), FILTERS), np.int64)
    pool = np.zeros((len(raws), FILTERS), r.dtype)
    for i, end in enumerate(half_ends.tolist()):
        part = h[half_ends[i - 1] if i else 0 : end]
        m = (part[:-1] + part[1:]) / 2
        at[i], pool[i] = m.argmax(axis=0), m.max(axis=0)
    z = np.clip(pool @ net.out + net.bias[0], -60, 60)
    g = (1 / (1 + np.exp(-z)) - y) * weight / weight.sum()
    down = np.outer(g, net.out) / (2 * WINDOWS)
    windows = (begins[:, None] + at * WINDOWS)[:, :, None] + np.arange(2 * WINDOWS)  # groups that begin the chosen chunks' windows
    de = np.zeros_like(e)
    d_first, d_second, d_repeat, d_offset = (np.zeros_like(p) for p in (net.first, net.second, net.repeat, net.offset))
    for f in range(FILTERS):
        rows = windows[:, f].ravel()
        d = (r[rows, f] > 0) * np.repeat(down[:, f], 2 * WINDOWS)
        d_first[:, f], d_second[:, f], d_repeat[f], d_offset[f] = d @ e[rows], d @ e[rows + 1], d @ again[rows], d.sum()
        de[rows] += d[:, None] * net.first[:, f]  # a filter's rows are all different
        de[rows + 1] += d[:, None] * net.second[:, f]
    used = np.flatnonzero(de.any(axis=1))
    letters, flow = raw.reshape(-1, STEP)[used].ravel(), de[used].reshape(-1, EMBED)
    d_embed = np.stack([np.bincount(letters, flow[:, k], 256) for k in range(EMBED)], axis=1).astype(net.embed.dtype)
    return [d_embed, d_first, d_second, d_repeat, d_offset, (pool.T @ g + 1e-4 * net.out).astype(net.out.dtype), np.array([g.sum()], net.bias.dtype)]


def train(rows: list[tuple[int, str, int]], steps: int = 300, batch: int = 32, rate: float = 0.02) -> Net:
    """Adam steps on (id, text, label) rows; both labels weigh the same, however many rows they have."""
    rng = np.random.default_rng(5)
    net = fresh(rng)
    if not rows:
        return net
    raws = [padded(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)) for _, t, _ in rows]
    agains = [repeated(raw) for raw in raws]
    y = np.array([int(label) for *_, label in rows], np.float32)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())).astype(np.float32) * len(y)
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    order: list[int] = []
    for n in range(1, steps + 1):
        if len(order) < batch:
            order += rng.permutation(len(rows)).tolist()
        some, order = order[:batch], order[batch:]
        now = rate * (1 - 0.9 * n / steps)
        for p, g, a, b in zip(net.parameters(), loss_gradient(net, [raws[j] for j in some], [agains[j] for j in some], y[some], weight[some]), first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= now * (a / (1 - 0.9**n)) / (np.sqrt(b / (1 - 0.99**n)) + 1e-6)
    return net


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the rows whose crc32(doc_id) modulo 5 is not 0: the others are held out."""
    return labels.where(crc_mod("doc_id", 5) != 0).select("doc_id", F.col("quality").cast("int").alias("label")).where("label IN (0, 1)")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1000) -> Net:
    """Fit on at most per_label whole texts of each label; labels: doc_id, label."""
    return train(labelled_sample(docs, labels, per_label))


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted for each row, from its whole text; `keep` columns come along.

    A null text is scored as an empty one. Repeated rows stay repeated; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            p = np.array([probability(own, x.as_py()) for x in batch.column(batch.num_columns - 1)], np.float64)
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`doc_id` {kinds[id_col]}", *(f"`{c}` {kinds[c]}" for c in keep), "score double, predicted int"])
    return docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame, per_label: int = 1000) -> DataFrame:
    """Fit on the labels that may be learned from and score all documents: doc_id, held_out, score, predicted."""
    net = fit(docs, learnable(labels), per_label)
    return score(docs, net).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
