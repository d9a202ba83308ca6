"""Packing of tokenised documents into sequences of balanced attention cost, with little padding."""

from __future__ import annotations

import base64
import functools
import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 1024
#: Tokens that are packed together: the memory of a task, whatever the partition holds.
UNIT_TOKENS = 1 << 21
#: Attention cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Texts of these characters only are cut alike by both libraries' rules for letters, digits and spaces.
PLAIN = re.compile(r"[\t\n\r -~¡-ɏ]*")


class Encoder:
    """Ids of the byte-level vocabulary, as the tokenizers library gives them for its file.

    Plain texts go through tiktoken, which holds the same vocabulary as ranks and is several times faster;
    all others, and those with a special token's string, through tokenizers itself.
    """

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None) -> None:
        import public_tokenizers as files
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path or files.path("byte_bpe_50k.json"))
        with open(ranks_path or files.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        """uint32 ids of a text with id 0 after them."""
        text = text or ""
        if PLAIN.fullmatch(text) and "<|" not in text:
            got = self.fast.encode_ordinary(text)
        else:
            got = self.slow.encode(text, add_special_tokens=False).ids
        got.append(0)
        return np.array(got, np.uint32)


@functools.lru_cache(maxsize=1)
def loaded() -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder()


def capacities(total: int, length: int = SEQUENCE) -> list[int]:
    """Lengths of the sequences of a unit: full ones, and the rest in powers of two, which need no padding."""
    full, rest = divmod(total, length)
    return [length] * full + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def packed(lengths: np.ndarray, length: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, tokens, sequence, offset) of documents of these lengths.

    Documents come in descending order of length. Each goes to the sequence of lowest cost so far that has
    room for it, out of all sequences; if none has room for all of it, the one with the most room is filled
    and the rest goes on the same way. Sequences together hold exactly the tokens there are.
    """
    room = capacities(int(lengths.sum()), length)
    cost = [0.0 if n == length else 1e15 + s for s, n in enumerate(room)]  # the short ones of the rest come last
    used, out = [0] * len(room), []
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(length + 1)]  # open sequences by remaining room
    none, width = (math.inf, -1), 1 << length.bit_length()
    least = [none] * (2 * width)  # a tree over rooms: leaves hold the cheapest of each heap, nodes that of their leaves
    for s, n in enumerate(room):
        heapq.heappush(heaps[n], (cost[s], s))

    def update(n: int) -> None:
        k = width + n
        least[k] = heaps[n][0] if heaps[n] else none
        while k > 1:
            k >>= 1
            x = min(least[2 * k], least[2 * k + 1])
            if x == least[k]:
                break
            least[k] = x

    def cheapest(n: int) -> tuple[float, int]:
        """The sequence of lowest cost among those with room for n tokens."""
        k = width + n
        x = least[k]
        while k > 1:
            if not k & 1 and least[k + 1] < x:
                x = least[k + 1]
            k >>= 1
        return x

    def roomiest() -> tuple[float, int]:
        k = 1
        while k < width:
            k = 2 * k + (least[2 * k + 1] != none)
        return least[k]

    for n in set(room):
        update(n)
    for doc in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[doc])
        while left:
            n = min(left, length)
            x = cheapest(n)
            s = (x if x != none else roomiest())[1]
            before = room[s] - used[s]
            n = min(n, before)
            heapq.heappop(heaps[before])
            out.append((doc, start, n, s, used[s]))
            used[s] += n
            cost[s] += LINEAR * n + QUADRATIC * n * n
            update(before)
            if n < before:
                heapq.heappush(heaps[before - n], (cost[s], s))
                update(before - n)
            start, left = start + n, left - n
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Each partition packs its own documents in units of UNIT_TOKENS
    (a longer document is a unit of its own), so nothing is shuffled and a lost task gives the same rows
    again. Repeated rows are documents of their own. sequence_id: partition times 2**33, plus a running number.
    More columns are not looked at; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = loaded()
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        ids: list = []
        held: list[np.ndarray] = []
        size = done = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, held, size, done
            pieces = np.array(packed(np.array([len(x) for x in held], np.int64), length), np.int64).reshape(-1, 5)
            crc = [zlib.crc32(held[d][s : s + n].astype("<u4").tobytes()) for d, s, n in pieces[:, :3].tolist()]
            which = pieces[:, 0]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(ids, kind).take(pa.array(which)), pa.array(pieces[:, 1]), pa.array(pieces[:, 2]), pa.array(crc, pa.int64()), pa.array(np.array([len(x) for x in held], np.int64)[which]), pa.array(base + done + pieces[:, 3]), pa.array(pieces[:, 4])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            done += int(pieces[:, 3].max()) + 1
            ids, held, size = [], [], 0
            return batch

        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = encoder.ids(text.as_py())
                if held and size + len(got) > UNIT_TOKENS:
                    yield flush()
                ids.append(i)
                held.append(got)
                size += len(got)
        if held:
            yield flush()

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
