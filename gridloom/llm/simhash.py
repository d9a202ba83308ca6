"""Near duplicates by SimHash fingerprints, pivot distance tables and connected components.

Two rules. Narrow: 64-bit fingerprints link at MAX_DISTANCE or fewer differing bits; candidates share three of six parts
of their bits, which loses none. Wide, for a similarity of shingle sets: fingerprints of WIDE_BITS bits link at the
number of differing bits that this similarity has, and three standard deviations more; candidates share one of the
KEYS smallest hashes of their shingles, which two texts of similarity s both have in all but about (1 - s) ** KEYS of
cases. Pivot distance tables discard candidates, and the fingerprints verify what is left.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, hash_pair, partitions, weighted_join
from gridloom.llm.components import components

SEED = 42
MAX_DISTANCE = 3
#: The 64 bits in six parts; of two fingerprints at 3 or fewer differing bits, three parts at least are equal.
PARTS = (11, 11, 11, 11, 10, 10)
#: Fingerprints in a block; a bucket of more is cut into blocks, and a tile pairs two of them.
BLOCK = 1024
PIVOTS = 24
#: Bits of a fingerprint of the wide rule, and smallest shingle hashes by which its candidates meet.
WIDE_BITS, KEYS = 512, 8


def pivots(words: int = 1) -> np.ndarray:
    """Reference fingerprints of so many 64-bit words, the same everywhere."""
    return np.random.default_rng(7).integers(0, 1 << 64, (PIVOTS, words), dtype=np.uint64)


def bit_limit(similarity: float, bits: int = WIDE_BITS) -> int:
    """Differing bits of two fingerprints whose shingle sets are of this (Jaccard) similarity: the mean and three standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + 3 * math.sqrt(bits * share * (1 - share)))


def masks() -> list[int]:
    """For each choice of three parts, the mask of their bits, as signed longs."""
    ends = list(itertools.accumulate(PARTS))
    parts = [((1 << n) - 1) << (e - n) for n, e in zip(PARTS, ends, strict=True)]
    return [m - (1 << 64) if m >> 63 else m for m in (a | b | c for a, b, c in itertools.combinations(parts, 3))]


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a whole text, in runs; fewer words: of the whole sequence; none if it has no word (or is null)."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    n = max(1, len(tokens) - words + 1) if tokens else 0
    for at in range(0, n, 1 << 16):  # a very long text never has all its shingles at once
        some = tokens[at : at + (1 << 16) + words - 1] if len(tokens) > words else tokens
        runs = zip(*(some[i:] for i in range(words)), strict=False) if len(some) >= words else [some]
        yield np.array([xxh64_intdigest(x, SEED) for x in map(b" ".join, runs)], np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each bit is set in hashes."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 128 * 128  # sums of 128 rows fit a byte
    return bits[:whole].reshape(-1, 128, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the word shingles of a whole text; 0 if it has no word (or is null)."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        counts += bit_counts(h)
        n += len(h)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist())


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of hashes, by the finaliser of a 64-bit generator."""
    x = h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def wide_fingerprint(text: str | None, words: int = 5) -> tuple[bytes, list[int]]:
    """SimHash of WIDE_BITS bits, and the KEYS smallest different hashes of shingles (0 alone if there is no word)."""
    counts, n = np.zeros((WIDE_BITS // 64, 64), np.int64), 0
    least = np.array([], np.uint64)
    for h in shingle_hashes(text, words):
        for k in range(len(counts)):
            counts[k] += bit_counts(mixed(h, k))
        n += len(h)
        least = np.unique(np.concatenate([least, h]))[:KEYS]
    return np.packbits(counts.ravel() * 2 > n, bitorder="little").tobytes(), least.view(np.int64).tolist() or [0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id as it is, fp long (the fingerprint's 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """doc_id as it is, fp binary, keys array of long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [wide_fingerprint(x.as_py(), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.list_(pa.int64()))], ["doc_id", "fp", "keys"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp binary, keys array<long>")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def close_pairs(left: np.ndarray, right: np.ndarray, limit: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs of fingerprints (rows of uint64 words, or single ones) at limit or fewer differing bits.

    A pivot table holds each fingerprint's distances to the pivots. Pairs that differ by more than limit in
    any coordinate are discarded; the fingerprints themselves verify those that are left.
    """
    left, right = left.reshape(len(left), -1), right.reshape(len(right), -1)
    refs = pivots(left.shape[1])
    a, b = (apart(x[:, None], refs) for x in (left, right))
    rows, cols = np.nonzero(np.abs(a[:, :1] - b[:, 0]) <= limit)
    for p in range(1, PIVOTS):
        if len(rows) < 4096:
            stay = (np.abs(a[rows] - b[cols]) <= limit).all(axis=1)
            rows, cols = rows[stay], cols[stay]
            break
        stay = np.abs(a[rows, p] - b[cols, p]) <= limit
        if stay.mean() > 0.9 and p >= 4:  # the group is dense; more coordinates would discard next to nothing
            break
        rows, cols = rows[stay], cols[stay]
    stay = apart(left[rows], right[cols]) <= limit
    return rows[stay], cols[stay]


def forest(n: int, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all that the given pairs join, fewer than n of them: each node with its group's root."""
    root = np.arange(n)
    while len(rows):
        low = np.minimum(root[rows], root[cols])
        before = root.copy()
        np.minimum.at(root, root[rows], low)
        np.minimum.at(root, root[cols], low)
        np.minimum.at(root, rows, low)
        np.minimum.at(root, cols, low)
        root = root[root]
        if (root == before).all():
            break
    other = np.flatnonzero(root != np.arange(n))
    return list(zip(other.tolist(), root[other].tolist(), strict=True))


def tile_links(fps: np.ndarray, blocks: np.ndarray, limit: int = MAX_DISTANCE) -> list[tuple[int, int]]:
    """Links within one tile, as indices: the fingerprints (rows of words) of one block, or of two. Linear in their number."""
    if len(fps) < 2:
        return []
    names = np.unique(blocks)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    sides = [np.flatnonzero(blocks == x) for x in names]
    one, two = sides[0], sides[-1]
    for i in range(0, len(one), 256):
        r, c = close_pairs(fps[one[i : i + 256]], fps[two], limit)
        out.append((one[i + r], two[c]))
    rows, cols = (np.concatenate(x) for x in zip(*out, strict=True))
    stay = rows != cols
    return forest(len(fps), rows[stay], cols[stay])


def parts_of(nodes: DataFrame) -> DataFrame:
    """c, v, fp of the narrow rule: a key for each choice of three parts of a fingerprint (fp long)."""
    return nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks()])).alias("c", "v"))


def links(keyed: DataFrame, limit: int = MAX_DISTANCE) -> DataFrame:
    """Links (a, b) between fingerprints (fp: long, or binary of whole 64-bit words) that share a key (c int, v long) and differ in limit bits or fewer.

    Enough links to join all that belong together. Keys of one fingerprint are left out after a count; large
    buckets are cut into blocks whose pairs are tiles of bounded size, in tasks of their own. A tile hands on a
    forest of its links, not all pairs.
    """
    kind = dict(keyed.dtypes)["fp"]
    full = keyed.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    rows = keyed.join(full, ["c", "v"]).withColumn("nb", blocks).withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    tiled = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("c", "v", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "fp")
    dealt = tiled.repartition(partitions(keyed.sparkSession), "c", "v", "i", "j").sortWithinPartitions("c", "v", "i", "j")

    def words(column: pa.Array) -> np.ndarray:
        raw = column.to_numpy().astype("<i8").tobytes() if kind == "bigint" else b"".join(column.to_pylist())
        return np.frombuffer(raw, "<u8").reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def linked(tiles: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            m, fps = (np.concatenate(x) for x in zip(*tiles, strict=True))
            ends = [0, *(np.flatnonzero((m[1:, :4] != m[:-1, :4]).any(axis=1)) + 1).tolist(), len(m)]
            pairs = [(a + x, a + y) for a, b in zip(ends, ends[1:], strict=False) if b - a > 1 for x, y in tile_links(fps[a:b], m[a:b, 4], limit)]
            at = np.array(pairs, np.int64).reshape(-1, 2)
            side = lambda k: pa.array(fps[at[:, k], 0].astype(np.int64)) if kind == "bigint" else pa.array([fps[i].tobytes() for i in at[:, k]], pa.binary())
            return pa.RecordBatch.from_arrays([side(0), side(1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], axis=1)
            fps = words(batch.column(5))
            same = (m[:, :4] == m[-1, :4]).all(axis=1)
            end = len(m) - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last tile begins
            if end or (held and (held[-1][0][-1, :4] != m[0, :4]).any()):
                done, held = [*held, (m[:end], fps[:end])], [(m[end:], fps[end:])]
                yield linked(done)
            else:
                held.append((m, fps))
        if held:
            yield linked(held)

    return dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint (hex digits), component_id: the smallest doc_id of all documents linked to it, itself included.

    Without a similarity the narrow rule holds, with one the wide rule. Null and empty texts have fingerprint zero
    and are linked with each other like any others. Copies share a fingerprint and are one node, however many. A
    null doc_id keeps its row; it is never a component_id unless no document of the component has another.
    Repeated rows stay repeated. More columns are not looked at.
    """
    if similarity is None:
        prints = cut(fingerprints(docs, id_col, text_col, words))
    else:
        prints = cut(wide_fingerprints(docs, id_col, text_col, words))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    if similarity is None:
        found = links(parts_of(nodes.select("fp")))
    else:
        found = links(prints.select("fp", F.lit(0).alias("c"), F.explode("keys").alias("v")).distinct(), bit_limit(similarity))
    roots = components(found).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = cut(named.join(least, "root").select(*hash_pair("f", "fp"), "n", "component_id"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0") if similarity is None else F.lower(F.hex("fp"))
    rows = weighted_join(prints.select("doc_id", "fp", *hash_pair("f", "fp")), table, ["f1", "f2"], "n", ["component_id"], "inner")
    return rows.select("doc_id", digits.alias("fingerprint"), "component_id")
