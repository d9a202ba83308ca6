"""Tiled products of a stated set of query vectors and all candidate vectors.

Both sides are packed into blocks of about a megabyte. Blocks, not rows, are dealt to the cells of a grid
(query group x candidate group), so neither a common id nor a common vector can fill one cell. The group
counts follow from counted bytes: a cell holds about GROUP_BYTES of each side, whatever the tables' size.
Each cell returns the k best of its candidates for each of its queries; window group limits merge these
lists in a tree.

Rows whose id or vector is null, whose vector is empty or holds a null or a non-finite component take no
part, before anything else is decided by them. Vectors of another length than the query's are not compared
with it. Each row of the queries is a query of its own, also where an id occurs several times: it gets k rows,
ranked from 1. Rows alike in id and vector are searched once and their results repeated. Candidates that occur
several times each count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import partitions

BLOCK_BYTES = 1 << 20
GROUP_BYTES = 24 << 20
TILE_ROWS, TILE_COLS = 512, 4096

#: (queries, candidates, ids of the queries, ids of the candidates, k) -> rows (query index, candidate index, score)
Scorer = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]

_BLOCKS = "dim int, g int, ids binary, vecs binary, marks binary"


def takes_part(drop_zero: bool) -> Column:
    """Whether a row (id, vec) is searched or found: nothing null, not empty, all finite, and not zero if so wanted."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    good = F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", number)
    return good & F.exists("vec", lambda x: x != 0) if drop_zero else good


def usable(batch: pa.RecordBatch, drop_zero: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, matrix of float64, marks) for each vector length in a batch of (id, vec, marks...); rows that take no part are left out."""
    ids, vec = batch.column(0), batch.column(1)
    keep = ids.is_valid().to_numpy(zero_copy_only=False) & vec.is_valid().to_numpy(zero_copy_only=False)
    flat, lengths = vec.flatten(), np.nan_to_num(vec.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    values[~flat.is_valid().to_numpy(zero_copy_only=False)] = np.nan
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    numbers = np.where(keep, np.nan_to_num(ids.to_numpy(zero_copy_only=False)).astype(np.int64) if ids.null_count else ids.to_numpy(zero_copy_only=False), 0)
    marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2, batch.num_columns)], axis=1) if batch.num_columns > 2 else np.zeros((batch.num_rows, 0), np.int64)
    for dim in np.unique(lengths[keep & (lengths > 0)]):
        rows = np.flatnonzero(keep & (lengths == dim))
        matrix = values[starts[rows, None] + np.arange(dim)]
        good = np.isfinite(matrix).all(axis=1)
        if drop_zero:
            good &= (matrix != 0).any(axis=1)
        if good.any():
            yield numbers[rows][good].astype(np.int64), matrix[good], marks[rows][good]


def packed(df: DataFrame, groups: int, convert: Callable[[np.ndarray], np.ndarray], drop_zero: bool) -> DataFrame:
    """Blocks of the vectors of df (id, vec, and longs that mark a row), dealt to groups by the place where they were made."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = (TaskContext.get().partitionId() if TaskContext.get() else 0) * 7919
        made, held = 0, {}

        def block(dim: int, full: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids, vecs, marks = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            step = max(1, BLOCK_BYTES // (8 * dim))
            end = len(ids) // step * step if full else len(ids)
            for i in range(0, end, step):
                yield pa.RecordBatch.from_pydict(
                    {"dim": [dim], "g": [(place + made) % groups], "ids": [ids[i : i + step].tobytes()], "vecs": [np.ascontiguousarray(vecs[i : i + step]).tobytes()], "marks": [np.ascontiguousarray(marks[i : i + step]).tobytes()]},
                    schema=pa.schema([("dim", pa.int32()), ("g", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary()), ("marks", pa.binary())]),
                )
                made += 1
            if end < len(ids):
                held[dim] = [(ids[end:], vecs[end:], marks[end:])]

        for batch in batches:
            for ids, matrix, marks in usable(batch, drop_zero):
                dim = matrix.shape[1]
                held.setdefault(dim, []).append((ids, convert(matrix), marks))
                if sum(len(x) for x, *_ in held[dim]) * dim * 8 >= BLOCK_BYTES:
                    yield from block(dim, True)
        for dim in list(held):
            yield from block(dim, False)

    return df.mapInArrow(pack, _BLOCKS)


def opened(blocks: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, matrix and marks of a group's blocks, in order of the ids."""
    ids = np.frombuffer(b"".join(blocks.column("ids").to_pylist()), np.int64)
    vecs = np.frombuffer(b"".join(blocks.column("vecs").to_pylist()), np.float64).reshape(-1, dim)
    marks = np.frombuffer(b"".join(blocks.column("marks").to_pylist()), np.int64).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], vecs[order], marks[order]


def search(queries: DataFrame, candidates: DataFrame, k: int, score: Scorer, score_type: str, convert: Callable[[np.ndarray], np.ndarray] = lambda m: m, drop_zero: bool = False) -> DataFrame:
    """The k best candidates of each query (both: id, vec), best first, ties to the smaller id.

    Returns query_id long, rank int, vec_id long, score. Empty sides give an empty result.
    """
    spark = candidates.sparkSession
    queries = queries.select(F.col(queries.columns[0]).cast("long").alias("id"), F.col(queries.columns[1]).alias("vec"))
    candidates = candidates.select(F.col(candidates.columns[0]).cast("long").alias("id"), F.col(candidates.columns[1]).alias("vec"))
    size = F.sum(F.greatest(F.size("vec"), F.lit(0)).cast("long") * 8).alias("n")
    q_bytes, c_bytes = (df.agg(size).first()["n"] or 0 for df in (queries, candidates))
    q_groups = max(1, math.ceil(q_bytes / GROUP_BYTES))
    c_groups = max(math.ceil(c_bytes / GROUP_BYTES), min(math.ceil(c_bytes / BLOCK_BYTES), math.ceil(partitions(spark) / q_groups)), 1)
    exact = F.transform("vec", lambda x: x.cast("double"))
    # a query is its id and vector: two hashes mark the vector among those of one id
    one = queries.where(takes_part(drop_zero)).select("id", exact.alias("vec")).groupBy("id", "vec").agg(F.count("*").alias("copies"))
    one = one.select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"), "copies")
    q = packed(one, q_groups, convert, drop_zero).withColumnRenamed("g", "qg").withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(c_groups - 1))))
    c = packed(candidates, c_groups, convert, drop_zero).withColumnRenamed("g", "cg").withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1))))
    kind = np.int64 if score_type == "long" else np.float64
    empty = [np.array([], t) for t in (np.int64, np.int64, np.int64, np.int64, np.int32, np.int64, kind)]

    def cell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            dim = key[0].as_py()
            (qi, qv, marks), (ci, cv, _) = opened(left, dim), opened(right, dim)
            for i in range(0, len(qi), TILE_ROWS):
                ids, rows, mark = qi[i : i + TILE_ROWS], qv[i : i + TILE_ROWS], marks[i : i + TILE_ROWS]
                a, b, s = merged_tiles(ids, rows, ci, cv, k, score)
                out.append((ids[a], *mark[a].T, np.full(len(a), key[2].as_py(), np.int32), ci[b], s.astype(kind)))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else empty
        return pa.table(dict(zip(("query_id", "h1", "h2", "copies", "cg", "vec_id", "score"), cols, strict=True)))

    lists = q.groupBy("dim", "qg", "cg").cogroup(c.groupBy("dim", "qg", "cg")).applyInArrow(cell, f"query_id long, h1 long, h2 long, copies long, cg int, vec_id long, score {score_type}")
    query, order = ("query_id", "h1", "h2"), (F.desc("score"), F.asc("vec_id"))
    if c_groups > 64:
        near = Window.partitionBy(*query, (F.col("cg") / F.lit(math.isqrt(c_groups))).cast("int")).orderBy(*order)
        lists = lists.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(*order))).where(F.col("rank") <= k)
    again = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", again.alias("copy")).drop("copy")


def merged_tiles(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, score: Scorer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partial selection tile by tile, each tile's lists merged into the running ones."""
    rows, cols, scores = (np.array([], np.int64), np.array([], np.int64), None)
    for j in range(0, len(c_ids), TILE_COLS):
        a, b, s = score(q, c[j : j + TILE_COLS], q_ids, c_ids[j : j + TILE_COLS], k)
        rows, cols = np.concatenate([rows, a]), np.concatenate([cols, b + j])
        scores = s if scores is None else np.concatenate([scores, s])
        rows, cols, scores = best(rows, cols, scores, k)
    return rows, cols, scores


def best(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each row, ties to the smaller column (columns are in order of the ids)."""
    order = np.lexsort((cols, -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.array([], np.int64)
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return rows[rank < k], cols[rank < k], scores[rank < k]


def own(q_ids: np.ndarray, c_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) of the same id; c_ids are sorted."""
    lo, hi = np.searchsorted(c_ids, q_ids, "left"), np.searchsorted(c_ids, q_ids, "right")
    n = hi - lo
    rows = np.repeat(np.arange(len(q_ids)), n)
    return rows, np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def most_of_an_id(ids: np.ndarray) -> int:
    """How often the most frequent of the sorted ids occurs: so many copies at most are a query's own."""
    ends = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
    return int(np.diff(ends).max(initial=0))


def spare_copies(c: np.ndarray, keep: int) -> np.ndarray:
    """Indices of c without those copies of a vector that come after its first `keep`: they can't be among the best."""
    raw = np.ascontiguousarray(c).view(np.dtype((np.void, c.shape[1] * c.itemsize))).ravel()
    _, which, counts = np.unique(raw, return_inverse=True, return_counts=True)
    if counts.max(initial=0) <= keep:
        return np.arange(len(c))
    order = np.argsort(which, kind="stable")
    rank = np.empty(len(c), np.int64)
    rank[order] = np.arange(len(c)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.flatnonzero(rank < keep)
