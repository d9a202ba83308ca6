"""Nearest neighbours by a block matrix join of int8 tiles.

Each vector is rounded to int8 with one scale of its own. A tile's int8 products give every inner product up to
an error that the two rounding errors bound. A pair stays if its upper bound reaches the k-th best lower bound of
its query; only these pairs are computed again from the original doubles, and heaps keep the best of them.
Nothing that could be among the k best is lost, so recall is 1 in exact arithmetic. A product beyond the doubles
is infinite, and ranks so.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame

from gridloom.llm import vector_tiles as tiles

PAIRS_AT_ONCE = 1 << 16
#: int8 products are summed as float32, which is exact below 2**24: so many dimensions at a time.
EXACT_DIMS = (1 << 24) // (127 * 127)
#: Products below this one have finite bounds.
OVERFLOW = 1e300


def rounded(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scales, the norms of the rounded vectors and of the rounding errors."""
    scale = np.abs(m).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    exact = m / scale[:, None]  # of small numbers, whatever the vector's size
    codes = np.rint(exact).astype(np.int8)
    norm = lambda x: scale * np.sqrt((x**2).sum(axis=1))
    return codes, scale, norm(codes.astype(np.float64)), norm(exact - codes)


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, d : d + EXACT_DIMS].astype(np.float32) @ b[:, d : d + EXACT_DIMS].astype(np.float32).T
    return out


def products(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed from the first component to the last."""
    out = np.zeros(len(rows))
    for i in range(0, len(rows), PAIRS_AT_ONCE):
        a, b = q[rows[i : i + PAIRS_AT_ONCE]], c[cols[i : i + PAIRS_AT_ONCE]]
        total = a[:, 0] * b[:, 0]
        for d in range(1, q.shape[1]):
            total += a[:, d] * b[:, d]
        out[i : i + PAIRS_AT_ONCE] = total
    return out


def survivors(q: np.ndarray, c: np.ndarray, use: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in use whose upper bound reaches the k-th best lower bound of their query.

    Where a product of the two sides could overflow, there is no bound and every pair survives.
    """
    if float(np.abs(q).max()) * float(np.abs(c).max()) > OVERFLOW / q.shape[1]:
        return np.nonzero(use)
    (qc, qs, qn, qe), (cc, cs, cn, ce) = rounded(q), rounded(c)
    near = int8_product(qc, cc)
    near *= qs[:, None]
    near *= cs
    error = np.outer(qe, cn + ce) + np.outer(qn, ce)
    error += 1e-12 * np.outer(qn + qe, cn + ce) + 1e-310  # rounding of the doubles themselves
    low = np.where(use, near - error, -np.inf)
    n = min(k, c.shape[0])
    floor = np.partition(low, len(c) - n, axis=1)[:, len(c) - n]
    return np.nonzero(use & (near + error >= floor[:, None]))


def bounded_scores(q: np.ndarray, c: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest inner products of each query with a tile; a product that is not a number (inf - inf) takes no part."""
    picked = tiles.spare_copies(c, k + tiles.most_of_an_id(c_ids))
    some, ids = c[picked], c_ids[picked]
    use = np.ones((len(q), len(some)), bool)
    use[tiles.own(q_ids, ids)] = False
    with np.errstate(over="ignore", invalid="ignore"):
        rows, cols = survivors(q, some, use, k)
        scores = products(q, some, rows, cols)
    real = ~np.isnan(scores)
    rows, cols, scores = rows[real], cols[real], scores[real]
    heaps: dict[int, list] = {}
    for row, col, s in zip(rows.tolist(), cols.tolist(), scores.tolist(), strict=True):
        heap = heaps.setdefault(row, [])
        if len(heap) < k:
            heapq.heappush(heap, (s, -col))
        elif (s, -col) > heap[0]:
            heapq.heapreplace(heap, (s, -col))
    kept = [(row, -col, s) for row, heap in heaps.items() for s, col in heap]
    if not kept:
        return np.array([], np.int64), np.array([], np.int64), np.array([], np.float64)
    rows, cols, scores = (np.array(x) for x in zip(*kept, strict=True))
    return rows.astype(np.int64), picked[cols.astype(np.int64)], scores.astype(np.float64)


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """The k candidates of largest inner product for each query, every candidate but the query's own id.

    queries and candidates: two columns, an id and an array of numbers. Zero vectors take no part; see
    vector_tiles for nulls, repeated rows and empty tables. More columns are not looked at.
    """
    return tiles.search(queries, candidates, k, bounded_scores, "double", drop_zero=True)
