"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from gridloom.llm import vector_tiles as tiles

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def quantised(matrix: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component, kept as a double that holds an integer."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(matrix * 256.0), -1.7e308, 1.7e308)


def integer_scores(q: np.ndarray, c: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest integer inner products of each query with a tile, ties to the smaller id.

    A tile product in doubles is exact while every partial sum is under 2**53; the bound is checked for each
    tile. Beyond it the products are taken in Python's integers, and a score outside a long is set to its end.
    """
    picked = tiles.spare_copies(c, k + tiles.most_of_an_id(c_ids))
    some, ids = c[picked], c_ids[picked]
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(some).max(initial=0)) * q.shape[1]
    if bound < 2**40:
        s = q @ some.T
        s *= tiles.TILE_COLS
        s += np.arange(tiles.TILE_COLS - 1, tiles.TILE_COLS - 1 - len(ids), -1)  # ties: the smaller column is higher
        r, w = tiles.own(q_ids, ids)
        s[r, w] = -np.inf
        n = min(k, len(ids))
        at = np.argpartition(s, len(ids) - n, axis=1)[:, len(ids) - n :] if n < len(ids) else np.tile(np.arange(len(ids)), (len(q), 1))
        rows, cols = np.repeat(np.arange(len(q)), n), at.ravel()
        value = s[rows, cols]
        real = np.isfinite(value)
        rows, cols, value = rows[real], cols[real], value[real]
        scores = np.floor_divide(value, tiles.TILE_COLS).astype(np.int64)
    else:
        if bound < 2**53:
            exact = (q @ some.T).astype(np.int64)
        else:
            whole = [[int(x) for x in v] for v in some]
            exact = np.array([[min(max(sum(a * b for a, b in zip(x, y, strict=True)), LONG_MIN + 1), LONG_MAX) for y in whole] for x in ([int(v) for v in row] for row in q)], np.int64).reshape(len(q), len(some))
        r, w = tiles.own(q_ids, ids)
        use = np.ones(exact.shape, bool)
        use[r, w] = False
        rows, cols = np.nonzero(use)
        rows, cols, scores = tiles.best(rows, cols, exact[rows, cols], k)
    return rows, picked[cols], scores


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """The k candidates of highest integer inner product for each query, every candidate but the query's own id.

    queries and candidates: two columns, an id and an array of numbers. Components become floor(256 x).
    See vector_tiles for nulls, repeated rows and empty tables. More columns are not looked at.
    """
    return tiles.search(queries, candidates, k, integer_scores, "long", convert=quantised)
