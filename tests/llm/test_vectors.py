import math

import numpy as np
import pytest

from gridloom.llm import ann, entry, topk
from gridloom.llm import vector_tiles as tiles
from tests.compare import same
from tests.llm.common import run

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(vectors, queries, k, score):
    out = {}
    for q, qv in queries:  # each row is a query of its own
        s = sorted(((-score(qv, cv), c) for c, cv in vectors if c != q and len(cv) == len(qv)))[:k]
        out.setdefault(q, []).extend((r + 1, c, -v) for r, (v, c) in enumerate(s))
    return {q: sorted(v) for q, v in out.items() if v}


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def sample(seed=0, n=400, dim=9):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n, dim)).astype(np.float32)
    a[10:200] = a[10]  # a large group of copies, and so of ties
    return [(i, [float(x) for x in v]) for i, v in enumerate(a)]


ODD = [(1000, None), (1001, [1.0, None] + [0.0] * 7), (1002, [float("nan")] * 9), (1003, [float("inf")] + [0.0] * 8), (1004, []), (1005, [1.0, 2.0]), (1006, [3.0, 4.0]), (None, [1.0] * 9), (1050, [0.5] * 9), (1050, [0.5] * 9)]


def test_exact_topk(spark):
    rows = sample() + ODD
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    q = df.where("vec_id % 50 = 0")
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b, strict=True))
    assert got(topk.exact_topk(q, df, 5)) == brute(good, [(i, v) for i, v in good if i % 50 == 0], 5, score)


def test_nearest(spark):
    rows = sample(1) + ODD + [(1100, [0.0] * 9)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]

    def score(a, b):
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += x * y
        return total

    assert got(ann.nearest(df.where("vec_id % 20 = 0"), df, 20)) == brute(good, [(i, v) for i, v in good if i % 20 == 0], 20, score)


@pytest.mark.parametrize("name", ["topk", "ann"])
def test_each_row_of_a_repeated_id_is_a_query(name, spark, duck):
    rows = [(1, [1.0, 2.0]), (2, [2.0, -1.0]), (3, [0.5, 0.5]), (100, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0])]
    bad = [(100, []), (100, None), (100, [None, 1.0]), (100, [float("nan"), 0.0]), (100, [float("-inf"), 0.0])]
    bad += [(100, [0.0, 0.0])] if name == "ann" else []
    find, k = (topk.exact_topk, 5) if name == "topk" else (ann.nearest, 20)
    want = got(find(spark.createDataFrame([(i, v) for i, v in rows if i == 100], "vec_id long, embedding array<float>"), spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>"), k))
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    assert got(find(df.where("vec_id % 100 = 0"), df, k)) == want and len(want[100]) == 9
    one = {"topk": [(1, 1, 65536 * 2), (2, 3, 32768), (3, 2, -65536)], "ann": [(1, 1, 2.0), (2, 3, 0.5), (3, 2, -1.0)]}[name]
    other = {"topk": [(1, 2, 65536 * 2), (2, 1, 65536), (3, 3, 32768)], "ann": [(1, 2, 2.0), (2, 1, 1.0), (3, 3, 0.5)]}[name]
    assert want[100] == sorted(one * 2 + other)


def test_sql_of_repeated_ids(spark, duck, tmp_path):
    import duckdb

    rows = [(i % 70, [float((i * 7) % 11 - 5), float((i * 5) % 13 - 6), float(i % 3)]) for i in range(200)] + [(50, []), (50, None), (40, [0.0] * 3), (0, [None] * 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("op1_exact_topk", "op10_nearest"):
        same(run(name, spark, str(tmp_path)), con, entry.ORACLE_SQL[name])


def test_products_beyond_doubles(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e160, 0.0]), (3, [-1e200, 3.0]), (4, [1e-200, 1e-200]), (5, [1e300, -1e300]), (20, [1e150, 1e100])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    inf = float("inf")
    assert got(ann.nearest(df.where("vec_id = 20"), df, 20)) == {20: [(1, 1, inf), (2, 2, inf), (3, 4, 1e-50), (4, 3, -inf)]}  # 5: inf - inf
    df = spark.createDataFrame([(1, [1e160, 1.0]), (2, [2e160, 5.0]), (20, [1e140, 3.0])], "vec_id long, embedding array<double>")
    assert [x[1] for x in got(ann.nearest(df.where("vec_id = 20"), df, 1))[20]] == [2]


def test_scores_beyond_doubles():
    q = np.array([[2.0**40, 3.0]])
    c = np.array([[2.0**13, 1.0], [2.0**13, 2.0], [2.0**50, 0.0]])
    rows, cols, scores = topk.integer_scores(q, c, np.array([9]), np.array([1, 2, 3]), 3)
    assert cols.tolist() == [2, 1, 0] and scores.tolist() == [(1 << 63) - 1, 2**53 + 6, 2**53 + 3]


@pytest.mark.parametrize("name", ["op1_exact_topk", "op10_nearest"])
def test_query_sql(name, spark, sf_dir, duck):
    same(run(name, spark, sf_dir), duck, entry.ORACLE_SQL[name])


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topk.exact_topk(df, df).collect() == [] and ann.nearest(df, df).collect() == []


def test_copies_that_cannot_win_are_left_out():
    c = np.array([[1.0], [2.0], [1.0], [1.0]])
    assert tiles.spare_copies(c, 2).tolist() == [0, 1, 2]
