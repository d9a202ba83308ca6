import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from gridloom.operators import attribution, colour, rules, sampling


def brute(masks, lack):
    taken = []
    while True:
        fit = [i for i in sorted(masks) if i not in taken and masks[i].any() and (lack[masks[i]] >= 1).mean() >= 0.999 and ((lack - masks[i])[masks[i]] < 0).mean() <= 0.0005]
        if not fit:
            return taken
        best = max(fit, key=lambda i: (masks[i].sum(), -i))
        taken.append(best)
        lack = lack - masks[best]


@pytest.mark.parametrize("left_out", [(), (2,), (0, 3), (1, 2, 4)])
def test_explaining_scenes(spark, left_out):
    rng = np.random.default_rng(5)
    masks = {i: rng.random((12, 12)) < (0.3 + 0.1 * i) for i in range(5)}
    lack = sum((masks[i].astype(int) for i in left_out), np.zeros((12, 12), int))
    rows = [(int(y), int(x), i) for i, m in masks.items() for y, x in zip(*np.nonzero(m))]
    a = spark.createDataFrame(rows, "y int, x int, scene int")
    b = spark.createDataFrame([(y, x, int(lack[y, x])) for y in range(12) for x in range(12)], "y int, x int, missing int")
    got = attribution.explaining_scenes(a, b, ["y", "x"])
    assert got == brute(masks, lack) and set(got) >= set(left_out)


def test_cell_ratios(spark):
    a = np.arange(64).reshape(8, 8) % 7
    df = spark.createDataFrame([(3, 0, y, x, int(a[y, x])) for y in range(8) for x in range(8)], "t int, b int, y int, x int, v int")
    r = sampling.cell_ratios(df).collect()[0]
    assert (r.t, r.raw, r.packed) == (3, 128, len(zstandard.ZstdCompressor(level=5).compress(a.astype("<u2").tobytes())))


@pytest.mark.parametrize("pattern", ["%Y", "%Y%j%m", "%Y%q", "%Y%m%Y", "%j"])
def test_patterns_refused(spark, pattern):
    with pytest.raises(ValueError, match="pattern"):
        rules.time_by_pattern(F.col("name"), pattern)


def test_patterns(spark):
    names = [("20240301",), ("120240301",), ("20240230",), ("x",), (None,), ("2024-03 100%",)]
    df = spark.createDataFrame(names, "name string")
    at = lambda p: [None if r[0] is None else str(r[0]) for r in df.select(rules.time_by_pattern(F.col("name"), p)).collect()]
    assert at("%Y%m%d") == ["2024-03-01 00:00:00", None, None, None, None, None]
    assert at("%Y-%m 100%%")[-1] == "2024-03-01 00:00:00"


def test_stretch_needs_thirty_tones(spark):
    df = spark.createDataFrame([(0, float(i), 1.0, float("nan")) for i in range(5)] + [(1, 0.0, 0.0, 0.0)], "t int, red double, green double, blue double")
    assert [tuple(r) for r in colour.stretch_low(df, ["t"]).collect()] == [(0, 10, 0.0)]
