"""Operators against numpy, and rules that hold whatever the data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import functions
from gridloom.functions import projection, validity
from gridloom.operators import composite, planning, pyramid, stats


def frame(spark, a, mask=None):
    rows = [(0, 0, y, x, int(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1]) if mask is None or mask[y, x]]
    return spark.createDataFrame(rows, "t int, b int, y int, x int, v int")


@pytest.mark.parametrize("shape", [(5, 7), (4, 6), (1, 1), (3, 2)])
def test_downsample_is_floor_of_mean_with_edges_repeated(spark, shape):
    rng = np.random.default_rng(1)
    a, m = rng.integers(-50, 50, shape), rng.random(shape) < 0.7
    h, w = -(-shape[0] // 2), -(-shape[1] // 2)
    pad = ((0, 2 * h - shape[0]), (0, 2 * w - shape[1]))
    pa, pm = np.pad(a, pad, mode="edge"), np.pad(m, pad, mode="edge")
    want = {}
    for y in range(h):
        for x in range(w):
            v = pa[2 * y : 2 * y + 2, 2 * x : 2 * x + 2][pm[2 * y : 2 * y + 2, 2 * x : 2 * x + 2]]
            if len(v):
                want[y, x] = int(np.floor(v.sum() / len(v)))
    got = {(r.y, r.x): r.v for r in pyramid.downsample(frame(spark, a, m), *shape).collect()}
    assert got == want


def test_sentinel_guard_stops(spark):
    level = pyramid.downsample(frame(spark, np.full((2, 2), 9)), 2, 2)
    with pytest.raises(Exception, match="nodata 9"):
        pyramid.guard_sentinel(level, 9).collect()
    assert pyramid.guard_sentinel(level, 9, has_mask=True).count() == 1


def test_median_of_even_number_is_floored(spark):
    rows = [(0, 0, 0, 0, v) for v in (3, 8, 0)] + [(0, 0, 0, 1, 0)]
    df = spark.createDataFrame(rows, "t int, b int, y int, x int, v int")
    got = {(r.x): (r.v, r.k) for r in composite.median_composite(df, F.col("t")).collect()}
    assert got == {0: (5, 2), 1: (0, 0)}


def test_otsu_on_two_peaks(spark):
    df = spark.createDataFrame([(0,)] * 10 + [(100,)] * 10, "q int")
    assert stats.otsu(stats.histogram(df, "q", 0, 100)).first().threshold == 49


def test_dates_in_names(spark):
    names = {"a_20240131.tif": "2024-01-31", "a-2024-02-30": None, "x202401": None, "2024_05_b": "2024-05-01", "120240131": None, "2024-01_05": None}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r["name"]: str(r.day) if r.day else None for r in planning.dated(df).collect()} == names


def test_utm(spark):
    df = spark.createDataFrame([(3.0, 45.0, 31)], "lon double, lat double, zone int")
    e, n = projection.utm_forward(F.col("lon"), F.col("lat"), F.col("zone"))
    row = df.select(e.alias("e"), n.alias("n")).first()
    assert abs(row.e - 500000) < 1e-6 and abs(row.n - 4982950.40) < 0.05


def test_utm_south_and_back(spark):
    points = [(lon, lat) for lon in (-177.5, -70.2, 0.1, 31.7, 179.9) for lat in (-79.9, -33.4, -0.001, 0.0, 51.5, 83.9)]
    df = spark.createDataFrame(points, "lon double, lat double").withColumn("zone", projection.utm_zone(F.col("lon"))).withColumn("south", F.col("lat") < 0)
    e, n = projection.utm_forward(F.col("lon"), F.col("lat"), F.col("zone"), F.col("south"))
    lon, lat = projection.utm_inverse(F.col("e"), F.col("n"), F.col("zone"), F.col("south"))
    for r in df.withColumns({"e": e, "n": n}).withColumns({"lon2": lon, "lat2": lat}).collect():
        assert abs(r.lon - r.lon2) < 1e-7 and abs(r.lat - r.lat2) < 1e-7 and 0 <= r.n <= 1e7


def test_mercator_and_back(spark):
    df = spark.createDataFrame([(0.0, 0.0), (-180.0, 85.0511287798066), (90.0, -60.0)], "lon double, lat double")
    x, y = projection.mercator_forward(F.col("lon"), F.col("lat"))
    rows = df.select("*", x.alias("x"), y.alias("y")).collect()
    assert np.allclose([(r.x, r.y) for r in rows], [(0.5, 0.5), (0, 0), (0.75, 0.7096077)], atol=1e-6)
    lon, lat = projection.mercator_inverse(F.col("x"), F.col("y"))
    back = spark.createDataFrame([(r.x, r.y, r.lon, r.lat) for r in rows], "x double, y double, lon double, lat double").select("*", lon.alias("a"), lat.alias("b")).collect()
    assert all(abs(r.a - r.lon) < 1e-9 and abs(r.b - r.lat) < 1e-9 for r in back)


def test_otsu_of_very_many_pixels(spark):
    hist = spark.createDataFrame([(b, n) for b, n in [(-10000, 4 * 10**9), (-9990, 10**10), (9000, 6 * 10**9), (9500, 3 * 10**9)]], "bin int, n long")
    r = stats.otsu(hist).first()
    a, n = np.array([-10000, -9990, 9000, 9500], float), np.array([4e9, 1e10, 6e9, 3e9])
    between = [((n[:k].sum() / n.sum()) * (n[k:].sum() / n.sum()) * (np.average(a[:k], weights=n[:k]) - np.average(a[k:], weights=n[k:])) ** 2) for k in (1, 2, 3)]
    whole = np.average((a - np.average(a, weights=n)) ** 2, weights=n)
    assert r.threshold == -9990 and r.total == 23 * 10**9 and abs(r.separability - max(between) / whole) < 1e-6


def test_percentiles_by_ranges(spark):
    rng = np.random.default_rng(2)
    a = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), rng.exponential(size=500) * 1e6])
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(a)], "k int, v double")
    for r in stats.index_percentiles(df, "v", (0.0, 0.02, 0.5, 0.98), ("k",)).collect():
        own = np.sort(a[np.arange(len(a)) % 3 == r.k])
        assert r.v == own[int(np.floor(len(own) * r.share))]
    islands = {tuple(r) for r in stats.value_islands(spark.createDataFrame([(v,) for v in [*range(100), 5000, 5001, 9999, 9999]], "v int")).collect()}
    assert islands == {(0, 0, 99, 100, 100), (1, 5000, 5001, 2, 2), (2, 9999, 9999, 1, 2)}


def test_band_functions(spark):
    df = spark.createDataFrame([(30, 10), (0, 0)], "nir int, red int")
    assert [r.x for r in df.select(functions.band_function("ndvi", {"nir": F.col("nir"), "red": F.col("red")}).alias("x")).collect()] == [0.5, None]
    functions.register_band_function("twice", ("red",), lambda r: 2 * r)
    assert df.select(functions.band_function("twice", {"red": F.col("red")}).alias("x")).first().x == 20
    with pytest.raises(ValueError, match="known already"):
        functions.register_band_function("twice", ("red",), lambda r: r)
    with pytest.raises(ValueError, match="needs nir"):
        functions.band_function("ndvi", {"red": F.col("red")})
    with pytest.raises(KeyError):
        functions.band_function("none", {})


def test_validity_without_a_value(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (0.0, 1), (0.0, None), (float("nan"), 1), (None, 1), (2.0, None)], "v double, m int")
    got = df.select(validity.is_valid(F.col("v"), F.lit(0.0), F.col("m")).alias("a"), validity.is_valid(F.col("v")).alias("b"), validity.is_valid_backscatter(F.col("v"), F.col("m")).alias("c")).collect()
    assert [r.a for r in got] == [True, False, True, False, False, False, True]
    assert [r.b for r in got] == [True, True, True, True, False, False, True] and [r.c for r in got] == [True, False, False, False, False, False, False]
