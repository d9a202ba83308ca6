"""Queries over the cube: slices, pyramids, composites, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import validity
from gridloom.operators import composite, pyramid, stats
from gridloom.plans.cube import BANDS, CELL, CUBE, GRID, HEIGHT, STEPS, WIDTH, dense, int_, pixels
from gridloom.plans.registry import query

W1 = "(CASE WHEN y = 19 AND 20 % 2 = 1 THEN 2 ELSE 1 END) * (CASE WHEN x = 14 THEN 2 ELSE 1 END)"
WIDE = "wide AS (SELECT t, y, x, max(CASE WHEN b = 0 THEN v ELSE 0 END) AS v0, max(CASE WHEN b = 1 THEN v ELSE 0 END) AS v1, max(CASE WHEN b = 2 THEN v ELSE 0 END) AS v2 FROM dense GROUP BY t, y, x)"


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands side by side for every pixel and step: t, y, x, v0, v1, v2."""
    d = dense(spark, sf_dir)
    return d.groupBy("t", "y", "x").agg(*[F.max(F.when(F.col("b") == b, F.col("v")).otherwise(0)).alias(f"v{b}") for b in range(BANDS)])


@query(
    "P01_F01_ndvi_series",
    f"""WITH {CUBE}, w AS (SELECT t, y, x, max(CASE WHEN b = 0 THEN v END) AS r, max(CASE WHEN b = 2 THEN v END) AS i FROM px GROUP BY t, y, x),
e AS (SELECT t, CAST(round_even(10000.0 * (i - r) / (i + r), 0) AS BIGINT) AS q FROM w WHERE r IS NOT NULL AND i IS NOT NULL AND i + r > 0)
SELECT t, count(*) AS n, CAST(sum(q) AS BIGINT) AS total, CAST(sum(q) AS DOUBLE) / count(*) AS mean_e4 FROM e GROUP BY t""",
)
def ndvi_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area mean of the vegetation index by step, of pixels that are valid in both bands."""
    g = pixels(spark, sf_dir).where("b <> 1").groupBy("t", "y", "x").agg(F.max(F.when(F.col("b") == 0, F.col("v"))).alias("r"), F.max(F.when(F.col("b") == 2, F.col("v"))).alias("i"))
    e = g.where("r IS NOT NULL AND i IS NOT NULL AND i + r > 0").select("t", F.rint(F.lit(10000.0) * (F.col("i") - F.col("r")) / (F.col("i") + F.col("r"))).cast("long").alias("q"))
    return e.groupBy("t").agg(F.count("*").alias("n"), F.sum("q").alias("total"), (F.sum("q").cast("double") / F.count("*")).alias("mean_e4"))


@query(
    "J02_P01_physical",
    f"""WITH {CUBE} SELECT t, p.b, y, x, CAST(v AS FLOAT) * CAST(scale AS FLOAT) + CAST(o AS FLOAT) AS value
FROM px p JOIN (VALUES (0, 0.0001, 0.0), (1, 0.01, -1.0), (2, 0.5, 0.25)) s(b, scale, o) ON p.b = s.b""",
)
def physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical values in single precision: stored * scale + offset of the band."""
    bands = spark.createDataFrame([(0, 0.0001, 0.0), (1, 0.01, -1.0), (2, 0.5, 0.25)], "b int, scale double, o double")
    f = lambda c: F.col(c).cast("float")
    return pixels(spark, sf_dir).join(F.broadcast(bands), "b").select("t", "b", "y", "x", (f("v") * f("scale") + f("o")).alias("value"))


@query("SC02_read_step", f"WITH {CUBE}, {GRID} SELECT b, y, x, v, valid FROM dense WHERE t = 5")
def read_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir, [5]).select("b", "y", "x", "v", "valid")


@query("SC03_F38_read_cell", f"WITH {CUBE}, {GRID} SELECT b, y - 16 AS dy, x - 8 AS dx, v FROM dense WHERE t = 7 AND y // 8 = 2 AND x // 8 = 1")
def read_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell of one step, cut to the extent at the edges: bounds, not functions of y and x, reach the scan."""
    row, col = 2, 1
    h, w = min(CELL, HEIGHT - row * CELL), min(CELL, WIDTH - col * CELL)
    d = dense(spark, sf_dir, [7]).where(F.col("y").between(row * CELL, row * CELL + h - 1) & F.col("x").between(col * CELL, col * CELL + w - 1))
    return d.select("b", (F.col("y") - row * CELL).alias("dy"), (F.col("x") - col * CELL).alias("dx"), "v")


@query("SC04_read_region", f"WITH {CUBE} SELECT t, b, y, x, v FROM px WHERE t IN (3, 11, 40) AND y BETWEEN 4 AND 9 AND x BETWEEN 2 AND 12")
def read_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir, [3, 11, 40]).where(F.col("y").between(4, 9) & F.col("x").between(2, 12)).select("t", "b", "y", "x", "v")


@query(
    "SC05_per_band_arrays",
    f"WITH {CUBE} SELECT t, b, y, x, v FROM px WHERE b = 0 UNION ALL SELECT t, b, y, x, v FROM px WHERE b = 1 UNION ALL SELECT t, b, y, x, v FROM px WHERE b = 2",
)
def per_band_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays without a band axis, one for each band, as one."""
    parts = [pixels(spark, sf_dir).where(F.col("b") == b).select("t", "y", "x", "v", F.lit(b).alias("b")) for b in range(BANDS)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("t", "b", "y", "x", "v")


@query("SC06_planes", f"WITH {CUBE}, {GRID} SELECT y, x, CAST(bool_or(valid) AS INTEGER) AS mask, CAST(least(sum(n), 255) AS INTEGER) AS coverage FROM dense WHERE t = 9 GROUP BY y, x")
def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dense(spark, sf_dir, [9])
    return d.groupBy("y", "x").agg(F.bool_or("valid").cast("int").alias("mask"), int_(F.least(F.sum("n"), F.lit(255))).alias("coverage"))


@query(
    "SC08_P09_outer_index",
    f"""WITH {CUBE}, {GRID}, ys AS (SELECT * FROM (VALUES (0, 19), (1, 0), (2, 5)) a(i, y)), xs AS (SELECT * FROM (VALUES (0, 14), (1, 10), (2, 6), (3, 2)) a(j, x))
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, t, v FROM dense JOIN ys USING (y) JOIN xs USING (x) WHERE b = 1 AND t BETWEEN 10 AND 20""",
)
def outer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and slices by axis, in the order asked for: y = [-1, 0, 5], x = [14:1:-4]."""
    ys, xs = [v % HEIGHT for v in (-1, 0, 5)], list(range(14, 1, -4))
    place = lambda c, values: F.array_position(F.array(*map(F.lit, values)), F.col(c)).cast("int") - 1
    d = dense(spark, sf_dir, list(range(10, 21))).where(F.col("y").isin(ys) & F.col("x").isin(xs) & (F.col("b") == 1))
    return d.select(place("y", ys).alias("i"), place("x", xs).alias("j"), "t", "v")


@query("SC21_recompose", f"WITH {CUBE}, {GRID} SELECT t, y // 8 AS row, x // 8 AS col, count(*) AS n, CAST(sum(v * (1 + b * 64 + (y % 8) * 8 + x % 8)) AS BIGINT) AS digest FROM dense GROUP BY ALL")
def recompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of one size from pixels of any layout, with a digest of values and places."""
    at = 1 + F.col("b") * 64 + (F.col("y") % CELL) * CELL + F.col("x") % CELL
    return dense(spark, sf_dir).groupBy("t", F.expr("y div 8").cast("int").alias("row"), F.expr("x div 8").cast("int").alias("col")).agg(F.count("*").alias("n"), F.sum(F.col("v") * at).cast("long").alias("digest"))


@query("SC26_P03_joint_validity", f"WITH {CUBE}, {GRID} SELECT t, y, x, bool_and(v <> 0) AS valid FROM dense GROUP BY t, y, x")
def joint_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir).groupBy("t", "y", "x").agg(F.bool_and(F.col("v") != 0).alias("valid"))


@query("SC27_flip", f"WITH {CUBE} SELECT t, b, 19 - y AS y, x, v FROM px")
def flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("t", "b", (HEIGHT - 1 - F.col("y")).alias("y"), "x", "v")


@query(
    "SC32_W12_star_delta",
    f"""WITH {CUBE}, {GRID}, a AS (SELECT *, least(6 * ((t + 2) // 6), 78) AS ref FROM dense),
r AS (SELECT a.t, a.b, a.y, a.x, a.ref, CASE WHEN a.t = a.ref THEN a.v ELSE ((a.v - d.v) % 65536 + 65536) % 65536 END AS stored FROM a JOIN dense d ON d.t = a.ref AND d.b = a.b AND d.y = a.y AND d.x = a.x)
SELECT t, CAST(sum(stored) AS BIGINT) AS stored, CAST(sum(v) AS BIGINT) AS decoded FROM r JOIN dense USING (t, b, y, x) GROUP BY t""",
)
def star_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals to the anchor frame modulo 65536, and what they decode to: anchors come from a window by pixel, not a join."""
    by = Window.partitionBy("b", "y", "x", "ref")
    a = dense(spark, sf_dir).withColumn("ref", composite.comparison_step(F.col("t"), STEPS)).withColumn("anchor", F.max(F.when(F.col("t") == F.col("ref"), F.col("v"))).over(by))
    stored = F.when(F.col("t") == F.col("ref"), F.col("v")).otherwise(F.pmod(F.col("v") - F.col("anchor"), F.lit(65536)))
    s = a.withColumn("stored", stored)
    decoded = F.when(F.col("t") == F.col("ref"), F.col("stored")).otherwise(F.pmod(F.col("stored") + F.col("anchor"), F.lit(65536)))
    return s.groupBy("t").agg(F.sum("stored").cast("long").alias("stored"), F.sum(decoded).cast("long").alias("decoded"))


@query("J01_masked", f"WITH {CUBE}, {GRID} SELECT d.t, d.b, d.y, d.x, CASE WHEN m.ok THEN d.v END AS v FROM dense d JOIN (SELECT t, y, x, bool_and(valid) AS ok FROM dense GROUP BY t, y, x) m USING (t, y, x)")
def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values under the mask that all bands of a pixel share."""
    d = dense(spark, sf_dir)
    ok = F.bool_and("valid").over(Window.partitionBy("t", "y", "x"))
    return d.select("t", "b", "y", "x", F.when(ok, F.col("v")).alias("v"))


def _level(n: int, source: str, h: int, w: int) -> str:
    weight = f"(CASE WHEN y = {h - 1} AND {h % 2} = 1 THEN 2 ELSE 1 END) * (CASE WHEN x = {w - 1} AND {w % 2} = 1 THEN 2 ELSE 1 END)"
    return f"l{n} AS (SELECT t, b, y // 2 AS y, x // 2 AS x, CAST(floor(sum(v * {weight}) / sum({weight})) AS INTEGER) AS v, CAST(sum({weight}) AS INTEGER) AS w FROM {source} GROUP BY t, b, y // 2, x // 2)"


@query("A01_A05_downsample_int", f"WITH {CUBE}, {_level(1, 'px', 20, 15)} SELECT t, b, y, x, v, w FROM l1")
def downsample_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.downsample(pixels(spark, sf_dir), HEIGHT, WIDTH)


@query("A01_downsample_signed", f"WITH {CUBE}, s AS (SELECT t, b, y, x, v - 100 AS v FROM px), {_level(1, 's', 20, 15)} SELECT t, b, y, x, v, w FROM l1")
def downsample_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.downsample(pixels(spark, sf_dir).withColumn("v", F.col("v") - 100), HEIGHT, WIDTH)


@query("A02_downsample_float", f"WITH {CUBE} SELECT t, b, y // 2 AS y, x // 2 AS x, CAST(CAST(sum(v * {W1}) AS DOUBLE) / sum({W1}) AS FLOAT) AS v, CAST(sum({W1}) AS INTEGER) AS w FROM px GROUP BY t, b, y // 2, x // 2")
def downsample_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.downsample(pixels(spark, sf_dir), HEIGHT, WIDTH, as_float=True)


_PLANES = "pl AS (SELECT t, y, x, CAST(bool_or(valid) AS INTEGER) AS mask, CAST(least(sum(n), 255) AS INTEGER) AS coverage FROM dense GROUP BY t, y, x)"


@query("A03_A04_planes_reduce", f"WITH {CUBE}, {GRID}, {_PLANES} SELECT t, y // 2 AS y, x // 2 AS x, max(mask) AS mask, CAST((sum(coverage * {W1}) + 2) // 4 AS INTEGER) AS coverage FROM pl GROUP BY t, y // 2, x // 2")
def planes_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dense(spark, sf_dir).groupBy("t", "y", "x").agg(F.bool_or("valid").cast("int").alias("mask"), int_(F.least(F.sum("n"), F.lit(255))).alias("coverage"))
    return pyramid.reduce_planes(d, HEIGHT, WIDTH)


@query(
    "A06_J03_pyramid",
    f"WITH {CUBE}, {_level(1, 'px', 20, 15)}, {_level(2, 'l1', 10, 8)}, {_level(3, 'l2', 5, 4)} SELECT 0 AS level, t, b, y, x, v FROM px UNION ALL SELECT 1, t, b, y, x, v FROM l1 UNION ALL SELECT 2, t, b, y, x, v FROM l2 UNION ALL SELECT 3, t, b, y, x, v FROM l3",
)
def full_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.pyramid(pixels(spark, sf_dir), HEIGHT, WIDTH, 3)


@query("A07_sentinel_guard", f"WITH {CUBE}, {_level(1, 'px', 20, 15)} SELECT t, b, y, x, v, w FROM l1")
def sentinel_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level passes: no mean is 65535."""
    return pyramid.guard_sentinel(pyramid.downsample(pixels(spark, sf_dir), HEIGHT, WIDTH), 65535)


@query(
    "A08_J04_volatility",
    f"""WITH {CUBE}, {GRID}, a AS (SELECT *, least(6 * ((t + 2) // 6), 78) AS q FROM dense)
SELECT a.y // 8 AS row, a.x // 8 AS col, CAST(sum(abs(a.v - d.v)) AS BIGINT) AS total, count(*) AS n, CAST(least(1.0, CAST(sum(abs(a.v - d.v)) AS DOUBLE) / count(*) / 10000.0) AS FLOAT) AS volatility
FROM a JOIN dense d ON d.t = a.q AND d.b = a.b AND d.y = a.y AND d.x = a.x WHERE a.t <> a.q GROUP BY a.y // 8, a.x // 8""",
)
def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.volatility(dense(spark, sf_dir), STEPS, CELL)


@query(
    "A10_A11_A12_median",
    f"""WITH {CUBE}, {GRID}, g AS (SELECT t // 12 AS period, b, y, x, list_sort(list(v) FILTER (WHERE v > 0)) AS a FROM dense GROUP BY t // 12, b, y, x),
k AS (SELECT *, CAST(coalesce(len(a), 0) AS INTEGER) AS k FROM g)
SELECT period, b, y, x, CAST(CASE WHEN k > 0 THEN (a[(k - 1) // 2 + 1] + a[k // 2 + 1]) // 2 ELSE 0 END AS INTEGER) AS v, k, CAST(k AS FLOAT) / CAST(12 AS FLOAT) AS coverage FROM k""",
)
def median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly median of monthly scenes, valid scenes and their share."""
    m = composite.median_composite(dense(spark, sf_dir), F.expr("t div 12").cast("int"))
    return m.withColumn("coverage", (F.col("k").cast("float") / F.lit(12).cast("float")).cast("float"))


@query(
    "A13_recover_counts",
    f"""WITH {CUBE}, {GRID}, k AS (SELECT t % 12 AS m, y, x, b, count_if(valid) AS k, count(*) AS n FROM dense GROUP BY ALL), c AS (SELECT DISTINCT m, CAST(CAST(k AS FLOAT) / CAST(n AS FLOAT) AS FLOAT) AS c FROM k),
f AS (SELECT m, CAST(i AS INTEGER) AS n, bool_and(CAST(round_even(CAST(c AS DOUBLE) * i, 0) / i AS FLOAT) = c) AS ok FROM c, range(1, 65) r(i) GROUP BY m, i)
SELECT m, min(n) AS n FROM f WHERE ok GROUP BY m""",
)
def recover_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many observations the shares of a calendar month were taken from: the smallest count that gives all of them."""
    keys = dense(spark, sf_dir).groupBy((F.col("t") % 12).alias("m"), "y", "x", "b").agg(F.count_if("valid").alias("k"), F.count("*").alias("n"))
    return composite.recovered_counts(keys.select("m", (F.col("k").cast("float") / F.col("n").cast("float")).cast("float").alias("c")), 64, ("m",))


@query("A15_multilook", f"WITH {CUBE} SELECT t, b, y // 2 AS y, x // 2 AS x, CASE WHEN count(*) = 4 THEN CAST(sum(v) AS DOUBLE) / 4 END AS mean FROM px WHERE x < 14 GROUP BY t, b, y // 2, x // 2")
def multilook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.multilook(pixels(spark, sf_dir), HEIGHT, WIDTH)


@query("A16_block_mean", f"WITH {CUBE} SELECT t, b, y // 4 AS y, x // 4 AS x, CAST(sum(v) AS BIGINT) AS s, count(*) AS k, CAST(sum(v) AS DOUBLE) / count(*) AS mean FROM px WHERE x < 12 GROUP BY t, b, y // 4, x // 4")
def block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.block_mean(pixels(spark, sf_dir), 4, HEIGHT, WIDTH)


NDWI = "ndwi AS (SELECT t, y, x, CAST(round_even(10000.0 * (v1 - v2) / (v1 + v2), 0) AS INTEGER) AS q FROM wide WHERE v1 > 5 AND v2 > 5)"


def ndwi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water index times 10000 of pixels that aren't dark: t, y, x, q."""
    w = wide(spark, sf_dir).where("v1 > 5 AND v2 > 5")
    return w.select("t", "y", "x", int_(F.rint(F.lit(10000.0) * (F.col("v1") - F.col("v2")) / (F.col("v1") + F.col("v2")))).alias("q"))


@query("A17_F07_ndwi_histogram", f"WITH {CUBE}, {GRID}, {WIDE}, {NDWI} SELECT CAST(r.b AS INTEGER) AS bin, count(q) AS n FROM range(-10000, 10001) r(b) LEFT JOIN ndwi ON q = r.b GROUP BY r.b")
def ndwi_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(ndwi(spark, sf_dir), "q", -10000, 10000)


@query(
    "A18_W07_otsu",
    f"""WITH {CUBE}, {GRID}, {WIDE}, {NDWI}, h AS (SELECT CAST(r.b AS BIGINT) AS bin, count(q) AS n FROM range(-10000, 10001) r(b) LEFT JOIN ndwi ON q = r.b GROUP BY r.b),
c AS (SELECT bin, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS w, CAST(sum(n * bin) OVER (ORDER BY bin) AS BIGINT) AS m FROM h), s AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n * bin) AS BIGINT) AS moment, CAST(sum(n * bin * bin) AS BIGINT) AS square FROM h),
v AS (SELECT bin, total, moment, square, CAST(m * total - w * moment AS DOUBLE) * CAST(m * total - w * moment AS DOUBLE) / (CAST(w AS DOUBLE) * CAST(total - w AS DOUBLE)) AS g FROM c, s WHERE w > 0 AND w < total)
SELECT CAST((min(bin) + max(bin)) // 2 AS INTEGER) AS threshold, max(total) AS total,
  round(max(g) / (CAST(max(square) AS DOUBLE) * CAST(max(total) AS DOUBLE) - CAST(max(moment) AS DOUBLE) * CAST(max(moment) AS DOUBLE)), 6) AS separability FROM v WHERE g = (SELECT max(g) FROM v)""",
)
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.otsu(stats.histogram(ndwi(spark, sf_dir), "q", -10000, 10000))


@query(
    "A19_water_stats",
    f"""WITH {CUBE}, {GRID}, {WIDE} SELECT t, count_if(v1 > 0 AND v2 > 0) AS valid, count_if(v1 > 0 AND v2 > 0 AND v1 <= 5 AND v2 <= 5) AS dark, count_if(v1 > v2 AND v2 > 0) AS water,
CAST(count_if(v1 > v2 AND v2 > 0) AS DOUBLE) / count(*) AS water_share, count_if(v1 > v2 AND v2 > 0) * 100.0 / 1000000.0 AS km2 FROM wide GROUP BY t""",
)
def water_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = (F.col("v1") > 0) & (F.col("v2") > 0)
    water = (F.col("v1") > F.col("v2")) & (F.col("v2") > 0)
    return wide(spark, sf_dir).groupBy("t").agg(
        F.count_if(seen).alias("valid"), F.count_if(seen & (F.col("v1") <= 5) & (F.col("v2") <= 5)).alias("dark"), F.count_if(water).alias("water"),
        stats.share(water).alias("water_share"), (F.count_if(water) * F.lit(100.0) / F.lit(1000000.0)).alias("km2"),
    )


@query("A20_linear_percentiles", f"WITH {CUBE} SELECT b, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75 FROM px GROUP BY b")
def linear_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return pixels(spark, sf_dir).groupBy("b").agg(p.alias("p")).select("b", *[F.col("p")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))])


@query(
    "A21_W09_stretch",
    f"""WITH {CUBE}, r AS (SELECT b, v, row_number() OVER (PARTITION BY b ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY b) AS n FROM px),
p AS (SELECT b, max(CASE WHEN i = floor(n * 0.02::DOUBLE) THEN v END) AS lo, max(CASE WHEN i = floor(n * 0.98::DOUBLE) THEN v END) AS hi FROM r GROUP BY b)
SELECT b, lo, CASE WHEN hi = lo THEN lo + 1 ELSE hi END AS hi FROM p""",
)
def stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stretch(pixels(spark, sf_dir), "v", ("b",))


@query(
    "A23_F04_dual_ranges",
    f"""WITH {CUBE}, {GRID}, {WIDE}, c AS (SELECT 'co' AS channel, v0 AS v FROM wide WHERE v0 > 0 AND v1 > 0 UNION ALL SELECT 'cross', v1 FROM wide WHERE v0 > 0 AND v1 > 0 UNION ALL SELECT 'ratio', v0 - v1 FROM wide WHERE v0 > 0 AND v1 > 0),
r AS (SELECT channel, v, row_number() OVER (PARTITION BY channel ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY channel) AS n FROM c),
p AS (SELECT channel, max(CASE WHEN i = floor(n * 0.02::DOUBLE) THEN v END) AS lo, max(CASE WHEN i = floor(n * 0.98::DOUBLE) THEN v END) AS hi FROM r GROUP BY channel)
SELECT channel, lo, CASE WHEN hi = lo THEN lo + 1 ELSE hi END AS hi FROM p""",
)
def dual_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir).where("v0 > 0 AND v1 > 0")
    c = w.select(F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), v.alias("v")) for n, v in (("co", F.col("v0")), ("cross", F.col("v1")), ("ratio", F.col("v0") - F.col("v1")))])).alias("s")).select("s.*")
    return stats.stretch(c, "v", ("channel",))


_CODES = "q AS (SELECT CASE WHEN (t + y + x) % 7 = 0 THEN -9999 ELSE v END AS v FROM px)"
_ISLANDS = """c AS (SELECT v, count(*) AS n FROM q GROUP BY v), m AS (SELECT *, v - lag(v) OVER (ORDER BY v) AS gap FROM c), k AS (SELECT *, CASE WHEN gap > (SELECT max(v) - min(v) FROM c) * 0.05 THEN 1 ELSE 0 END AS cut FROM m),
i AS (SELECT *, CAST(sum(cut) OVER (ORDER BY v) AS INTEGER) AS island FROM k), g AS (SELECT island, min(v) AS lo, max(v) AS hi, count(*) AS codes, CAST(sum(n) AS BIGINT) AS n FROM i GROUP BY island)"""


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select(F.when((F.col("t") + F.col("y") + F.col("x")) % 7 == 0, -9999).otherwise(F.col("v")).alias("v"))


@query("W08_value_islands", f"WITH {CUBE}, {_CODES}, {_ISLANDS} SELECT island, lo, hi, codes, n FROM g")
def value_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_islands(_coded(spark, sf_dir))


@query(
    "A24_T04_likely_fills",
    f"""WITH {CUBE}, {_CODES}, {_ISLANDS}, o AS (SELECT lo, hi FROM g ORDER BY codes DESC, n DESC LIMIT 1)
SELECT v, n, CAST(n AS DOUBLE) / (SELECT count(*) FROM q) AS share FROM c WHERE (v < (SELECT lo FROM o) OR v > (SELECT hi FROM o)) AND CAST(n AS DOUBLE) / (SELECT count(*) FROM q) >= 0.001 ORDER BY n DESC, v LIMIT 5""",
)
def likely_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.likely_fills(_coded(spark, sf_dir))


@query("A26_physical_range", f"WITH {CUBE} SELECT p.b, least(min(v) * scale + o, max(v) * scale + o) AS lo, greatest(min(v) * scale + o, max(v) * scale + o) AS hi FROM px p JOIN (VALUES (0, 0.5::DOUBLE, 0.0::DOUBLE), (1, -0.25, 1.0), (2, 2.0, -3.0)) s(b, scale, o) ON p.b = s.b GROUP BY p.b, scale, o")
def physical_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame([(0, 0.5, 0.0), (1, -0.25, 1.0), (2, 2.0, -3.0)], "b int, scale double, offset double")
    return stats.physical_range(pixels(spark, sf_dir), bands)


@query(
    "A31_latest_covered",
    f"""WITH {CUBE}, {GRID}, {_PLANES}, s AS (SELECT t, CAST(count_if(coverage > 0) AS DOUBLE) / count(*) AS share FROM pl GROUP BY t ORDER BY t DESC LIMIT 24)
SELECT t, share FROM s ORDER BY share >= 0.5 DESC, CASE WHEN share >= 0.5 THEN t END DESC NULLS LAST, share DESC, t DESC LIMIT 1""",
)
def latest_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dense(spark, sf_dir).groupBy("t", "y", "x").agg(int_(F.least(F.sum("n"), F.lit(255))).alias("coverage"))
    return stats.latest_covered(d)


@query("A32_A33_A41_quality", f"WITH {CUBE}, {GRID} SELECT t, b, count_if(valid) AS valid, count_if(v = 0) AS zeros, min(CASE WHEN valid THEN v END) AS lo, max(CASE WHEN valid THEN v END) AS hi, CAST(count_if(valid) AS DOUBLE) / count(*) AS share, bool_and(CAST(valid AS INTEGER) IN (0, 1)) AS binary_mask FROM dense GROUP BY t, b")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.when(F.col("valid"), F.col("v"))
    return dense(spark, sf_dir).groupBy("t", "b").agg(
        F.count_if("valid").alias("valid"), F.count_if(F.col("v") == 0).alias("zeros"), F.min(seen).alias("lo"), F.max(seen).alias("hi"), stats.share(F.col("valid")).alias("share"), F.bool_and(F.col("valid").cast("int").isin(0, 1)).alias("binary_mask")
    )


@query(
    "W01_W02_J05_carry_forward",
    f"""WITH {CUBE}, {GRID}, {WIDE}, g AS (SELECT *, last_value(CASE WHEN greatest(v0, v1, v2) > 0 THEN t END IGNORE NULLS) OVER (PARTITION BY y, x ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS src FROM wide)
SELECT g.t, g.y, g.x, coalesce(w.v0, 0) AS v0, coalesce(w.v1, 0) AS v1, coalesce(w.v2, 0) AS v2, greatest(g.v0, g.v1, g.v2) = 0 AND src IS NOT NULL AS filled FROM g LEFT JOIN wide w ON w.t = g.src AND w.y = g.y AND w.x = g.x""",
)
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.carry_forward(wide(spark, sf_dir))


@query(
    "P14_W13_best_window",
    f"""WITH {CUBE}, {GRID}, c AS (SELECT y, x, count_if(valid) AS n FROM dense GROUP BY y, x), w AS (SELECT a.y, a.x, CAST(sum(b.n) AS BIGINT) AS total FROM c a JOIN c b ON b.y BETWEEN a.y AND a.y + 5 AND b.x BETWEEN a.x AND a.x + 5 WHERE a.y <= 14 AND a.x <= 9 GROUP BY a.y, a.x)
SELECT y, x, total FROM w ORDER BY total DESC, y, x LIMIT 1""",
)
def best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = dense(spark, sf_dir).groupBy("y", "x").agg(F.count_if("valid").alias("n"))
    return stats.best_window(counts, 6, HEIGHT, WIDTH)


@query(
    "J17_F02_F03_water_fraction",
    f"""WITH {CUBE}, {GRID}, {WIDE}, f AS (SELECT t, y, x, CASE WHEN v1 + v2 > 0 THEN CAST(v1 > v2 AS INTEGER) END AS w FROM wide)
SELECT a.t, count(b.w) AS n, CAST(coalesce(sum(b.w), 0) AS BIGINT) AS water FROM f a JOIN f b ON a.t = b.t AND b.y BETWEEN 7 AND 9 AND b.x BETWEEN 8 AND 9 WHERE a.y = 8 AND a.x = 8 GROUP BY a.t""",
)
def water_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water among the pixels around (8, 8), cut to its cell's columns: bounds reach the scan, no join is needed."""
    y, x = 8, 8
    w = wide(spark, sf_dir).where(F.col("y").between(y - 1, y + 1) & F.col("x").between(max(x - 1, x // CELL * CELL), x + 1))
    q = F.when(F.col("v1") + F.col("v2") > 0, (F.col("v1") > F.col("v2")).cast("int"))
    return w.groupBy("t").agg(F.count(q).alias("n"), F.coalesce(F.sum(q), F.lit(0)).cast("long").alias("water"))


@query("SK04_all_cells", f"WITH {CUBE}, {GRID} SELECT t, y // 8 AS row, x // 8 AS col, count(*) AS pixels, CAST(sum(v) AS BIGINT) AS total FROM dense GROUP BY ALL")
def all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell is there, also those that hold fill only."""
    return dense(spark, sf_dir).groupBy("t", F.expr("y div 8").cast("int").alias("row"), F.expr("x div 8").cast("int").alias("col")).agg(F.count("*").alias("pixels"), F.sum("v").cast("long").alias("total"))


@query("SK08_A29_object_bytes", f"WITH {CUBE} SELECT t // 12 AS shard, y // 8 AS row, x // 8 AS col, count(*) * 2 AS bytes FROM px GROUP BY ALL")
def object_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy(F.expr("t div 12").cast("int").alias("shard"), F.expr("y div 8").cast("int").alias("row"), F.expr("x div 8").cast("int").alias("col")).agg((F.count("*") * 2).alias("bytes"))


_COPY = "copy AS (SELECT t, b, y, x, CASE WHEN (31 * t + 7 * y + x) % 97 = 0 THEN v + 1 ELSE v END AS v, n FROM px WHERE (13 * t + 5 * y + 3 * x + b) % 89 <> 0 UNION ALL SELECT t, b, y, x, v, n FROM px WHERE t = 4 AND y = 3)"


@query(
    "SK11_U05_verify",
    f"""WITH {CUBE}, {_COPY}, a AS (SELECT * FROM px EXCEPT ALL SELECT * FROM copy), z AS (SELECT * FROM copy EXCEPT ALL SELECT * FROM px)
SELECT coalesce(a.t, z.t) AS t, coalesce(a.lost, 0) AS lost, coalesce(z.added, 0) AS added FROM (SELECT t, count(*) AS lost FROM a GROUP BY t) a FULL JOIN (SELECT t, count(*) AS added FROM z GROUP BY t) z ON a.t = z.t""",
)
def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A migrated copy with changed, lost and doubled pixels against its source, as bags: steps with rows that only one side has; one exchange, both ways."""
    px = pixels(spark, sf_dir)
    kept = px.where((13 * F.col("t") + 5 * F.col("y") + 3 * F.col("x") + F.col("b")) % 89 != 0)
    copy = kept.withColumn("v", F.when((31 * F.col("t") + 7 * F.col("y") + F.col("x")) % 97 == 0, F.col("v") + 1).otherwise(F.col("v"))).unionByName(px.where("t = 4 AND y = 3"))
    both = px.withColumn("side", F.lit(1)).unionByName(copy.withColumn("side", F.lit(-1)))
    g = both.groupBy("t", "b", "y", "x", "v", "n").agg(F.sum("side").alias("d")).where("d <> 0")
    return g.groupBy("t").agg(F.sum(F.greatest("d", F.lit(0))).alias("lost"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("added"))


@query("P02_valid_pixels", f"WITH {CUBE}, {GRID} SELECT t, b, count_if(CASE WHEN t % 2 = 0 THEN n % 2 = 1 ELSE v <> 0 END) AS valid FROM dense GROUP BY t, b")
def valid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with a mask (here odd counts) go by it, the others by the sentinel 0."""
    d = dense(spark, sf_dir)
    mask = F.when(F.col("t") % 2 == 0, F.col("n") % 2)
    return d.groupBy("t", "b").agg(F.count_if(validity.is_valid(F.col("v"), F.lit(0), mask)).alias("valid"))


@query("P04_validity_strategy", f"""WITH {CUBE}, {GRID}, s AS (SELECT t, b, CAST(count_if(NOT valid) AS BIGINT) AS invalid, count_if(valid AND v = 7) AS taken FROM dense GROUP BY t, b)
SELECT t, b, CASE WHEN invalid = 0 THEN 'none' WHEN taken = 0 THEN 'sentinel' ELSE 'mask' END AS strategy, invalid, taken FROM s""")
def validity_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether 7 can mark what is missing at each step and band."""
    return validity.validity_strategy(dense(spark, sf_dir), 7, ("t", "b"))


@query("P07_radar_validity", f"WITH {CUBE}, {GRID} SELECT t, count_if(CAST(v AS DOUBLE) / 10 > 0 AND (CASE WHEN y = 0 THEN 255 WHEN x % 4 = 0 THEN 0 ELSE b + 1 END) NOT IN (0, 255)) AS valid FROM dense GROUP BY t")
def radar_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.when(F.col("y") == 0, 255).when(F.col("x") % 4 == 0, 0).otherwise(F.col("b") + 1)
    return dense(spark, sf_dir).groupBy("t").agg(F.count_if(validity.is_valid_backscatter(F.col("v").cast("double") / 10, mask)).alias("valid"))


@query("SK12_drop_nodata_tag", f"WITH {CUBE} SELECT t, bool_or(v = 7) AS drop_tag FROM px GROUP BY t")
def drop_nodata_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps whose exported raster can't name 7 as its nodata value, as a valid pixel has it."""
    return pixels(spark, sf_dir).groupBy("t").agg(F.bool_or(F.col("v") == 7).alias("drop_tag"))


@query("F05_db_quantise", f"WITH {CUBE} SELECT t, b, y, x, CAST(least(65535, greatest(0, round_even((10 * log10(CAST(v AS DOUBLE)) + 60) / 0.01::DOUBLE, 0))) AS INTEGER) AS q FROM px")
def db_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.rint((F.lit(10) * F.log10(F.col("v").cast("double")) + 60) / F.lit(0.01))
    return pixels(spark, sf_dir).select("t", "b", "y", "x", int_(F.least(F.lit(65535.0), F.greatest(F.lit(0.0), q))).alias("q"))


@query("F08_P06_scene_mask", f"WITH {CUBE} SELECT t, y, x, CAST(least(65535, greatest(1, v - 10)) AS INTEGER) AS v, b FROM px WHERE n IN (1, 2, 4)")
def scene_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the accepted classes (here n), with the offset taken off, cut to 1..65535."""
    return pixels(spark, sf_dir).where(F.col("n").isin(1, 2, 4)).select("t", "b", "y", "x", int_(F.least(F.lit(65535), F.greatest(F.lit(1), F.col("v") - 10))).alias("v"))


@query("F09_integer_divisor", f"WITH {CUBE} SELECT t, b, y, x, CAST(v AS DOUBLE) / 100 AS value FROM px")
def integer_divisor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scale whose inverse is a whole number divides."""
    scale = 0.01
    divisor = round(1 / scale)
    exact = abs(divisor * scale - 1) < 1e-12
    v = F.col("v").cast("double")
    return pixels(spark, sf_dir).select("t", "b", "y", "x", (v / divisor if exact else v * scale).alias("value"))


@query("X02_A30_union_grid", f"""WITH {CUBE}, tiles AS (SELECT t, y // 7 AS tile, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM px GROUP BY t, y // 7)
SELECT t, min(y0) AS y0, min(x0) AS x0, max(y1) - min(y0) + 1 AS h, max(x1) - min(x0) + 1 AS w, CAST((max(y1) - min(y0) + 1) * (max(x1) - min(x0) + 1) - sum((y1 - y0 + 1) * (x1 - x0 + 1)) AS BIGINT) AS uncovered FROM tiles GROUP BY t""")
def union_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid that holds all tiles of a step, and how many of its pixels no tile covers."""
    tiles = pixels(spark, sf_dir).groupBy("t", F.expr("y div 7").alias("tile")).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    h, w = F.max("y1") - F.min("y0") + 1, F.max("x1") - F.min("x0") + 1
    area = F.sum((F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1))
    return tiles.groupBy("t").agg(F.min("y0").alias("y0"), F.min("x0").alias("x0"), h.alias("h"), w.alias("w"), (h * w - area).cast("long").alias("uncovered"))


@query("X01_warp_nearest", f"WITH {CUBE}, {GRID} SELECT t, b, CAST(r AS INTEGER) AS y, CAST(c AS INTEGER) AS x, v, valid FROM dense JOIN range(10) a(r) ON y = CAST(floor((r + 0.5) * 2) AS INTEGER) JOIN range(5) e(c) ON x = CAST(floor((c + 0.5) * 3) AS INTEGER)")
def warp_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest pixel of a coarser grid: the source pixel that holds each target centre; keys are computed, not searched."""
    d = dense(spark, sf_dir).where("y % 2 = 1 AND x % 3 = 1")
    return d.select("t", "b", F.expr("y div 2").cast("int").alias("y"), F.expr("x div 3").cast("int").alias("x"), "v", "valid")


@query("X01_warp_mode", f"""WITH {CUBE}, c AS (SELECT t, b, y // 4 AS y, x // 5 AS x, v, count(*) AS k FROM px GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY t, b, y, x ORDER BY k DESC, v) AS i FROM c)
SELECT t, b, y, x, v FROM r WHERE i = 1""")
def warp_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent valid value below each target pixel, the smallest of equals."""
    c = pixels(spark, sf_dir).groupBy("t", "b", F.expr("y div 4").cast("int").alias("y"), F.expr("x div 5").cast("int").alias("x"), "v").agg(F.count("*").alias("k"))
    return c.groupBy("t", "b", "y", "x").agg(F.max_by("v", F.struct("k", -F.col("v"))).alias("v"))


@query("A42_W03_spacing", f"WITH {CUBE}, d AS (SELECT DISTINCT b, y, t FROM px), g AS (SELECT *, t - lag(t) OVER (PARTITION BY b, y ORDER BY t) AS gap FROM d), c AS (SELECT *, lag(gap) OVER (PARTITION BY b, y ORDER BY t) AS was FROM g) SELECT b, y, min(gap) AS shortest, max(gap) AS longest, count_if(gap <> was) AS changes FROM c GROUP BY b, y")
def spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spacing(pixels(spark, sf_dir), "t", ("b", "y"))


@query("A14_mean_joint", f"WITH {CUBE}, {GRID}, {WIDE} SELECT t // 12 AS period, y, x, count_if(v0 > 0 AND v1 > 0) AS n, CAST(sum(CASE WHEN v0 > 0 AND v1 > 0 THEN v0 END) AS DOUBLE) / nullif(count_if(v0 > 0 AND v1 > 0), 0) AS co, CAST(sum(CASE WHEN v0 > 0 AND v1 > 0 THEN v1 END) AS DOUBLE) / nullif(count_if(v0 > 0 AND v1 > 0), 0) AS cross_ FROM wide GROUP BY t // 12, y, x")
def mean_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of both channels over the scenes where both are valid."""
    ok = (F.col("v0") > 0) & (F.col("v1") > 0)
    return wide(spark, sf_dir).groupBy(F.expr("t div 12").cast("int").alias("period"), "y", "x").agg(F.count_if(ok).alias("n"), F.avg(F.when(ok, F.col("v0"))).alias("co"), F.avg(F.when(ok, F.col("v1"))).alias("cross_"))
