"""Queries of names, keys, ranges and small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.plans.cube import CUBE, int_, pixels
from gridloom.plans.planning import SCENES, scenes
from gridloom.plans.registry import query, table


@query("P05_settle_nan", f"WITH {CUBE} SELECT t, b, y, x, CASE WHEN n = 3 THEN -1.0::DOUBLE ELSE CAST(v AS DOUBLE) END AS v FROM px WHERE t < 10")
def settle_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN becomes the fill value."""
    v = F.when(F.col("n") == 3, float("nan")).otherwise(F.col("v").cast("double"))
    return pixels(spark, sf_dir).where("t < 10").select("t", "b", "y", "x", F.nanvl(v, F.lit(-1.0)).alias("v"))


@query("P13_quality_filter", f"WITH {CUBE} SELECT t, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM px WHERE n <= 2 GROUP BY t")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).where("n <= 2").groupBy("t").agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total"))


@query("A27_divisor_refusal", f"WITH {CUBE} SELECT b, max(abs(v * 1000.0::DOUBLE)) > 100000 AS refused FROM px GROUP BY b")
def divisor_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands whose scale looks like a divisor: a power of ten from 100 on that makes values too large."""
    return pixels(spark, sf_dir).groupBy("b").agg((F.max(F.abs(F.col("v") * F.lit(1000.0))) > 100000).alias("refused"))


@query("J19_ancestors", f"WITH {CUBE} SELECT DISTINCT CAST(k AS INTEGER) AS level, y >> (3 + k) AS row, x >> (3 + k) AS col FROM px, range(3) r(k)")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that hold a pixel, and their ancestors at coarser levels."""
    at = pixels(spark, sf_dir).select("y", "x").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return at.select("level", F.expr("shiftright(y, 3 + level)").alias("row"), F.expr("shiftright(x, 3 + level)").alias("col")).distinct()


@query("SC34_parse_names", f"WITH {SCENES}, n AS (SELECT id, 'S1A_IW_GRDH_1SDV_' || strftime(day, '%Y%m%d') || 'T' || lpad(CAST(id % 24 AS VARCHAR), 2, '0') || '0000_' || orbit AS name FROM scenes) SELECT id, name[1:3] AS mission, name[15:16] AS polarisation, CAST(id % 24 AS INTEGER) AS hour, right(name, 1) AS orbit FROM n")
def parse_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = "^(S1[AB])_IW_GRDH_1S(D[VH])_([0-9]{8})T([0-9]{2})[0-9]{4}_([A-Z])$"
    name = F.concat(F.lit("S1A_IW_GRDH_1SDV_"), F.date_format("day", "yyyyMMdd"), F.lit("T"), F.lpad((F.col("id") % 24).cast("string"), 2, "0"), F.lit("0000_"), F.col("orbit"))
    part = lambda i: F.regexp_extract("name", pattern, i)
    return scenes(spark, sf_dir).withColumn("name", name).select("id", part(1).alias("mission"), part(2).alias("polarisation"), part(4).cast("int").alias("hour"), part(5).alias("orbit"))


@query("SC36_month_files", f"WITH {SCENES} SELECT strftime(day, '%Y-%m') AS month, count(*) AS files, count(*) > 1 AS refused FROM scenes WHERE tile = 0 GROUP BY 1")
def month_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months with more than one file are refused."""
    return scenes(spark, sf_dir).where("tile = 0").groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("files"), (F.count("*") > 1).alias("refused"))


@query("F24_F25_masked_labels", f"WITH {SCENES} SELECT tile, count(DISTINCT regexp_replace('t' || tile || ' of ' || strftime(day, '%Y-%m-%d'), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', '<date>', 'g')) = 1 AS label FROM scenes GROUP BY tile")
def masked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions that are alike once their dates are masked are labels of the file, not of a step."""
    text = F.concat(F.lit("t"), F.col("tile").cast("string"), F.lit(" of "), F.date_format("day", "yyyy-MM-dd"))
    return scenes(spark, sf_dir).groupBy("tile").agg((F.count_distinct(F.regexp_replace(text, "[0-9]{4}-[0-9]{2}-[0-9]{2}", "<date>")) == 1).alias("label"))


@query("F29_keys", f"WITH {CUBE} SELECT DISTINCT '0/data/c/' || t || '/0/' || (y // 8) || '/' || (x // 8) AS key FROM px")
def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: F.expr(c).cast("string")
    return pixels(spark, sf_dir).select(F.concat_ws("/", F.lit("0/data/c"), part("t"), F.lit("0"), part("y div 8"), part("x div 8")).alias("key")).distinct()


@query("F31_pack_bits", f"WITH {CUBE} SELECT t, y, CAST(sum(CASE WHEN b = 0 THEN 1 << x ELSE 0 END) AS BIGINT) AS bits FROM px GROUP BY t, y")
def pack_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's mask of band 0 as bits."""
    return pixels(spark, sf_dir).groupBy("t", "y").agg(F.sum(F.when(F.col("b") == 0, F.expr("shiftleft(1, x)")).otherwise(0)).cast("long").alias("bits"))


@query("F33_regular_axis", f"WITH {CUBE}, d AS (SELECT DISTINCT y, x FROM px), g AS (SELECT y, x - lag(x) OVER (PARTITION BY y ORDER BY x) AS gap FROM d) SELECT y, CAST(min(gap) AS DOUBLE) * 10 AS step, max(gap) - min(gap) <= 1e-6 AS regular FROM g GROUP BY y")
def regular_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step of an axis from its coordinates, and whether it is the same everywhere."""
    gap = F.col("x") - F.lag("x").over(Window.partitionBy("y").orderBy("x"))
    g = pixels(spark, sf_dir).select("y", "x").distinct().withColumn("gap", gap)
    return g.groupBy("y").agg((F.min("gap").cast("double") * 10).alias("step"), (F.max("gap") - F.min("gap") <= 1e-6).alias("regular"))


@query("F35_chart_range", f"WITH {CUBE} SELECT b, min(v) - 0.08::DOUBLE * (max(v) - min(v)) AS lo, max(v) + 0.08::DOUBLE * (max(v) - min(v)) AS hi FROM px GROUP BY b")
def chart_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = F.lit(0.08) * (F.max("v") - F.min("v"))
    return pixels(spark, sf_dir).groupBy("b").agg((F.min("v") - pad).alias("lo"), (F.max("v") + pad).alias("hi"))


@query("F42_scene_identity", f"""WITH {SCENES} SELECT id, '{{"cloud":' || cloud || ',"day":"' || strftime(day, '%Y-%m-%d') || '","orbit":"' || orbit || '","tile":' || tile || '}}' AS identity FROM scenes""")
def scene_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON: members in order of their names."""
    s = scenes(spark, sf_dir)
    return s.select("id", F.to_json(F.struct("cloud", "day", "orbit", "tile")).alias("identity"))


@query("V06_volatility_rules", f"WITH {CUBE}, c AS (SELECT y // 8 AS row, x // 8 AS col, CAST(max(v) AS DOUBLE) / 100 AS volatility FROM px GROUP BY 1, 2) SELECT row, col, CASE WHEN volatility > 1 THEN 'above 1' ELSE 'ok' END AS state FROM c")
def volatility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose volatility isn't finite or leaves 0..1."""
    c = pixels(spark, sf_dir).groupBy(F.expr("y div 8").cast("int").alias("row"), F.expr("x div 8").cast("int").alias("col")).agg((F.max("v").cast("double") / 100).alias("q"))
    state = F.when(F.isnan("q") | F.col("q").isNull(), "not finite").when(F.col("q") > 1, "above 1").when(F.col("q") < 0, "below 0").otherwise("ok")
    return c.select("row", "col", state.alias("state"))


@query("V09_codec_subset", "SELECT * FROM (VALUES ('bytes,zstd', true), ('bytes,gzip', true), ('zstd', false), ('bytes,lz4', false)) x(chain, allowed)")
def codec_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = spark.createDataFrame([("bytes,zstd",), ("bytes,gzip",), ("zstd",), ("bytes,lz4",)], "chain string")
    c = F.split("chain", ",")
    known = F.array(*map(F.lit, ("bytes", "zstd", "gzip")))
    return chains.select("chain", ((c[0] == "bytes") & (F.size(F.array_except(c, known)) == 0)).alias("allowed"))


@query("X25_remote_sync", f"WITH {SCENES} SELECT 'c/' || id AS key FROM scenes a WHERE id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM scenes b WHERE b.id = a.id AND b.id % 5 <> 0 AND (CASE WHEN b.id % 10 = 1 THEN b.cloud + 1 ELSE b.cloud END) = a.cloud)")
def remote_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local objects that the remote side lacks or has in another size."""
    s = scenes(spark, sf_dir)
    remote = s.where("id % 5 <> 0").select("id", F.when(F.col("id") % 10 == 1, F.col("cloud") + 1).otherwise(F.col("cloud")).alias("cloud"))
    return s.where("id % 3 <> 0").join(remote, ["id", "cloud"], "left_anti").select(F.concat(F.lit("c/"), F.col("id").cast("string")).alias("key"))


@query("X05_block_rectangles", f"WITH {CUBE} SELECT t, y // 8 AS row, x // 8 AS col, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM px GROUP BY ALL")
def block_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangle of each block that holds its valid pixels."""
    g = pixels(spark, sf_dir).groupBy("t", F.expr("y div 8").cast("int").alias("row"), F.expr("x div 8").cast("int").alias("col"))
    return g.agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))


@query("ST6_volatility_increments", f"""WITH {CUBE}, a AS (SELECT y // 8 AS row, x // 8 AS col, t // 40 AS part, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM px GROUP BY ALL)
SELECT row, col, CAST(sum(total) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS n, CAST(least(1.0, CAST(sum(total) AS DOUBLE) / sum(n) / 10000.0) AS FLOAT) AS volatility FROM a GROUP BY row, col""")
def volatility_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of increments give what the whole axis gives."""
    from gridloom.streaming.rasters import change_sums

    parts = pixels(spark, sf_dir).groupBy(F.expr("y div 8").cast("int").alias("row"), F.expr("x div 8").cast("int").alias("col"), F.expr("t div 40").alias("part")).agg(F.sum("v").cast("long").alias("total"), F.count("*").alias("n"))
    return change_sums(parts, ["row", "col"])


@query("F10_tone_map", f"WITH {CUBE} SELECT t, b, y, x, CAST(floor(255 * pow((5.0::DOUBLE * v / 400) / (1 + 5.0::DOUBLE * v / 400), 1 / 2.2::DOUBLE) + 0.5::DOUBLE) AS INTEGER) AS level FROM px WHERE t = 30")
def tone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reinhard tone mapping with a gain of 5 and display gamma, as a byte."""
    a = F.lit(5.0) * F.col("v") / 400
    return pixels(spark, sf_dir).where("t = 30").select("t", "b", "y", "x", int_(F.floor(F.lit(255) * F.pow(a / (1 + a), F.lit(1 / 2.2)) + 0.5)).alias("level"))


@query("F12_display_mode", "SELECT event_id, CASE WHEN value >= 50 THEN 'reflectance' ELSE 'linear' END AS mode FROM events")
def display_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") >= 50, "reflectance").otherwise("linear").alias("mode"))
