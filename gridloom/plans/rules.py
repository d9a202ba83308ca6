"""Queries of colours, sampling, attribution and the rules of names, links, layouts and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import attribution, colour, composite, rules
from gridloom.plans.cube import CELL, CUBE, GRID, HEIGHT, STEPS, WIDTH, dense, int_, pixels
from gridloom.plans.planning import SCENES, scenes
from gridloom.plans.registry import query

_BANDS = "w AS (SELECT t, y, x, max(CASE WHEN b = 0 THEN v END) AS r, max(CASE WHEN b = 1 THEN v END) AS g, max(CASE WHEN b = 2 THEN v END) AS n FROM px GROUP BY t, y, x)"


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each pixel of a step: red, green, near infrared."""
    at = lambda b: F.max(F.when(F.col("b") == b, F.col("v")))
    return pixels(spark, sf_dir).groupBy("t", "y", "x").agg(at(0).alias("r"), at(1).alias("g"), at(2).alias("n"))


def _byte(c):
    return int_(F.floor(c * 255 + 0.5))


def _ramp_sql(pieces: tuple, c: int) -> str:
    out = "CASE"
    for i, (a, b, low, high) in enumerate(pieces):
        at = f"(v - {a}::DOUBLE) / {b - a!r}::DOUBLE"
        at = at if 0 < i < len(pieces) - 1 else f"least(greatest({at}, 0.0::DOUBLE), 1.0::DOUBLE)"
        out += f" {f'WHEN v < {b}::DOUBLE THEN' if i < len(pieces) - 1 else 'ELSE'} {low[c]}::DOUBLE * (1.0::DOUBLE - {at}) + {high[c]}::DOUBLE * ({at})"
    return f"CAST(floor(({out} END) * 255 + 0.5::DOUBLE) AS INTEGER)"


def _ramp_query(one: str, two: str, pieces: tuple) -> str:
    v = f"CASE WHEN {one} + {two} > 0 THEN CAST({one} - {two} AS DOUBLE) / ({one} + {two}) ELSE 0.0::DOUBLE END"
    return f"WITH {CUBE}, {_BANDS}, i AS (SELECT t, y, x, {v} AS v FROM w WHERE {one} IS NOT NULL AND {two} IS NOT NULL) SELECT t, y, x, {_ramp_sql(pieces, 0)} AS r, {_ramp_sql(pieces, 1)} AS g, {_ramp_sql(pieces, 2)} AS b FROM i"


def _ramped(df: DataFrame, one: str, two: str, pieces: tuple) -> DataFrame:
    total = F.col(one) + F.col(two)
    index = F.when(total > 0, (F.col(one) - F.col(two)).cast("double") / F.when(total > 0, total)).otherwise(0.0)
    rgb = colour.ramp(F.col("i"), pieces)
    return df.where(F.col(one).isNotNull() & F.col(two).isNotNull()).select("t", "y", "x", index.alias("i")).select("t", "y", "x", *[_byte(c).alias(k) for k, c in zip("rgb", rgb, strict=True)])


@query("F11_ndvi_ramp", _ramp_query("n", "r", colour.NDVI))
def ndvi_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ramped(wide(spark, sf_dir), "n", "r", colour.NDVI)


@query("F11_ndwi_ramp", _ramp_query("g", "n", colour.NDWI))
def ndwi_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ramped(wide(spark, sf_dir), "g", "n", colour.NDWI)


#: A table of three colours, for the query only; colour.pseudocolour takes any.
_STOPS = [(0.0, 0.1, 0.3), (0.5, 0.6, 0.2), (1.0, 0.9, 0.1)]
_P = "least(greatest(v / 100.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) * 2"


@query(
    "F11_pseudocolour",
    f"WITH {CUBE}, p AS (SELECT t, b, y, x, {_P} AS p, CAST(least(floor({_P}), 1) AS INTEGER) AS i FROM px WHERE b = 0) SELECT t, y, x, "
    + ", ".join(f"CAST(floor((list_extract({[s[c] for s in _STOPS]}::DOUBLE[], i + 1) * (1.0::DOUBLE - (p - i)) + list_extract({[s[c] for s in _STOPS]}::DOUBLE[], i + 2) * (p - i)) * 255 + 0.5::DOUBLE) AS INTEGER) AS {'rgb'[c]}2" for c in range(3))
    + " FROM p",
)
def pseudocolour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = colour.pseudocolour(F.col("v") / F.lit(100.0), _STOPS)
    return pixels(spark, sf_dir).where("b = 0").select("t", "y", "x", *[_byte(c).alias(f"{k}2") for k, c in zip("rgb", rgb, strict=True)])


def _curve_sql(v: str) -> str:
    x = f"({v} * 5.0::DOUBLE / ({v} * 5.0::DOUBLE + 1))"
    return f"CASE WHEN {x} <= 0.0031308 THEN {x} * 12.92::DOUBLE ELSE pow({x}, {1 / 2.4!r}::DOUBLE) * 1.055::DOUBLE - 0.055::DOUBLE END"


@query("F11_true_colour", f"WITH {CUBE}, {_BANDS}, c AS (SELECT t, y, x, {_curve_sql('(r / 400.0::DOUBLE)')} AS r, {_curve_sql('(g / 400.0::DOUBLE)')} AS g, {_curve_sql('(n / 400.0::DOUBLE)')} AS n FROM w WHERE r IS NOT NULL AND g IS NOT NULL AND n IS NOT NULL), l AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * n AS lum FROM c) SELECT t, y, x, " + ", ".join(f"CAST(floor(least(greatest(lum * (1 - 1.4::DOUBLE) + 1.4::DOUBLE * {c}, 0.0), 1.0) * 1000) AS INTEGER) AS {k}" for c, k in (("r", "red"), ("g", "green"), ("n", "blue"))) + " FROM l")
def true_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousandths of the three channels after tone curve and saturation."""
    df = wide(spark, sf_dir).where("r IS NOT NULL AND g IS NOT NULL AND n IS NOT NULL")
    rgb = colour.true_colour(*[F.col(c) / F.lit(400.0) for c in "rgn"])
    return df.select("t", "y", "x", *[int_(F.floor(c * 1000)).alias(k) for k, c in zip(("red", "green", "blue"), rgb, strict=True)])


@query(
    "A22_stretch_low",
    f"""WITH {CUBE}, {_BANDS}, s AS (SELECT t, unnest([r, g, n]) AS v FROM w WHERE NOT coalesce(r = 0 AND g = 0 AND n = 0, false) AND r IS NOT NULL AND g IS NOT NULL AND n IS NOT NULL),
o AS (SELECT t, {_curve_sql('(v / 400.0::DOUBLE)')} AS tone FROM s), k AS (SELECT t, tone, row_number() OVER (PARTITION BY t ORDER BY tone) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM o)
SELECT t, max(n) AS tones, CAST(floor(CASE WHEN max(n) < 30 THEN 0 ELSE max(CASE WHEN i = CAST(floor(n * 0.02::DOUBLE) AS BIGINT) THEN tone END) END * 1000000) AS BIGINT) AS low FROM k GROUP BY t""",
)
def stretch_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = wide(spark, sf_dir).where("r IS NOT NULL AND g IS NOT NULL AND n IS NOT NULL").select("t", *[(F.col(c) / F.lit(400.0)).alias(c) for c in "rgn"])
    return colour.stretch_low(df, ["t"], ("r", "g", "n")).select("t", "tones", F.floor(F.col("low") * 1000000).alias("low"))


@query("F06_intensity", f"WITH {CUBE} SELECT t, b, y, x, CAST(v AS FLOAT) * CAST(v AS FLOAT) AS intensity, CAST(floor(10 * log10(CAST(v AS DOUBLE) * v) * 1000 + 0.5) AS INTEGER) AS milli_db FROM px WHERE v > 0")
def intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitude squared in float32, and thousandths of dB; no logarithm of zero, negative or missing."""
    v = F.col("v").cast("float")
    db = F.log10(F.col("v").cast("double") * F.col("v")) * 10
    return pixels(spark, sf_dir).where("v > 0").select("t", "b", "y", "x", (v * v).alias("intensity"), int_(F.floor(db * 1000 + 0.5)).alias("milli_db"))


@query("A09_volatility_append", f"""WITH {CUBE}, {GRID}, a AS (SELECT *, least(6 * ((t + 2) // 6), 78) AS q FROM dense), s AS (SELECT *, least(6 * ((t + 2) // 6), 66) AS q FROM dense WHERE t < 70),
f AS (SELECT a.y // 8 AS row, a.x // 8 AS col, CAST(sum(abs(a.v - d.v)) AS BIGINT) AS total_after FROM a JOIN dense d ON d.t = a.q AND d.b = a.b AND d.y = a.y AND d.x = a.x WHERE a.t <> a.q GROUP BY 1, 2),
g AS (SELECT a.y // 8 AS row, a.x // 8 AS col, CAST(sum(abs(a.v - d.v)) AS BIGINT) AS total_before FROM s a JOIN dense d ON d.t = a.q AND d.b = a.b AND d.y = a.y AND d.x = a.x WHERE a.t <> a.q GROUP BY 1, 2)
SELECT row, col, total_before, total_after FROM f JOIN g USING (row, col)""")
def volatility_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change sums of 70 steps, and of all after an append: the schedule of the whole axis counts."""
    d = dense(spark, sf_dir)
    before = composite.volatility(d.where("t < 70"), 70, CELL).select("row", "col", F.col("total").alias("total_before"))
    return before.join(composite.volatility(d, STEPS, CELL).select("row", "col", F.col("total").alias("total_after")), ["row", "col"])


@query("A25_sampled_bands", f"WITH {CUBE}, s AS (SELECT *, count(*) OVER (PARTITION BY b) AS all_ FROM px) SELECT b, count(*) AS n, min(v) AS lo, max(v) AS hi, CAST(sum(v) AS BIGINT) AS total FROM s WHERE CAST('0x' || substr(md5(t || ',' || y || ',' || x), 1, 4) AS INTEGER) < floor(65536 * least(1.0::DOUBLE, 2000.0::DOUBLE / all_)) GROUP BY b")
def sampled_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a hash-chosen sample of about 2000 pixels of each band: the same pixels in every run."""
    px = pixels(spark, sf_dir)
    share = F.broadcast(px.groupBy("b").agg(F.floor(F.least(F.lit(1.0), F.lit(2000.0) / F.count("*")) * 65536).alias("below")))  # one row a band
    h = F.conv(F.substring(F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in ("t", "y", "x")])), 1, 4), 16, 10).cast("int")
    return px.join(share, "b").where(h < F.col("below")).groupBy("b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("v").cast("long").alias("total"))


@query("A28_compression_ratio")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zstd level 5 over the top-left cell of the first, middle and last step; t, raw, packed, ratio."""
    from gridloom.operators.sampling import cell_ratios

    steps = sorted({0, STEPS // 2, STEPS - 1})
    return cell_ratios(dense(spark, sf_dir).where(F.col("t").isin(*steps) & (F.col("y") < CELL) & (F.col("x") < CELL)))


@query("J13_A37_explaining_scenes")
def explaining_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes (steps) that explain what counts lack where steps 1 and 4 were left out: rank, scene."""
    masks = pixels(spark, sf_dir).where("b = 0").select("y", "x", F.col("t").alias("scene"))
    lack = masks.groupBy("y", "x").agg(int_(F.sum(F.when(F.col("scene").isin(1, 4), 1).otherwise(0))).alias("missing"))
    found = attribution.explaining_scenes(masks, lack, ["y", "x"])
    return spark.createDataFrame([(i, s) for i, s in enumerate(found)], "rank int, scene int")


@query("A38_X15_level_report", f"WITH {CUBE}, l AS (SELECT t, b, y, x FROM px) SELECT CAST(0 AS INTEGER) AS level, count(*) AS pixels, count(DISTINCT (t, y // 8, x // 8)) AS chunks, CAST(0 AS VARCHAR) || ': ' || CAST(count(*) AS VARCHAR) || ' pixels in ' || CAST(count(DISTINCT (t, y // 8, x // 8)) AS VARCHAR) || ' chunks' AS line FROM l")
def level_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels and chunks of a level, and the line of a report."""
    cells = pixels(spark, sf_dir).groupBy("t", F.expr("y div 8"), F.expr("x div 8")).agg(F.count("*").alias("n"))
    r = cells.agg(F.sum("n").alias("pixels"), F.count("*").alias("chunks"))
    return r.select(F.lit(0).alias("level"), "pixels", "chunks", F.format_string("0: %d pixels in %d chunks", "pixels", "chunks").alias("line"))


@query("T06_centre_first", f"WITH {CUBE}, c AS (SELECT DISTINCT y // 8 AS row, x // 8 AS col FROM px), d AS (SELECT *, pow(col * 8 + 4 - 7.5::DOUBLE, 2) + pow(row * 8 + 4 - 10.0::DOUBLE, 2) AS d2 FROM c) SELECT row, col, d2, row_number() OVER (ORDER BY d2, row, col) AS place FROM d")
def centre_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in view, nearest to its centre first."""
    from pyspark.sql import Window

    c = pixels(spark, sf_dir).select(int_(F.expr("y div 8")).alias("row"), int_(F.expr("x div 8")).alias("col")).distinct()
    dx, dy = F.col("col") * 8 + 4 - WIDTH / 2, F.col("row") * 8 + 4 - HEIGHT / 2
    d = c.withColumn("d2", dx * dx + dy * dy)
    return d.select("row", "col", "d2", F.row_number().over(Window.orderBy("d2", "row", "col")).cast("long").alias("place"))


@query(
    "F21_same_crs",
    r"""WITH c AS (SELECT * FROM (VALUES ('EPSG:32718', NULL, 'epsg:32718', NULL), ('EPSG:4326', NULL, 'EPSG:3857', NULL), (NULL, 'G["a b", 1]', 'EPSG:1', 'G["a b",1]'), (NULL, 'G["a b"]', NULL, 'G["ab"]'), ('EPSG:1', NULL, NULL, 'G["x"]')) x(a_code, a_wkt, b_code, b_wkt))
SELECT a_code, a_wkt, b_code, b_wkt, CASE WHEN a_wkt IS NOT NULL AND b_wkt IS NOT NULL AND regexp_replace(a_wkt, '("[^"]*")|\s+', '\1', 'g') = regexp_replace(b_wkt, '("[^"]*")|\s+', '\1', 'g') THEN 'same'
WHEN a_wkt IS NULL AND b_wkt IS NULL AND upper(a_code) = upper(b_code) THEN 'same' WHEN a_wkt IS NULL AND b_wkt IS NULL THEN 'different' ELSE 'unknown' END AS verdict FROM c""",
)
def same_crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("EPSG:32718", None, "epsg:32718", None), ("EPSG:4326", None, "EPSG:3857", None), (None, 'G["a b", 1]', "EPSG:1", 'G["a b",1]'), (None, 'G["a b"]', None, 'G["ab"]'), ("EPSG:1", None, None, 'G["x"]')]
    names = ["a_code", "a_wkt", "b_code", "b_wkt"]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).select(*names, rules.same_crs(*map(F.col, names)).alias("verdict"))


@query(
    "F23_SC35_date_pattern",
    f"""WITH {SCENES}, n AS (SELECT id, CASE id % 3 WHEN 0 THEN 'ndvi_' || strftime(day, '%Y%j') ELSE 'ndvi_' || strftime(day, '%Y') || '366' END AS name FROM scenes),
p AS (SELECT id, name, CAST(regexp_extract(name, 'ndvi_([0-9]{{4}})([0-9]{{3}})', 1) AS INTEGER) AS y, CAST(regexp_extract(name, 'ndvi_([0-9]{{4}})([0-9]{{3}})', 2) AS INTEGER) AS j FROM n)
SELECT id, name, CASE WHEN year(make_date(y, 1, 1) + (j - 1)) = y THEN make_date(y, 1, 1) + (j - 1) END AS day FROM p""",
)
def date_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of names by a pattern; a common year has no day 366."""
    s = scenes(spark, sf_dir)
    name = F.concat(F.lit("ndvi_"), F.when(F.col("id") % 3 == 0, F.date_format("day", "yyyyDDD")).otherwise(F.concat(F.date_format("day", "yyyy"), F.lit("366"))))
    return s.select("id", name.alias("name")).select("id", "name", rules.time_by_pattern(F.col("name"), "ndvi_%Y%j").cast("date").alias("day"))


_META = """ar AS (SELECT 'a/' || id AS path, md5(cloud || orbit) AS meta FROM scenes WHERE id % 7 <> 0), co AS (SELECT 'a/' || id AS path, CASE WHEN id % 11 = 0 THEN 'old' ELSE md5(cloud || orbit) END AS meta FROM scenes WHERE id % 13 <> 0)"""


@query("V07_SK09_consolidated", f"WITH {SCENES}, {_META} SELECT co.path, CASE WHEN ar.path IS NULL THEN 'missing' ELSE 'stale' END AS problem FROM co LEFT JOIN ar USING (path) WHERE ar.path IS NULL OR ar.meta <> co.meta")
def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of consolidated metadata that are not there or say something else."""
    s = scenes(spark, sf_dir).select("id", F.concat(F.lit("a/"), F.col("id").cast("string")).alias("path"), F.md5(F.concat(F.col("cloud").cast("string"), "orbit")).alias("meta"))
    listed = s.where("id % 13 <> 0").select("path", F.when(F.col("id") % 11 == 0, "old").otherwise(F.col("meta")).alias("listed"))
    both = listed.join(s.where("id % 7 <> 0").select("path", "meta"), "path", "left")
    return both.select("path", F.when(F.col("meta").isNull(), "missing").when(F.col("meta") != F.col("listed"), "stale").alias("problem")).where("problem IS NOT NULL")


@query("V14_parse_rules", "SELECT * FROM (VALUES (1, NULL, NULL, NULL), (2, 'empty name', 'no sources', 'assets'), (3, 'repeated name', 'gap fill', 'derivation'), (4, 'no bands', 'no composite', 'empty')) x(i, bands, provenance, levels)")
def parse_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        (1, ["a", "b"], ["s2"], "median", "none", ["0", "1"], [None, "0"], [None, 2]),
        (2, ["a", ""], None, "median", "none", ["0", "2"], [None, "0"], [None, 2]),
        (3, ["a", "a"], ["s2"], "median", "linear", ["0", "1"], [None, "0"], [None, 4]),
        (4, [], ["s2"], "", "none", [], [], []),
    ]
    df = spark.createDataFrame(rows, "i int, names array<string>, sources array<string>, composite string, fill string, assets array<string>, derived array<string>, scales array<int>")
    return df.select("i", rules.band_problem(F.col("names")).alias("bands"), rules.provenance_problem(F.col("sources"), F.col("composite"), F.col("fill")).alias("provenance"), rules.levels_problem(F.col("assets"), F.col("derived"), F.col("scales")).alias("levels"))


@query(
    "V15_decode_cross_check",
    f"""WITH {CUBE}, {GRID}, o AS (SELECT t, b, y, x, v, CASE WHEN y // 8 = 1 AND x // 8 = 0 AND t % 9 = 4 AND (y + x) % 3 = 0 THEN v + 256 ELSE v END AS w FROM dense)
SELECT t, count(*) AS pixels, CAST(sum(CASE WHEN v <> w THEN 1 ELSE 0 END) AS BIGINT) AS differ FROM o GROUP BY t""",
)
def decode_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels as they are against those that the decoder finds in encoded cells, some of which hold a damaged byte: how many differ at each step.

    Cells are little-endian 16-bit numbers in hex, in order of y and x; the decoder takes them apart again.
    """
    d = dense(spark, sf_dir)
    row, col = F.expr("y div 8"), F.expr("x div 8")
    damaged = (row == 1) & (col == 0) & (F.col("t") % 9 == 4) & ((F.col("y") + F.col("x")) % 3 == 0)
    stored = F.when(damaged, F.col("v") + 256).otherwise(F.col("v"))
    word = F.concat(F.lpad(F.hex(stored % 256), 2, "0"), F.lpad(F.hex(F.floor(stored / 256)), 2, "0"))
    cells = d.groupBy("t", "b", row.cast("int").alias("row"), col.cast("int").alias("col")).agg(F.sort_array(F.collect_list(F.struct("y", "x", word.alias("word")))).alias("c"), F.max("x").alias("x1"), F.min("x").alias("x0"))  # a cell is 8 x 8
    packed = cells.select("t", "b", "row", "x0", (F.col("x1") - F.col("x0") + 1).alias("w"), F.array_join(F.col("c.word"), "").alias("bytes"))
    each = packed.select("t", "b", "row", "x0", "w", "bytes", F.explode(F.sequence(F.lit(0), (F.length("bytes") / 4).cast("int") - 1)).alias("i"))
    part = lambda k: F.conv(F.substring(F.col("bytes"), F.col("i") * 4 + k, F.lit(2)), 16, 10).cast("int")
    other = each.select("t", "b", (F.col("row") * 8 + (F.col("i") / F.col("w")).cast("int")).alias("y"), (F.col("x0") + F.col("i") % F.col("w")).alias("x"), (part(1) + 256 * part(3)).alias("w"))
    return d.join(other, ["t", "b", "y", "x"]).groupBy("t").agg(F.count("*").alias("pixels"), F.sum(F.when(F.col("v") != F.col("w"), 1).otherwise(0)).alias("differ"))


@query("V16_X19_hosted_check", f"WITH {SCENES} SELECT tile, count(*) AS objects, count(*) FILTER (WHERE id % 17 = 0) AS changed FROM scenes GROUP BY tile")
def hosted_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose size and version are not those that were published, by tile."""
    s = scenes(spark, sf_dir)
    version = F.struct("cloud", F.md5(F.col("id").cast("string")).alias("etag"))
    now = F.struct("cloud", F.when(F.col("id") % 17 == 0, F.lit("other")).otherwise(F.md5(F.col("id").cast("string"))).alias("etag"))
    both = s.select("id", "tile", version.alias("a")).join(s.select("id", now.alias("b")), "id")
    return both.groupBy("tile").agg(F.count("*").alias("objects"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("changed"))


@query("X03_X09_target_grid", f"WITH {SCENES}, r AS (SELECT tile, arg_min(cloud, id) AS target FROM scenes GROUP BY tile) SELECT s.tile, r.target, count(*) FILTER (WHERE s.cloud <> r.target) AS disagree FROM scenes s JOIN r USING (tile) GROUP BY s.tile, r.target")
def target_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first file's grid is the target; files that disagree with it are counted."""
    by = scenes(spark, sf_dir).groupBy("tile", "cloud").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    first = by.groupBy("tile").agg(F.min_by("cloud", "first").alias("target"))
    return by.join(first, "tile").groupBy("tile", "target").agg(F.sum(F.when(F.col("cloud") != F.col("target"), F.col("n")).otherwise(0)).alias("disagree"))


@query("X08_squeezed_dims", f"WITH {SCENES} SELECT tile, count(DISTINCT orbit) AS n_values, count(DISTINCT orbit) = 1 AS squeezed FROM scenes GROUP BY tile")
def squeezed_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension of length one goes where all files agree on its value."""
    n = F.count_distinct("orbit")
    return scenes(spark, sf_dir).groupBy("tile").agg(n.alias("n_values"), (n == 1).alias("squeezed"))


@query("X10_registrations", "SELECT * FROM (VALUES (1, 'ok'), (2, 'absent'), (3, 'more than one'), (4, 'not the literal')) x(i, state)")
def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations are found by UUID; a reader takes one whose name differs, a writer must not write it."""
    rows = [(1, [("u1", "proj")]), (2, [("u2", "geo")]), (3, [("u1", "proj"), ("u1", "proj")]), (4, [("u1", "proj:")])]
    mine = F.filter("regs", lambda r: r["uuid"] == "u1")
    state = F.when(F.size(mine) == 0, "absent").when(F.size(mine) > 1, "more than one").when(mine[0]["name"] != "proj", "not the literal").otherwise("ok")
    return spark.createDataFrame(rows, "i int, regs array<struct<uuid:string,name:string>>").select("i", state.alias("state"))


@query("X11_chunk_layout", "SELECT * FROM (VALUES (1, NULL), (2, 'chunks'), (3, 'dimensions'), (4, 'shards'), (5, NULL)) x(i, problem)")
def chunk_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, [1, 3, 8, 8], None), (2, [1, 3, 8, 4], None), (3, [1, 8, 8], None), (4, [1, 3, 8, 8], [12, 3, 16, 8]), (5, [1, 3, 8, 8], [12, 3, 8, 8])]
    return spark.createDataFrame(rows, "i int, chunks array<int>, shards array<int>").select("i", rules.layout_problem(F.col("chunks"), F.col("shards"), [3]).alias("problem"))


@query("X13_ST3_append_commit", f"WITH {SCENES}, d AS (SELECT DISTINCT day FROM scenes), n AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM d) SELECT year(day) AS year, count(*) AS steps, count(*) FILTER (WHERE i <= 100) AS seen FROM n GROUP BY 1")
def append_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps by year, and those that a reader of an earlier snapshot (100 steps) sees."""
    days = scenes(spark, sf_dir).select("day").distinct()
    last = days.orderBy("day").limit(100).agg(F.max("day")).first()[0]  # what the snapshot's metadata says
    return days.groupBy(F.year("day").alias("year")).agg(F.count("*").alias("steps"), F.count(F.when(F.col("day") <= F.lit(last), 1)).alias("seen"))


@query("X14_band_roles", "SELECT * FROM (VALUES (0, 'B04', 'red'), (1, 'B03', 'green'), (2, 'B08', 'nir'), (3, 'B12', NULL)) x(i, name, role)")
def band_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles set in place: those named change, the others stay as they are."""
    bands = spark.createDataFrame([(0, "B04", None), (1, "B03", "green"), (2, "B08", "red"), (3, "B12", None)], "i int, name string, role string")
    new = F.create_map(*[F.lit(x) for x in ("B04", "red", "B08", "nir")])
    return bands.select("i", "name", F.coalesce(F.try_element_at(new, F.col("name")), "role").alias("role"))


@query("X18_link_rules", "SELECT * FROM (VALUES ('s3://b/a/v1', NULL, 'not a web address'), ('https://h/a', 'web address', NULL), ('s3://b/a/../c', 'empty or dotted segment', 'not a web address'), ('b/a', 'no storage location', 'not a web address'), ('http://h/a', 'web address', 'plain http'), ('http://localhost/a', 'web address', NULL), ('https://u:p@h/a', 'web address', 'credentials, query or fragment'), ('gs://u@b/a', 'credentials, query or fragment', 'not a web address'), ('https://h/a?x=1', 'web address', 'credentials, query or fragment')) x(text, destination, public)")
def link_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["s3://b/a/v1", "https://h/a", "s3://b/a/../c", "b/a", "http://h/a", "http://localhost/a", "https://u:p@h/a", "gs://u@b/a", "https://h/a?x=1"]
    return spark.createDataFrame([(t,) for t in texts], "text string").select("text", rules.destination_problem(F.col("text")).alias("destination"), rules.public_problem(F.col("text")).alias("public"))


@query("X20_strip_plan", f"WITH {SCENES}, m AS (SELECT strftime(day, '%Y-%m') AS month, count(*) AS n FROM scenes GROUP BY 1), r AS (SELECT month, n, CAST(n * 9000 AS BIGINT) AS per_row FROM m), l AS (SELECT *, greatest(512, CAST(floor((2000000000::DOUBLE - 1000000) / per_row / 512) * 512 AS INTEGER)) AS lim FROM r) SELECT month, CASE WHEN 1000000 + per_row * 2759 <= 2000000000 THEN 2759 WHEN 1000000 + per_row * 512 <= 2000000000 THEN least(lim, CAST(ceil(ceil(2759::DOUBLE / ceil(2759::DOUBLE / lim)) / 512) * 512 AS INTEGER)) END AS rows FROM l")
def strip_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the strips in which a month's scenes fit two gigabytes."""
    m = scenes(spark, sf_dir).groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg((F.count("*") * 9000).alias("per_row"))
    return m.select("month", rules.strip_rows(F.lit(2_000_000_000), F.lit(1_000_000), F.col("per_row"), 2759, 512).alias("rows"))


@query("X24_projected_centre", f"WITH {CUBE}, p AS (SELECT DISTINCT y, x FROM px), q AS (SELECT y, x, 10.0::DOUBLE * x + 0.0::DOUBLE * y + 500000.0::DOUBLE AS px_, 0.0::DOUBLE * x + -10.0::DOUBLE * y + 9100000.0::DOUBLE AS py_ FROM p) SELECT y, x, px_ AS east, py_ AS north, (-10.0::DOUBLE * (px_ - 500000.0::DOUBLE) - 0.0::DOUBLE * (py_ - 9100000.0::DOUBLE)) / -100.0::DOUBLE AS col, (10.0::DOUBLE * (py_ - 9100000.0::DOUBLE) - 0.0::DOUBLE * (px_ - 500000.0::DOUBLE)) / -100.0::DOUBLE AS row FROM q")
def projected_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel to projected coordinates and back."""
    t = (10.0, 0.0, 500000.0, 0.0, -10.0, 9100000.0)
    east, north = rules.to_projected(t, F.col("x"), F.col("y"))
    at = pixels(spark, sf_dir).select("y", "x").distinct().select("y", "x", east.alias("east"), north.alias("north"))
    col, row = rules.to_pixel(t, F.col("east"), F.col("north"))
    return at.select("y", "x", "east", "north", col.alias("col"), row.alias("row"))


@query("X23_footprints", f"WITH {CUBE}, c AS (SELECT DISTINCT y // 8 AS row, x // 8 AS col FROM px), e AS (SELECT row, col, i, (col * 8 + 2.0::DOUBLE * i) * 10 + 500000 AS top_x, 9100000 - row * 80.0::DOUBLE AS top_y FROM c, range(5) r(i)) SELECT row, col, CAST(i AS INTEGER) AS i, top_x, top_y FROM e")
def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper edges of cells, each cut into four."""
    c = pixels(spark, sf_dir).select(int_(F.expr("y div 8")).alias("row"), int_(F.expr("x div 8")).alias("col")).distinct()
    i = c.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return i.select("row", "col", "i", ((F.col("col") * 8 + F.col("i") * 2.0) * 10 + 500000).alias("top_x"), (F.lit(9100000) - F.col("row") * 80.0).alias("top_y"))


@query("SC16_partial_response", "SELECT * FROM (VALUES (1, NULL), (2, 'other start'), (3, 'bytes missing'), (4, 'no range'), (5, 'too much'), (6, NULL)) x(i, problem)")
def partial_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, 10, 5, "bytes 10-14/100", 5), (2, 10, 5, "bytes 0-4/100", 5), (3, 10, 5, "bytes 10-14/100", 3), (4, 10, 5, "", 5), (5, 10, 5, "bytes 10-20/100", 11), (6, 10, 5, "bytes 10-12/13", 3)]
    return spark.createDataFrame(rows, "i int, start long, size long, header string, got long").select("i", rules.range_problem(F.col("start"), F.col("size"), F.col("header"), F.col("got")).alias("problem"))


@query("SC31_valid_aoi_qa", f"WITH {CUBE} SELECT y, x, count(*) AS steps, bool_and(n <= 2) AS clear, bool_and(v > 0 AND n <= 3 AND (x + y) % 5 <> 0) AS usable FROM px WHERE b = 0 GROUP BY y, x")
def valid_aoi_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel is usable where valid, area and quality masks agree in all observations."""
    ok = (F.col("v") > 0) & (F.col("n") <= 3) & ((F.col("x") + F.col("y")) % 5 != 0)
    return pixels(spark, sf_dir).where("b = 0").groupBy("y", "x").agg(F.count("*").alias("steps"), F.bool_and(F.col("n") <= 2).alias("clear"), F.bool_and(ok).alias("usable"))


@query("SK06_cell_major", f"WITH {CUBE} SELECT y // 8 AS row, x // 8 AS col, count(DISTINCT t) AS steps, count(*) AS pixels FROM px GROUP BY 1, 2")
def cell_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps in order of time become cells with all their steps; the shuffle spills where a cell is large."""
    px = pixels(spark, sf_dir).select(int_(F.expr("y div 8")).alias("row"), int_(F.expr("x div 8")).alias("col"), "t")
    per_step = px.groupBy("row", "col", "t").agg(F.count("*").alias("n"))
    return per_step.groupBy("row", "col").agg(F.count("*").alias("steps"), F.sum("n").alias("pixels"))


@query("SK19_plane_digests", f"WITH {CUBE}, {GRID} SELECT t, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY b, y, x)) AS digest FROM dense GROUP BY t")
def plane_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of a step's values in order of band, row and column; a step's grid is bounded."""
    rows = dense(spark, sf_dir).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("b", "y", "x", "v"))).alias("p"))
    return rows.select("t", F.sha2(F.array_join(F.transform("p", lambda s: s["v"].cast("string")), ","), 256).alias("digest"))
