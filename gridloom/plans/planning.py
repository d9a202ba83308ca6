"""Queries of ingest planning, geometry, metadata and validation, over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom import functions
from gridloom.functions import projection
from gridloom.operators import planning as plan
from gridloom.operators import stats
from gridloom.plans.cube import int_
from gridloom.plans.registry import query, table

SCENES = """scenes AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(o_custkey % 7 AS INTEGER) AS tile, CAST(o_totalprice AS BIGINT) % 100 AS cloud, o_orderstatus AS orbit FROM orders)"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scenes: id, day, tile, cloud, orbit."""
    o = table(spark, sf_dir, "orders")
    cloud = F.rint("o_totalprice").cast("long") % 100
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"), int_(F.col("o_custkey") % 7).alias("tile"), cloud.alias("cloud"), F.col("o_orderstatus").alias("orbit"))


SCENES = SCENES.replace("CAST(o_totalprice AS BIGINT) % 100", "CAST(round_even(o_totalprice, 0) AS BIGINT) % 100")


@query("SC33_P15_filter_scenes", f"WITH {SCENES} SELECT id, day, tile FROM scenes WHERE cloud < 20 AND day BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND orbit IN ('F', 'O')")
def filter_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes(spark, sf_dir).where((F.col("cloud") < 20) & F.col("day").between("1996-01-01", "1997-06-30") & F.col("orbit").isin("F", "O")).select("id", "day", "tile")


@query("A36_dedup_latest", f"WITH {SCENES}, r AS (SELECT *, row_number() OVER (PARTITION BY day, tile ORDER BY id DESC) AS n FROM scenes) SELECT day, tile, id, cloud, orbit FROM r WHERE n = 1")
def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.latest(scenes(spark, sf_dir), ["day", "tile"], ["id"]).select("day", "tile", "id", "cloud", "orbit")


@query("A35_F24_scenes_by_month", f"WITH {SCENES} SELECT strftime(day, '%Y-%m') AS month, count(*) AS scenes, count(DISTINCT tile) AS tiles FROM scenes GROUP BY 1")
def scenes_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes(spark, sf_dir).groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("scenes"), F.count_distinct("tile").alias("tiles"))


@query("A34_T05_series_choice", f"WITH {SCENES}, c AS (SELECT tile, orbit, count(DISTINCT day) AS days FROM scenes GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY days DESC, orbit) AS n FROM c) SELECT tile, orbit, days FROM r WHERE n = 1")
def series_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orbit of most dates for each tile, the first by name of equals."""
    c = scenes(spark, sf_dir).groupBy("tile", "orbit").agg(F.count_distinct("day").alias("days"))
    r = Window.partitionBy("tile").orderBy(F.desc("days"), "orbit")
    return c.withColumn("n", F.row_number().over(r)).where("n = 1").select("tile", "orbit", "days")


@query("J08_copies", f"WITH {SCENES} SELECT day, tile, count(*) AS copies, min(id) AS first FROM scenes GROUP BY day, tile HAVING count(*) > 1")
def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes(spark, sf_dir).groupBy("day", "tile").agg(F.count("*").alias("copies"), F.min("id").alias("first")).where("copies > 1")


_TILES = "tl AS (SELECT day, tile, min(id) AS id, CAST((tile % 3) * 8 AS INTEGER) AS y0, CAST((tile % 3) * 8 + 10 AS INTEGER) AS y1, CAST((tile // 3) * 8 AS INTEGER) AS x0, CAST((tile // 3) * 8 + 9 AS INTEGER) AS x1 FROM scenes GROUP BY day, tile)"


@query("J07_V13_overlaps", f"WITH {SCENES}, {_TILES} SELECT a.day, least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, (least(a.y1, b.y1) - greatest(a.y0, b.y0)) * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS shared FROM tl a JOIN tl b ON a.day = b.day AND a.id < b.id AND least(a.y1, b.y1) > greatest(a.y0, b.y0) AND least(a.x1, b.x1) > greatest(a.x0, b.x0)")
def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tile")
    y0, x0 = (t % 3) * 8, F.expr("tile div 3").cast("int") * 8
    tiles = scenes(spark, sf_dir).groupBy("day", "tile").agg(F.min("id").alias("id")).select("day", "id", y0.alias("y0"), (y0 + 10).alias("y1"), x0.alias("x0"), (x0 + 9).alias("x1"))
    return plan.overlaps(tiles, ["day"])


_FILES = "f AS (SELECT tile, CAST(id AS VARCHAR) AS uri, CAST(epoch(day) / 86400 AS INTEGER) AS s, CAST(epoch(day) / 86400 AS INTEGER) + CAST(cloud AS INTEGER) AS e FROM scenes)"


@query("J09_W05_overlapping_spans", f"WITH {SCENES}, {_FILES}, w AS (SELECT *, max(e) OVER (PARTITION BY tile ORDER BY s, e, uri ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM f) SELECT tile, uri, s, e, latest FROM w WHERE s <= latest")
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.unix_date("day")
    files = scenes(spark, sf_dir).select("tile", F.col("id").cast("string").alias("uri"), s.alias("s"), (s + F.col("cloud").cast("int")).alias("e"))
    return stats.overlapping_spans(files, "s", "e", ("tile",))


@query("J10_SK10_staged", f"WITH {SCENES} SELECT DISTINCT day FROM scenes WHERE tile < 4 AND day NOT IN (SELECT day FROM scenes WHERE tile >= 4 AND day IS NOT NULL)")
def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned steps that aren't staged yet."""
    s = scenes(spark, sf_dir)
    return s.where("tile < 4").select("day").distinct().join(s.where("tile >= 4").select("day"), "day", "left_anti")


@query("J11_exactly_one_qa", f"WITH {SCENES}, q AS (SELECT day, count(*) AS k, min(id) AS qa FROM scenes WHERE tile = 6 GROUP BY day) SELECT s.id, CASE WHEN q.k = 1 THEN q.qa END AS qa, coalesce(q.k, 0) AS matches FROM scenes s LEFT JOIN q USING (day) WHERE s.tile = 5")
def exactly_one_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scenes(spark, sf_dir)
    q = s.where("tile = 6").groupBy("day").agg(F.count("*").alias("k"), F.min("id").alias("one"))
    return s.where("tile = 5").join(q, "day", "left").select("id", F.when(F.col("k") == 1, F.col("one")).alias("qa"), F.coalesce("k", F.lit(0)).alias("matches"))


_OBJECTS = """lo AS (SELECT 'c/' || id AS key, cloud AS size, md5(CAST(cloud AS VARCHAR)) AS md5 FROM scenes WHERE id % 3 <> 0), re AS (SELECT 'c/' || id AS key, CASE WHEN id % 10 = 1 THEN cloud + 1 ELSE cloud END AS size, md5(CAST(cloud AS VARCHAR)) AS md5 FROM scenes WHERE id % 5 <> 0)"""


@query("J12_SK17_U03_U04_publish_diff", f"WITH {SCENES}, {_OBJECTS} SELECT coalesce(l.key, r.key) AS key, CASE WHEN r.key IS NULL THEN 'new' WHEN l.key IS NULL THEN 'foreign' WHEN l.size = r.size AND l.md5 = r.md5 THEN 'unchanged' ELSE 'changed' END AS state FROM lo l FULL JOIN re r ON l.key = r.key")
def publish_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scenes(spark, sf_dir).withColumn("key", F.concat(F.lit("c/"), F.col("id").cast("string"))).withColumn("md5", F.md5(F.col("cloud").cast("string")))
    local = s.where("id % 3 <> 0").select("key", F.col("cloud").alias("size"), "md5")
    remote = s.where("id % 5 <> 0").select("key", F.when(F.col("id") % 10 == 1, F.col("cloud") + 1).otherwise(F.col("cloud")).alias("size"), "md5")
    return plan.publish_diff(local, remote)


@query("J06_F34_lattice", f"WITH {SCENES}, f AS (SELECT id, 500000.0::DOUBLE + 10 * cloud + CASE WHEN id % 9 = 0 THEN 3.0 ELSE 0 END AS c FROM scenes) SELECT id, CAST(round_even((c - 500000.0) / 10, 0) AS INTEGER) AS col, abs((c - 500000.0) / 10 - round_even((c - 500000.0) / 10, 0)) <= 1e-6 AS on_lattice FROM f")
def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of files in pixels of the first one's grid, and whether they are whole."""
    c = F.lit(500000.0) + 10 * F.col("cloud") + F.when(F.col("id") % 9 == 0, 3.0).otherwise(0.0)
    q = (F.col("c") - 500000.0) / 10
    return scenes(spark, sf_dir).withColumn("c", c).select("id", int_(F.rint(q)).alias("col"), (F.abs(q - F.rint(q)) <= 1e-6).alias("on_lattice"))


@query("J14_clip_window", f"WITH {SCENES} SELECT id, greatest(0, tile * 5 - 8) AS y0, least(20, tile * 5 + 4) AS y1 FROM scenes WHERE least(20, tile * 5 + 4) > greatest(0, tile * 5 - 8)")
def clip_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scenes(spark, sf_dir).withColumn("y0", F.greatest(F.lit(0), F.col("tile") * 5 - 8)).withColumn("y1", F.least(F.lit(20), F.col("tile") * 5 + 4))
    return s.where("y1 > y0").select("id", "y0", "y1")


@query("J16_J15_point_cells", "SELECT event_id, CAST(floor((value - 0.0) / 2.5) AS INTEGER) AS col, CAST(floor(floor((value - 0.0) / 2.5) / 8) AS INTEGER) AS cell FROM events WHERE value IS NOT NULL")
def point_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel and the cell that hold a point: keys are computed from the inverse transform."""
    col = F.floor(F.col("value") / 2.5)
    return table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", int_(col).alias("col"), int_(F.floor(col / 8)).alias("cell"))


@query("J18_first_finite", "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_min(value, (ts, event_id)) AS v FROM events WHERE value IS NOT NULL AND event_type <> 'error' GROUP BY 1, 2")
def first_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value IS NOT NULL AND event_type <> 'error'")
    return e.groupBy("user_id", F.col("ts").cast("date").cast("string").alias("day")).agg(F.min_by("value", F.struct("ts", "event_id")).alias("v"))


@query("J20_prefix", f"WITH {SCENES}, d AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM scenes)) SELECT (SELECT count(*) FROM d WHERE i <= 100) = 100 AS prefix")
def prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether hosted times are where the local ones begin."""
    days = scenes(spark, sf_dir).select(F.col("day").alias("v")).distinct()
    d = days.withColumn("i", F.row_number().over(Window.orderBy("v")))
    return plan.is_prefix(d.where("i <= 100"), d)


_NAMES = """n AS (SELECT id, CASE id % 6 WHEN 0 THEN 'S2_' || strftime(day, '%Y%m%d') || '_T1' WHEN 1 THEN 'a-' || strftime(day, '%Y-%m-%d') || '.tif' WHEN 2 THEN 'm_' || strftime(day, '%Y_%m') || '.png' WHEN 3 THEN 'x' || strftime(day, '%Y%m') || '.tif'
 WHEN 4 THEN strftime(day, '%Y%m%d') || '_' || strftime(day + INTERVAL 1 DAY, '%Y%m%d') ELSE 'none_' || id % 7 END AS name, day FROM scenes)"""


@query(
    "F22_SC24_dated_names",
    f"""WITH {SCENES}, {_NAMES} SELECT id, name, CASE id % 6 WHEN 3 THEN 'undated' WHEN 4 THEN 'several' WHEN 5 THEN 'undated' ELSE 'dated' END AS state,
CAST(CASE id % 6 WHEN 0 THEN day WHEN 1 THEN day WHEN 2 THEN date_trunc('month', day) END AS DATE) AS day FROM n""",
)
def dated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda f, c="day": F.date_format(c, f)
    i = F.col("id") % 6
    name = (
        F.when(i == 0, F.concat(F.lit("S2_"), d("yyyyMMdd"), F.lit("_T1"))).when(i == 1, F.concat(F.lit("a-"), d("yyyy-MM-dd"), F.lit(".tif"))).when(i == 2, F.concat(F.lit("m_"), d("yyyy_MM"), F.lit(".png")))
        .when(i == 3, F.concat(F.lit("x"), d("yyyyMM"), F.lit(".tif"))).when(i == 4, F.concat(d("yyyyMMdd"), F.lit("_"), F.date_format(F.date_add("day", 1), "yyyyMMdd"))).otherwise(F.concat(F.lit("none_"), (F.col("id") % 7).cast("string")))
    )
    return plan.dated(scenes(spark, sf_dir).select("id", name.alias("name")))


@query("SC12_T01_natural_order", "SELECT v, CAST(n AS INTEGER) AS place FROM (VALUES ('b1', 1), ('b2', 2), ('b07', 3), ('b8a', 4), ('b10', 5), ('b11', 6)) x(v, n)")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(x,) for x in ("b10", "b2", "b8a", "b07", "b1", "b11")], "v string")
    return names.withColumn("place", F.row_number().over(Window.orderBy(plan.natural_key(F.col("v")), "v")))


_ARRAYS = [("B01", 0, "y,x", "20,15", "u2"), ("B02", 0, "y,x", "20,15", "u2"), ("B03", 0, "y,x", "20,15", "u2"), ("B01", 1, "y,x", "10,8", "u2"), ("B03", 1, "y,x", "10,8", "u2"), ("qa", 0, "y,x", "20,15", "u1"), ("cube", 0, "time,y,x", "4,20,15", "u2")]
_ARRAY_SQL = "a AS (SELECT * FROM (VALUES " + ", ".join(str(x) for x in _ARRAYS) + ") t(name, level, dims, shape, dtype))"


def _arrays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ARRAYS, "name string, level int, dims string, shape string, dtype string")


@query("SC10_choose_arrays", f"WITH {_ARRAY_SQL}, g AS (SELECT level, dims, shape, dtype, count(*) AS n, len(string_split(dims, ',')) AS axes, string_agg(name, ',' ORDER BY name) AS names FROM a GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY axes DESC, n DESC) AS i FROM g) SELECT CAST(level AS INTEGER) AS level, dims, names FROM r WHERE i = 1")
def choose_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of arrays alike in axes, shape and type that has most axes, then most arrays."""
    g = _arrays(spark).groupBy("level", "dims", "shape", "dtype").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return g.groupBy("level").agg(F.max_by(F.struct("dims", "names"), F.struct(F.size(F.split("dims", ",")), "n")).alias("x")).select("level", "x.dims", "x.names")


@query("SC11_common_bands", f"WITH {_ARRAY_SQL} SELECT name FROM a WHERE dims = 'y,x' AND dtype = 'u2' GROUP BY name HAVING count(DISTINCT level) = 2")
def common_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrays(spark).where("dims = 'y,x' AND dtype = 'u2'").groupBy("name").agg(F.count_distinct("level").alias("k")).where("k = 2").select("name")


@query("SC13_X06_nearest_scope", f"WITH {SCENES} SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN 1 END, CASE WHEN id % 3 = 0 THEN 2 END, CASE WHEN id % 5 = 0 THEN 3 END, 4) AS scope FROM scenes")
def nearest_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attribute of the array, else of the group, the layout entry, the root."""
    at = lambda m, v: F.when(F.col("id") % m == 0, v)
    return scenes(spark, sf_dir).select("id", F.coalesce(at(2, 1), at(3, 2), at(5, 3), F.lit(4)).alias("scope"))


@query("SC14_F26_cf_time", f"WITH {SCENES} SELECT id, (9131 + CAST(cloud AS BIGINT)) * 86400000 + 43200000 AS t_ms FROM scenes")
def cf_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """days since 1995-01-01 12:00 as milliseconds."""
    base = F.unix_date(F.to_date(F.lit("1995-01-01"))).cast("long") * 86400000 + 12 * 3600000
    return scenes(spark, sf_dir).select("id", (base + F.col("cloud") * 86400000).alias("t_ms"))


@query("SC28_T02_W06_time_merge", f"WITH {SCENES} SELECT id, tile, CAST(row_number() OVER (PARTITION BY tile ORDER BY day, id) - 1 AS INTEGER) AS step FROM scenes")
def time_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes(spark, sf_dir).select("id", "tile", (F.row_number().over(Window.partitionBy("tile").orderBy("day", "id")) - 1).alias("step"))


@query("SC29_pivot_dates", f"WITH {SCENES} SELECT day, count(*) FILTER (WHERE orbit = 'F') AS F, count(*) FILTER (WHERE orbit = 'O') AS O, count(*) FILTER (WHERE orbit = 'P') AS P FROM scenes GROUP BY day")
def pivot_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scenes(spark, sf_dir).groupBy("day").pivot("orbit", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.na.fill(0, ["F", "O", "P"])


@query("SC30_F41_valid_time", f"WITH {SCENES} SELECT id, epoch_ms(CAST(day AS TIMESTAMP) + cloud * INTERVAL 1 HOUR) AS valid_ms FROM scenes")
def valid_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast time: initial time plus lead."""
    return scenes(spark, sf_dir).select("id", (F.unix_date("day").cast("long") * 86400000 + F.col("cloud") * 3600000).alias("valid_ms"))


@query("SK13_stems", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H%M%SZ') END AS stem FROM events")
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HHmmss'Z'")).alias("stem"))


@query("SK15_stac_extent", f"WITH {SCENES} SELECT tile, strftime(min(day), '%Y-%m-%dT00:00:00Z') AS start, strftime(max(day), '%Y-%m-%dT00:00:00Z') AS stop, count(DISTINCT day) AS steps, list_sort(list(DISTINCT orbit))[1] AS first_band FROM scenes GROUP BY tile")
def stac_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda c: F.date_format(c, "yyyy-MM-dd'T'00:00:00'Z'")
    return scenes(spark, sf_dir).groupBy("tile").agg(f(F.min("day")).alias("start"), f(F.max("day")).alias("stop"), F.count_distinct("day").alias("steps"), F.min("orbit").alias("first_band"))


_KEYS = "k AS (SELECT id, CASE id % 4 WHEN 0 THEN '0/data/c/' || id WHEN 1 THEN '0/zarr.json' WHEN 2 THEN 'time/c/0' ELSE 'zarr.json' END AS key FROM scenes)"


@query("X17_SK16_T03_publish_plan", f"WITH {SCENES}, {_KEYS} SELECT CASE WHEN key = 'zarr.json' THEN 3 WHEN key LIKE 'time/%' THEN 2 WHEN key LIKE '%zarr.json' THEN 1 ELSE 0 END AS phase, count(*) AS n FROM k GROUP BY 1")
def publish_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id") % 4
    key = F.when(i == 0, F.concat(F.lit("0/data/c/"), F.col("id").cast("string"))).when(i == 1, "0/zarr.json").when(i == 2, "time/c/0").otherwise("zarr.json")
    return scenes(spark, sf_dir).groupBy(plan.publish_phase(key).alias("phase")).agg(F.count("*").alias("n"))


@query("P08_U02_time_selector", f"WITH {SCENES}, d AS (SELECT day, CAST(row_number() OVER (ORDER BY day) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT day FROM scenes)) SELECT i, day FROM d WHERE strftime(day, '%Y-%m-%d') LIKE '1996-03%' OR (i >= 10 AND i < 30 AND (i - 10) % 5 = 0) OR day BETWEEN DATE '1997-01-30' AND DATE '1997-02-28' OR i = 3")
def time_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = scenes(spark, sf_dir).select("day").distinct()
    d = days.withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)
    return d.where(plan.time_selector("1996-03, 10:30:5, 1997-01-30..1997-02, 3", F.col("i"), F.date_format("day", "yyyy-MM-dd"))).select("i", "day")


@query("P10_F16_level_choice", f"WITH {SCENES} SELECT id, CAST(coalesce((SELECT max(k) FROM range(5) r(k) WHERE 10.0 * pow(2, k) <= cloud * 2), 0) AS INTEGER) AS level FROM scenes")
def level_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level for each scene's resolution (here twice its cloud share): the coarsest no coarser, else 0."""
    levels = [10.0 * 2**k for k in range(5)]
    return scenes(spark, sf_dir).select("id", plan.level_of(F.col("cloud") * 2, levels).alias("level"))


@query(
    "F14_products",
    f"""WITH {SCENES}, r AS (SELECT tile, list(DISTINCT CASE cloud % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'nir' ELSE 'co' END) AS roles FROM scenes WHERE day < DATE '1995-01-01' + INTERVAL (tile + 1) DAY GROUP BY tile),
p AS (SELECT * FROM (VALUES ('ndvi', ['nir', 'red']), ('ndwi', ['green', 'nir']), ('cross_ratio', ['co', 'cross'])) x(product, needs))
SELECT tile, product, array_to_string(list_filter(needs, lambda n: NOT list_contains(roles, n)), ',') AS missing FROM r, p""",
)
def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which functions of bands each tile's roles allow: the roles that are missing, none where it is available."""
    some = scenes(spark, sf_dir).where("day < date_add(DATE '1995-01-01', tile + 1)")
    role = F.element_at(F.array(*map(F.lit, ("red", "green", "nir", "co"))), (F.col("cloud") % 4 + 1).cast("int"))
    have = some.groupBy("tile").agg(F.collect_set(role).alias("roles"))  # at most four
    known = [f for f in functions.band_functions() if f.name in ("ndvi", "ndwi", "cross_ratio")]
    each = F.array(*[F.struct(F.lit(f.name).alias("product"), F.array_join(F.filter(F.array(*map(F.lit, f.roles)), lambda n: ~F.array_contains("roles", n)), ",").alias("missing")) for f in known])
    return have.select("tile", F.explode(each).alias("p")).select("tile", "p.*")


_POINTS = "p AS (SELECT event_id, value % 160 - 80 AS lat, (value * 7) % 340 - 170 AS lon FROM events)"


@query("F18_mercator", f"WITH {_POINTS} SELECT event_id, CAST(round((lon + 180) / 360 * 1000000) AS BIGINT) AS mx, CAST(round((1 - ln(tan(radians(lat) / 2 + pi() / 4)) / pi()) / 2 * 1000000) AS BIGINT) AS my, CAST(round(lon * 1000000) AS BIGINT) AS lon_back, CAST(round(lat * 1000000) AS BIGINT) AS lat_back FROM p")
def mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web Mercator of points in millionths of the world, and the way back in millionths of a degree."""
    p = table(spark, sf_dir, "events").select("event_id", (F.col("value") % 160 - 80).alias("lat"), ((F.col("value") * 7) % 340 - 170).alias("lon"))
    x, y = projection.mercator_forward(F.col("lon"), F.col("lat"))
    lon, lat = projection.mercator_inverse(F.col("mx"), F.col("my"))
    whole = lambda c: F.round(c * 1000000).cast("long")
    return p.withColumns({"mx": x, "my": y}).select("event_id", whole(F.col("mx")).alias("mx"), whole(F.col("my")).alias("my"), whole(lon).alias("lon_back"), whole(lat).alias("lat_back"))


@query("F18_utm_round_trip", f"WITH {_POINTS} SELECT event_id, CAST(floor((lon + 180) / 6) + 1 AS INTEGER) AS zone, lat < 0 AS south, CAST(round(lon * 1000000) AS BIGINT) AS lon, CAST(round(lat * 1000000) AS BIGINT) AS lat, true AS inside FROM p")
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to their zone's plane and back, in millionths of a degree; eastings of a zone lie within 100 to 900 km."""
    p = table(spark, sf_dir, "events").select("event_id", (F.col("value") % 160 - 80).alias("lat"), ((F.col("value") * 7) % 340 - 170).alias("lon"))
    q = p.select("event_id", projection.utm_zone(F.col("lon")).alias("zone"), (F.col("lat") < 0).alias("south"), "lon", "lat")
    e, n = projection.utm_forward(F.col("lon"), F.col("lat"), F.col("zone"), F.col("south"))
    r = q.withColumns({"e": e, "n": n})
    lon, lat = projection.utm_inverse(F.col("e"), F.col("n"), F.col("zone"), F.col("south"))
    whole = lambda c: F.round(c * 1000000).cast("long")
    return r.select("event_id", "zone", "south", whole(lon).alias("lon"), whole(lat).alias("lat"), (F.col("e").between(100000, 900000) & F.col("n").between(0, 10000000)).alias("inside"))


@query(
    "V04_levels_mirror",
    f"""WITH {SCENES}, d AS (SELECT DISTINCT tile, cloud AS level FROM scenes WHERE id % 3 <> 0), f AS (SELECT DISTINCT tile, cloud AS level FROM scenes WHERE id % 4 <> 1)
SELECT coalesce(d.tile, f.tile) AS tile, coalesce(d.level, f.level) AS level, CASE WHEN f.tile IS NULL THEN 'declared but absent' ELSE 'not declared' END AS problem FROM d FULL JOIN f ON d.tile = f.tile AND d.level = f.level WHERE d.tile IS NULL OR f.tile IS NULL""",
)
def levels_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that metadata declares against the groups that are there, both ways."""
    s = scenes(spark, sf_dir)
    declared, found = (s.where(c).select("tile", F.col("cloud").alias("level")).distinct() for c in ("id % 3 <> 0", "id % 4 <> 1"))
    return plan.mirror_problems(declared, found, ["tile", "level"])


@query(
    "V08_coordinate_mirror",
    """WITH v AS (SELECT event_id, value AS stored, CASE WHEN event_id % 13 = 0 THEN value * 1.0001 + 0.01 WHEN event_id % 11 = 0 THEN NULL ELSE value * (1 + 1e-12) END AS mirrored FROM events)
SELECT event_id, CASE WHEN mirrored IS NULL THEN 'missing' ELSE 'differs' END AS problem FROM v WHERE mirrored IS NULL OR abs(stored - mirrored) > 1e-8 + 1e-5 * abs(mirrored)""",
)
def coordinate_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a coordinate array against their mirror in the metadata, within tolerance."""
    v = F.col("value")
    mirrored = F.when(F.col("event_id") % 13 == 0, v * 1.0001 + 0.01).when(F.col("event_id") % 11 == 0, None).otherwise(v * (1 + 1e-12))
    e = table(spark, sf_dir, "events").select("event_id", v.alias("stored"), mirrored.alias("mirrored"))
    return e.withColumn("problem", plan.value_problem(F.col("stored"), F.col("mirrored"))).where("problem IS NOT NULL").select("event_id", "problem")


@query(
    "X12_append_validity",
    f"""WITH {SCENES}, s AS (SELECT tile, day, CASE WHEN tile % 3 = 0 THEN 'mask' WHEN tile % 3 = 1 THEN 'sentinel' ELSE 'none' END AS base, CASE orbit WHEN 'F' THEN 'mask' WHEN 'O' THEN 'sentinel' ELSE 'none' END AS batch FROM scenes)
SELECT tile, count_if(base = batch OR (base = 'mask' AND batch = 'sentinel') OR (base <> 'none' AND batch = 'none')) AS accepted, count_if(NOT (base = batch OR (base = 'mask' AND batch = 'sentinel') OR (base <> 'none' AND batch = 'none'))) AS refused FROM s GROUP BY tile""",
)
def append_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose way to say what is valid the store can take over: its own, a sentinel as a mask, or one where all is valid."""
    base = F.element_at(F.array(*map(F.lit, ("mask", "sentinel", "none"))), (F.col("tile") % 3 + 1).cast("int"))
    batch = F.when(F.col("orbit") == "F", "mask").when(F.col("orbit") == "O", "sentinel").otherwise("none")
    ok = plan.takes_validity(base, batch)
    return scenes(spark, sf_dir).groupBy("tile").agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("refused"))


@query("P11_wrap_bbox", "SELECT event_id, ((value * 37 + 180) % 360 + 360) % 360 - 180 AS lon FROM events WHERE ((value * 37 + 180) % 360 + 360) % 360 - 180 BETWEEN -20 AND 45")
def wrap_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon = (((F.col("value") * 37 + 180) % 360 + 360) % 360 - 180).alias("lon")
    return table(spark, sf_dir, "events").select("event_id", lon).where("lon BETWEEN -20 AND 45")


@query("P12_version_gate", "SELECT v, regexp_matches(v, '^0\\.[34]\\.[0-9]+$') AS ok FROM (VALUES ('0.3.0'), ('0.4.12'), ('0.5.0'), ('1.0'), ('0.3')) x(v)")
def version_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame([(x,) for x in ("0.3.0", "0.4.12", "0.5.0", "1.0", "0.3")], "v string")
    return v.withColumn("ok", F.col("v").rlike(r"^0\.[34]\.[0-9]+$"))


@query("A39_T07_bench_quantiles", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(CASE WHEN i = floor(n * 0.5::DOUBLE) THEN value END) AS p50, max(CASE WHEN i = floor(n * 0.95::DOUBLE) THEN value END) AS p95 FROM r GROUP BY event_type")
def bench_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.index_percentiles(table(spark, sf_dir, "events"), "value", (0.5, 0.95), ("event_type",))
    at = lambda q: F.max(F.when(F.col("share") == q, F.col("value")))
    return p.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("A40_F32_digests", f"WITH {SCENES} SELECT tile, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS etag, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS digest FROM scenes GROUP BY tile")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    g = scenes(spark, sf_dir).groupBy("tile").agg(ids.alias("ids"))
    return g.select("tile", F.md5("ids").alias("etag"), F.sha2("ids", 256).alias("digest"))


@query("W03_W04_disordered", f"WITH {SCENES}, w AS (SELECT tile, id, day, lag(day) OVER (PARTITION BY tile ORDER BY id, day) AS before FROM scenes) SELECT tile, id, day, before FROM w WHERE day <= before")
def disordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.disordered(scenes(spark, sf_dir).select("tile", "id", "day"), "day", "id", ("tile",))


@query("W10_scrub_cost", "SELECT CAST(i AS INTEGER) AS frame, CAST(least((i - 20 + 83) % 83, 2 * ((20 - i + 83) % 83)) AS INTEGER) AS cost FROM range(83) r(i)")
def scrub_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each frame from frame 20 on a ring, twice as dear backwards."""
    i, n, at = int_(F.col("id")), 83, 20
    return spark.range(n).select(i.alias("frame"), F.least((i - at + n) % n, 2 * ((at - i + n) % n)).alias("cost"))


@query("T08_capped_lists", f"WITH {SCENES}, r AS (SELECT tile, id, row_number() OVER (PARTITION BY tile ORDER BY id) AS i, count(*) OVER (PARTITION BY tile) AS n FROM scenes) SELECT tile, string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id) || ' and ' || CAST(max(n) - 5 AS VARCHAR) || ' more' AS message FROM r WHERE i <= 5 GROUP BY tile")
def capped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of each list and how many more there are; the counts are sums, the lists group limits."""
    s = scenes(spark, sf_dir)
    some = s.withColumn("i", F.row_number().over(Window.partitionBy("tile").orderBy("id"))).where("i <= 5").groupBy("tile").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    n = s.groupBy("tile").agg(F.count("*").alias("n"))
    return some.join(n, "tile").select("tile", F.concat(F.array_join(F.transform("ids", lambda x: x.cast("string")), ", "), F.lit(" and "), (F.col("n") - 5).cast("string"), F.lit(" more")).alias("message"))


@query("T09_byte_budget", f"WITH {SCENES}, w AS (SELECT tile, id, CAST(sum(cloud) OVER (PARTITION BY tile ORDER BY day, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM scenes) SELECT tile, id, used FROM w WHERE used <= 1000")
def byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.running_budget(scenes(spark, sf_dir), "cloud", ["day", "id"], 1000, ["tile"]).select("tile", "id", "used")


@query("U01_U06_union_steps", f"WITH {SCENES} SELECT DISTINCT day FROM (SELECT day FROM scenes WHERE tile = 1 UNION ALL SELECT day FROM scenes WHERE tile = 2) q")
def union_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scenes(spark, sf_dir)
    return s.where("tile = 1").select("day").unionByName(s.where("tile = 2").select("day")).distinct()


@query("U07_month_range", f"WITH {SCENES}, e AS (SELECT min(day) AS a, max(day) AS z FROM scenes), m AS (SELECT CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', z), INTERVAL 1 MONTH)) AS DATE) AS first FROM e) SELECT first, last_day(first) AS last FROM m")
def month_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scenes(spark, sf_dir).agg(F.trunc(F.min("day"), "month").alias("a"), F.trunc(F.max("day"), "month").alias("z"))
    return e.select(F.explode(F.expr("sequence(a, z, interval 1 month)")).alias("first")).withColumn("last", F.last_day("first"))


@query("F13_roles", "SELECT * FROM (VALUES ('red', 'B04'), ('green', 'B03'), ('nir', 'B08')) x(role, band)")
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of each role: by common name, else by name, else by alias."""
    bands = spark.createDataFrame([("B03", "green"), ("B04", None), ("B08", "nir"), ("B8A", "nir")], "name string, common string")
    # Aliases of roles.
    alias = spark.createDataFrame([("red", "B04"), ("green", "B03"), ("nir", "B08")], "role string, alias string")
    rank = F.when(F.col("common") == F.col("role"), 0).when(F.col("name") == F.col("role"), 1).when(F.col("name") == F.col("alias"), 2)
    both = alias.join(F.broadcast(bands), (F.col("common") == F.col("role")) | (F.col("name") == F.col("role")) | (F.col("name") == F.col("alias")))
    return both.groupBy("role").agg(F.min_by("name", F.struct(rank, "name")).alias("band"))


@query("F15_parse_roles", "SELECT * FROM (VALUES ('B04', 'red'), ('B08', 'nir'), ('VV', 'co')) x(name, role)")
def parse_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = spark.createDataFrame([("B04=red, B08=nir,VV=co",)], "spec string")
    pair = F.split(F.trim(F.col("p")), "=")
    return spec.select(F.explode(F.split("spec", ",")).alias("p")).select(pair[0].alias("name"), pair[1].alias("role"))


@query("F17_F38_level_shapes", "SELECT CAST(k AS INTEGER) AS level, CAST(ceil(2765 / pow(2, k)) AS INTEGER) AS h, CAST(ceil(2759 / pow(2, k)) AS INTEGER) AS w, CAST(ceil(ceil(2765 / pow(2, k)) / 512) AS INTEGER) AS rows, CAST(ceil(ceil(2759 / pow(2, k)) / 512) AS INTEGER) AS cols FROM range(5) r(k)")
def level_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda size: F.ceil(F.lit(float(size)) / F.pow(F.lit(2.0), F.col("id")))
    return spark.range(5).select(int_(F.col("id")).alias("level"), int_(n(2765)).alias("h"), int_(n(2759)).alias("w"), int_(F.ceil(n(2765) / 512)).alias("rows"), int_(F.ceil(n(2759) / 512)).alias("cols"))


@query("F18_F19_utm", "WITH p AS (SELECT event_id, value % 90 - 45 AS lat, (value * 7) % 340 - 170 AS lon FROM events) SELECT event_id, CAST(floor((lon + 180) / 6) + 1 AS INTEGER) AS zone, lat >= 0 AS north FROM p")
def utm_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").select("event_id", (F.col("value") % 90 - 45).alias("lat"), ((F.col("value") * 7) % 340 - 170).alias("lon"))
    return p.select("event_id", int_(F.floor((F.col("lon") + 180) / 6) + 1).alias("zone"), (F.col("lat") >= 0).alias("north"))


@query("F20_X04_snap_grid", f"WITH {SCENES} SELECT id, floor((cloud * 7.3::DOUBLE) / 10) * 10 AS x0, ceil((cloud * 7.3::DOUBLE + 55) / 10) * 10 AS x1 FROM scenes")
def snap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("cloud") * F.lit(7.3)
    return scenes(spark, sf_dir).select("id", (F.floor(at / 10).cast("double") * 10).alias("x0"), (F.ceil((at + 55) / 10).cast("double") * 10).alias("x1"))


@query("F27_F28_iso_labels", "SELECT event_id, CAST(epoch_ms(date_trunc('second', ts)) - 7200000 AS BIGINT) AS t_ms, strftime(ts, '%b %Y') AS label FROM events")
def iso_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO times with an offset as UTC milliseconds, and month labels."""
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.to_timestamp(iso, "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("t_ms"), F.date_format("ts", "MMM yyyy").alias("label"))


@query("F30_range_header", "SELECT h, CAST(nullif(regexp_extract(h, '^bytes=([0-9]+)-([0-9]*)$', 1), '') AS BIGINT) AS first, CAST(nullif(regexp_extract(h, '^bytes=([0-9]+)-([0-9]*)$', 2), '') AS BIGINT) AS last FROM (VALUES ('bytes=0-99'), ('bytes=100-'), ('bytes=-5'), ('x')) t(h)")
def range_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = spark.createDataFrame([(x,) for x in ("bytes=0-99", "bytes=100-", "bytes=-5", "x")], "h string")
    part = lambda i: F.regexp_extract("h", "^bytes=([0-9]+)-([0-9]*)$", i).try_cast("long")
    return h.select("h", part(1).alias("first"), part(2).alias("last"))


@query("F36_props_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("F37_explode_chunks", "SELECT vec_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, embedding[i] AS v FROM embeddings, range(1, 65) r(i)")
def explode_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows of 8 x 8 values as pixels."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).alias("x"), "v")


@query("F37_pack_chunks", "SELECT vec_id, CAST(8 AS INTEGER) AS h, CAST(8 AS INTEGER) AS w, CAST(len(embedding) AS INTEGER) AS n, embedding[1] AS first, embedding[64] AS last FROM embeddings")
def pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels packed into chunk rows again, in order of their places."""
    p = explode_chunks(spark, sf_dir)
    data = F.transform(F.array_sort(F.collect_list(F.struct((F.col("y") * 8 + F.col("x")).alias("i"), "v"))), lambda s: s["v"])
    g = p.groupBy("vec_id").agg(int_(F.max("y") + 1).alias("h"), int_(F.max("x") + 1).alias("w"), data.alias("d"))
    return g.select("vec_id", "h", "w", F.size("d").alias("n"), F.element_at("d", 1).alias("first"), F.element_at("d", -1).alias("last"))


_LEVELS = [(0, 20, 15, 10.0), (1, 10, 8, 20.0), (2, 5, 4, 40.0), (3, 3, 3, 80.0)]


@query("V02_V03_ladder", "SELECT CAST(3 AS INTEGER) AS level, 'width is not half of the level before' AS message")
def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that aren't half of the one before, rounded up."""
    v = spark.createDataFrame(_LEVELS, "level int, h int, w int, r double")
    o = Window.orderBy("level")
    before = v.select("*", F.lag("h").over(o).alias("ph"), F.lag("w").over(o).alias("pw"), F.lag("r").over(o).alias("pr"))
    rules = [("problem", "height is not half of the level before", F.col("level"), F.col("h") != F.ceil(F.col("ph") / 2)), ("problem", "width is not half of the level before", F.col("level"), F.col("w") != F.ceil(F.col("pw") / 2)), ("problem", "resolution is not twice that of the level before", F.col("level"), F.abs(F.col("r") - 2 * F.col("pr")) > 1e-6)]
    return plan.findings(before, rules).select(F.col("place").cast("int").alias("level"), "message")


@query("V05_inventory", f"WITH {SCENES}, {_OBJECTS} SELECT l.key FROM lo l JOIN re r ON l.key = r.key WHERE l.size <> r.size")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose size isn't the one that the inventory states."""
    s = scenes(spark, sf_dir).withColumn("key", F.concat(F.lit("c/"), F.col("id").cast("string")))
    a = s.where("id % 3 <> 0").select("key", F.col("cloud").alias("size"))
    b = s.where("id % 5 <> 0").select("key", F.when(F.col("id") % 10 == 1, F.col("cloud") + 1).otherwise(F.col("cloud")).alias("stated"))
    return a.join(b, "key").where("size <> stated").select("key")


@query("V10_append_mismatches", "SELECT * FROM (VALUES ('dtype', 'uint16', 'int16'), ('nodata', '0', NULL)) x(field, expected, got)")
def append_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["crs", "dtype", "bands", "nodata", "mask"]
    row = "crs string, dtype string, bands string, nodata int, mask boolean"
    base, batch = spark.createDataFrame([("EPSG:32631", "uint16", "B04,B08", 0, False)], row), spark.createDataFrame([("EPSG:32631", "int16", "B04,B08", None, False)], row)
    return plan.append_mismatches(base, batch, fields)


@query("V12_V11_series_consistency", f"WITH {SCENES}, f AS (SELECT tile, arg_min(orbit, (day, id)) AS orbit FROM scenes GROUP BY tile) SELECT s.tile, count(*) AS differing FROM scenes s JOIN f USING (tile) WHERE s.orbit <> f.orbit GROUP BY s.tile")
def series_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a series that differ from its first one."""
    s = scenes(spark, sf_dir)
    first = s.groupBy("tile").agg(F.min_by("orbit", F.struct("day", "id")).alias("expected"))
    return s.join(first, "tile").where("orbit <> expected").groupBy("tile").agg(F.count("*").alias("differing"))


@query("X07_nodata_tokens", "SELECT * FROM (VALUES ('uint8', '255', 255.0::DOUBLE), ('uint8', '-1', NULL), ('int16', '-32768', -32768.0), ('uint16', 'nan', NULL), ('float32', '-9999.5', -9999.5)) x(dtype, token, nodata)")
def nodata_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared nodata as a number, unset where the type can't hold it."""
    t = spark.createDataFrame([("uint8", "255"), ("uint8", "-1"), ("int16", "-32768"), ("uint16", "nan"), ("float32", "-9999.5")], "dtype string, token string")
    v = F.col("token").try_cast("double")
    low = F.when(F.col("dtype").startswith("u"), 0).when(F.col("dtype") == "int16", -32768)
    high = F.when(F.col("dtype") == "uint8", 255).when(F.col("dtype") == "uint16", 65535).when(F.col("dtype") == "int16", 32767)
    fits = F.when(F.isnan(v), False).otherwise((F.col("dtype") == "float32") | (v.between(low, high) & (v == F.floor(v))))
    return t.select("dtype", "token", F.when(fits, v).alias("nodata"))


@query("X16_day_of_year", f"WITH {SCENES}, n AS (SELECT id, CAST(1996 + id % 3 AS INTEGER) AS y, CAST(1 + id % 366 AS INTEGER) AS doy FROM scenes) SELECT id, CASE WHEN year(make_date(y, 1, 1) + (doy - 1)) = y THEN make_date(y, 1, 1) + (doy - 1) END AS day FROM n")
def day_of_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year and day of the year in a name as a day, null where the year has no such day."""
    y, doy = int_(F.lit(1996) + F.col("id") % 3), int_(F.lit(1) + F.col("id") % 366)
    day = F.date_add(F.make_date(y, F.lit(1), F.lit(1)), doy - 1)
    return scenes(spark, sf_dir).select("id", F.when(F.year(day) == y, day).alias("day"))
