"""Lists of dated files: manifests in CSV and JSON, and listings of folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import planning, rules
from gridloom.sources.zarr import opened, read_object

#: Suffixes of rasters; other files beside them are not listed.
SUFFIXES = ("tif", "tiff", "png", "jp2", "webp")


def list_rasters(spark: SparkSession, path: str, pattern: str | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """uri, name, size, modified, state, day of the rasters under a folder; only the listing is read, no content.

    Dates are found in names, or by a pattern such as ndvi_%Y%j.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    some = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*suffixes))
    named = some.select(F.col("path").alias("uri"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if pattern is None:
        return planning.dated(named)
    day = rules.time_by_pattern(F.col("name"), pattern)
    return named.withColumn("state", F.when(day.isNull(), "undated").otherwise("dated")).withColumn("day", day.cast("date"))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, list[str] | None, list[float] | None]:
    """Entries (uri, time in UTC) of a manifest, its band names and its bounds.

    CSV: uri, datetime and maybe bands (by semicolons). JSON: a list of such objects, or an object with items
    and maybe bands and bounds. Relative names are those of the manifest's folder. Refused are rows without
    a name or a readable time, two rows of one time, and bands that differ between rows.
    """
    bounds, top = None, None
    if path.lower().endswith(".csv"):
        rows = spark.read.option("header", "true").option("escape", '"').csv(path)
        if lacking := {"uri", "datetime"} - set(rows.columns):
            raise ValueError(f"{path}: the header lacks {sorted(lacking)}")
        bands = F.filter(F.transform(F.split("bands", ";"), F.trim), lambda b: b != "") if "bands" in rows.columns else F.lit(None).cast("array<string>")
        rows = rows.select("uri", "datetime", bands.alias("bands"))
    elif path.lower().endswith(".json"):
        raw = read_object(*opened(path))  # a manifest is small beside its files
        if raw is None:
            raise FileNotFoundError(path)
        document = json.loads(raw)
        items = document.get("items", []) if isinstance(document, dict) else document
        if isinstance(document, dict):
            top, bounds = document.get("bands"), document.get("bounds")
        rows = spark.createDataFrame([(i.get("uri"), i.get("datetime"), i.get("bands")) for i in items], "uri string, datetime string, bands array<string>")
    else:
        raise ValueError(f"{path}: a manifest is .csv or .json")
    folder = path.rpartition("/")[0]
    uri = F.when(F.col("uri").rlike("^([a-z][a-z0-9+.-]*://|/)"), F.col("uri")).otherwise(F.concat(F.lit(f"{folder}/"), "uri"))
    time = F.try_to_timestamp(F.trim("datetime"))
    entries = rows.select(uri.alias("uri"), time.alias("time"), F.when(F.size("bands") > 0, F.col("bands")).alias("bands"))
    facts = entries.agg(
        F.count("*").alias("n"), F.count("uri").alias("named"), F.count("time").alias("timed"), F.count_distinct("time").alias("times"),
        F.count_distinct("bands").alias("lists"), F.first("bands", ignorenulls=True).alias("bands"),
    ).first()
    if not facts["n"]:
        raise ValueError(f"{path}: no rows")
    if facts["named"] < facts["n"] or facts["timed"] < facts["n"]:
        raise ValueError(f"{path}: a row has no uri or no datetime that can be read")
    if facts["times"] < facts["n"]:
        raise ValueError(f"{path}: two rows have the same datetime")
    if facts["lists"] > 1 or (top and facts["bands"] and list(top) != facts["bands"]):
        raise ValueError(f"{path}: rows name different bands")
    return entries.select("uri", "time").orderBy("time"), top or facts["bands"], bounds


def write_manifest(files: DataFrame, path: str, bands: list[str] | None = None) -> None:
    """Write files (uri, day; null where undated) as a folder of CSV that read_manifest reads: undated rows have an empty datetime."""
    extra = [F.lit(";".join(bands)).alias("bands")] if bands else []
    files.select("uri", F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("")).alias("datetime"), *extra).write.mode("errorifexists").option("header", "true").option("emptyValue", "").csv(path)
