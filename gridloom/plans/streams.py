"""The streaming operators over stored events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.registry import query, table
from gridloom.streaming import rasters


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("cents", F.rint(F.col("value") * 100).cast("long"))


@query("ST4_period_composite", "SELECT date_trunc('day', ts) AS start, event_type, count(value) AS n, CAST(sum(CAST(round_even(value * 100, 0) AS BIGINT)) AS BIGINT) AS total, min(CAST(round_even(value * 100, 0) AS BIGINT)) AS lo, max(CAST(round_even(value * 100, 0) AS BIGINT)) AS hi FROM events GROUP BY 1, 2")
def period_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.period_composite(_events(spark, sf_dir), "ts", ["event_type"], "cents")


@query(
    "ST7_passes",
    """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pass FROM m) SELECT min(ts) AS start, max(ts) AS last, event_type, count(*) AS n FROM s GROUP BY event_type, pass""",
)
def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.passes(table(spark, sf_dir, "events"), "ts", ["event_type"])
