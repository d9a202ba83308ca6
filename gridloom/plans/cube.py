"""The cube that queries look at: months x flags x suppliers x parts of lineitem, with gaps.

t = month from 1995-01, b = return flag (0 red, 1 green, 2 near infrared), y, x = supplier and part on a fixed
grid, v = quantity, n = rows. A formula mask leaves gaps at every scale.
"""

from __future__ import annotations

import functools
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.registry import table

STEPS, BANDS, HEIGHT, WIDTH, CELL = 83, 3, 20, 15, 8

CUBE = """cube AS (SELECT CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS t, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS b,
  CAST(l_suppkey % 20 AS INTEGER) AS y, CAST(l_partkey % 15 AS INTEGER) AS x, CAST(sum(l_quantity) AS INTEGER) AS v, CAST(least(count(*), 255) AS INTEGER) AS n
  FROM lineitem GROUP BY 1, 2, 3, 4),
px AS (SELECT * FROM cube WHERE (7 * t + 3 * y + 5 * x) % 11 <> 0)"""
GRID = """grid AS (SELECT CAST(t AS INTEGER) AS t, CAST(b AS INTEGER) AS b, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x
  FROM range(83) r1(t), range(3) r2(b), range(20) r3(y), range(15) r4(x)),
dense AS (SELECT g.*, coalesce(p.v, 0) AS v, coalesce(p.n, 0) AS n, p.v IS NOT NULL AS valid FROM grid g LEFT JOIN px p USING (t, b, y, x))"""


def int_(c: Column) -> Column:
    return c.cast("int")


def days_of(steps: list[int]) -> Column:
    """Whether a ship date lies in one of the steps' months: bounds on the stored column, which reach the Parquet scan."""
    first = lambda t: date(1995 + t // 12, t % 12 + 1, 1)
    runs: list[list[int]] = []
    for t in sorted(set(steps)):
        if runs and runs[-1][1] == t:
            runs[-1][1] = t + 1
        else:
            runs.append([t, t + 1])
    return functools.reduce(lambda x, y: x | y, [(F.col("l_shipdate") >= F.lit(first(a))) & (F.col("l_shipdate") < F.lit(first(z))) for a, z in runs], F.lit(False))


def pixels(spark: SparkSession, sf_dir: str, steps: list[int] | None = None) -> DataFrame:
    """Valid pixels: t, b, y, x, v, n; of some steps only, if they are named."""
    li = table(spark, sf_dir, "lineitem")
    if steps is not None:
        li = li.where(days_of(steps))
    keys = li.select(
        int_((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).alias("t"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("b"),
        int_(F.col("l_suppkey") % HEIGHT).alias("y"), int_(F.col("l_partkey") % WIDTH).alias("x"), "l_quantity",
    )
    some = keys.where((7 * F.col("t") + 3 * F.col("y") + 5 * F.col("x")) % 11 != 0)
    return some.groupBy("t", "b", "y", "x").agg(int_(F.sum("l_quantity")).alias("v"), int_(F.least(F.count("*"), F.lit(255))).alias("n"))


def lattice(spark: SparkSession, steps: int = STEPS, bands: int = BANDS, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """All t, b, y, x of a grid, from one range: no join."""
    i = F.col("id")
    return spark.range(steps * bands * height * width).select(
        int_(F.expr(f"id div {bands * height * width}")).alias("t"), int_(F.expr(f"id div {height * width}") % bands).alias("b"), int_(F.expr(f"id div {width}") % height).alias("y"), int_(i % width).alias("x")
    )


def dense(spark: SparkSession, sf_dir: str, steps: list[int] | None = None) -> DataFrame:
    """Every pixel of the grid: t, b, y, x, v and n (0 where there is none), valid; of some steps only, if they are named."""
    keys = ["t", "b", "y", "x"]
    px = pixels(spark, sf_dir, steps).withColumn("valid", F.lit(True))
    grid = lattice(spark) if steps is None else lattice(spark).where(F.col("t").isin(steps))
    return grid.join(px, keys, "left").select(*keys, F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("valid", F.lit(False)).alias("valid"))
