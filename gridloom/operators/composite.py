"""Temporal compositing, gap filling and change metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.pyramid import floor_div


def median_composite(scenes: DataFrame, period: Column, keys: tuple[str, ...] = ("b", "y", "x")) -> DataFrame:
    """Median of the valid values (above 0) of each pixel and period; of an even number the floor of the two middle ones' mean.

    Returns period, keys, v, k (valid scenes). Without a valid value v and k are 0. A period's values of one
    pixel are a few dozen, one for each scene.
    """
    g = scenes.groupBy(period.alias("period"), *keys).agg(F.array_sort(F.collect_list(F.when(F.col("v") > 0, F.col("v")))).alias("a"))
    k = F.size("a")
    middle = floor_div(F.element_at("a", F.expr("(size(a) - 1) div 2 + 1").cast("int")) + F.element_at("a", F.expr("size(a) div 2 + 1").cast("int")), F.lit(2))
    return g.select("period", *keys, F.when(k > 0, middle).otherwise(0).cast("int").alias("v"), k.alias("k"))


def carry_forward(composite: DataFrame, time: str = "t", keys: tuple[str, ...] = ("y", "x"), bands: tuple[str, ...] = ("v0", "v1", "v2")) -> DataFrame:
    """Pixels whose bands are all 0 take all bands of the latest earlier step that has any; filled tells which did."""
    any_band = F.greatest(*[F.col(b) for b in bands]) > 0
    past = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(any_band, F.struct(*bands)), ignorenulls=True).over(past)
    got = composite.withColumn("__last", last)
    values = [F.coalesce(F.col(f"__last.{b}"), F.lit(0)).alias(b) for b in bands]
    return got.select(time, *keys, *values, (~any_band & F.col("__last").isNotNull()).alias("filled"))


def comparison_step(t: Column, steps: int, every: int = 6) -> Column:
    """The nearest comparison frame (0, every, 2 every, ...) of a time, the earlier of two equally near."""
    last = (steps - 1) // every * every
    return F.least(F.lit(every) * F.floor((t + (every - 1) // 2) / F.lit(every)), F.lit(last)).cast("int")


def volatility(pixels: DataFrame, steps: int, cell: int, every: int = 6) -> DataFrame:
    """Mean absolute difference to the nearest comparison frame by cell, over 10000 and cut to 0..1; invalid pixels count.

    pixels: every pixel (t, b, y, x, v). Frames are compared within a pixel's own rows, so that one exchange by
    pixel does, no self-join.
    """
    t = F.col("t")
    q = comparison_step(t, steps, every)
    by = Window.partitionBy("b", "y", "x", q)
    framed = pixels.withColumn("__q", F.max(F.when(t == q, F.col("v"))).over(by)).where((t != q) & F.col("__q").isNotNull())
    cells = framed.groupBy(F.expr(f"y div {cell}").cast("int").alias("row"), F.expr(f"x div {cell}").cast("int").alias("col")).agg(F.sum(F.abs(F.col("v") - F.col("__q"))).cast("long").alias("total"), F.count("*").alias("n"))
    return cells.select("row", "col", "total", "n", F.least(F.lit(1.0), F.col("total") / F.col("n") / F.lit(10000.0)).cast("float").alias("volatility"))


def recovered_counts(fractions: DataFrame, largest: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The smallest n for which every fraction c (float) is k / n in single precision, by keys: keys, n; no row where there is none."""
    tried = fractions.select(*keys, "c").distinct().select(*keys, "c", F.explode(F.sequence(F.lit(1), F.lit(largest))).alias("n"))
    k = F.rint(F.col("c").cast("double") * F.col("n"))
    fits = (k / F.col("n")).cast("float") == F.col("c")
    good = tried.groupBy(*keys, "n").agg(F.bool_and(fits).alias("ok")).where("ok")
    return good.groupBy(*keys).agg(F.min("n").alias("n"))


def first_finite(slices: DataFrame, keys: tuple[str, ...], order: str, value: str = "v") -> DataFrame:
    """Overlapping slices of a pass: the first value that is there, in order of the slices."""
    return slices.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value))
