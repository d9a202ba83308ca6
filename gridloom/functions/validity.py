"""Which pixels are valid, and how a store should say so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_valid(value: Column, nodata: Column | None = None, mask: Column | None = None) -> Column:
    """A mask decides where there is one (1 is valid), else the sentinel; not-a-number is never valid, and without either all else is."""
    number = value.isNotNull() & ~F.isnan(value.cast("double"))
    by_value = number if nodata is None else number & ~value.eqNullSafe(nodata)
    return by_value if mask is None else number & F.when(mask.isNotNull(), mask == 1).otherwise(by_value)


def is_valid_backscatter(power: Column, mask: Column) -> Column:
    """Radar power is valid where it is finite and above zero and its mask is neither 0 (no data) nor 255 (outside)."""
    p = power.cast("double")
    return power.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf")) & (p > 0) & ~F.coalesce(mask, F.lit(0)).isin(0, 255)


def validity_strategy(pixels: DataFrame, nodata: int | float, keys: tuple[str, ...]) -> DataFrame:
    """sentinel, mask or none by keys: a sentinel serves unless a valid pixel has its value; none where all are valid.

    pixels: keys, v, valid (as the source's own masks say).
    """
    g = pixels.groupBy(*keys).agg(F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("valid") & (F.col("v") == nodata)).alias("taken"))
    return g.select(*keys, F.when(F.col("invalid") == 0, "none").when(F.col("taken") == 0, "sentinel").otherwise("mask").alias("strategy"), "invalid", "taken")
