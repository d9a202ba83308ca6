"""Overview pyramids: each level halves the one before, with odd edges repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floor_div(total: Column, n: Column) -> Column:
    """Floor of an exact integer quotient; null where n is 0."""
    t, m = total.cast("long"), n.cast("long")
    return F.when(m > 0, ((t - F.pmod(t, F.when(m > 0, m).otherwise(F.lit(1)))) / m).cast("long"))


def edge_weight(height: int, width: int) -> Column:
    """How often a pixel counts: an odd last row or column is repeated before reduction."""
    row = F.when((F.lit(height % 2) == 1) & (F.col("y") == height - 1), 2).otherwise(1)
    col = F.when((F.lit(width % 2) == 1) & (F.col("x") == width - 1), 2).otherwise(1)
    return row * col


def downsample(pixels: DataFrame, height: int, width: int, value: str = "v", as_float: bool = False, keys: tuple[str, ...] = ("t", "b")) -> DataFrame:
    """2x2 means of valid pixels (rows that exist): floor of the integer mean, or the mean as float.

    Cells without a valid pixel have no row. Adds nothing but keys, y, x, the value and w, the weight behind it.
    """
    w = edge_weight(height, width)
    kind = "double" if as_float else "long"
    halved = pixels.select(*keys, F.expr("y div 2").cast("int").alias("y"), F.expr("x div 2").cast("int").alias("x"), F.col(value).cast(kind).alias("q"), w.alias("w"))
    sums = halved.groupBy(*keys, "y", "x").agg(F.sum(F.col("q") * F.col("w")).alias("s"), F.sum("w").cast("int").alias("w"))
    mean = (F.col("s") / F.col("w")).cast("float") if as_float else floor_div(F.col("s"), F.col("w")).cast("int")
    return sums.select(*keys, "y", "x", mean.alias(value), "w")


def reduce_planes(pixels: DataFrame, height: int, width: int, keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """mask: largest of four; coverage: half-up mean of four, invalid ones included. Needs every pixel of the plane."""
    w = edge_weight(height, width)
    return (
        pixels.select(*keys, F.expr("y div 2").cast("int").alias("y"), F.expr("x div 2").cast("int").alias("x"), "mask", (F.col("coverage") * w).alias("c"))
        .groupBy(*keys, "y", "x")
        .agg(F.max("mask").cast("int").alias("mask"), F.expr("(sum(c) + 2) div 4").cast("int").alias("coverage"))
    )


def half(n: int) -> int:
    return -(-n // 2)


def pyramid(pixels: DataFrame, height: int, width: int, levels: int) -> DataFrame:
    """Levels 0 to levels, each made from the one before: level, t, b, y, x, v. A lineage of a dozen steps at most."""
    out = pixels.select(F.lit(0).alias("level"), "t", "b", "y", "x", "v")
    last, h, w = pixels, height, width
    for k in range(1, levels + 1):
        last = downsample(last, h, w)
        h, w = half(h), half(w)
        out = out.unionByName(last.select(F.lit(k).alias("level"), "t", "b", "y", "x", "v"))
    return out


def guard_sentinel(level: DataFrame, nodata: int, unsigned: bool = True, has_mask: bool = False) -> DataFrame:
    """The level as it is; the job fails if a valid mean equals nodata, unless that can't mislead."""
    if has_mask or (unsigned and nodata == 0):
        return level
    message = F.lit(f"a valid mean equals nodata {nodata}")
    return level.withColumn("v", F.when(F.col("v") == nodata, F.raise_error(message).cast("int")).otherwise(F.col("v")))


def block_mean(pixels: DataFrame, n: int, height: int, width: int, keys: tuple[str, ...] = ("t", "b")) -> DataFrame:
    """n x n means of valid pixels; rows and columns that fill no block are left out. s and k: sum and number."""
    inside = pixels.where((F.col("y") < height // n * n) & (F.col("x") < width // n * n))
    g = inside.groupBy(*keys, F.expr(f"y div {n}").cast("int").alias("y"), F.expr(f"x div {n}").cast("int").alias("x")).agg(F.sum("v").cast("long").alias("s"), F.count("*").alias("k"))
    return g.withColumn("mean", F.col("s") / F.col("k"))


def multilook(pixels: DataFrame, height: int, width: int, keys: tuple[str, ...] = ("t", "b")) -> DataFrame:
    """2x2 means, null if any of the four is missing."""
    blocks = block_mean(pixels, 2, height, width, keys)
    return blocks.select(*keys, "y", "x", F.when(F.col("k") == 4, F.col("mean")).alias("mean"))
