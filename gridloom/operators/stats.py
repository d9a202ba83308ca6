"""Histograms, thresholds, ranges, fill values and other statistics of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(values: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """Counts of every integer from low to high: bin, n. Bins without a value are there with 0."""
    counts = values.groupBy(F.col(value).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    bins = values.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def otsu(hist: DataFrame) -> DataFrame:
    """The threshold of largest variance between classes, the middle of a plateau, as one row: threshold, total, separability.

    separability: that variance as a share of the whole variance. The histogram has one row a bin, a bounded number,
    so its running sums are one small window. Products of sums are decimals, so counts may reach 1e13 and more.
    """
    order = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    run = hist.select("bin", F.sum("n").over(order).alias("w"), F.sum(F.col("n") * F.col("bin")).over(order).alias("m"))
    totals = hist.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("bin")).alias("moment"), F.sum(exact("n") * F.col("bin") * F.col("bin")).alias("square"))
    both = run.join(F.broadcast(totals), on=F.lit(True)).where("w > 0 AND w < total")
    d = (exact("m") * exact("total") - exact("w") * exact("moment")).cast("double")
    scored = both.select("bin", "total", "moment", "square", F.try_divide(d * d, F.col("w").cast("double") * (F.col("total") - F.col("w")).cast("double")).alias("s"))
    top = scored.agg(F.max("s").alias("best"))
    tied = scored.join(F.broadcast(top), F.col("s") == F.col("best"))
    of = lambda c: F.max(c).cast("double")
    apart = F.round(of("s") / (of("square") * of("total") - of("moment") * of("moment")), 6)
    return tied.agg(F.expr("(min(bin) + max(bin)) div 2").cast("int").alias("threshold"), F.max("total").alias("total"), apart.alias("separability"))


#: Ranges that values are cut into before any running sum, so that a range and not all values are one task.
RANGES = 64


def in_ranges(counts: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Rows of distinct values with part: the range of about equally many values that each lies in, by keys."""
    at = F.col(value).cast("double")
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(at, [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts"))
    with_cuts = counts.join(cuts, list(keys)) if keys else counts.join(F.broadcast(cuts), on=F.lit(True))
    return with_cuts.withColumn("part", F.size(F.filter("cuts", lambda c: c < at))).drop("cuts")


def running_sum(ranged: DataFrame, value: str, keys: tuple[str, ...], column: Column, name: str) -> DataFrame:
    """Rows of in_ranges() with the sum of a column up to each value: within its range, and the ranges before as one number."""
    part = ranged.groupBy(*keys, "part").agg(F.sum(column).alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # RANGES rows a key
    offsets = part.select(*keys, "part", before.alias("before"))
    within = F.sum(column).over(Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn(name, within).join(offsets, [*keys, "part"]).withColumn(name, F.col(name) + F.col("before")).drop("before")


def index_percentiles(values: DataFrame, value: str, shares: tuple[float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """sorted[floor(share * n)] for each share, by keys: keys, share, value.

    From counts of distinct values, so that a common value or key is one row before any sort, and by ranges, so that
    no task sorts all values of a key.
    """
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("c"))
    placed = running_sum(in_ranges(counts, value, keys), value, keys, F.col("c"), "hi")
    totals = counts.groupBy(*keys).agg(F.sum("c").alias("total"))
    both = placed.join(totals, list(keys)) if keys else placed.join(F.broadcast(totals), on=F.lit(True))
    wanted = both.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("at", F.floor(F.col("total") * F.col("share")))
    return wanted.where("at >= hi - c AND at < hi").select(*keys, "share", value)


def stretch(values: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The 2nd and 98th index percentiles: keys, lo, hi; equal ends are set one apart."""
    p = index_percentiles(values, value, (0.02, 0.98), keys)
    g = p.groupBy(*keys).agg(F.max(F.when(F.col("share") == 0.02, F.col(value))).alias("lo"), F.max(F.when(F.col("share") == 0.98, F.col(value))).alias("hi"))
    return g.withColumn("hi", F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))


def value_islands(values: DataFrame, value: str = "v", gap_share: float = 0.05) -> DataFrame:
    """Distinct values cut into islands where the gap to the next smaller one is over a share of the range.

    Returns island (from 0), lo, hi, codes (distinct values), n (pixels). Distinct values are few beside pixels.
    """
    counts = in_ranges(values.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")), "v", ())
    ends = counts.groupBy("part").agg(F.min("v").alias("least"), F.max("v").alias("most"))
    span = ends.agg((F.max("most") - F.min("least")).alias("span"))
    last = ends.select("part", F.lag("most").over(Window.orderBy("part")).alias("last"))  # RANGES rows at most
    both = counts.join(F.broadcast(last), "part").join(F.broadcast(span), on=F.lit(True))
    before = F.coalesce(F.lag("v").over(Window.partitionBy("part").orderBy("v")), F.col("last"))
    marked = both.withColumn("cut", F.when(F.col("v") - before > F.col("span") * gap_share, 1).otherwise(0))
    named = running_sum(marked, "v", (), F.col("cut"), "island").withColumn("island", F.col("island").cast("int"))
    return named.groupBy("island").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("codes"), F.sum("n").alias("n"))


def likely_fills(values: DataFrame, value: str = "v", gap_share: float = 0.05, least: float = 0.001, most_codes: int = 5) -> DataFrame:
    """Codes outside the body (the island of most distinct values) that hold a share of the pixels: v, n, share."""
    islands = value_islands(values, value, gap_share)
    body = islands.agg(F.max_by(F.struct("lo", "hi"), F.struct("codes", "n")).alias("body"), F.sum("n").alias("total"))
    counts = values.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    outside = counts.join(F.broadcast(body), on=F.lit(True)).where("v < body.lo OR v > body.hi").withColumn("share", F.col("n") / F.col("total"))
    return outside.where(F.col("share") >= least).orderBy(F.desc("share"), "v").limit(most_codes).select("v", "n", "share")


def latest_covered(pixels: DataFrame, newest: int = 24, least: float = 0.5) -> DataFrame:
    """Of the newest steps the latest that is covered enough, else the one of largest share: t, share.

    pixels: every pixel of a plane, with coverage.
    """
    shares = pixels.groupBy("t").agg((F.sum((F.col("coverage") > 0).cast("int")) / F.count("*")).alias("share")).orderBy(F.desc("t")).limit(newest)
    good = F.max(F.when(F.col("share") >= least, F.struct("t", "share")))
    best = F.max_by(F.struct("t", "share"), F.struct("share", "t"))
    return shares.agg(F.coalesce(good, best).alias("x")).select("x.t", "x.share")


def spacing(times: DataFrame, time: str = "t", keys: tuple[str, ...] = ()) -> DataFrame:
    """Gaps between steps that follow each other, by keys: shortest, longest, changes (gaps unlike the one before)."""
    order = Window.partitionBy(*keys).orderBy(time)
    gaps = times.select(*keys, time).distinct().withColumn("gap", F.col(time) - F.lag(time).over(order))
    changed = gaps.withColumn("was", F.lag("gap").over(order))
    return changed.groupBy(*keys).agg(F.min("gap").alias("shortest"), F.max("gap").alias("longest"), F.count_if(F.col("gap") != F.col("was")).alias("changes"))


def disordered(times: DataFrame, time: str, order: str, keys: tuple[str, ...]) -> DataFrame:
    """Rows whose time isn't after that of the row before, by keys."""
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(order, time))
    return times.withColumn("before", before).where(F.col(time) <= F.col("before"))


def overlapping_spans(files: DataFrame, start: str, end: str, keys: tuple[str, ...]) -> DataFrame:
    """Files that begin before the latest end of the ones ahead of them, by keys."""
    ahead = Window.partitionBy(*keys).orderBy(start, end, "uri").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("latest", F.max(end).over(ahead)).where(F.col(start) <= F.col("latest"))


def best_window(counts: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """The size x size window of largest sum of n over a grid y, x: y, x, total; the uppermost, then leftmost of equals."""
    rows = Window.partitionBy("x").orderBy("y").rowsBetween(0, size - 1)
    cols = Window.partitionBy("y").orderBy("x").rowsBetween(0, size - 1)
    sums = counts.withColumn("s", F.sum("n").over(rows)).withColumn("total", F.sum("s").over(cols))
    inside = sums.where((F.col("y") <= height - size) & (F.col("x") <= width - size))
    return inside.agg(F.max_by(F.struct("y", "x", "total"), F.struct("total", -F.col("y"), -F.col("x"))).alias("w")).select("w.*")


def physical_range(pixels: DataFrame, bands: DataFrame) -> DataFrame:
    """Extremes of the valid values as physical values, by band: b, lo, hi; a negative scale swaps them."""
    ends = pixels.groupBy("b").agg(F.min("v").alias("a"), F.max("v").alias("z")).join(F.broadcast(bands), "b")
    at = lambda c: F.col(c) * F.col("scale") + F.col("offset")
    return ends.select("b", F.least(at("a"), at("z")).alias("lo"), F.greatest(at("a"), at("z")).alias("hi"))


def share(c: Column) -> Column:
    return F.count_if(c) / F.count("*")
