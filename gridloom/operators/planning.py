"""Ingest planning, diffs, selectors and validation rules as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Year, one separator used twice or not at all, month, day; no digit before or after.
FULL_DATE = r"(?<![0-9])((?:19|20)[0-9]{2}|2100)([-_]?)(0[1-9]|1[0-2])\2(0[1-9]|[12][0-9]|3[01])(?![0-9])"
MONTH_DATE = r"(?<![0-9])((?:19|20)[0-9]{2}|2100)[-_](0[1-9]|1[0-2])(?![-_]?[0-9])"


def dates_in(name: Column) -> Column:
    """The dates that a name holds, as an array of days: full dates, else year and month (first of it)."""

    def days(pattern: str, form: Column) -> Column:
        found = F.regexp_extract_all(name, F.lit(pattern), F.lit(0))
        digits = F.transform(found, lambda x: F.concat(F.regexp_replace(x, "[-_]", ""), form))
        return F.filter(F.transform(digits, lambda d: F.to_date(F.try_to_timestamp(d, F.lit("yyyyMMdd")))), lambda d: d.isNotNull())

    full = days(FULL_DATE, F.lit(""))
    return F.array_distinct(F.when(F.size(full) > 0, full).otherwise(days(MONTH_DATE, F.lit("01"))))


def dated(files: DataFrame, name: str = "name") -> DataFrame:
    """Files with state (dated, undated, several) and day: exactly one date must be in a name."""
    found = files.withColumn("__d", dates_in(F.col(name)))
    n = F.size("__d")
    return found.withColumn("state", F.when(n == 1, "dated").when(n == 0, "undated").otherwise("several")).withColumn("day", F.when(n == 1, F.element_at("__d", 1))).drop("__d")


def natural_key(name: Column) -> Column:
    """A key in whose order digit runs count as numbers: each is padded to twelve digits."""
    runs = F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 12, "0")).otherwise(x)), "")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of largest order of each key, with all its columns."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("x")).select(*keys, "x.*")


def overlaps(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rectangles (id, y0, y1, x0, x1; ends excluded) of the same keys that share pixels: a, b, shared.

    The keys are a date's; rectangles of a date are its tiles, a bounded few.
    """
    a, b = tiles.alias("a"), tiles.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.id") < F.col("b.id")]
    h = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    w = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    both = a.join(b, on).where((h > 0) & (w > 0))
    return both.select(*[F.col(f"a.{k}") for k in keys], F.col("a.id").alias("a"), F.col("b.id").alias("b"), (h * w).alias("shared"))


def publish_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """key and state: new, changed, unchanged (same size and digest), foreign (only remote)."""
    a, b = local.select("key", F.struct("size", "md5").alias("l")), remote.select("key", F.struct("size", "md5").alias("r"))
    state = F.when(F.col("r").isNull(), "new").when(F.col("l").isNull(), "foreign").when(F.col("l") == F.col("r"), "unchanged").otherwise("changed")
    return a.join(b, "key", "full_outer").select("key", state.alias("state"))


def publish_phase(key: Column) -> Column:
    """Order of upload: chunks, then level metadata, then coordinates, the root last."""
    return F.when(key == "zarr.json", 3).when(key.rlike("^(time|band|x|y)/"), 2).when(key.endswith("zarr.json"), 1).otherwise(0)


def is_prefix(short: DataFrame, long: DataFrame) -> DataFrame:
    """One row, prefix: whether the ordered list short (i, v) is where long begins."""
    missing = short.join(long, ["i", "v"], "left_anti")
    return missing.agg((F.count("*") == 0).alias("prefix"))


def time_selector(spec: str, index: Column, iso: Column) -> Column:
    """all, i, a:b[:s], YYYY, YYYY-MM[-DD], A..B, and unions of these by commas, as a predicate."""
    out = F.lit(False)
    for part in (p.strip() for p in spec.split(",")):
        if part == "all":
            out = F.lit(True)
        elif ".." in part:
            a, b = part.split("..")
            out = out | ((iso >= a) & ((iso <= b) | iso.startswith(b)))
        elif ":" in part:
            a, b, *s = part.split(":")
            first, step = int(a or 0), int(s[0]) if s and s[0] else 1
            out = out | ((index >= first) & (index < int(b) if b else F.lit(True)) & ((index - first) % step == 0))
        elif "-" in part or len(part) == 4:
            out = out | iso.startswith(part)
        else:
            out = out | (index == int(part))
    return out


def level_of(resolution: Column, levels: list[float]) -> Column:
    """The coarsest of the levels' resolutions (from fine to coarse) that is no coarser than asked for, else level 0."""
    return F.coalesce(F.array_max(F.array(*[F.when(F.lit(r) <= resolution, k) for k, r in enumerate(levels)])), F.lit(0)).cast("int")


def mirror_problems(declared: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that only one side has: keys, problem. One exchange: both sides' rows are counted together."""
    both = declared.select(*keys, F.lit(1).alias("side")).unionByName(found.select(*keys, F.lit(2).alias("side")))
    sides = both.groupBy(*keys).agg(F.bit_or("side").alias("sides")).where("sides <> 3")
    return sides.select(*keys, F.when(F.col("sides") == 1, "declared but absent").otherwise("not declared").alias("problem"))


def value_problem(stored: Column, mirrored: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    """missing, differs (beyond absolute + relative * |mirrored|) or null."""
    return F.when(mirrored.isNull() | stored.isNull(), "missing").when(F.abs(stored - mirrored) > F.lit(absolute) + F.lit(relative) * F.abs(mirrored), "differs")


def takes_validity(store: Column, batch: Column) -> Column:
    """Whether a store that says what is valid by a mask, a sentinel or not at all can append a batch that does so its own way."""
    return (store == batch) | ((store == "mask") & (batch == "sentinel")) | ((store != "none") & (batch == "none"))


def findings(rows: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """All rules over all rows in one pass: severity, place, message of each rule that a row breaks.

    A rule: severity, message, place, and the condition under which it is broken.
    """
    each = F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(s).alias("severity"), place.cast("string").alias("place"), F.lit(m).alias("message"))) for s, m, place, broken in rules])
    return rows.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select("f.*")


def append_mismatches(base: DataFrame, batch: DataFrame, fields: list[str]) -> DataFrame:
    """Each field in which a batch's one-row description differs from the store's: field, expected, got; all are listed."""
    pair = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("s")).select("s.*")
    a, b = pair(base).withColumnRenamed("v", "expected"), pair(batch).withColumnRenamed("v", "got")
    return a.join(b, "field").where(~F.col("expected").eqNullSafe(F.col("got")))


def running_budget(rows: DataFrame, size: str, order: list[str], budget: int, keys: list[str]) -> DataFrame:
    """Rows in order, by keys, until their sizes reach a budget."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(size).over(upto)).where(F.col("used") <= budget)
