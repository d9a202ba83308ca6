"""Streams of observations: composites by period, gap filling with state, sessions, appends and change sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def period_composite(rows: DataFrame, time: str, keys: list[str], value: str, period: str = "1 day", late: str = "2 days") -> DataFrame:
    """Valid observations, their sum and extremes by period and keys; on a stream, rows later than `late` are left out."""
    source = rows.withWatermark(time, late) if rows.isStreaming else rows
    g = source.groupBy(F.window(time, period).alias("w"), *keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total", "lo", "hi")


def passes(rows: DataFrame, time: str, keys: list[str], gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of observations no further apart than gap, by keys: start, last, n."""
    source = rows.withWatermark(time, late) if rows.isStreaming else rows
    g = source.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.max(time).alias("last"))
    return g.select(F.col("w.start").alias("start"), "last", *keys, "n")


def carry_forward(rows: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each observation with a gap (0 or null) filled by the latest earlier value of its key: key, time, value, filled.

    State is one value for each key; rows of a key are put in order of time within a trigger.
    """

    def fill(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        frame = pd.concat(list(parts)).sort_values(time, kind="stable")
        values, filled = [], []
        for v in frame[value]:
            gap = pd.isna(v) or v == 0
            filled.append(bool(gap and last is not None))
            last = last if gap else float(v)
            values.append(0.0 if last is None else last)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: frame[key], time: frame[time], value: values, "filled": filled})

    kind = dict(rows.dtypes)
    return rows.select(key, time, value).groupBy(key).applyInPandasWithState(fill, f"{key} {kind[key]}, {time} {kind[time]}, {value} double, filled boolean", "last double", "append", GroupStateTimeout.NoTimeout)


def append_later(path: str, time: str = "t") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: add the rows of steps later than all that the table at path has; others are refused.

    A batch that runs again replaces its own folder, so nothing is added twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        j = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        store = j.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
        last = None
        if store.exists(j):
            before = spark.read.parquet(path).where(F.col("batch") < batch_id)
            last = before.agg(F.max(time)).first()[0]
        later = batch if last is None else batch.where(F.col(time) > last)
        later.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def change_sums(rows: DataFrame, keys: list[str], total: str = "total", n: str = "n") -> DataFrame:
    """Running sums of change and comparisons by cell, from increments: the volatility so far."""
    g = rows.groupBy(*keys).agg(F.sum(total).alias("total"), F.sum(n).alias("n"))
    return g.withColumn("volatility", F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("total") / F.when(F.col("n") > 0, F.col("n")) / F.lit(10000.0))).cast("float"))
