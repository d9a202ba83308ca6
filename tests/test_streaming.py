from pyspark.sql import functions as F

from gridloom.streaming import rasters


def stream(spark, tmp_path, parts):
    schema = "k int, ts timestamp, v double, t int"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "k int, s long, v double, t int").select("k", F.timestamp_seconds("s").alias("ts"), "v", "t").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


PARTS = [[(1, 0, 5.0, 0), (2, 0, 0.0, 0)], [(1, 3600, 0.0, 1), (2, 3600, 7.0, 1)], [(1, 7200, 0.0, 2), (2, 7200, 0.0, 2)]]


def test_carry_forward(spark, tmp_path):
    out = drained(rasters.carry_forward(stream(spark, tmp_path, PARTS), "k", "ts", "v"), "cf")
    got = sorted((r.k, int(r.ts.timestamp()), r.v, r.filled) for r in out.collect())
    assert got == [(1, 0, 5.0, False), (1, 3600, 5.0, True), (1, 7200, 5.0, True), (2, 0, 0.0, False), (2, 3600, 7.0, False), (2, 7200, 7.0, True)]


def test_period_composite_leaves_late_rows_out(spark, tmp_path):
    day = 86400
    parts = [[(1, 0, 1.0, 0), (1, 10, 2.0, 0)], [(1, 10 * day, 4.0, 0)], [(1, 11 * day, 16.0, 0)], [(1, 20, 8.0, 0), (1, 20 * day, 1.0, 0)]]
    out = drained(rasters.period_composite(stream(spark, tmp_path, parts), "ts", ["k"], "v"), "pc")
    assert sorted((r.n, r.total) for r in out.collect()) == [(1, 4.0), (1, 16.0), (2, 3.0)]


def test_append_takes_later_steps_only(spark, tmp_path):
    s = stream(spark, tmp_path, [[(1, 0, 1.0, 0)], [(1, 0, 2.0, 0), (1, 1, 3.0, 1)], [(1, 2, 4.0, 2)]])
    path = str(tmp_path / "out")
    q = s.writeStream.foreachBatch(rasters.append_later(path)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.t, r.v) for r in spark.read.parquet(path).collect()) == [(0, 1.0), (1, 3.0), (2, 4.0)]


def test_passes_and_change_sums(spark, tmp_path):
    out = rasters.passes(stream(spark, tmp_path, PARTS), "ts", ["k"])
    assert out.isStreaming
    sums = rasters.change_sums(spark.createDataFrame([(0, 100, 2), (0, 300, 2), (1, 0, 0)], "cell int, total long, n long"), ["cell"])
    assert {r.cell: r.volatility for r in sums.collect()} == {0: sums.select(F.lit(0.01).cast("float")).first()[0], 1: None}
