import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import pyramid
from gridloom.sources import zarr
from gridloom.sources.checksum import crc32c

TIMES = [0, 86_400_000, 172_800_000]


def cube(spark, steps=3, h=11, w=9):
    i = F.col("id")
    return spark.range(steps * 2 * h * w).select((i / (2 * h * w)).cast("int").alias("t"), ((i / (h * w)).cast("int") % 2).alias("b"), ((i / w).cast("int") % h).alias("y"), (i % w).cast("int").alias("x"), (i * 7 % 1000 + 1).cast("int").alias("v"))


def rows(df):
    return sorted(tuple(r) for r in df.select("t", "b", "y", "x", "v").collect())


def levels(df, h=11, w=9, n=2):
    return pyramid.pyramid(df, h, w, n)


@pytest.mark.parametrize(("codec", "shard"), [("zstd", 0), ("gzip", 0), ("none", 0), ("zstd", 2)])
def test_round_trip(spark, tmp_path, codec, shard):
    df = cube(spark)
    objects = zarr.write_levels(levels(df), str(tmp_path / "s"), TIMES, ["B04", "B08"], 11, 9, 2, cell=4, codec=codec, shard=shard)
    assert objects.where("level = 0").count() == (3 if not shard else 2) * 3 * 3
    assert rows(zarr.open_store(spark, str(tmp_path / "s"))) == rows(df)
    assert rows(zarr.open_store(spark, str(tmp_path / "s"), 1)) == rows(pyramid.downsample(df, 11, 9))
    assert zarr.validate(str(tmp_path / "s")) == []


def test_predicates_choose_chunks(spark, tmp_path):
    df = cube(spark)
    zarr.write_levels(levels(df), str(tmp_path / "s"), TIMES, ["a", "b"], 11, 9, 2, cell=4)
    want = df.where("t = 1 AND y BETWEEN 2 AND 3 AND x IN (8)")
    got = zarr.open_store(spark, str(tmp_path / "s")).where("t = 1 AND y >= 2 AND y <= 3 AND x IN (8)")
    assert rows(got) == rows(want)
    from pyspark.sql.datasource import EqualTo, In, LessThan

    reader = zarr.Reader({"path": str(tmp_path / "s")})
    list(reader.pushFilters([EqualTo(("t",), 1), LessThan(("y",), 4), In(("x",), (8,))]))
    assert reader.chunks() == [(1, 0, 2)]


def test_append(spark, tmp_path):
    df, path = cube(spark), str(tmp_path / "s")
    zarr.write_levels(levels(df.where("t < 2")), path, TIMES[:2], ["a", "b"], 11, 9, 2, cell=4)
    with pytest.raises(ValueError, match="later"):
        zarr.append_steps(levels(df.where("t = 2")), path, [5], cell=4)
    zarr.append_steps(levels(df.where("t = 2")), path, TIMES[2:], cell=4)
    assert rows(zarr.open_store(spark, path)) == rows(df) and zarr.describe(path)["times"] == TIMES


def test_absent_chunks_and_damage(spark, tmp_path):
    path = tmp_path / "s"
    zarr.write_levels(levels(cube(spark)), str(path), TIMES, ["a", "b"], 11, 9, 2, cell=4)
    (path / "0/data/c/0/0/0/0").unlink()
    assert zarr.open_store(spark, str(path)).where("v = 0").count() == 2 * 16
    with pytest.raises(ValueError, match="checksum"):
        zarr.shard_index(bytes(36), 2)
    shard = zarr.shard_of([b"abc", None, b"de"])
    assert zarr.shard_index(shard[-52:], 3) == [(0, 3), None, (3, 2)]
    assert crc32c(b"123456789") == 0xE3069283
    with pytest.raises(ValueError, match="not understood"):
        zarr.check_extensions({"zarr_format": 3, "strange": {"must_understand": True}})
    assert np.dtype(zarr.DTYPES["uint16"]).itemsize == 2
