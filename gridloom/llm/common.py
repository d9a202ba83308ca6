"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder, read by Spark, whatever the store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder (spark.checkpoint.dir); make a local one only where it is unset and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):  # local-cluster is a cluster
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gridloom-ckpt-"))


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there: the lineage ends, lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder: computed once, small on disk, and read by the columns that are needed."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_pair(name: str, *columns: Column | str) -> list[Column]:
    """Two 64-bit hashes of the columns, name1 and name2: together they stand for a line or document."""
    return [F.xxhash64(*columns).alias(f"{name}1"), F.xxhash64(F.lit(1), *columns).alias(f"{name}2")]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: neither filters nor projections are moved through a generator."""
    return df.withColumn(name, F.explode(F.array(value)))


#: A key of more than one in so many rows is hot.
HOT = 1000


def weighted_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, values: list[str], how: str) -> DataFrame:
    """left joined to right (each key once; weight: how many rows of left have it) on keys that are hashes, with the columns `values` of right.

    Keys of more than a HOTth of the weights' sum, fewer than HOT, are broadcast. Rows of left that meet one don't
    take part in the shuffle join but are dealt by a hash of their own, so that no task gets a hot key. how: inner or left.
    """
    total = right.agg(F.sum(weight).alias("n")).first()["n"] or 0
    side = lambda rows, name: rows.select(*keys, F.struct(*values).alias(name))
    is_hot = F.col(weight) * HOT > F.lit(total)
    marked = left.join(F.broadcast(side(right.where(is_hot), "__hot")), keys, "left")
    spread = F.xxhash64(F.lit("hot"), *[F.col(f"`{c}`") for c in left.columns if c not in keys])
    moved = marked.withColumns({f"__{k}": F.when(F.col("__hot").isNotNull(), spread).otherwise(F.col(k)) for k in keys})
    cold = side(right.where(~is_hot), "__cold").withColumnsRenamed({k: f"__{k}" for k in keys})
    both = moved.join(cold, [f"__{k}" for k in keys], "left").withColumn("__v", F.coalesce("__hot", "__cold"))
    if how == "inner":
        both = both.where(F.col("__v").isNotNull())
    return both.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"__v.{v}").alias(v) for v in values])


def crc_mod(id_col: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string").cast("binary")) % F.lit(modulus)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
