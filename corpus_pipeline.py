"""A corpus pipeline of five operators: language, quality, recurring lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet and read again as
the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import langid, linededup, packing, quality, simhash
from gridloom.llm.common import ensure_checkpoint_dir, removed, table

#: A document is rejected if it has no language, or if the best one is less likely than this.
LEAST_LANGUAGE_SCORE = 0.5
#: Documents of five-word shingle sets as similar as this are near duplicates.
SIMILARITY = 0.8


def whole_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and each row as one column, so that no column's name is in the way."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter (null and empty texts too) or of an unclear language go."""
    model = langid.fit(docs, langid.learnable(docs))
    kept = langid.identify(whole_rows(docs), model, keep=("row",))
    return kept.where((F.col("lang_pred") != langid.NONE) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; it learns from the labels of documents that are still there.

    A null text is scored as an empty one.
    """
    net = quality.fit(docs, quality.learnable(table(spark, sf_dir, "labels")))
    return quality.score(whole_rows(docs), net, keep=("row",)).where("predicted = 1").select("row.*")


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur elsewhere; n_chars follows the text. No row goes."""
    shorter = linededup.dedup_lines(docs)
    return shorter.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id (a null id only where there is no other).

    Five-word shingles, a similarity of SIMILARITY or more. Of rows that are alike in id and text one stays. Null and
    empty texts are one group.
    """
    key = [F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "doc_id", "text")]
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), key[0].alias("k1"), key[1].alias("k2"))
    rows = whole_rows(docs).select("row", "text", order.alias("order"))
    groups = simhash.near_duplicates(rows, id_col="order", words=5, similarity=SIMILARITY)
    first = groups.where("doc_id = component_id").select("doc_id.k1", "doc_id.k2").distinct()
    kept = rows.select("row", "order.k1", "order.k2").join(first, ["k1", "k2"], "left_semi")
    return kept.groupBy("k1", "k2").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("language", language), ("quality", good_quality), ("lines", without_recurring_lines), ("near_duplicates", without_near_duplicates), ("packing", packed)]

#: The stages' models and hashes have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on documents; what they hand on is written to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)  # earlier stages' folders go as soon as they have been read; the last one holds the result
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return docs
