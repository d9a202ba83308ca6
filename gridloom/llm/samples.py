"""Bounded samples of labelled rows, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: More labels are refused, before any row of a label is looked at.
MAX_CLASSES = 1000
#: Rows of all labels together, and bytes of one text and of all texts together: what the driver holds at most.
MAX_ROWS, MAX_TEXT_BYTES, MAX_BYTES = 4000, 1 << 20, 64 << 20
#: So many times the rows that are wanted are let through by hash; fewer than wanted is then next to impossible.
MARGIN = 4
#: Hashes are cut to this range.
RANGE = 1 << 48


def class_counts(ids: DataFrame) -> dict:
    """How many ids each label has, by an aggregate; more than MAX_CLASSES labels are refused."""
    counts = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).limit(MAX_CLASSES + 1).collect()}
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} labels")
    return counts


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, str, object]]:
    """(id, whole text, label) of at most per_class ids of each label, those of smallest hash; the same on every run.

    labels: columns id_col and label. Ids are chosen first, from two narrow columns: a hash below a threshold that
    follows from the label's count lets about MARGIN times the wanted rows through, so a common label is cut down
    where it is read and no task gets more. The chosen ids are then joined to the texts. Null ids, labels and
    texts are left out, and texts of more than MAX_TEXT_BYTES. A repeated id counts once, with the smallest of its
    texts. Many labels share MAX_ROWS rows, and rows end (by hash) where MAX_BYTES of text are reached.
    """
    ids = labels.where(F.col("label").isNotNull() & F.col(id_col).isNotNull()).select(id_col, "label").withColumn("h", F.pmod(F.xxhash64(id_col), F.lit(RANGE)))
    counts = class_counts(ids)
    if not counts:
        return []
    wanted = max(1, min(per_class, MAX_ROWS // len(counts)))
    spark, kinds = docs.sparkSession, dict(ids.dtypes)
    # repeated ids only make the threshold lower than it need be, so it is taken from distinct ids where they might
    distinct = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.approx_count_distinct(id_col, 0.02).alias("n")).collect()}
    limits = [(label, int(min(1.0, MARGIN * wanted / max(1, distinct[label])) * RANGE)) for label in counts]
    small = F.broadcast(spark.createDataFrame(limits, f"label {kinds['label']}, below long"))  # MAX_CLASSES rows at most
    order = Window.partitionBy("label").orderBy("h", id_col)
    near = ids.join(small, "label").where(F.col("h") < F.col("below")).select(id_col, "label", "h").distinct()
    chosen = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= wanted).select(id_col, "label", "h").collect()  # MAX_ROWS at most
    if not chosen:
        return []
    picked = F.broadcast(spark.createDataFrame([tuple(r) for r in chosen], f"{id_col} {kinds[id_col]}, label {kinds['label']}, h long"))
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") <= MAX_TEXT_BYTES)
    one = texts.join(picked, id_col).groupBy("h", id_col, "label").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy("h", id_col, "label").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = one.withColumn("bytes", so_far).where(F.col("bytes") <= MAX_BYTES).select("h", id_col, "text", "label").collect()
    return [(r[1], r[2], r[3]) for r in sorted(rows, key=lambda r: (r[0], r[1], str(r[3]), r[2]))]
