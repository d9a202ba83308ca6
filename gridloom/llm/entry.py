"""Queries of the operators of this subpackage, over the tables they are meant for, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import ann, langid, licenses, linededup, packing, pieces, quality, simhash, topk, warc
from gridloom.llm.common import table


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.exact_topk(vectors.where(F.col("vec_id") % 50 == 0), vectors, 5)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return records.withColumn("record_crc32", F.crc32("record")).drop("block", "record")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors.where(F.col("vec_id") % 20 == 0), vectors, 20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_topk, op2_quality, op3_licenses, op4_packing, op5_warc, op6_pieces, op7_language, op8_line_dedup, op9_simhash, op10_nearest)
}

# each row is a query of its own, whatever its id: k tells rows apart
_VALID = """SELECT vec_id, embedding, row_number() OVER () AS k FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

ORACLE_SQL = {
    "op1_exact_topk": f"""
WITH v AS ({_VALID}), i AS (SELECT k, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM v),
s AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM i q JOIN i c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op10_nearest": f"""
WITH v AS ({_VALID} AND len(list_filter(embedding, lambda x: x <> 0)) > 0), i AS (SELECT k, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM v),
s AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM i q JOIN i c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS n FROM s WHERE NOT isnan(score))
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20""",
    "op8_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
l AS (SELECT k, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
p AS (SELECT k, doc_id, pos, list_filter(string_split(line, ' '), lambda x: x <> '') AS own,
  list_transform(own, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS opened FROM l WHERE regexp_matches(line, '\S')),
w AS (SELECT k, doc_id, pos, CASE WHEN len(list_filter(opened, lambda x: x <> '<*>')) = 0 THEN own ELSE opened END AS w, array_to_string(w, ' ') AS m FROM p),
u AS (SELECT m, any_value(w) AS w, len(any_value(w)) AS n, count(DISTINCT k) AS docs, min(doc_id) AS first FROM w GROUP BY m),
leaf AS (SELECT *, CASE WHEN n < 13 THEN 1 ELSE greatest(3, n // 4) END AS lead, n - lead AS rest, least(12, rest) AS many, w[1:lead] AS path FROM u
  WHERE n >= 5 AND len(list_filter(w, lambda x: x <> '<*>')) > 0),
t AS (SELECT *, unnest(range(many)) AS place FROM leaf),
s AS (SELECT m, n, path, place, ((place + 1) * rest) // many - (place * rest) // many AS width,
  array_to_string(w[lead + (place * rest) // many + 1 : lead + ((place + 1) * rest) // many], ' ') AS word, sum(docs) OVER (PARTITION BY n, path, place, word) AS support FROM t),
o AS (SELECT m, n, path, list({'word': word, 'width': width, 'support': support} ORDER BY place) AS parts, list_sort(list(support))[(count(*) + 1) // 2] AS middle FROM s GROUP BY m, n, path),
g AS (SELECT m, n, path, list_transform(parts, lambda x: CASE WHEN x.support * 2 <= middle THEN '<*>' ELSE x.word END) AS template
  FROM o WHERE list_sum(list_transform(parts, lambda x: CASE WHEN x.support * 2 <= middle THEN x.width ELSE 0 END)) * 5 <= n),
gd AS (SELECT n, path, template, count(DISTINCT k) AS docs, min(doc_id) AS first FROM g JOIN w USING (m) GROUP BY n, path, template),
r AS (SELECT m, first FROM u WHERE docs >= CASE WHEN n < 5 THEN 3 ELSE 2 END
  UNION ALL SELECT m, gd.first FROM g JOIN gd USING (n, path, template) WHERE gd.docs >= CASE WHEN n < 13 THEN 3 ELSE 2 END),
x AS (SELECT DISTINCT k, pos FROM w JOIN r USING (m) WHERE r.first IS NOT NULL AND (w.doc_id IS NULL OR w.doc_id <> r.first)),
f AS (SELECT l.k, count(*) AS n_lines, count(x.pos) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE x.pos IS NULL), '') AS kept
  FROM l LEFT JOIN x ON l.k = x.k AND l.pos = x.pos GROUP BY l.k)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_dropped, 0) AS INTEGER) AS n_dropped, md5(coalesce(kept, '')) AS text_md5
FROM d LEFT JOIN f USING (k)""",
}
