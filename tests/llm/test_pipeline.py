import hashlib

import duckdb
import pyarrow as pa
import pytest

from gridloom.llm import entry, langid, linededup, packing, quality
from gridloom.llm.common import table
from tests.llm.common import odd_docs
from tests.llm.test_simhash import wide_groups
from tests.llm.test_text_models import plain_probabilities
from tests.llm.test_text_tools import check_packing


def test_stages_on_odd_rows(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    odd = odd_docs(spark).selectExpr("*", "1 AS row", "'a' AS __lines", "2 AS __dropped", "3 AS h", "'x' AS lang_pred", "4 AS predicted", "5 AS `key`", "6 AS drop")
    docs = odd.union(odd.where("doc_id IS NULL").selectExpr("doc_id", "concat(text, ' Noch ein ganz anderer Satz.') AS text", *[f"`{c}`" for c in odd.columns[2:]]))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), sf_dir).collect() == []
        out.collect()
    kept = pipeline.without_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 5, 6, 7, 8] and sum(r.doc_id is None for r in kept) == 2
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()


def test_stages_do_what_their_operators_say(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        rows = spark.createDataFrame(out.collect(), docs.schema)
        kept, before = {r.doc_id for r in rows.collect()}, {r.doc_id for r in docs.collect()}
        if name == "language":
            model = langid.fit(docs, langid.learnable(docs))
            want = {r.doc_id for r in docs.collect() if (p := model.predict(r.text))[0] != "und" and p[1] >= pipeline.LEAST_LANGUAGE_SCORE}
        elif name == "quality":
            net = quality.fit(docs, quality.learnable(table(spark, sf_dir, "labels")))
            want = {r.doc_id for r in docs.collect() if quality.probability(net, r.text) >= quality.THRESHOLD}
        elif name == "lines":
            want = before
            text = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
            assert all(r.text == text[r.doc_id] and r.n_chars == len(r.text) for r in rows.collect())
        else:
            have = docs.collect()
            group = wide_groups([r.text for r in have])
            want = {min(have[k].doc_id for k in range(len(have)) if group[k] == g) for g in set(group)}
        assert kept == want and kept <= before
        docs = rows
    assert sum(r.length for r in packing.pack(docs).collect()) == sum(r.length for r in pipeline.run(spark, sf_dir).collect())


def test_run_is_brute_force(spark, sf_dir):
    """Every stage again, by plain loops, the standard SQL and the tokenizers library, on what the one before it kept."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, langid.learnable(docs))
    rows = []
    for r in docs.collect():
        p = plain_probabilities(model, r.text or "")
        if any(c.isalpha() for c in r.text or "") and max(p.values()) >= pipeline.LEAST_LANGUAGE_SCORE:
            rows.append(r)
    net = quality.fit(spark.createDataFrame(rows, docs.schema), quality.learnable(table(spark, sf_dir, "labels")))
    rows = [r for r in rows if quality.probability(net, r.text) >= 0.3]  # test_quality_is_brute_force holds this against loops
    con = duckdb.connect()
    documents = pa.table({"doc_id": [r.doc_id for r in rows], "text": [r.text for r in rows]})  # noqa: F841
    digests = dict(con.execute(f"SELECT doc_id, text_md5 FROM ({entry.ORACLE_SQL['op8_line_dedup']})").fetchall())
    shorter = {r.doc_id: r.text for r in pipeline.without_recurring_lines(spark, spark.createDataFrame(rows, docs.schema), sf_dir).collect()}
    assert {i: hashlib.md5(t.encode()).hexdigest() for i, t in shorter.items()} == digests
    ids = sorted(shorter)
    group = wide_groups([shorter[i] for i in ids])
    kept = {ids[g]: shorter[ids[g]] for g in set(group)}
    check_packing(pipeline.run(spark, sf_dir).collect(), kept)
