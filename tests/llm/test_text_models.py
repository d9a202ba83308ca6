import math
import zlib
from pathlib import Path

import numpy as np

from gridloom.llm import langid, licenses, quality
from gridloom.llm.common import table
from tests.llm.common import LONG, odd_docs, run


def test_language_held_out_accuracy(spark, sf_dir):
    lang = {r.doc_id: (r.text, r.lang) for r in table(spark, sf_dir, "documents").collect()}
    rows = run("op7_language", spark, sf_dir).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id][1] for r in held]) > 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_language_learns_nothing_from_held_out_rows(spark, sf_dir):
    ids = [r.doc_id for r in langid.learnable(table(spark, sf_dir, "documents")).collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)


def test_language_odd_rows(spark):
    docs = odd_docs(spark)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(docs).collect()}
    assert all(got[i] == ("und", 0.0) for i in (2, 3, 4, 5)) and got[6][0] != "und"
    assert langid.identified(docs).count() == docs.count() and langid.identified(docs.limit(0)).collect() == []


def test_grams_of_runs_are_those_of_the_whole(monkeypatch):
    text = "Der schnelle Fuchs. " * 50
    whole = np.sort(np.concatenate(list(langid.grams(text))))
    monkeypatch.setattr(langid, "RUN", 64)
    assert np.array_equal(np.sort(np.concatenate(list(langid.grams(text)))), whole)


def plain_probabilities(model, text):
    """The same by dictionaries and loops: n-grams as strings, hashed one at a time, each weighed by itself."""
    m32 = lambda x: x & 0xFFFFFFFF
    mix = lambda h: m32((h ^ h >> 15) * 0x85EBCA6B) >> (32 - langid.BITS)
    c = [ord(x) if x.isalpha() else 32 for x in f" {text.lower()} "]
    hashes = [mix(m32(x * 0xC2B2AE35)) for x in c]
    hashes += [mix(m32(x * 0x9E3779B1 + y + 0x27D4EB2F)) for x, y in zip(c, c[1:], strict=False)]
    hashes += [mix(m32(m32(m32(x * 0x9E3779B1 + y) * 0x9E3779B1 + z) * 0x165667B1)) for x, y, z in zip(c, c[1:], c[2:], strict=False)]
    weight = dict(zip(model.live.tolist(), model.weights.tolist(), strict=True))
    z = [(b + sum(weight.get(h, [0.0] * len(model.langs))[k] for h in hashes) / len(hashes)) / model.temperature for k, b in enumerate(model.bias.tolist())]
    e = [math.exp(x - max(z)) for x in z]
    return {k: x / sum(e) for k, x in zip(model.langs, e, strict=True)}


def test_language_is_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, langid.learnable(docs))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in run("op7_language", spark, sf_dir).collect():
        if not any(x.isalpha() for x in texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        want = plain_probabilities(model, texts[r.doc_id])
        assert abs(r.score - max(want.values())) < 1e-6 and want[r.lang_pred] > max(want.values()) - 1e-6


def test_language_needs_a_letter():
    model = langid.train([(i, t, lang) for i in range(20) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"))])
    assert {model.predict(t) for t in ("½ ² ① Ⅷ", "", None, "12 _ !", "🙂")} == {("und", 0.0)} and model.predict("ª")[0] != "und"


def test_temperature_and_sparsity():
    rows = [(i, t * (i % 3 + 1), lang) for i in range(60) for t, lang in (("the cat and the dog ", "en"), ("der hund und die katze ", "de"))]
    model = langid.train(rows)
    assert model.predict("the dog and the cat")[0] == "en" and model.predict("die katze und der hund")[0] == "de"
    assert len(model.live) < 0.05 * 2**langid.BITS and (model.weights != 0).any(axis=1).all() and model.temperature > 0


def test_quality_rows(spark, sf_dir):
    rows = run("op2_quality", spark, sf_dir).collect()
    assert len(rows) == table(spark, sf_dir, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_held_out_accuracy(spark, sf_dir):
    """At sf0.01, where 70 labelled rows are held out; "always 1" would have 0.84 of them right."""
    sf_dir = str(Path(sf_dir).parent / "sf0.01")
    label = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    held = [r for r in run("op2_quality", spark, sf_dir).collect() if r.held_out and r.doc_id in label]
    good, bad = (np.array([r.score for r in held if label[r.doc_id] == k]) for k in (1, 0))
    right = np.mean([r.predicted == label[r.doc_id] for r in held])
    assert len(good) > 50 and len(bad) > 8 and right > 0.92 and np.mean(good[:, None] > bad) > 0.98 and not (good < 0.3).any()


def plain_probability(net, text):
    """The same by loops over windows, chunks and filters."""
    raw = (text or "").encode()
    n = max(2, -(-len(raw) // 128))
    raw += bytes(128 * n + 4 - len(raw))
    means = []
    for half in range(n):
        total = [0.0] * quality.FILTERS
        for i in range(128 * half, 128 * half + 128, 4):
            window = raw[i : i + 8]
            again = float(any(raw[i - lag : i - lag + 8] == window for lag in range(2, 25) if i >= lag) and any(window))
            x = [v for byte in window for v in net.embed[byte].tolist()]
            for f in range(quality.FILTERS):
                kernel = net.first[:, f].tolist() + net.second[:, f].tolist()
                total[f] += max(0.0, sum(a * b for a, b in zip(x, kernel, strict=True)) + again * float(net.repeat[f]) + float(net.offset[f]))
        means.append([t / 32 for t in total])
    best = [max((a[f] + b[f]) / 2 for a, b in zip(means, means[1:], strict=False)) for f in range(quality.FILTERS)]
    return 1 / (1 + math.exp(-sum(a * float(b) for a, b in zip(best, net.out, strict=True)) - float(net.bias[0])))


def test_quality_is_brute_force():
    rng = np.random.default_rng(2)
    net = quality.fresh(rng)
    net.offset += 0.1
    for text in ("", "a", "word word word word word " * 9, "é漢🙂 Some text of no great length, which ends here. " * 7, "x" * 256, None):
        assert abs(quality.probability(net, text) - plain_probability(net, text)) < 1e-5


def test_quality_gradient():
    rng = np.random.default_rng(0)
    net = quality.fresh(rng)
    for p in net.parameters():
        p += 0.01
    net64 = quality.Net(*[p.astype(np.float64) for p in net.parameters()])
    raws = [quality.padded(np.frombuffer(t.encode(), np.uint8)) for t in ("ab ab ab ab ab ab " * 30, "hello there!! " * 40, "x")]
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 3.0, 0.5])

    def loss():
        hs = [quality.means(quality.responses(net64, quality.groups(net64, r), quality.repeated(r))) for r in raws]
        z = np.array([((h[:-1] + h[1:]) / 2).max(axis=0) @ net64.out + net64.bias[0] for h in hs])
        return (weight * (np.log1p(np.exp(z)) - y * z)).sum() / weight.sum() + 0.5e-4 * (net64.out**2).sum()

    grads = quality.loss_gradient(net64, raws, [quality.repeated(r) for r in raws], y, weight)
    for p, g in zip(net64.parameters(), grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        before = p[i]
        p[i] = before + 1e-4
        up = loss()
        p[i] = before - 1e-4
        down = loss()
        p[i] = before
        assert abs((up - down) / 2e-4 - g[i]) < 1e-3 + 0.01 * abs(g[i])


def test_quality_runs_are_the_whole(monkeypatch):
    net = quality.fresh(np.random.default_rng(1))
    text = "".join(chr(97 + i * i % 23) for i in range(5000))
    whole = quality.pooled(net, text)
    monkeypatch.setattr(quality, "RUN", 4 * quality.HALF)
    assert np.allclose(quality.pooled(net, text), whole, atol=1e-6)


def test_quality_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (8, 0), (4, 0), (None, 1), (77, 1)], "doc_id long, quality int")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == docs.count() and all(np.isfinite(r.score) for r in rows)
    assert quality.scored(docs.limit(0), labels).collect() == [] and len(quality.scored(docs, labels.limit(0)).collect()) == docs.count()


NOTICES = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Released under the MIT License.": "mit", "All rights reserved.": "all-rights-reserved"}


def test_licences(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    planted = {(i, NOTICES[x]) for i, t in docs.items() for x in (t or "").split("\n") if x in NOTICES}
    rows = run("op3_licenses", spark, sf_dir).collect()
    assert planted and {(r.doc_id, r.family) for r in rows if r.confirmed} == planted
    assert len({(r.doc_id, r.family) for r in rows} - planted) < len(docs) / 50  # unconfirmed ones that nobody planted


def plain_rows(model, docs):
    return sorted((str(i), *x[:3], round(x[3], 9), round(x[4], 9)) for i, t in docs for x in model.segments(t or ""))


def spark_rows(df):
    return sorted((str(r.doc_id), r.paragraph, r.segment, r.family, round(r.score, 9), round(r.similarity, 9)) for r in df.collect())


def test_licences_are_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prose = " ".join(" ".join(r.text.split()) for r in docs.collect())
    notices = [*NOTICES, "Released under CC BY 4.0.", "Distributed under the GNU GPL v3", "Apache-2.0", *[t for ts in licenses.TEMPLATES.values() for t in ts]]
    lines = [prose[i * 997 : i * 997 + (37 * i) % 4000] + f"\n{x}\n" * (i % 2) + "\n \t\n" * (i % 3) + x for i, x in enumerate(notices)]
    extra = [(i, t) for i, t in enumerate(lines, 10**6)] + [(1, "\n\n".join(notices)), (2, " ".join(notices)), (3, prose[:200000]), (4, "\n\n\n"), (None, notices[0])]
    both = docs.union(spark.createDataFrame(extra, docs.schema))
    model = licenses.fit(docs)
    want = plain_rows(model, [(r.doc_id, r.text) for r in both.collect()])
    assert spark_rows(licenses.scan(both, model)) == want and len(want) > len(notices)


def test_licences_of_wrapped_and_embedded_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
    filler = " ".join(f"{w} river {k}" for k, w in enumerate(["mountain", "lake", "summer", "winter"] * 100))
    rows = [(1, f"Some words first.\n\n{mit}\n\nAnd more.", None), (2, f"{filler} Licensed under CC BY-SA 4.0. {filler}", None), (3, "This work is licensed under a Creative\nCommons Attribution 4.0 International License.", None)]
    got = {(r.doc_id, r.paragraph, r.family) for r in licenses.scan(odd_docs(spark, rows), licenses.train()).collect() if r.confirmed}
    assert got == {(1, 1, "mit"), (2, 0, "cc-by-sa"), (3, 0, "cc-by")}


def test_licences_unknown_and_odd(spark):
    rows = [(1, "A fishing license costs ten dollars.\n\nlicensed under the BSD license", None), (2, "Human rights are protected by law", None), (3, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", None)]
    got = {(r.doc_id, r.paragraph, r.family) for r in licenses.scan(odd_docs(spark, rows)).collect()}
    assert got == {(1, 1, "bsd"), (3, 0, "bsd")}
    docs = odd_docs(spark)
    assert sorted((r.doc_id, r.family, r.confirmed) for r in licenses.scan(docs).collect()) == [(1, "mit", True), (1, "mit", True), (8, "all-rights-reserved", True)]
    assert licenses.scan(docs.limit(0)).collect() == [] and LONG
