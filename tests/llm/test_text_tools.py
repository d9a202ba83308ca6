import base64
import hashlib
import html.parser
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from gridloom.llm import common, entry, linededup, packing, pagetext, pieces, warc
from gridloom.llm.common import table
from tests.compare import same
from tests.llm.common import odd_docs, run


def check_packing(rows, docs):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in docs.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, v in ids.items():
        at = 0
        for start, n in sorted(by_doc[i]):
            assert start == at and n > 0
            at += n
        assert at == len(v)
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)


def test_packing(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    check_packing(run("op4_packing", spark, sf_dir).collect(), docs)


def test_packing_odd_rows(spark):
    docs = odd_docs(spark).dropDuplicates(["doc_id", "text"])
    check_packing(packing.pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert packing.pack(docs.limit(0)).collect() == []
    twice = odd_docs(spark).where("doc_id = 1")
    assert sum(r.length for r in packing.pack(twice).collect()) == 2 * packing.pack(twice).first().doc_tokens


def test_packing_balances_cost():
    lengths = np.random.default_rng(0).integers(1, 900, 3000)
    cost = defaultdict(float)
    for _, _, n, s, _ in packing.packed(lengths):
        cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
    full = [c for s, c in cost.items() if s < lengths.sum() // 1024]
    assert np.std(full) / np.mean(full) < 0.25


def test_packing_cuts_only_where_no_sequence_has_room():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 900, 1500), rng.geometric(0.004, 4000), np.array([3000, 1024, 1, 1]), np.array([5]), np.array([], np.int64)):
        room = packing.capacities(int(lengths.sum()))
        cost, left = [0.0 if n == 1024 else 1e15 + s for s, n in enumerate(room)], dict(enumerate(lengths.tolist()))
        for doc, start, n, s, _ in packing.packed(lengths):
            want = min(left[doc], 1024)
            fits = [(c, k) for k, c in enumerate(cost) if room[k] >= want]
            assert start == lengths[doc] - left[doc] and (s, n) == (min(fits)[1], want) if fits else n == room[s] == max(room)
            room[s], cost[s], left[doc] = room[s] - n, cost[s] + packing.LINEAR * n + packing.QUADRATIC * n * n, left[doc] - n
        assert not any(room) and not any(left.values())


def test_encoder_is_the_library(sf_dir):
    e = packing.Encoder()
    for t in ("", " a  b\t\n", "é漢🙂", "<|endoftext|>x", "can't WON'T 12345", " x y", "ª²³ ǅ"):
        assert e.ids(t).tolist() == [*e.slow.encode(t, add_special_tokens=False).ids, 0]


def test_pieces_are_the_library_s(spark, sf_dir):
    s = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [r.text for r in table(spark, sf_dir, "documents").collect()]
    texts += ["", "  a  b\n c\t<s>é漢🙂 ", "▁▁x ▁", "a" * 3000, "aaaa bbbb  ", "   ", "🙂🙂 漢字 def f(x):\n\treturn x+1", "<unk> </s>"]
    own = pieces.Pieces()
    got = own.encode(texts)
    assert [list(g) for g in got] == s.encode(texts)
    assert [own.decode(g) for g in got] == [s.decode(x) for x in s.encode(texts)]
    assert own.encode([]) == [] and own.encode(texts[:5])[0].tolist() == got[0].tolist()


def test_pieces_of_a_long_text_without_spaces():
    s = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("etaoinshrdlucmfwypvbgk"), 60000))
    own = pieces.Pieces()
    began = time.perf_counter()
    assert own.encode([text])[0].tolist() == s.encode(text) and time.perf_counter() - began < 30


def test_pieces_odd_rows(spark):
    docs = odd_docs(spark)
    rows = pieces.digests(docs).collect()
    assert len(rows) == docs.count() and all(r.exact for r in rows) and {r.n_ids for r in rows if r.doc_id in (2, 3)} == {0}
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(docs)).collect()}
    assert back[7] == "é漢🙂 mixed <|endoftext|> text" and pieces.digests(docs.limit(0)).collect() == []


def plain_text(page):
    return pagetext.scan(page).text()


class Reader(html.parser.HTMLParser):
    """The visible text by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title", "template", "noscript")
        self.parts += ["\n"] * (tag in pagetext.BREAKING)

    def handle_startendtag(self, tag, attrs):
        self.parts += ["\n"] * (tag in pagetext.BREAKING)

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title", "template", "noscript")
        self.parts += ["\n"] * (tag in pagetext.BREAKING)

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_warc_text_is_the_standard_parser_s(spark, sf_dir):
    for r in table(spark, sf_dir, "pages").collect():
        reader = Reader()
        reader.feed(r.html)
        reader.close()
        lines = [" ".join(x.split()) for x in "".join(reader.parts).split("\n")]
        assert plain_text(r.html) == "\n".join(x for x in lines if x)


def test_warc_hostile_pages_take_linear_time():
    n = 5 << 20
    for piece in ("<a ", "<a href=", "<a b='", '<a b="', "<a b='\"", "<script>", "<!--", "<title>", "</", "<![", "<p>x", "<a b='>' ", "= ", "<a b=\"c' ", "<template>", "&lt", "<textarea", "<a" + " " * 50):
        page = piece * (n // len(piece))
        began = time.perf_counter()
        pagetext.scan(page).text()
        pagetext.scan(f"<p>{page}>").text()
        assert time.perf_counter() - began < 20, piece


def test_warc_text_of_broken_pages():
    assert plain_text('<script>if (a) x = "<!--";</script>the text<style><!-- </style> stays') == "the text stays"
    assert plain_text("a<!-->b<!--->c<!-- d --!>e<!-- f") == "abce"
    assert plain_text('<p title="a > b">c</p ><a href=">">d</a><a href="unclosed>e</a>') == "c\nde"
    assert plain_text("a < b <3 <> </> </ x>c<?php d ?>e<!doctype html>f") == "a < b <3 <> cef"
    assert plain_text("<noscript>a<body>b<template>c<template>d</template>e</template>f") == "bf"
    assert plain_text("<textarea><b>x</b> &amp; y</textarea><xmp><p></xmp>z<plaintext") == "<b>x</b> & yz"
    page = pagetext.scan("<HTML LANG=en><meta http-equiv=content-type content='text/html; charset=latin-1'><title> a\n b </title><a HREF='x&amp;y' href=z>1</a><a href>2</a><a name=n>3</a><!--<a href=c>--><script><a href=s></script>")
    assert (page.language, page.charset, page.title, page.links) == ("en", "latin-1", "a b", ["x&y", ""])


def test_warc_source_headers(spark):
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Note: a: b\r\n\r\n"
    rows = [(1, "http://a/", "<urn:uuid:1>", "2020-02-03T04:05:06Z", http, bytearray(b"<p>x\xff</p>"), "extra"), (2, "http://b/", None, None, None, None, None)]
    source = spark.createDataFrame(rows, "page_id long, target_uri string, record_id string, date string, http_headers string, payload binary, block string")
    out = {(r.page_id, r.record_type): warc.parsed(bytes(r.record))[0] for r in warc.derive(source).collect()}
    headers, block = out[1, "conversion"]
    assert headers["WARC-Date"] == "2020-02-03T04:05:06Z" and headers["WARC-Refers-To"] == "<urn:uuid:1>" and block == "x\ufffd".encode()
    assert headers["WARC-Source-HTTP-Headers"] == "HTTP/1.1 200 OK; Content-Type: text/html; charset=utf-8; X-Note: a: b"
    assert headers["WARC-Source-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"<p>x\xff</p>").digest()).decode()
    assert out[1, "metadata"][1] == b"".join(b"source-http-header: " + x.encode() + b"\r\n" for x in http.split("\r\n") if x)
    assert out[2, "conversion"][1] == out[2, "metadata"][1] == b"" and "WARC-Refers-To" not in out[2, "conversion"][0]


def test_warc(spark, sf_dir):
    source = warc.responses(table(spark, sf_dir, "pages"))
    ids = {r.page_id: (r.record_id, r.target_uri, warc.digest(bytes(r.payload))) for r in source.collect()}
    rows = warc.derive(source).collect()
    assert len(rows) == 2 * len(ids) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        (headers, block), = warc.parsed(bytes(r.record))
        rid, uri, digest = ids[r.page_id]
        assert headers["WARC-Type"] == r.record_type and headers["WARC-Refers-To"] == rid == r.refers_to and headers["WARC-Target-URI"] == uri
        assert headers["WARC-Block-Digest"] == warc.digest(block) == r.block_digest and headers["WARC-Source-Payload-Digest"] == digest
        assert block == bytes(r.block) and int(headers["Content-Length"]) == len(block)
    assert all(b"<script" not in bytes(r.block) for r in rows if r.record_type == "conversion")


def test_warc_text_and_odd_rows(spark, tmp_path):
    page = "<html lang='de'><head><title>A &amp; B</title><style>x</style></head><body><!-- c --><p>Eins<br>zwei <b>drei</b></p><script>var t='</p>';</script><a href=\"/u?a=1&amp;b\">l</a> 1 < 2</body></html>"
    assert plain_text(page) == "Eins\nzwei drei\nl 1 < 2"
    assert warc.described(pagetext.scan(page), None) == "title: A & B\r\nlanguages-html: de\r\noutlink: /u?a=1&b L a/@href\r\n"
    pages = spark.createDataFrame([(1, "http://a", page, "x"), (1, "http://a", page, "x"), (2, None, None, "x"), (None, "u\r\nv", "", "x")], "page_id long, url string, html string, record_id string")
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 8 and warc.derive(warc.responses(pages.limit(0))).collect() == []
    warc.write(warc.derive(warc.responses(pages)), f"file://{tmp_path}/w")
    assert sum(len(warc.parsed(p.read_bytes())) for p in (tmp_path / "w").iterdir()) == 8


def test_warc_text_behind_an_unclosed_head():
    for page in ("<html><head><title>t</title><body><p>all the text</p>", "<head>\n<meta charset=utf-8><TITLE>a <script> b</TITLE><style>x</style>\n<p>all the text", "<head ><title>t</title>all the text", "<head/><link href=x></head >all the text", "<head-x>all</head-x> the text<script >x</script>"):
        assert plain_text(page) == "all the text"
    assert plain_text("<script-x>a</script-x><header>b</header><head><title>t") == "a\nb"


def test_line_dedup_sql(spark, sf_dir, duck):
    same(run("op8_line_dedup", spark, sf_dir), duck, entry.ORACLE_SQL["op8_line_dedup"])


def test_line_dedup_templates(spark):
    a, b = "Call us at 555-1234 for more details today please friends", "Call us at 555-9999 for more details today please friends"
    long = "one two three four five six seven eight nine ten eleven twelve thirteen {} fifteen sixteen"
    rows = [(1, f"{a}\nunique words stand alone in here", None), (2, f"{b}\nshort line", None), (3, f"short line\n{long.format('x')}", None), (4, long.format("y"), None), (5, "one two three other words follow then and nothing is alike here at all so it stays", None)]
    got = {r.doc_id: (r.text, r["__dropped"]) for r in linededup.dedup_lines(odd_docs(spark, rows)).collect()}
    assert got[1][1] == 0 and got[2] == ("short line", 1) and got[3][1] == 0 and got[4] == ("", 1) and got[5][1] == 0


def test_line_dedup_short_lines(spark):
    rows = [(i, f"Les.\n\n \t \n{10 + i}\nPage {i} of 9\nOnly {'abc'[i - 1]}", None) for i in (1, 2, 3)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(odd_docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "\n \t \n12\nOnly b", 3: "\n \t \n13\nOnly c"}
    twice = {r.doc_id: r["__dropped"] for r in linededup.dedup_lines(odd_docs(spark, rows[:2])).collect()}
    assert twice == {1: 0, 2: 0}


def test_line_dedup_open_field_in_lines_of_few_tokens(spark):
    rows = [(i, f"Posted by {x} in category news\nFiled under {x} one two three four five six seven eight nine\nin {x} each word is {x} {x} {x}", None) for i, x in enumerate(("alice", "bob", "carol"), 1)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(odd_docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1].split("\n")[2], 3: rows[2][1].split("\n")[2]}
    assert {r["__dropped"] for r in linededup.dedup_lines(odd_docs(spark, rows[:2])).collect()} == {0}


def test_line_dedup_fields_anywhere(spark):
    line = "The job of user {} in queue {} ran on host {} without error and was closed"
    rows = [(i, line.format(*(w * i for w in ("u", "v", "w"))) + f"\nwords {'a' * i} {'b' * i} {'c' * i} {'d' * i} that {'e' * i} are {'f' * i} all {'g' * i} open {'h' * i}", None) for i in (1, 2, 3)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(odd_docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1].split("\n")[1], 3: rows[2][1].split("\n")[1]}


def test_line_dedup_hot_keys_give_the_same(spark, sf_dir, duck, monkeypatch):
    monkeypatch.setattr(common, "HOT", 20)
    same(run("op8_line_dedup", spark, sf_dir), duck, entry.ORACLE_SQL["op8_line_dedup"])


def test_weighted_join(spark, monkeypatch):
    left = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(100)] + [(None, 100)], "k long, v long")
    right = spark.createDataFrame([(1, 50, "a"), (2, 9, "b"), (3, 9, "c")], "k long, n long, x string")
    want = {how: sorted(left.join(right.select("k", "x"), "k", how).collect()) if how == "inner" else left.join(right.select("k", "x"), "k", how).count() for how in ("inner", "left")}
    for hot in (1000, 4, 1):
        monkeypatch.setattr(common, "HOT", hot)
        assert sorted(common.weighted_join(left, right, ["k"], "n", ["x"], "inner").collect()) == want["inner"]
        assert common.weighted_join(left, right, ["k"], "n", ["x"], "left").count() == want["left"]


def test_masked_lines_of_hostile_length(spark):
    began = time.perf_counter()
    rows = [(i, t, None) for i, t in enumerate(("a" * 1000000, "1" + "a" * 1000000, "a1" * 500000, " " * 1000000, "\n" * 200000, "x y\n" * 100000, "".join(f"line {chr(97 + k % 26) * (k % 50)} of text here\n" for k in range(20000))))]
    rows.append((9, rows[-1][1], None))
    got = {r.doc_id: r["__dropped"] for r in linededup.dedup_lines(odd_docs(spark, rows)).collect()}
    assert got[9] > 19000 and not any(got[i] for i in range(6)) and time.perf_counter() - began < 90


def test_line_dedup_odd_rows(spark):
    docs = odd_docs(spark)
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "__lines", "__dropped"]
    rows = out.collect()
    assert len(rows) == docs.count() and [r.text for r in rows if r.doc_id == 2] == [None]
    assert {r["__dropped"] for r in rows if r.doc_id == 1} == {0} and [r.text for r in rows if r.doc_id == 8] == ["All rights reserved."]
    assert linededup.dedup_lines(docs.limit(0)).collect() == []
