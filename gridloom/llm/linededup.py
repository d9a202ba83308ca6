"""Removal of recurring lines by a fixed-depth tree of log templates, in DataFrame operations only.

The tree: a line goes down by its number of tokens, then by its leading tokens (one in lines of fewer than LONG
tokens, a quarter of them in longer ones, three at least), to a leaf. Tokens with a digit are variable fields from
the start. Within a leaf the lines' own words tell what else is variable: what stands behind the leading tokens is cut
into PLACES places of like length, single tokens in lines that are not much longer, and a place's support is the number
of documents whose line has the same there. A place of half the support or less of the line's middle place is a
variable field, wherever in the line it stands. A line's template is what is left with its fields open; it holds if no
more than a fifth of the tokens are open. Lines and templates that occur in several documents recur, and are dropped
from all documents but the first. Lines of fewer than SHORT tokens have no field that could be left open and are
compared whole.

Lines travel as hashes: 128 bits stand for a line, 32 for a place within its leaf. What could be hot (a line of every
document, a leaf of very many lines) is counted first. A key of more than a thousandth of the rows, and there are
fewer than a thousand such, is joined by broadcast; the others shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import hash_pair, once, weighted_join, written

#: Lines of fewer tokens are compared whole.
SHORT = 5
#: Lines of so many tokens have LEADING leading tokens or more instead of one.
LONG, LEADING = 13, 3
#: Places that a line's other tokens are cut into at most.
PLACES = 12
#: One in so many tokens of a template may be open.
OPEN = 5
#: What recurs by chance more easily, lines below SHORT and the templates of lines below LONG, needs MIN_DOCS_WEAK documents.
MIN_DOCS, MIN_DOCS_WEAK = 2, 3
FIELD = "<*>"
#: A token with a digit; looked for at the beginning of tokens only, so a long token is read once.
VARIABLE = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def masked(line: Column) -> Column:
    """The line with single spaces between its tokens and variable fields open; as it is if it has nothing else; null if it is blank."""
    bare = lambda opened: F.replace(F.replace(opened, F.lit(FIELD)), F.lit(" ")) == ""
    opened = lambda s: let(F.regexp_replace(s, VARIABLE, FIELD), lambda o: F.when(bare(o), s).otherwise(o))
    of = lambda s: F.when(s.rlike("[0-9]"), opened(s)).when(s.rlike(r"\S"), s)
    return let(F.trim(line), lambda t: F.when(t.contains("  "), let(F.regexp_replace(t, " {2,}", " "), of)).otherwise(of(t)))


def leading(n: Column) -> Column:
    """How many of a line's n tokens lead."""
    return F.when(n < LONG, 1).otherwise(F.greatest(F.lit(LEADING), (n / 4).cast("int")))


def placed(line: Column) -> Column:
    """A masked line's number of tokens n, its leaf and its places, which lines of fewer than SHORT tokens or of fields only lack."""

    def places(tokens: Column, s: Column) -> Column:
        edges = F.transform(F.sequence(F.lit(0), s["many"]), lambda i: s["lead"] + (i * (s["n"] - s["lead"]) / s["many"]).cast("int"))
        word = lambda a, b: F.pmod(F.xxhash64(F.slice(tokens, a + 1, b - a)), F.lit((1 << 31) - 1)).cast("int")
        return let(edges, lambda e: F.zip_with(F.slice(e, 1, s["many"]), F.slice(e, 2, s["many"]), word))

    def of(tokens: Column) -> Column:
        n = F.size(tokens)
        has_leaf = (n >= SHORT) & F.exists(tokens, lambda t: t != FIELD)
        sizes = F.struct(n.alias("n"), leading(n).alias("lead"), F.least(F.lit(PLACES), n - leading(n)).alias("many"))
        known = let(sizes, lambda s: F.struct(s["n"].alias("n"), F.xxhash64(s["n"], F.slice(tokens, 1, s["lead"])).alias("leaf"), places(tokens, s).alias("places")))
        none = F.struct(n.alias("n"), F.lit(None).cast("long").alias("leaf"), F.lit(None).cast("array<int>").alias("places"))
        return F.when(has_leaf, known).otherwise(none)

    return let(F.split(line, " "), of)


def templates(lines: DataFrame) -> DataFrame:
    """Of different lines (h1, h2, n, leaf, places, docs, first) those that have a template: h1, h2, n, docs, first and t1, t2, the template's hashes."""
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("lines")).where("lines > 1")
    near = weighted_join(lines, written(leaves), ["leaf"], "lines", ["lines"], "inner").drop("lines")
    each = near.select("h1", "h2", "n", "docs", "first", "leaf", F.size("places").alias("many"), F.posexplode("places").alias("at", "word"))
    words = written(each.withColumns(dict(zip(("w1", "w2"), hash_pair("w", "leaf", "at", "word"), strict=True))))
    shared = words.groupBy("w1", "w2").agg(F.count("*").alias("lines"), F.sum("docs").alias("support")).where("lines > 1")
    known = weighted_join(words, written(shared), ["w1", "w2"], "lines", ["support"], "left").withColumn("support", F.coalesce("support", "docs"))
    line = known.groupBy("h1", "h2", "n", "leaf", "many", "docs", "first").agg(F.sort_array(F.collect_list(F.struct("at", "word", "support"))).alias("parts"))
    edge = lambda i: (i * (F.col("n") - leading(F.col("n"))) / F.col("many")).cast("int")
    middle = F.element_at(F.sort_array(F.col("parts.support")), ((F.size("parts") + 1) / 2).cast("int"))
    marked = once(line, "middle", middle)
    opened = F.transform("parts", lambda p: F.when(p["support"] * 2 > F.col("middle"), p["word"]))
    tokens = F.aggregate("parts", F.lit(0), lambda acc, p: acc + F.when(p["support"] * 2 > F.col("middle"), 0).otherwise(edge(p["at"] + 1) - edge(p["at"])))
    return marked.where(tokens * OPEN <= F.col("n")).withColumn("opened", opened).select("h1", "h2", "n", "docs", "first", *hash_pair("t", "leaf", F.transform("opened", lambda x: F.coalesce(x, F.lit(-1)))))


def recurring(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_docs_weak: int) -> DataFrame:
    """k1, k2 (hashes of id and text) of documents that lose lines, and drop: the hashes (h1, h2) of those."""
    weak = max(min_docs, min_docs_weak)
    lines = F.array_compact(F.array_distinct(F.transform(F.split("text", "\n"), masked)))
    each = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    every = each.select("id", *hash_pair("k", "id", "text"), F.explode(lines).alias("m"))
    parts = once(every.select("id", *hash_pair("h", "m"), "m"), "p", placed(F.col("m"))).select("id", "h1", "h2", "p.*")
    different = written(parts.groupBy("h1", "h2", "n", "leaf", "places").agg(F.count("*").alias("docs"), F.min("id").alias("first")))
    generalised = templates(different.where("leaf IS NOT NULL"))
    whole = different.where(F.col("docs") >= min_docs).select("h1", "h2", "n", "docs", "first", F.lit(None).cast("long").alias("t1"), F.lit(None).cast("long").alias("t2"))
    watched = whole.union(generalised).groupBy("h1", "h2", "n", "docs", "first").agg(F.max("t1").alias("t1"), F.max("t2").alias("t2"))
    narrow = every.select("id", "k1", "k2", *hash_pair("h", "m"))
    found = written(weighted_join(narrow, written(watched), ["h1", "h2"], "docs", ["n", "docs", "first", "t1", "t2"], "inner"))
    # a row counts once for a template, however many of its lines have it; rows alike in id and text each count
    copies = found.where("t1 IS NOT NULL").groupBy("t1", "t2", "k1", "k2", "h1", "h2").agg(F.count("*").alias("c"), F.min("id").alias("id"))
    rows = copies.groupBy("t1", "t2", "k1", "k2").agg(F.max("c").alias("c"), F.min("id").alias("id"), F.sum("c").alias("lines"))
    counts = rows.groupBy("t1", "t2").agg(F.sum("c").alias("t_docs"), F.min("id").alias("t_first"), F.sum("lines").alias("lines")).where(F.col("t_docs") >= min_docs)
    judged = weighted_join(found, written(counts), ["t1", "t2"], "lines", ["t_docs", "t_first"], "left")
    elsewhere = lambda c: F.col(c).isNotNull() & F.coalesce(F.col("id") != F.col(c), F.lit(True))
    line = (F.col("docs") >= F.when(F.col("n") < SHORT, weak).otherwise(min_docs)) & elsewhere("first")
    template = (F.col("t_docs") >= F.when(F.col("n") < LONG, weak).otherwise(min_docs)) & elsewhere("t_first")
    return judged.where(line | F.coalesce(template, F.lit(False))).groupBy("k1", "k2").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_docs_weak: int = MIN_DOCS_WEAK) -> DataFrame:
    """All rows and columns of docs, text without recurring lines; and __lines, __dropped, their numbers.

    A line goes if it or its template occurs in min_docs rows or more (min_docs_weak for weak ones, see
    MIN_DOCS_WEAK), unless the row has the smallest id of those: the first document keeps what recurs. A row
    counts once for a line or template. Blank lines stay. Lines of nothing but variable fields are compared as they
    are: numbers alone are not alike. A null text stays null, with 0 lines; a row with a null id is never first; if
    all rows of a line have none, it stays. Rows of the same id and text get the same result. An empty table gives
    an empty table. Other columns come along, whatever their names; where they are called __lines or __dropped,
    the numbers get one more underscore in front. Tables of lines are written to spark.checkpoint.dir.
    """
    drop = recurring(docs, id_col, text_col, min_docs, min_docs_weak)
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no column's name is in the way
    held = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in own.items()], *hash_pair("k", F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    joined = held.join(drop, ["k1", "k2"], "left")
    whole = F.col(own[text_col])
    # hashes in about as many slots as each then holds: a line is looked for in one
    slots = F.ceil(F.sqrt(F.size("drop")))
    dealt = once(joined, "slots", F.transform(F.sequence(F.lit(0).cast("bigint"), slots - 1), lambda b: F.filter("drop", lambda d: F.pmod(d["h1"], slots) == b)))

    def stays(line: Column) -> Column:
        gone = lambda h: F.array_contains(F.col("slots")[F.pmod(h["h1"], F.size("slots")).cast("int")], h)
        return let(masked(line), lambda m: F.when(m.isNull(), True).otherwise(~let(F.struct(*hash_pair("h", m)), gone)))

    split = F.split(whole, "\n")
    kept = F.when(F.col("drop").isNotNull(), F.filter(split, stays))
    result = once(dealt, "kept", kept)
    text = F.when(F.col("drop").isNull(), whole).otherwise(F.array_join("kept", "\n"))
    columns = [(text if c == text_col else F.col(own[c])).alias(c) for c in docs.columns]
    free = lambda c: c if c not in docs.columns else free(f"_{c}")
    n = F.when(whole.isNull(), 0).otherwise(F.size(split))
    return result.select(*columns, n.alias(free("__lines")), F.when(F.col("drop").isNull(), 0).otherwise(n - F.size("kept")).alias(free("__dropped")))
