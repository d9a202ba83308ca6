"""Rules of metadata, names, links and layouts as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directives of date patterns and what they match.
DIRECTIVES = {"Y": "([0-9]{4})", "m": "([0-9]{2})", "d": "([0-9]{2})", "j": "([0-9]{3})", "H": "([0-9]{2})", "M": "([0-9]{2})", "S": "([0-9]{2})"}
GAP_FILLS = ("none", "carry-forward")


def time_by_pattern(name: Column, pattern: str) -> Column:
    """The timestamp that a name holds by a pattern of %Y %m %d %j %H %M %S (%% is a percent sign); null if none or no such day."""
    out, order = "", []
    for literal, mark in re.findall(r"([^%]+)|%(.?)", pattern):
        if literal:
            out += re.escape(literal)
        elif mark == "%":
            out += "%"
        elif mark in DIRECTIVES and mark not in order:
            out += DIRECTIVES[mark]
            order.append(mark)
        else:
            raise ValueError(f"pattern {pattern!r}: %{mark} is unknown or repeated")
    if "Y" not in order or ("j" in order) == ("m" in order) or {"j", "d"} <= set(order):
        raise ValueError(f"pattern {pattern!r} needs %Y with %m (and %d), or with %j")
    if pattern.startswith("%") and not pattern.startswith("%%"):
        out = "(?<![0-9])" + out
    if re.search("%[YmdjHMS]$", pattern):
        out += "(?![0-9])"
    part = lambda m, other: F.try_to_number(F.nullif(F.regexp_extract(name, out, order.index(m) + 1), F.lit("")), F.lit("9999")).cast("int") if m in order else F.lit(other)
    month, day = part("m", 1), part("d", 1)
    text = F.format_string("%04d-%02d-%02d", part("Y", 0), month, day)
    date = F.try_to_timestamp(F.when(part("Y", 0).isNotNull() & month.isNotNull() & day.isNotNull(), text), F.lit("yyyy-MM-dd")).cast("date")
    if "j" in order:
        moved = F.date_add(date, part("j", 1) - 1)
        date = F.when((part("j", 1) >= 1) & (F.year(moved) == F.year(date)), moved)
    clock = [part("H", 0), part("M", 0), part("S", 0)]
    seconds = clock[0] * 3600 + clock[1] * 60 + clock[2]
    ok = (clock[0] < 24) & (clock[1] < 60) & (clock[2] < 60)
    return F.when(ok, F.timestamp_seconds(F.unix_date(date).cast("long") * 86400 + seconds))


def squashed(wkt: Column) -> Column:
    """A definition without white space outside quotes."""
    return F.regexp_replace(wkt, r'("[^"]*")|\s+', "$1")


def same_crs(a_code: Column, a_wkt: Column, b_code: Column, b_wkt: Column) -> Column:
    """same, different or unknown: by the definition of each side's highest rank (text before code)."""
    text = a_wkt.isNotNull() & b_wkt.isNotNull()
    code = a_wkt.isNull() & b_wkt.isNull() & a_code.isNotNull() & b_code.isNotNull()
    return (
        F.when(text & (squashed(a_wkt) == squashed(b_wkt)), "same")
        .when(code, F.when(F.upper(a_code) == F.upper(b_code), "same").otherwise("different"))
        .otherwise("unknown")
    )


def destination_problem(text: Column) -> Column:
    """Why a text is no SCHEME://BUCKET/PREFIX to write to; null if it is one."""
    m = lambda i: F.regexp_extract(text, r"^([a-z][a-z0-9+.-]*)://([^/?#]*)/?([^?#]*)", i)
    prefix = F.trim(m(3), F.lit("/"))
    return (
        F.when(text.rlike("^https?://"), "web address")
        .when((m(1) == "") | (m(2) == ""), "no storage location")
        .when(text.rlike("[?#]") | m(2).contains("@"), "credentials, query or fragment")
        .when(prefix.rlike(r"(^|/)(\.{1,2}|)(/|$)") & (prefix != ""), "empty or dotted segment")
    )


def public_problem(url: Column) -> Column:
    """Why a URL cannot be linked to; null if it can."""
    host = F.regexp_extract(url, r"^https?://(?:[^/@]*@)?([^/:?#]*)", 1)
    return (
        F.when(~url.rlike("^https?://[^/?#]"), "not a web address")
        .when(url.startswith("http://") & ~host.isin("localhost", "127.0.0.1"), "plain http")
        .when(url.rlike("^https?://[^/]*@|[?#]"), "credentials, query or fragment")
    )


def layout_problem(chunks: Column, shards: Column, lead: list[int]) -> Column:
    """Chunks must be (1, *lead, cell, cell), shards the same with any number of steps; null if so."""
    n = len(lead) + 3
    cell = chunks[n - 1]
    front = F.array(F.lit(1), *map(F.lit, lead), cell, cell)
    behind = F.slice(shards, 2, n - 1) == F.slice(front, 2, n - 1)
    return (
        F.when(F.size(chunks) != n, "dimensions")
        .when(chunks != front, "chunks")
        .when(shards.isNotNull() & ~(behind & (shards[0] >= 1)), "shards")
    )


def band_problem(names: Column) -> Column:
    """A list of bands must hold names, each once."""
    return (
        F.when(names.isNull() | (F.size(names) == 0), "no bands")
        .when(F.exists(names, lambda x: x.isNull() | (x == "")), "empty name")
        .when(F.size(F.array_distinct(names)) < F.size(names), "repeated name")
    )


def provenance_problem(sources: Column, composite: Column, gap_fill: Column, gap_fills: tuple[str, ...] = GAP_FILLS) -> Column:
    return (
        F.when(sources.isNull(), "no sources")
        .when(composite.isNull() | (composite == ""), "no composite")
        .when(gap_fill.isNull() | ~gap_fill.isin(*gap_fills), "gap fill")
    )


def levels_problem(assets: Column, derived_from: Column, scales: Column) -> Column:
    """Level i is asset i, made of level i - 1 at half its size."""
    return F.when(F.size(assets) == 0, "empty").when(
        F.exists(F.transform(assets, lambda a, i: F.coalesce(a != i.cast("string"), F.lit(True))), lambda x: x), "assets"
    ).when(
        F.exists(F.transform(assets, lambda a, i: (i > 0) & F.coalesce((derived_from[i] != (i - 1).cast("string")) | (scales[i] != 2), F.lit(True))), lambda x: x), "derivation"
    )


def range_problem(start: Column, size: Column, header: Column, got: Column) -> Column:
    """Whether a partial response is the range that was asked for: its Content-Range and the number of bytes."""
    m = lambda i: F.nullif(F.regexp_extract(header, r"^bytes ([0-9]+)-([0-9]+)/([0-9]+|\*)$", i), F.lit("")).cast("long")
    return (
        F.when(m(1).isNull(), "no range").when(m(2) < m(1), "no range").when(m(1) != start, "other start")
        .when(m(2) - m(1) + 1 > size, "too much").when(got != m(2) - m(1) + 1, "bytes missing")
    )


def strip_rows(budget: Column, fixed: Column, per_row: Column, height: int, cell: int) -> Column:
    """Rows of a strip that fit a budget of bytes: all, else equal strips in whole cells; null if one cell does not fit."""
    whole = fixed + per_row * height
    least = fixed + per_row * min(cell, height)
    limit = F.greatest(F.lit(cell), (F.floor((budget - fixed) / per_row / cell) * cell).cast("int"))
    pieces = F.ceil(F.lit(height) / limit)
    even = (F.ceil(F.ceil(F.lit(height) / pieces) / cell) * cell).cast("int")
    return F.when(whole <= budget, F.lit(height)).when(least <= budget, F.least(limit, even))


def to_projected(transform: tuple[float, ...], col: Column, row: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = map(F.lit, map(float, transform))
    return a * col + b * row + c, d * col + e * row + f


def to_pixel(transform: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = map(float, transform)
    det = a * e - b * d
    dx, dy = x - F.lit(c), y - F.lit(f)
    return (F.lit(e) * dx - F.lit(b) * dy) / F.lit(det), (F.lit(a) * dy - F.lit(d) * dx) / F.lit(det)
