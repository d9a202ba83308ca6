"""Visible text and described fields of an HTML page, in one pass from left to right.

Every step moves forward: a tag is matched without backtracking, attributes are read from the matched tag alone,
and whatever has no end (a comment, a script, a tag) takes the rest of the page with it and ends the pass. So
time grows in proportion to the page, however it is made.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Elements of HTML whose content is text and not shown, other elements that are not shown, and elements that begin a new line.
RAW = frozenset("script style xmp iframe noembed noframes".split())
UNSEEN = frozenset("template noscript".split())
BREAKING = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())

#: A tag: slash, name, attributes. A '>' in a quoted value doesn't end it; a quote that is never closed is a character like any other.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_CHARSET = re.compile(r"charset\s*+=\s*+[\"']?([\w-]+)", re.I)
_COMMENT_END = re.compile(r"--!?>")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in [*RAW, "title", "textarea"]}
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def attribute(attributes: str, name: str) -> str | None:
    """The first value of an attribute, None where there is none."""
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() == name:
            return html.unescape(m[2] or m[3] or m[4] or "")
    return None


@dataclass
class Page:
    """What a page shows and what it says of itself."""

    parts: list[str] = field(default_factory=list)
    title: str | None = None
    language: str | None = None
    charset: str | None = None
    links: list[str] = field(default_factory=list)

    def text(self) -> str:
        """One line for each block, spaces collapsed."""
        return _LINES.sub("\n", _SPACES.sub(" ", "".join(self.parts))).strip()

    def start(self, name: str, attributes: str) -> None:
        if name == "a":
            link = attribute(attributes, "href")
            if link is not None:
                self.links.append(link)
        elif name == "html" and self.language is None:
            self.language = attribute(attributes, "lang")
        elif name == "meta" and self.charset is None and (m := _CHARSET.search(attributes)):
            self.charset = m[1]


def scan(source: str) -> Page:
    """Read a page. Tags that shouldn't stand where they do, elements without an end tag, and text outside of any element are all taken as they come.

    Scripts, styles, templates, noscript and titles are not shown; an unclosed noscript ends at the body. An unclosed
    head hides nothing, as all that is hidden in a head is hidden anywhere.
    """
    page, at, unseen = Page(), 0, {name: 0 for name in UNSEEN}
    parts = page.parts

    def shown(chunk: str) -> None:
        if chunk and not any(unseen.values()):
            parts.append(html.unescape(chunk) if "&" in chunk else chunk)

    while (i := source.find("<", at)) >= 0:
        shown(source[at:i])
        tag = _TAG.match(source, i)
        if tag:
            at = tag.end()
            name = tag[2].lower()
            if name in BREAKING:
                shown("\n")
            elif name in UNSEEN:
                unseen[name] = max(0, unseen[name] + (-1 if tag[1] else 1))
            elif name == "body" or (name == "head" and tag[1]):
                unseen["noscript"] = 0
            elif not tag[1] and name in _ENDS:
                end = _ENDS[name].search(source, at)
                if name == "textarea":
                    shown(source[at : end.start()] if end else source[at:])
                if not end:
                    return page
                if name == "title" and page.title is None and not any(unseen.values()):
                    page.title = " ".join(html.unescape(source[at : end.start()]).split())
                at = end.start()
            if not tag[1] and not any(unseen.values()):
                page.start(name, tag[3])
        elif source.startswith("<!--", i):
            end = _COMMENT_END.search(source, i + 2)
            if not end:
                return page
            at = end.end()
        elif source.startswith(("<!", "<?", "</"), i):
            at = source.find(">", i) + 1
            if not at:
                return page
        elif source[i + 1 : i + 2].isascii() and source[i + 1 : i + 2].isalpha():
            return page  # a tag without an end
        else:
            shown("<")
            at = i + 1
    shown(source[at:])
    return page
