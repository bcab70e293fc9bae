"""Main text of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Which elements are dropped, where text is looked for (in this order), and lengths in characters.
DROPPED = ("script", "style", "nav", "footer", "aside", "header", "noscript", "figure", "figcaption", "iframe", "form")
PLACES = ("article", '[role="main"]', ".article-body", ".article-content", ".story-body", ".post-content", ".entry-content", ".content-body", ".page-content", "main")
MOST, LEAST = 4000, 120
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Texts(HTMLParser):
    """Text by the first element of each place, and of the whole page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[int]]] = []
        self.dropped, self.found, self.live = 0, {}, set()
        self.all: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        if tag in DROPPED:
            self.dropped += 1
        a, here = dict(attrs), []
        classes = (a.get("class") or "").split()
        for k, place in enumerate(PLACES):
            hit = place[1:] in classes if place[0] == "." else a.get("role") == "main" if place[0] == "[" else tag == place
            if hit and k not in self.found and not self.dropped:
                self.found[k] = []
                self.live.add(k)
                here.append(k)
        self.open.append((tag, here))

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _ in self.open]:
            return
        while self.open:
            name, here = self.open.pop()
            self.dropped -= name in DROPPED
            self.live -= set(here)
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.all.append(data)
            for k in self.live:
                self.found[k].append(data)


def main_text(html: str | None, most: int | None = MOST) -> str:
    """Text of the first place that has enough, else of the page, else nothing; white space is one space. The whole page is read; ``most`` characters are returned, all if None."""
    parser = _Texts()
    parser.feed(html or "")
    parser.close()
    for parts in [*(parser.found[k] for k in sorted(parser.found)), parser.all]:
        text = " ".join(" ".join(parts).split())
        if len(text) >= LEAST:
            return text[:most]
    return ""


#: What Python's ``str.split`` takes for white space.
_SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
_TAG = r"""<[a-zA-Z/!][^<>"']*(?:"[^"<>]*"[^<>"']*|'[^'<>]*'[^<>"']*)*>"""


def _without_dropped(html: Column) -> Column:
    """A page without plain comments and dropped elements, none of which may hold its own kind."""
    x = F.regexp_replace(html, r"<!--[^<>-]*(?:-[^<>-]+)*-->", " ")
    for tag in DROPPED:
        x = F.regexp_replace(x, rf"(?is)<{tag}(?:\s[^<>]*)?>(?:(?!<{tag}\b).)*?</{tag}\s*>", " ")
    return x


def _is_simple(html: Column, rest: Column) -> Column:
    """Whether regular expressions read a page as a parser does. ``rest`` is the page without dropped elements.

    Every tag is whole, no dropped element is left open or lies across another, places are elements that occur once and are closed, not classes or roles, nothing but
    known entities is to be decoded, and there are no elements whose content is not markup.
    """
    once = [F.regexp_count(rest, F.lit(rf"(?i)<{t}\b")) for t in ("article", "main")]
    closed = [F.regexp_count(rest, F.lit(rf"(?is)<{t}(?:\s[^<>]*)?>.*</{t}\s*>")) for t in ("article", "main")]
    ended = [F.regexp_count(rest, F.lit(rf"(?i)</{t}\b")) for t in ("article", "main")]
    kinds, classes = "|".join(DROPPED), "|".join(p[1:] for p in PLACES if p[0] == ".")
    odd = [
        rest.contains("<!--"), rest.rlike(rf"(?i)</?(?:{kinds})\b"), F.regexp_replace(rest, _TAG, "").contains("<"), rest.rlike(rf"(?i)\brole\b|{classes}"),
        rest.rlike(r"&(?!(?:lt|gt|quot|copy|middot|amp);)[#a-zA-Z]"), html.rlike(r"(?i)<(?:title|textarea)\b[^<>]*>[^<]*<(?!/(?:title|textarea)\s*>)"),
        html.rlike(r"(?i)<(?:xmp|plaintext|noembed|noframes|textarea|svg|math|template|\?|!\[)|/\s*>|<(?:article|main)[^a-z\s>]|\x00"),
        *[(o > 1) | (o != c) | (o != e) for o, c, e in zip(once, closed, ended, strict=True)],
    ]
    return ~F.greatest(*odd)


def _text_of(markup: Column) -> Column:
    x = F.regexp_replace(markup, r"<[^<>]*>", " ")
    for name, char in _ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(x, _SPACE, " "))


def body_text(html: Column, ended: bool = False, most: int | None = MOST) -> Column:
    """The main text of a page as :func:`main_text` gives it: by regular expressions on the JVM where a page is simple, else by the parser in a pandas UDF, which gets only those.

    ``ended``: only entities that end with a semicolon are decoded; else a parser also takes some that don't (``&amp`` where a text was cut).
    ``most``: as many characters of the text are returned, all if None.
    """

    @F.pandas_udf("string")
    def parsed(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None or p != p else main_text(p, most))

    page = F.coalesce(html, F.lit(""))
    if ended:
        page = F.regexp_replace(page, r"&(?!#?[a-zA-Z0-9]+;)", "&amp;")
    rest = _without_dropped(page)
    simple = _is_simple(page, rest)
    found = [F.regexp_extract(rest, rf"(?is)<{t}(?:\s[^<>]*)?>(.*)</{t}\s*>", 1) for t in ("article", "main")]
    texts = F.filter(F.transform(F.array(*found, rest), _text_of), lambda t: F.length(t) >= LEAST)
    text = F.get(texts, F.lit(0))
    if most is not None:
        text = F.substring(text, 1, most)
    return F.when(simple, F.coalesce(text, F.lit(""))).otherwise(parsed(F.when(~simple, page)))


def plain_text(html: Column) -> Column:
    """All text of a page by regular expressions alone, for well-formed pages: dropped elements and tags go, common entities are decoded."""
    x = F.coalesce(html, F.lit(""))
    for tag in DROPPED:
        x = F.regexp_replace(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for name, char in _ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))
