"""Text of markup, and lines of a bounded length with the line that each came from."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of markup files and elements whose content is no text; what ends a line past the limit.
MARKUP_NAME = r"(?i)\.(?:x?html?|xml|xhtml|svg|rng|xsl|xslt|xsd)$"
SILENT = ("script", "style")
LINE_END, LIMIT, TOO_LONG = ' ;{}"', 115, 60_000


def looks_like_markup(path: Column, text: Column) -> Column:
    """Whether a text is markup: by the ending of its name and a tag in it, or by what it begins with."""
    by_name = path.rlike(MARKUP_NAME) & text.rlike(r"<[A-Za-z!?/]")
    return F.coalesce(by_name | text.rlike(r"<\?xml\b|(?i:<!DOCTYPE\s+html|<html[\s>])"), F.lit(False))


class _Blocks(HTMLParser):
    """Text between tags, and in comments, as (line, text) with single blanks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str]] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in SILENT

    def handle_endtag(self, tag: str) -> None:
        self.silent = max(0, self.silent - (tag in SILENT))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        pass

    def handle_data(self, data: str) -> None:
        if not self.silent and data.strip():
            before = data[: len(data) - len(data.lstrip())]
            self.found.append((self.getpos()[0] + before.count("\n"), " ".join(data.split())))

    def handle_comment(self, data: str) -> None:
        self.handle_data(re.sub(r"&(#?\w+);", lambda m: __import__("html").unescape(m[0]), data))


def blocks(text: str | None) -> list[tuple[int, str]]:
    parser = _Blocks()
    parser.feed(text or "")
    parser.close()
    return parser.found


def stripped(text: Column) -> Column:
    """The blocks of a markup text: array of (line, text)."""

    @F.pandas_udf("array<struct<line: int, text: string>>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"line": n, "text": s} for n, s in blocks(t)])

    return of(text)


def pieces(line: Column, limit: int = LIMIT) -> Column:
    """A line cut at the first blank, semicolon or brace past the limit, or before the first quote; one that has none is left."""
    return F.when(F.length(line) < limit, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(rf".{{{limit}}}[^{LINE_END}]*[{LINE_END[:-1]}]?|.+"), F.lit(0)))


def processed(text: Column) -> Column:
    """Array of (original, text): the lines of a text cut to length, each with the line that it came from. A text with a line that
    nobody can read is left as it is."""
    lines = F.split(text, "\n")
    cut = F.flatten(F.transform(lines, lambda line, at: F.transform(pieces(line), lambda p: F.struct((at + 1).alias("original"), p.alias("text")))))
    whole = F.transform(lines, lambda line, at: F.struct((at + 1).alias("original"), line.alias("text")))
    return F.when(F.exists(lines, lambda line: F.length(line) > TOO_LONG), whole).otherwise(cut)
