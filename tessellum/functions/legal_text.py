"""Normalization and harvest of legal text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What a normalization takes out of a text, in this order, and the lines that it drops.
NORMALIZING = (
    (r"<[^>]+>", " "), (r"&[a-zA-Z][a-zA-Z0-9]*;|&#[0-9]+;", " "), (r"/\*+|\*+/", " "), (r"\b0[0-9]{4,}\b", " "), (r"(?m)^[ \t]*[0-9]{1,6}[ \t]+", ""),
    (r"(?im)^[ \t]*(?:[*#;>|=-]+|//+|dnl|rem)[ \t]?", ""), (r"\\f[A-Z]|\\f\([A-Za-z]{2}|\\&", ""), (r'(?m)^[ \t]*\.\\"[ \t]?', ""),
)
DROPPED_LINE = r"(?i)copyright|\(c\)|©|all rights reserved|[\w.+-]+@[\w.-]+\.\w+|https?://"
#: Addresses. Each begins where a run of its characters begins, so that a long run is read once.
URL = r"https?://[^\s,;)>\"'`]+"
EMAIL = r"[\w.+%-]+@[\w-]+\.[\w.-]*\w"
RESERVED = r"(?i)[@/.]example\.(?:net|com|org)(?:[^\w.-]|$)"
#: Longest address that is kept; a longer one is none.
LONGEST_URL, LONGEST_EMAIL = 4000, 512


def normalized_license_text(text: Column) -> Column:
    """The text without tags, entities, comment signs, line numbers and font codes, without the lines of notices and
    addresses, with single blanks."""
    for pattern, instead in NORMALIZING:
        text = F.regexp_replace(text, pattern, instead)
    kept = F.filter(F.split(text, "\n"), lambda line: ~line.rlike(DROPPED_LINE))
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\s+", " "))


def normalized_expression(expression: Column) -> Column:
    """A license expression in lower case with single blanks, without licenseref-, + written out, and a flat list of
    alternatives sorted."""
    out = F.regexp_replace(F.lower(F.trim(expression)), r"\s+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"licenseref-", ""), r"\+", "-or-later")
    flat = out.rlike(r" or ") & ~out.rlike(r" and | with |[()]")
    return F.when(flat, F.array_join(F.array_sort(F.array_distinct(F.split(out, " or "))), " or ")).otherwise(out)


def _addresses(text: Column, sign: str, pattern: str, longest: int) -> Column:
    found = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a: (F.length(a) <= longest) & ~a.rlike(RESERVED))
    return F.when(F.contains(text, F.lit(sign)), found).otherwise(F.array().cast("array<string>"))


def urls(text: Column) -> Column:
    """The addresses of pages in a text, without those of the hosts reserved for examples."""
    return _addresses(text, "://", URL, LONGEST_URL)


def emails(text: Column) -> Column:
    """The lower-cased mail addresses in a text, without those of the hosts reserved for examples."""
    return _addresses(F.lower(text), "@", rf"(?<![\w.+%-]){EMAIL}", LONGEST_EMAIL)


# How a notice begins, what is a gap to be filled in, and where the license itself begins.
LEADER = r"[\s#*/;!|<>+-]*"
TOKEN = r"(?:SPDX-(?:File|Snippet)CopyrightText:|Copyright(?:\s*(?:\(c\)|\(C\)|©))?|©(?:\s*Copyright)?|(?:\(c\)|\(C\))\s*Copyright|(?:\(c\)|\(C\))(?=\s*\d{4}))"
PLACEHOLDER = re.compile(r"\b(?:YEAR|YYYY|yyyy|xxxx|XXXX)\b|\b(?i:name\s+of\s+(?:the\s+)?(?:author|copyright\s+(?:owner|holder)))\b|[<\[][^>\]]{0,40}(?i:year|name|author|owner|holder)[^>\]]{0,40}[>\]]")
BODY = re.compile(r"(?i)(?:Permission\s+is\s+hereby|Redistribution\s+and\s+use|This\s+(?:program|software|library|file|work)\s+is\s+(?:free|licensed)|Licensed\s+under|THE\s+SOFTWARE\s+IS\s+PROVIDED)")
#: Most lines that go on from the first one of a notice, most characters of a notice, and of a line that can hold one.
FOLLOWING, LONGEST_NOTICE, LONGEST_LINE = 4, 1024, 300

_FIRST = re.compile(rf"({LEADER})({TOKEN})\s+((?:[0-9(<\"'©]|[^\W\d_])\S*.*)")
_NEXT = re.compile(rf"({LEADER})(\S.*)")
_OPEN_END = re.compile(r"(?:,|\band\b|\bby\b|\d{4})$")
_CLOSING = re.compile(r"\s*(?:\*/|-->|\*\)|--\}\}|\}\})$")


def _goes_on(line: str, indent: int, before: str) -> tuple[int, str] | None:
    """The rest of a line that belongs to the notice above it: one further in, one after an open end, or a rights clause."""
    m = _NEXT.match(line) if len(line) <= LONGEST_LINE else None
    if not m or re.match(TOKEN, m[2]) or BODY.match(m[2]):
        return None
    further = len(m[1]) > indent or _OPEN_END.search(before) or re.match(r"(?i)All rights reserved\b", m[2])
    return (len(m[1]), m[2]) if further else None


def notices(text: str | None) -> list[str]:
    """The copyright notices of a text in its order, each as often as it stands there, folded to one line."""
    if not text or not re.search(r"Copyright|\([cC]\)|©", text):
        return []
    out, lines, at = [], text.split("\n"), 0
    while at < len(lines):
        line, at = lines[at], at + 1
        m = _FIRST.match(line) if len(line) <= LONGEST_LINE else None
        # a sentence about copyright goes on in lower case or defines a term
        if not m or (m[3][0].isalpha() and not m[3][0].isupper()) or re.match(r"(?:Holders?|Owners?|Notice)\b", m[3]):
            continue
        parts = [f"{m[2]} {m[3]}"]
        while at < len(lines) and len(parts) <= FOLLOWING and (more := _goes_on(lines[at], len(m[1]), parts[-1])):
            parts.append(more[1])
            at += 1
        notice = _CLOSING.sub("", " ".join(" ".join(parts).split()))[:LONGEST_NOTICE]
        if not PLACEHOLDER.search(notice):
            out.append(notice)
    return out


def copyrights(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(notices)

    return of(text)


_REVIEW = re.compile(r"\s*#+\s*Legal-Review-Notice:\s*(.+?)\s*$", re.I)
_COMMENT = re.compile(r"\s*#++\s*(\S.*?)\s*$")


def review_notices(text: str | None) -> list[str]:
    """The review notices in the comments of a text: each goes on over the comment lines below it, up to an empty comment,
    another line, or the next notice."""
    out: list[str] = []
    open_ = False
    for line in (text or "").split("\n"):
        if m := _REVIEW.match(line):
            out.append(m[1])
            open_ = True
        elif open_ and (m := _COMMENT.match(line)):
            out[-1] += "\n" + m[1]
        else:
            open_ = False
    return out


def legal_review_notices(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(review_notices)

    return of(text)
