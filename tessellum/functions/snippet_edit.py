"""Snippets cut to what surrounds their keywords, as proposals for patterns."""

from __future__ import annotations

import re

from tessellum.functions.legal_text import LEADER, TOKEN

#: Words kept on either side of the keywords, and what stands for the names in a notice.
PADDING, NAMES = 5, "$SKIP10"
_NOTICE = re.compile(rf"({LEADER}{TOKEN})\s+\S.*$")


def minimal(text: str, sline: int, keywords: set[int], licensed: set[int]) -> tuple[str, int]:
    """The text without the lines up to the last licensed one before the first keyword, and from the first licensed one after
    the last keyword on; and its first line. Line numbers count from 0 within the text. Nothing is cut if either set is empty."""
    if not keywords or not licensed:
        return text, sline
    lines = text.split("\n")
    inner = [k for k in keywords if 0 <= k < len(lines)]
    first, last = (min(inner), max(inner)) if inner else (len(lines), -1)
    start = max((k + 1 for k in licensed if k < first and k < len(lines)), default=0)
    end = min((k for k in licensed if k > last and k >= 0), default=len(lines))
    return "\n".join(lines[start:end]), sline + start


def edited(text: str, sline: int, keywords: set[int], licensed: set[int]) -> tuple[str, int, bool]:
    """The minimal text with PADDING words on either side of the keyword lines, names in notices replaced; its first line; and
    whether anything changed."""
    body, first = minimal(text, sline, keywords, licensed)
    lines = body.split("\n")
    marked = sorted(k - (first - sline) for k in keywords if k >= first - sline)
    if marked and marked[-1] < len(lines):
        start = sum(len(x) + 1 for x in lines[: marked[0]])
        end = sum(len(x) + 1 for x in lines[: marked[-1]]) + len(lines[marked[-1]])
        before, after = [m.start() for m in re.finditer(r"\S+", body[:start])], [m.end() for m in re.finditer(r"\S+", body[end:])]
        low = before[-PADDING] if len(before) > PADDING else 0
        high = end + after[PADDING - 1] if len(after) > PADDING else len(body)
        first += body[:low].count("\n")
        body = body[low:high]
    body = "\n".join(_NOTICE.sub(lambda m: f"{m[1]} {NAMES}", x) if _NOTICE.match(x) else x for x in body.split("\n"))
    return body, first, body != text
