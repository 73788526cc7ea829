"""License expressions: parsing and canonical form.

Grammar: alternatives (OR) of conjunctions (AND) of licenses, each perhaps WITH an exception; parentheses group. OR binds
weakest. A text that does not follow the grammar has no canonical form."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(\(|\)|[^\s()]+)")


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = _TOKEN.findall(text), 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def chain(self, word: str, inner) -> tuple:
        members = [inner()]
        while (self.peek() or "").upper() == word:
            self.at += 1
            members.append(inner())
        return members[0] if len(members) == 1 else (word, members)

    def alternatives(self):
        return self.chain("OR", self.conjunction)

    def conjunction(self):
        return self.chain("AND", self.single)

    def single(self):
        token = self.peek()
        if token is None or token == ")" or token.upper() in ("AND", "OR", "WITH"):
            raise ValueError("a license is missing")
        self.at += 1
        if token == "(":
            inner = self.alternatives()
            if self.peek() != ")":
                raise ValueError("a parenthesis is open")
            self.at += 1
            return inner
        if (self.peek() or "").upper() == "WITH":
            self.at += 1
            exception = self.peek()
            if exception is None or exception in "()":
                raise ValueError("an exception is missing")
            self.at += 1
            return f"{token} WITH {exception}"
        return token


def parse(text: str):
    """A license, or (word, members) for a chain."""
    parser = _Parser(text)
    tree = parser.alternatives()
    if parser.peek() is not None:
        raise ValueError("something follows the expression")
    return tree


def render(tree, inside: str | None = None) -> str:
    """The tree with nested chains of one kind merged, members sorted and repeated ones dropped."""
    if isinstance(tree, str):
        return tree
    word, members = tree
    flat: list = []
    queue = list(members)
    while queue:
        m = queue.pop(0)
        queue[:0] = m[1] if isinstance(m, tuple) and m[0] == word else []
        if not (isinstance(m, tuple) and m[0] == word):
            flat.append(render(m, word))
    parts = sorted(set(flat))
    out = f" {word} ".join(parts)
    return f"({out})" if inside == "AND" and word == "OR" and len(parts) > 1 else out


def canonical(text: str | None) -> str | None:
    try:
        return render(parse(text)) if text and text.strip() else None
    except ValueError:
        return None


def canonical_expression(expression: Column) -> Column:
    """The canonical form of license expressions; null where there is none."""

    @F.pandas_udf("string")
    def of(expressions: pd.Series) -> pd.Series:
        return expressions.map(canonical, na_action="ignore")

    return of(expression)


def strip_exception(expression: Column, identifier: str, exception: str) -> Column:
    """The expression without the identifiers that stand WITH such an exception; both are regular expressions."""
    return F.regexp_replace(expression, rf"(?i)\b{identifier} WITH {exception}\b", "")
