"""Expansion of the macros that a spec file defines itself; nothing is evaluated."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounds of expansion, so that definitions in a circle end.
ROUNDS = 10
_DEFINITION = re.compile(r"\s*%(?:define|global)\s+(\w+)\s+(.+?)\s*$")
_TAG = re.compile(r"(Name|Version|Release):\s*(.+?)\s*$")
_REFERENCES = (re.compile(r"(?<!%)%\{(\w+)\}"), re.compile(r"(?<!%)%(\w+)"))


def expand(text: str | None) -> str | None:
    """References replaced by their definitions until nothing changes. The first definition wins, those by %define and
    %global before the tags; unknown macros, conditional ones and %% stay."""
    if text is None:
        return None
    macros: dict[str, str] = {}
    lines = text.split("\n")
    for m in filter(None, map(_DEFINITION.match, lines)):
        macros.setdefault(m[1], m[2])
    for m in filter(None, map(_TAG.match, lines)):
        macros.setdefault(m[1].lower(), m[2])
    for _ in range(ROUNDS):
        before = text
        for reference in _REFERENCES:
            text = reference.sub(lambda m: macros.get(m[1], m[0]), text)
        if text == before:
            break
    return text


def expanded(text: Column) -> Column:
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(expand)

    return of(text)
