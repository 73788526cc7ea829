"""Problem 3: hand-typed values mapped to the entries of a reference list.

Distinct values are cleaned and split into a name, a version and a qualifier. Names are matched to the name forms of the
list by a prefix-filter set-similarity join over letter tokens: tokens are ordered by global rarity, only the rarest
tokens of a name, as many as its length and the threshold require, are joined, pairs are filtered by length and by the
position of the shared token, and the Jaccard similarity of the rest is computed in full. The most similar form is kept.
An exact check of that one pair follows: it must be within a small number of typing errors, and abbreviations (forms of at
most SHORT letters, where one letter makes another name) must be equal. Version and qualifier then choose the entry.

Defined results: null and blank values are no cases; values that are verbatim an id are returned as that id by
`resolve` and left out by `found`; ties between names of different families leave a value unmatched; an empty list leaves
every value unmatched. The list is a reference table of bounded size; it is counted before it is broadcast.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.operators.set_join import prefix_join
from tessellum.session import bounded_broadcast, shuffled

UNMATCHED = "UNMATCHED"
#: Least Jaccard similarity of the letter tokens of two names. Two typing errors in nine letters leave more than that.
THRESHOLD = Fraction(1, 2)
#: Most typing errors (inserted, lost, wrong or swapped neighbouring letters) in a name, and letters of an abbreviation.
ERRORS, SHORT = 2, 5

#: Words that say how a version binds. Longest first where one begins another.
ONLY = ("and no other version", "this version only", "only")
LATER = ("or if you wish any later version", "or any later version", "or later", "or newer", "plus")
#: Words beside a name that do not identify it.
DECORATION = ("license", "licence", "lic", "terms", "declared", "licenseref", "family", "unspecified", "the")


def _plain(value: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).lower()


def parse(value: str) -> tuple[str, str, str]:
    """(name, version, qualifier) of a typed value. Versions are written with at least one dot; qualifier is only, later or
    empty. A value that names several entries has an empty name."""
    text = _plain(value).strip()
    text = re.sub(r"^license\s*:\s*|^licenseref-", "", text)
    text = re.sub(r"\(see copying\)|\[declared\]", " ", text)
    text = text.replace("+", " plus ")
    flat = re.sub(r"[^a-z0-9./]+", " ", text).strip()
    flat = re.sub(r"(?<![0-9])\.|\.(?![0-9])", " ", flat)
    flat = re.sub(r"\s+", " ", flat).strip()
    qualifier = ""
    for kind, phrases in (("later", LATER), ("only", ONLY)):
        for phrase in phrases:
            if m := re.search(rf"(?<![a-z]){phrase}(?![a-z])", flat):
                qualifier, flat = kind, f"{flat[: m.start()]} {flat[m.end() :]}"
                break
        if qualifier:
            break
    flat = re.sub(r"\s+", " ", flat).strip()
    if re.search(r"\b(and|or)\b|/", flat):
        return "", "", ""
    versions = re.findall(r"(?<![0-9.])\d+(?:\.\d+)*", flat)
    name = re.sub(r"(?:\bver(?:sion)?\b|(?<![a-z])v(?=\s*\d)|(?<=[a-z])v(?=\d))\s*", " ", flat)
    name = re.sub(r"\d+(?:\.\d+)*", " ", name)
    name = re.sub(r"\bver(?:sion)?\b|\bv\b", " ", name)
    name = re.sub(r"\s+", " ", name).strip()
    if len(versions) > 1:
        return "", "", ""
    version = versions[0] if versions else ""
    if version:
        parts = version.split(".")
        while len(parts) > 2 and parts[-1] == "0":
            parts.pop()
        version = ".".join(str(int(p)) for p in (parts if len(parts) > 1 else [*parts, "0"]))
    return name, version, qualifier


def undecorated(name: str) -> str:
    """The name without words that do not identify it; the name itself if nothing else is in it."""
    words = [w for w in name.split() if w not in DECORATION]
    return " ".join(words)


def tokens(name: str) -> list[str]:
    """Letter tokens of a name: its padded letter pairs and its single letters, each with a running number so that a
    multiset becomes a set. Swapped letters keep the single letters, a wrong letter keeps most pairs."""
    padded, seen, out = f"^{name}$", {}, []
    for part in [*(padded[i : i + 2] for i in range(len(padded) - 1)), *name]:
        seen[part] = seen.get(part, 0) + 1
        out.append(f"{part}{seen[part]}")
    return out


def typing_errors(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbouring letters; most + 1 if it is larger than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    # only cells at most `most` off the diagonal can hold a small enough distance
    far = most + 1
    two, one = [], [min(j, far) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        row = [far] * (len(b) + 1)
        row[0] = min(i, far)
        for j in range(low, high + 1):
            y = b[j - 1]
            best = min(row[j - 1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row[j] = min(best, far)
        if min(row[low - 1 : high + 1]) > most:
            return far
        two, one = one, row
    return one[-1]


def name_forms(reference: DataFrame, id_col: str, title_col: str, aliases_col: str) -> DataFrame:
    """(form, family, license_id, version, qualifier): every way in which the list writes an entry. The family is the name
    in the entry's id."""

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for entry, title, aliases in batch.itertuples(index=False):
                if not isinstance(entry, str):
                    continue
                family, version, qualifier = parse(entry.replace("-or-later", " or later"))
                for written in [entry, title, *(aliases if aliases is not None else [])]:
                    if not isinstance(written, str):
                        continue
                    name = parse(written.replace("-or-later", " or later"))[0]
                    for form in {name, undecorated(name)} - {""}:
                        out.append((form, family, entry, version, qualifier))
            yield pd.DataFrame(out, columns=["form", "family", "license_id", "version", "qualifier"])

    return reference.select(id_col, title_col, aliases_col).mapInPandas(forms, "form string, family string, license_id string, version string, qualifier string").distinct()


def resolve(values: DataFrame, reference: DataFrame, value_col: str = "license", id_col: str = "license_id", title_col: str = "title", aliases_col: str = "aliases") -> DataFrame:
    """(value, license_id): one row per distinct value that is neither null nor blank; license_id is the entry that it
    denotes, or UNMATCHED."""
    typed = values.select(F.col(value_col).alias("value")).where(F.col("value").rlike(r"\S")).distinct()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch["value"]:
                name, version, qualifier = parse(value)
                for form in dict.fromkeys([name, undecorated(name)]):
                    if form:
                        rows.append((value, form, version, qualifier))
            yield pd.DataFrame(rows, columns=["value", "name", "version", "qualifier"])

    parsed = typed.mapInPandas(split, "value string, name string, version string, qualifier string")
    entries = name_forms(reference, id_col, title_col, aliases_col)

    @F.pandas_udf("array<string>")
    def letters(name: pd.Series) -> pd.Series:
        return name.map(tokens)

    @F.pandas_udf("int")
    def errors(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([typing_errors(x, y, ERRORS) for x, y in zip(a, b, strict=True)], dtype="int32")

    names = parsed.select(F.col("name").alias("l")).distinct().withColumn("tokens", letters("l"))
    forms = entries.select(F.col("form").alias("r")).distinct().withColumn("tokens", letters("r"))
    families = bounded_broadcast(entries.select(F.col("form").alias("r"), "family").distinct())
    # forms within reach of a name: at most as many as the list has
    near = prefix_join(names, forms, THRESHOLD).join(families, "r").groupBy("l").agg(F.max("similarity").alias("similarity"), F.collect_list(F.struct("similarity", "r", "family")).alias("all"))
    tied = near.select("l", "similarity", F.array_sort(F.filter("all", lambda c: c["similarity"] == F.col("similarity"))).alias("best"))
    checked = tied.withColumn("r", F.col("best")[0]["r"]).withColumn("errors", errors("l", "r")).where((F.col("errors") <= ERRORS) & ((F.length("r") > SHORT) | (F.col("errors") == 0)))
    named = checked.select(F.col("l").alias("name"), "errors", F.array_distinct(F.transform("best", lambda c: c["family"])).alias("families"))
    choices = (
        parsed.join(shuffled(named), "name")
        .groupBy("value", "version", "qualifier")
        .agg(F.min_by("families", "errors").alias("families"))
        .where(F.size("families") == 1)
        .withColumn("family", F.col("families")[0])
    )
    listed = entries.select("family", "license_id", F.col("version").alias("has_version"), F.col("qualifier").alias("has_qualifier")).distinct()
    fits = choices.join(bounded_broadcast(listed), "family").where(
        ((F.col("version") == "") | (F.col("version") == F.col("has_version"))) & ((F.col("qualifier") == "") | (F.col("qualifier") == F.col("has_qualifier")))
    )
    single = fits.groupBy("value").agg(F.min("license_id").alias("low"), F.max("license_id").alias("high")).where("low = high").select("value", F.col("low").alias("license_id"))
    verbatim = bounded_broadcast(reference.select(F.col(id_col).alias("value"), F.lit(True).alias("verbatim")).distinct())
    return (
        typed.join(verbatim, "value", "left").join(shuffled(single), "value", "left")
        .select("value", F.when(F.col("verbatim"), F.col("value")).otherwise(F.coalesce("license_id", F.lit(UNMATCHED))).alias("license_id"))
    )


def found(patterns: DataFrame, reference: DataFrame) -> DataFrame:
    """(pattern_id, license_id) of the rows whose license is typed: not null, not blank and not verbatim an id of the list."""
    listed = bounded_broadcast(reference.select(F.col("license_id").alias("license")).distinct())
    typed = patterns.select(F.col("id").alias("pattern_id"), "license").where(F.col("license").rlike(r"\S")).join(listed, "license", "left_anti")
    mapped = resolve(typed, reference)
    return typed.join(shuffled(mapped.withColumnRenamed("value", "license")), "license").select("pattern_id", "license_id").distinct()
