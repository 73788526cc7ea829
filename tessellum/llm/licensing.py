"""Problem 5: the license of every file and package, from the matches found in files and the names of license files.

Evidence is the set of entries stated by a file's matches. Typed license values are mapped to entries first by a
multi-pattern automaton over the phrases of the list, with versions and qualifiers decided by ordered rules, and, where
the phrases do not stand in the value as they are, by the set-similarity join of `canonical`. Files then follow the rules
"own statement, else that of the nearest directory with license files", packages "shallowest license files, else all
files". A set of stated entries is kept as its smallest and largest member: they are equal if and only if there is a
single one, so every step is a partial aggregate whatever the number of rows behind a key.

Defined results: matches without a file, pattern or package state nothing; files without a name have no directory but
count for their package; repeated matches change nothing; packages without live files have no row; rows with null
generation or a null ignored flag are not live; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions.paths import is_license_filename
from tessellum.functions.text import directory
from tessellum.llm import canonical
from tessellum.session import cut, salted_join, shuffled

CONFLICT, UNKNOWN = "CONFLICT", "UNKNOWN"
#: Parts over which rows of one pattern, package or directory are spread before a join with unique keys.
SALTS = 16

def phrase_automaton(entries: list[tuple[str, str, str, str]]):
    """An Aho-Corasick automaton over the word forms of a license list; a hit carries the families of the form."""
    import ahocorasick

    automaton, families = ahocorasick.Automaton(), {}
    for form, family, *_ in entries:
        families.setdefault(f" {form} ", set()).add(family)
    for form, of in families.items():
        automaton.add_word(form, (form, frozenset(of)))
    automaton.make_automaton()
    return automaton


def decide(value: str, automaton, entries_of: dict[str, list[tuple[str, str, str]]]) -> str | None:
    """The entry that a value states in the list's own phrases; None if no phrase stands in it. Ordered rules: the longest
    phrases win; several families are no entry; then the version, then the qualifier, must leave a single entry."""
    name, version, qualifier = canonical.parse(value)
    text = f" {name} "
    hits = [(end - len(form) + 1, end, of) for end, (form, of) in automaton.iter(text)]
    hits = [h for h in hits if not any(o[0] <= h[0] and h[1] <= o[1] and (o[0], o[1]) != (h[0], h[1]) for o in hits)]
    families = set().union(*(of for *_, of in hits)) if hits else set()
    if not families:
        return None
    covered = text
    for start, end, _ in hits:
        covered = covered[: start + 1] + " " * (end - start - 1) + covered[end:]
    if canonical.undecorated(" ".join(covered.split())):
        return None  # other words stand beside the phrase; left to the similarity join
    if len(families) > 1:
        return canonical.UNMATCHED
    fits = [e for e, v, q in entries_of[families.pop()] if version in ("", v) and qualifier in ("", q)]
    return fits[0] if len(set(fits)) == 1 else canonical.UNMATCHED


def stated_entries(patterns: DataFrame, reference: DataFrame) -> DataFrame:
    """(pattern, license_id) for the patterns whose license denotes an entry."""
    typed = patterns.select(F.col("id").alias("pattern"), F.col("license").alias("value")).where(F.col("value").rlike(r"\S"))
    values = typed.select("value").distinct()
    # The list is a reference table; its forms are bounded by it (three or four per entry).
    forms = [tuple(r) for r in canonical.name_forms(reference, "license_id", "title", "aliases").collect()]
    ids = {f[2] for f in forms}

    def by_phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = phrase_automaton([(f[0], f[1]) for f in forms]) if forms else None
        entries_of: dict[str, list] = {}
        for _, family, entry, version, qualifier in forms:
            entries_of.setdefault(family, []).append((entry, version, qualifier))
        for batch in batches:
            out = [v if v in ids else decide(v, automaton, entries_of) if automaton else canonical.UNMATCHED for v in batch["value"]]
            yield pd.DataFrame({"value": batch["value"], "license_id": pd.Series(out, dtype="object")})

    phrased = cut(values.mapInPandas(by_phrases, "value string, license_id string"))
    rest = canonical.resolve(phrased.where("license_id is null").select(F.col("value").alias("license")), reference)
    mapped = phrased.where("license_id is not null").union(rest).where(F.col("license_id") != canonical.UNMATCHED)
    return salted_join(typed, mapped, ["value"], SALTS, ["pattern"]).select("pattern", "license_id").distinct()


def _label(low: Column, high: Column) -> Column:
    return F.when(low.isNull(), UNKNOWN).when(low == high, low).otherwise(CONFLICT)


def licenses(matched_files: DataFrame, pattern_matches: DataFrame, license_patterns: DataFrame, license_list: DataFrame) -> DataFrame:
    """(package_id, file_id, license): one row per live file, and one with file_id 0 per package that has one."""
    files = (
        matched_files.where("generation = 0 and id is not null")
        .select(F.col("package").cast("long").alias("package"), F.col("id").cast("long").alias("file"), "filename")
        .distinct()
        .withColumn("license_file", is_license_filename(F.col("filename")))
        .withColumn("dir", directory(F.col("filename")))
        .withColumn("depth", F.size(F.split("filename", "/")) - 1)
    )
    live = pattern_matches.where("generation = 0 and not ignored").select(F.col("file").cast("long").alias("file"), F.col("pattern").cast("long").alias("pattern")).distinct()
    stated = salted_join(live, stated_entries(license_patterns, license_list), ["pattern"], SALTS, ["file"])
    own = stated.groupBy("file").agg(F.min("license_id").alias("low"), F.max("license_id").alias("high"))
    judged = cut(files.join(shuffled(own), "file", "left"))

    pair = (F.min("low").alias("low"), F.max("high").alias("high"))
    told = judged.where("low is not null")
    by_dir = told.where("license_file and dir is not null").groupBy("package", "dir").agg(*pair)

    # directories of a file, from its own up to the top one
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    )
    silent = judged.where("low is null").select("package", "file", "dir")
    # once per directory, not per file: many files share one
    places = silent.select("package", "dir").where("dir is not null").distinct().select("package", "dir", F.posexplode(above).alias("level", "at"))
    near = by_dir.select("package", F.col("dir").alias("at"), "low", "high")
    nearest = salted_join(places, near, ["package", "at"], SALTS, ["dir"]).groupBy("package", "dir").agg(F.max_by(F.struct("low", "high"), "level").alias("s"))
    inherited = salted_join(silent.where("dir is not null"), nearest, ["package", "dir"], SALTS, ["file"], "left").select("package", "file", F.col("s.low").alias("low"), F.col("s.high").alias("high"))
    nameless = silent.where("dir is null").select("package", "file", F.lit(None).cast("string").alias("low"), F.lit(None).cast("string").alias("high"))
    of_files = told.select("package", "file", "low", "high").union(inherited).union(nameless)

    by_depth = told.where("license_file").groupBy("package", "depth").agg(*pair).groupBy("package").agg(F.min_by(F.struct("low", "high"), "depth").alias("first"))
    overall = judged.groupBy("package").agg(*pair)
    of_packages = overall.join(shuffled(by_depth), "package", "left").select(
        "package", F.lit(0).cast("long").alias("file"), F.coalesce("first.low", "low").alias("low"), F.coalesce("first.high", "high").alias("high")
    )
    return of_files.union(of_packages.where("package is not null")).select(F.col("package").alias("package_id"), F.col("file").alias("file_id"), _label(F.col("low"), F.col("high")).alias("license"))
