"""Column expressions over text. All stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters_digits(text: Column) -> Column:
    """Lower-cased text without anything but letters and digits."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def words(text: Column) -> Column:
    """Maximal runs of letters and digits of the lower-cased text; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingle_hashes(word_array: Column, size: int) -> Column:
    """Distinct 64-bit hashes of all sequences of `size` consecutive words; empty if there are fewer words."""
    count = F.size(word_array) - F.lit(size - 1)
    hashed = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.array_join(F.slice(word_array, i, size), " ")))
    return F.when(count >= 1, F.array_sort(F.array_distinct(hashed))).otherwise(F.array().cast("array<bigint>"))


def directory(path: Column) -> Column:
    """Everything before the last slash; empty for a file of the top directory."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)
