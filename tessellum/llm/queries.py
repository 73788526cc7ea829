"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm import canonical, layout_dedup, licensing, mixing, near_dup, oracle, origin, packing, residue, shared_spans
from tessellum.sources.tables import table

#: Near-duplicates as TESTDATA.md states them for problem 2: three words, a similarity of 0.7.
P2_WORDS, P2_SIMILARITY = 3, Fraction(7, 10)
#: The tables of problem 2 with the column that holds their text.
P2_TABLES = {"snippets": "text", "license_patterns": "pattern"}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return origin.found(*(table(spark, folder, t) for t in ("matched_files", "package_components", "bot_packages")))


def p1_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return origin.classify(*(table(spark, folder, t) for t in ("matched_files", "package_components", "bot_packages")))


def p1_layout(spark: SparkSession, folder: str) -> DataFrame:
    """The layout comparison over the code that the tables hold: source comments and spec files among the documents."""
    code = table(spark, folder, "documents").where(F.col("source").isin("source_comment", "spec_file"))
    return origin.source_layout(code, "doc_id", "text").withColumnRenamed("id", "doc_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [near_dup.found(table(spark, folder, name), "id", text, P2_SIMILARITY, P2_WORDS).select(F.lit(name).alias("source_table"), "id_a", "id_b") for name, text in P2_TABLES.items()]
    return parts[0].union(parts[1])


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    parts = [near_dup.groups(table(spark, folder, name), "id", text, P2_SIMILARITY, P2_WORDS).select(F.lit(name).alias("source_table"), "id", "group_id", "links") for name, text in P2_TABLES.items()]
    return parts[0].union(parts[1])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.found(table(spark, folder, "license_patterns"), table(spark, folder, "license_list"))


def p3_values(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.resolve(table(spark, folder, "license_patterns"), table(spark, folder, "license_list"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.found(table(spark, folder, "file_snippets"), table(spark, folder, "snippets"))


def p4_files(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.per_file(table(spark, folder, "file_snippets"), table(spark, folder, "snippets"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return licensing.licenses(*(table(spark, folder, t) for t in ("matched_files", "pattern_matches", "license_patterns", "license_list")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return layout_dedup.found(table(spark, folder, "snippets"))


def p6_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return layout_dedup.collapsed(table(spark, folder, "snippets"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(packing.pack(table(spark, folder, "documents")))


def p8_draws(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.draws(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_targets")
    return mixing.shares(mixing.draws(table(spark, folder, "documents"), targets), targets)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.found(table(spark, folder, "documents"))


def p9_validation(spark: SparkSession, folder: str) -> DataFrame:
    return residue.validation(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_kinds, p1_layout, p2_found, p2_groups, p3_found, p3_values, p4_found, p4_files, p5_found, p6_found, p6_collapsed, p7_containers, p7_fill, p8_draws, p8_shares, p9_found, p9_validation)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
