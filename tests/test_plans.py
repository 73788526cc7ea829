"""What Catalyst makes of the queries: pushed filters, pruned columns, partial aggregates, top-k, no broadcast of a growing side."""

import re

import pytest

from tessellum.plans import catalog


def plan(spark, data, name):
    return catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "filters"), [("FLT03", "GreaterThanOrEqual(priority"), ("SNK03", "EqualTo(generation,0)"), ("FLT12", "In(type"), ("STM06", "Not(EqualTo(generation,0))")])
def test_filters_reach_the_scan(spark, data, name, filters):
    query = next(n for n in sorted(catalog.queries()) if n.startswith(name))
    pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan(spark, data, query))
    assert any(filters in p for p in pushed)


@pytest.mark.parametrize("name", ["AGG01_match_counts", "LA23_report_facts", "SNK06_notice_text", "JN08_interval_overlap", "LA26_pair_proximity"])
def test_texts_are_not_read_where_none_is_needed(spark, data, name):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, data, name))
    assert schemas and not any(re.search(r"\b(?:pattern:string|text:string|token_hexsum|checkout_dir)", s) for s in schemas)


def test_aggregates_combine_before_the_shuffle(spark, data):
    text = plan(spark, data, "STM05_snapshot")
    assert "partial_count" in text and text.index("keys=[package") < text.index("Exchange hashpartitioning(package") < text.rindex("partial_count")


def test_pages_are_top_k(spark, data):
    assert "TakeOrderedAndProject" in plan(spark, data, "Q17_pending_by_likelyness")


@pytest.mark.parametrize("name", ["JN08_interval_overlap", "JN09_outside_licensed_spans", "LA44_match_explained", "LA22_painted_lines", "JN15_inverted_index", "SNK01_promoted_build"])
def test_growing_sides_are_merged(spark, data, name):
    assert "SortMergeJoin" in plan(spark, data, name)


#: Queries with a side that is a single row: totals and the last row of a page.
SINGLE_ROW = {"AGG05_dashboard", "AGG15_license_idf", "AGG27_precision_recall", "SRT02_keyset_page"}


@pytest.mark.parametrize("name", [n for n in sorted(catalog.queries()) if n[:3] in ("FLT", "AGG", "SRT", "SET") and n not in SINGLE_ROW and not n.startswith(("SRT01", "FLT17"))])
def test_no_cartesian_products(spark, data, name):
    text = plan(spark, data, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
