import collections
import random

import pytest

from tessellum.llm import shared_spans


def brute(pairs, texts, span):
    where = collections.defaultdict(set)
    for f, s in pairs:
        for k in range(len(texts.get(s) or "") - span + 1):
            where[texts[s][k : k + span]].add(f)
    out = set()
    for f, s in pairs:
        t, marked = texts.get(s) or "", set()
        for k in range(len(t) - span + 1):
            if where[t[k : k + span]] - {f}:
                marked.update(range(k, k + span))
        if marked:
            out.add((f, s, len(marked)))
    return out


@pytest.mark.parametrize("span", [20, 41, 200])
def test_equals_brute_force(spark, span):
    r = random.Random(span)
    parts = ["".join(r.choice("abé 😀\n") for _ in range(r.randint(span // 2, span * 2))) for _ in range(12)]
    texts = {k: "".join(r.choice(parts) if r.random() < 0.6 else "".join(r.choice("xyz") for _ in range(r.randint(1, span))) for _ in range(r.randint(1, 4))) for k in range(1, 40)}
    texts |= {40: None, 41: "", 42: "q" * (3 * span), 43: "q" * (2 * span), 44: "ab" * 60_000, 45: texts[1]}
    rows = [(k, r.randint(1, 12), r.randint(1, 46), r.choice([0, 0, 0, 5])) for k in range(150)]
    rows += [(900, None, 3, 0), (901, 4, None, 0), *rows[:10]]
    occurrences = spark.createDataFrame(rows, "id long, file long, snippet long, generation int").selectExpr("*", "1 AS text_id", "2 AS hash", "3 AS text")
    snippets = spark.createDataFrame(list(texts.items()), "id long, text string").selectExpr("*", "1 AS snippet", "2 AS key", "3 AS f0")
    pairs = {(f, s) for _, f, s, g in rows if g == 0 and f is not None and s is not None}
    assert set(map(tuple, shared_spans.found(occurrences, snippets, span).collect())) == brute(pairs, texts, span)


def test_empty(spark):
    a, b = spark.createDataFrame([], "id long, file long, snippet long, generation int"), spark.createDataFrame([], "id long, text string")
    assert shared_spans.found(a, b).count() == 0 and shared_spans.per_file(a, b).count() == 0


def test_index_too_large_for_one_filter(spark):
    r = random.Random(7)
    part = "".join(r.choice("abcdef ") for _ in range(60))
    texts = {k: "".join(r.choice("uvwxyz") for _ in range(r.randint(0, 90))) + part[k % 7 :] + str(k) * 30 for k in range(1, 60)}
    df = spark.createDataFrame([(k, t, k % 9, k % 9) for k, t in texts.items()], "text_id long, text string, first_file long, last_file long")
    want = {(k, n) for _, k, n in brute([(k % 9, k) for k in texts], texts, 40)}
    assert want and set(map(tuple, shared_spans.shared_characters(df, 40, most=1 << 10).collect())) == want


def test_no_growing_side_is_broadcast(spark, data):
    from tessellum.llm import queries

    for name in ("p1_found", "p4_found", "p4_files"):
        plan = queries.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_rolling_hashes():
    h = shared_spans.rolling_hashes("abcabcabx", 3)
    assert len(h) == 7 and h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 4
    assert len(shared_spans.rolling_hashes("ab", 3)) == 0
