import random

import pytest
from pyspark.sql import functions as F

from tessellum.operators import phrase_match
from tessellum.operators.intervals import inside, overlaps
from tessellum.operators.components import connected_components
from tessellum.operators.ranking import global_rank
from tessellum.session import salted_join


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (None, 4), *((k, k + 1) for k in range(100, 160))]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5} | dict.fromkeys(range(100, 161), 100)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_global_rank(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        values = list(range(1000))
        random.Random(1).shuffle(values)
        ranked = global_rank(spark.createDataFrame([(v,) for v in values], "v long"), [F.desc("v")]).collect()
        assert all(r.place == 1000 - r.v for r in ranked) and len(ranked) == 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_salted_join(spark):
    left = spark.createDataFrame([(k, k % 3) for k in range(90)], "id long, key long")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "key long, value string")
    assert sorted(map(tuple, salted_join(left, right, ["key"], 8, ["id"]).select("id", "value").collect())) == [(k, "ab"[k % 3]) for k in range(90) if k % 3 < 2]
    assert salted_join(left, right, ["key"], 8, ["id"], "left").where("value is null").count() == 30


def test_pattern_tokens():
    assert phrase_match.pattern_tokens("$SKIP3 The GNU $SKIP2 $SKIP4 licence$SKIP") == ["the", "gnu", "#6", "licence"]
    assert phrase_match.pattern_tokens("$SKIP9") == []


def test_match_end():
    text = "a b x y c d".split()
    assert phrase_match.match_end(["a", "b", "#2", "c"], text, 0) == 5
    assert phrase_match.match_end(["a", "b", "#1", "c"], text, 0) == -1
    assert phrase_match.match_end(["d"], text, 5) == 6


def test_choose_longest_then_newer():
    assert phrase_match.choose([(0, 3, 1), (2, 8, 2), (8, 9, 3), (2, 8, 7)]) == [(2, 8, 7), (8, 9, 3)]


def test_matches_agree_with_brute_force(spark):
    r = random.Random(3)
    texts = [(k, " ".join(r.choice("abc") for _ in range(r.randint(0, 30)))) for k in range(25)] + [(99, None), (98, "")]
    patterns = [(1, "a b $SKIP2 c"), (2, "c"), (3, "a b c a"), (4, "b $SKIP1 b"), (5, None), (6, ""), (7, "a b $SKIP2 c"), (8, "$SKIP3 c c")]
    df, pf = spark.createDataFrame(texts, "doc long, body string"), spark.createDataFrame(patterns, "id long, pattern string")
    for resolve in (False, True):
        got = sorted(map(tuple, phrase_match.matches(df, pf, "doc", "body", resolve=resolve).select("text_id", "start", "end", "pattern_id").collect()))
        want = []
        for doc, body in texts:
            w = (body or "").split()
            spans = [(at, e, p) for p, pattern in patterns if pattern for at in range(len(w)) if (t := phrase_match.pattern_tokens(pattern)) and (e := phrase_match.match_end(t, w, at)) > at]
            want += [(doc, *s) for s in (phrase_match.choose(spans) if resolve else spans)]
        assert got == sorted(want)


def test_lines_of_matches(spark):
    df = spark.createDataFrame([(1, "x\na b\n\nc d"), (2, "a b c")], "doc long, body string")
    pf = spark.createDataFrame([(7, "a b c d"), (8, "d"), (9, "b $SKIP1 c")], "id long, pattern string")
    got = sorted(map(tuple, phrase_match.matches(df, pf, "doc", "body").select("text_id", "pattern_id", "sline", "eline").collect()))
    assert got == [(1, 7, 2, 4), (2, 9, 1, 1)]


@pytest.mark.parametrize("margin", [0, 3])
def test_overlapping_ranges(spark, margin):
    r = random.Random(margin)
    ranges = lambda n: [(k, r.randint(1, 3), s, s + r.choice([0, 1, 5, 90, 700])) for k in range(n) for s in [r.randint(1, 400)]] + [(900, None, 1, 5), (901, 1, 9, 2), (902, 1, None, 4)]
    a, b = ranges(60), ranges(60)
    x, y = spark.createDataFrame(a, "i long, file long, s int, e int"), spark.createDataFrame(b, "j long, file long, sline int, eline int")
    real = lambda rows: [v for v in rows if None not in v and v[2] <= v[3]]
    want = sorted((i, j) for i, f, s, e in real(a) for j, g, p, q in real(b) if f == g and s - margin <= q and e + margin >= p)
    assert sorted(map(tuple, overlaps(x, y, "file", ("s", "e"), ("sline", "eline"), margin).select("i", "j").collect())) == want
    within = {i for i, f, s, e in real(a) for _, g, p, q in real(b) if f == g and p <= s and e <= q}
    for how in ("left_semi", "left_anti"):
        got = {v.i for v in inside(x.where("s <= e"), y, "file", ("s", "e"), ("sline", "eline"), how).collect()}
        assert got & {v[0] for v in real(a)} == (within if how == "left_semi" else {v[0] for v in real(a)} - within)
