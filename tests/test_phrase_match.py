"""The phrase matcher on patterns that begin alike: whole results, and few candidates."""

import random

import pytest

from tessellum.operators import phrase_match
from tessellum.plans import catalog


def most_joined(df):
    """The rows that the largest join of a plan gave."""
    df.collect()

    def walk(node):
        inner = "executedPlan" if node.nodeName() == "AdaptiveSparkPlan" else "plan" if "QueryStage" in node.nodeName() else ""
        below = [getattr(node, inner)()] if inner else [node.children().apply(k) for k in range(node.children().size())]
        own = [node.metrics().get("numOutputRows").get().value()] if "Join" in node.nodeName() else []
        return own + [n for x in below for n in walk(x)]

    return max(walk(df._jdf.queryExecution().executedPlan()))


QUERIES = [
    "LA02_plain_matches",
    "LA02_matches",
    "LA02_texts_with_pattern",
    "LA04_indexed_files",
]


@pytest.mark.parametrize("name", QUERIES)
def test_patterns_that_begin_alike_are_no_candidates_of_each_other(spark, tmp_path, name):
    r = random.Random(4)
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    rows = [(k, f"You may not {' '.join(word() for _ in range(20))}" + (" $SKIP3 and so on" if k % 3 == 0 else ""), "", "MIT") for k in range(200)]
    spark.createDataFrame(rows, "id long, pattern string, packname string, license string").write.parquet(f"{tmp_path}/license_patterns.parquet")
    df = catalog.queries()[name](spark, str(tmp_path))
    assert most_joined(df) <= 2 * len(rows)
    assert df.count() == (200 if name in ("LA02_matches", "LA04_indexed_files") else 133)


def test_long_patterns_agree_with_brute_force(spark, monkeypatch):
    r = random.Random(8)
    of = lambda n: [r.choice("abcd") for _ in range(n)]
    texts = [(k, " ".join(of(r.randint(0, 120)))) for k in range(30)]
    patterns = []
    for k in range(60):
        w = r.choice(texts)[1].split()
        part = w[(at := r.randrange(len(w) or 1)) : at + r.randint(1, 30)]
        for _ in range(r.randint(0, 2)):
            cut = r.randint(0, len(part))
            part = [*part[:cut], f"$SKIP{r.randint(1, 4)}", *part[cut + r.randint(0, 2) :]]
        patterns.append((k, " ".join(part)))
    df, pf = spark.createDataFrame(texts, "doc long, body string"), spark.createDataFrame(patterns, "id long, pattern string")
    spans = {doc: [(at, e, p) for p, pattern in patterns for t in [phrase_match.pattern_tokens(pattern)] if t for at in range(len(body.split())) if (e := phrase_match.match_end(t, body.split(), at)) > at] for doc, body in texts}
    for bits in (phrase_match.FILTER_MOST, 7):  # a filter that lets nearly everything pass changes nothing
        monkeypatch.setattr(phrase_match, "FILTER_MOST", bits)
        for resolve in (False, True):
            got = sorted(map(tuple, phrase_match.matches(df, pf, "doc", "body", resolve=resolve).select("text_id", "start", "end", "pattern_id").collect()))
            assert got == sorted((doc, *s) for doc, of_text in spans.items() for s in (phrase_match.choose(of_text) if resolve else of_text))
