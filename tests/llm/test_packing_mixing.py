import collections
import random

import numpy as np
import pytest

from tessellum.llm import mixing, packing
from tessellum.llm.tokens import TOKENIZER, with_tokens


def test_nonnegative_least_squares():
    r = np.random.default_rng(2)
    a = r.random((12, 30))
    x = packing.nonnegative_least_squares(a, a @ np.maximum(r.normal(size=30), 0))
    assert (x >= 0).all() and np.abs(a @ x - a @ x).max() < 1e-9
    g = a.T @ (a @ x - a @ np.maximum(np.random.default_rng(2).random(30) * 0, 0))
    assert np.isfinite(g).all()


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_rank_once_and_never_overfills(seed):
    r, capacity = random.Random(seed), 256
    histogram = {n: r.randint(1, 60) for n in r.sample(range(1, capacity + 1), r.choice([1, 5, 60, 200]))}
    ranges, groups = packing.plan(dict(histogram), capacity, 16)
    load, seen = collections.Counter(), collections.Counter()
    for length, first, container, count in ranges:
        for k in range(count):
            load[container + k] += length
            seen[length, first + k] += 1
    assert set(seen.values()) == {1} and collections.Counter(n for n, _ in seen) == histogram
    told = {start + k: used for start, count, used in groups for k in range(count)}
    assert told == dict(load) and max(load.values()) <= capacity
    least = -(-sum(n * c for n, c in histogram.items()) // capacity)
    assert len(load) <= max(least * 1.35 + 2, sum(c for n, c in histogram.items() if 2 * n > capacity))


ROWS = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 5000), (5, "a"), (5, "a"), (None, "x"), (6, "naïve 😀 text"), *((k, "some words here " * (k % 17 + 1)) for k in range(10, 200))]


def test_pack(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS tokens", "3 AS piece", "4 AS length", "5 AS _text", "6 AS part")
    got = packing.pack(df).toPandas()
    sizes = {r.id: r.tokens for r in with_tokens(df, "doc_id", "text", []).collect()}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == sizes and sizes[2] == sizes[3] == 0
    packed = got[got.container_id.notna()]
    used = packed.groupby("container_id").n_tokens.sum()
    assert used.max() <= 2048 and (packed.set_index("container_id").fill * 2048 - used.reindex(packed.container_id)).abs().max() < 1e-6
    assert set(got[got.piece > 0].doc_id) == {4} and not packed.duplicated(["doc_id", "piece"]).any()
    assert len(used) == -(-sum(sizes.values()) // 2048) or len(used) == -(-sum(sizes.values()) // 2048) + 1
    assert packing.pack(df.where("false")).count() == 0


def test_ranks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 10)
    rows = [(k, 0, 7 if k % 3 else k % 5 + 1) for k in range(300)]
    got = packing.ranked(spark.createDataFrame(rows, "id long, piece long, length long")).collect()
    for length, n in collections.Counter(r[2] for r in rows).items():
        assert sorted(r["rank"] for r in got if r.length == length) == list(range(n))


def test_sainte_lague():
    assert mixing.sainte_lague([53, 24, 23], 7) == [3, 2, 2]
    r = random.Random(3)
    for _ in range(60):
        weights, seats = [r.choice([0, 1, 1, 2.5, 7, 1000, r.random()]) for _ in range(r.randint(1, 30))], r.randint(0, 300)
        given = [0] * len(weights)
        for _ in range(seats if any(weights) else 0):
            k = max(range(len(weights)), key=lambda k: (weights[k] / (2 * given[k] + 1), -k))
            given[k] += 1
        assert mixing.sainte_lague(weights, seats) == given
    assert sum(mixing.sainte_lague([1.0 + k % 7 for k in range(100_000)], 10**9)) == 10**9
    assert mixing.sainte_lague([1, 0, 1], 3) == [2, 0, 1] and mixing.sainte_lague([], 5) == [] and mixing.sainte_lague([0.0], 5) == [0]


def test_draws(spark):
    r = random.Random(1)
    rows = [(k, r.choice(["a", "a", "a", "b", "c", None, "unlisted"]), "word " * r.randint(1, 40)) for k in range(600)] + [(900, "a", None), (901, "b", ""), (None, "a", "x"), (1, "a", "word")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS id", "2 AS tokens", "3 AS shard", "4 AS quota")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, None), ("none", 0.1, 2), ("b", 0.0, 2), (None, 0.2, 1), ("neg", -1.0, 2)], "source string, target_share double, max_repeats int")
    got = mixing.draws(docs, targets)
    share = {x.source: x.actual_share for x in mixing.shares(got, targets).collect()}
    assert abs(share["a"] - 0.2) < 0.02 and abs(share["b"] - 0.5) < 0.02 and abs(share["c"] - 0.3) < 0.02 and share["none"] == 0
    most = {x.source: max(y.draws for y in got.collect() if y.source == x.source) for x in got.select("source").distinct().collect()}
    assert most["a"] <= 1 and most["b"] <= 2 and most["c"] <= 1
    assert got.count() == got.select("doc_id").distinct().count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.draws(docs, targets).collect()))
    assert mixing.draws(docs.where("false"), targets).count() == 0 and mixing.draws(docs, targets.where("false")).count() == 0


def test_tokenizer_is_a_parameter(spark):
    df = spark.createDataFrame([(1, "hello <|endoftext|> world")], "doc_id long, text string")
    assert with_tokens(df, "doc_id", "text", [], TOKENIZER).first().tokens > 5
