"""The inverted index of shingles: whole results in slices and batches, and no shuffled pairs of text and owner."""

import pickle
import re

import numpy as np
import pyarrow as pa
import pytest

from tessellum.operators import postings
from tessellum.plans import catalog, general
from tests.compare import connection, rows_of

QUERIES = [
    "JN15_inverted_index",
    "LA11_best_license",
    "LA12_closest_pattern",
    "LA14_closest_patterns",
    "Q27_rescored",
    "LA42_fold_calibration",
    "AGG27_precision_recall",
]


@pytest.mark.parametrize("name", QUERIES)
def test_pairs_are_never_shuffled(spark, data, name):
    plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(id#\d+L?, (?:license|owner|pattern)#", plan)


@pytest.mark.parametrize("name", QUERIES)
def test_slices_of_the_index_agree_with_sql(spark, data, name, monkeypatch):
    monkeypatch.setattr(postings, "ENTRIES", 300)
    monkeypatch.setattr(postings, "ROWS", 50)
    df = catalog.queries()[name](spark, data)
    want = connection(data).sql(catalog.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_texts_are_numbered_where_they_are_read(spark, data):
    plan = catalog.queries()["LA14_closest_patterns"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(h#", plan)


@pytest.mark.parametrize("name", QUERIES)
def test_numbers_that_are_too_many_to_broadcast_agree_with_sql(spark, data, name, monkeypatch):
    monkeypatch.setattr(postings, "NUMBERS", 100)
    df = catalog.queries()[name](spark, data)
    want = connection(data).sql(catalog.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_only_owners_that_can_be_among_the_best_are_weighed_whole(monkeypatch):
    rng, owners, rare, common = np.random.default_rng(1), 3000, 12, 40
    has = [np.sort(np.append(rng.choice(rare, 2 + (i % 50 == 0) * 8, replace=False), rare + rng.choice(common, 10, replace=False))) for i in range(owners)]
    table = pa.table({"owner": pa.array([str(i) for i in range(owners)]), "first": pa.array(range(owners), pa.int64()), "places": pa.array(has, pa.list_(pa.int32()))})
    index = postings.Index(None, None, 3, np.array([rare, rare + common]), 1, None, np.array([8.0, 2.0]))
    places = np.append(has[150], rare + np.setdiff1d(np.arange(common), has[150] - rare)[:5]).astype(np.int32)
    places = np.sort(places)
    of, weighed = {}, []
    monkeypatch.setattr(postings, "_against", lambda texts, index, schema, rows: of.setdefault("rows", rows))
    shared = postings.Lists.shared
    monkeypatch.setattr(postings.Lists, "shared", lambda self, at, w, some, *more: weighed.append(len(some)) or shared(self, at, w, some, *more))
    postings.best(None, index, 3, 20, 4.0, 2)
    text = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([places], pa.list_(pa.int32())), pa.array([1])], ["id", "places", "unknown"])
    (got,) = of["rows"](postings.lists_of(table), table["owner"].combine_chunks(), table["first"].to_numpy(), [text])
    total = sum(8.0 if p < rare else 2.0 for p in places) + 1
    both = {i: np.intersect1d(has[i], places) for i in range(owners)}
    scores = {i: sum(8.0 if p < rare else 2.0 for p in x) / total for i, x in both.items() if (x < rare).sum() >= 2}
    want = sorted((-round(s, 9), i) for i, s in scores.items())[:3]
    assert [(-round(s, 9), int(i)) for i, s in zip(got["owner"].to_pylist(), got["score"].to_pylist(), strict=True)] == want
    assert weighed and sum(weighed) < len(scores) / 5


def test_stale_texts_are_neither_copied_nor_shuffled_by_shingle(spark, data, monkeypatch):
    monkeypatch.setattr(general, "cut", lambda df: pytest.fail("the texts are written to disk"))
    plan = catalog.queries()["Q27_rescored"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(h#", plan)


def test_a_slice_is_sent_as_its_places_alone():
    sizes = np.full(2000, 50, np.int32)
    places = np.concatenate([np.sort(np.random.default_rng(i).choice(20_000, 50, replace=False)) for i in range(2000)]).astype(np.int32)
    lists = postings.Lists(places, sizes)
    sent = pickle.dumps(lists)
    assert len(sent) < 5 * len(places)
    again = pickle.loads(sent)
    assert all(np.array_equal(getattr(lists, name), getattr(again, name)) for name in ("owner", "key", "start"))


def test_nothing_but_the_owners_texts_is_shuffled_to_count(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)

    def texts(n):
        return [None, "", "a", "a b"] + [" ".join(f"word{i}" for i in rng.integers(0, 300, 30)) for _ in range(n)]

    snippets, patterns = texts(396), texts(796)
    for i in range(4):
        spark.createDataFrame([(k, snippets[k]) for k in range(i, 400, 4)], "id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/snippets.parquet")
    owned = [(k, p, [f"L{k % 90}", "", None][(k % 30 == 7) + (k % 30 == 8) * 2]) for k, p in enumerate(patterns)]
    spark.createDataFrame(owned, "id long, pattern string, license string").write.parquet(f"{tmp_path}/license_patterns.parquet")
    monkeypatch.setattr(postings, "ENTRIES", 8000)
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).head().totalShuffleWrite()

    before = written()
    df = catalog.queries()["JN15_inverted_index"](spark, str(tmp_path))
    got = {(r.id, r.license): r.shared for r in df.collect()}
    assert written() - before < sum(len(x or "") for x in patterns)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()

    def shingles(text):
        w = re.findall(r"[a-z0-9]+", text or "")
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {(x,) for x in w}

    by = {}
    for _, p, license in owned:
        if license:
            by.setdefault(license, set()).update(shingles(p))
    assert got == {(k, owner): n for k, x in enumerate(snippets) for owner, s in by.items() if (n := len(s & shingles(x)))} and got


@pytest.mark.parametrize("per", [0, 500])
def test_owners_of_shingles_are_sent_compressed(per):
    rng = np.random.default_rng(3)
    all_of = rng.integers(-(2**63), 2**63, 20_000)
    h = np.concatenate([rng.choice(all_of, per, replace=False) for _ in range(1000)])
    owners = postings.Owners.of(h, np.full(1000, per))
    sent = pickle.dumps(owners)
    assert len(sent) < 2.5 * len(h) + 1000
    again = pickle.loads(sent)
    assert again.n == owners.n and all(np.array_equal(getattr(owners, name), getattr(again, name)) for name in ("key", "size", "owner", "start"))
    here, at = again.lists(np.append(h[:50], 12345))
    assert here.tolist() == [True] * len(h[:50]) + [False]
    assert all(k // max(per, 1) in again.owner[again.start[a] : again.start[a] + again.size[a]] for k, a in enumerate(at))
