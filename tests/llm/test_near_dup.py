import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from tessellum.llm import near_dup


def jaccard(a, b, size):
    def s(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}

    x, y = s(a), s(b)
    return Fraction(len(x & y), len(x | y)) if x and y else Fraction(0)


def edited(r, words, times):
    words = list(words)
    for _ in range(times):
        k, kind = r.randrange(len(words)), r.randrange(3)
        if kind == 0:
            words[k] = f"w{r.randrange(999)}"
        elif kind == 1:
            words.insert(k, f"w{r.randrange(999)}")
        else:
            del words[k]
    return words


@pytest.fixture(scope="module")
def rows():
    r, out = random.Random(5), []
    for _ in range(40):
        base = [f"w{r.randrange(60)}" for _ in range(r.choice([3, 4, 5, 8, 12, 20, 45, 120]))]
        out += [" ".join(edited(r, base, r.randrange(0, 2 + len(base) // 12))) if k else " ".join(base) for k in range(4)]
    out += ["a b", "", None, "A, b; C", "a b c", "a b c", "x " * 5000, "x y " * 5000]
    return list(enumerate(out, 1))


@pytest.mark.parametrize(("threshold", "size"), [(Fraction(7, 10), 3), (Fraction(8, 10), 5), (Fraction(1, 2), 2)])
def test_all_pairs_are_found(spark, rows, threshold, size):
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "1 AS rec", "2 AS sig", "3 AS w", "4 AS key")
    got = set(map(tuple, near_dup.found(df, "id", "text", threshold, size).collect()))
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x is not None and y is not None and jaccard(x, y, size) >= threshold}
    assert got == want


def test_no_pair_is_lost_when_all_shared_signatures_are_lengthened(spark, rows, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", 1)
    got = set(map(tuple, near_dup.found(spark.createDataFrame(rows, "id long, text string"), "id", "text", Fraction(7, 10), 3).collect()))
    assert got == {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x is not None and y is not None and jaccard(x, y, 3) >= Fraction(7, 10)}


def test_a_signature_of_many_is_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", 5)
    base = " ".join(f"w{k}" for k in range(30))
    rows = [(k, f"{base} e{k} f{k % 3}") for k in range(40)] + [(100 + k, f"z{k} y x w v u t") for k in range(9)]
    got = set(map(tuple, near_dup.found(spark.createDataFrame(rows, "id long, text string"), "id", "text", Fraction(7, 10), 3).collect()))
    assert got == {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if jaccard(x, y, 3) >= Fraction(7, 10)}


def test_groups(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text), (2, text + " x"), (3, text + " x"), (4, "other words entirely here"), (5, "a b"), (6, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: (r.group_id, r.links) for r in near_dup.groups(df, "id", "text", Fraction(7, 10), 3).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (4, 0)}


def test_empty(spark):
    assert near_dup.found(spark.createDataFrame([], "id long, text string"), "id", "text", Fraction(7, 10), 3).count() == 0


def test_signatures_of_similar_sets_meet():
    r = np.random.default_rng(1)
    sign = near_dup._signer(Fraction(7, 10))
    import pyarrow as pa

    for n in (1, 2, 3, 5, 9, 17, 40, 150):
        for _ in range(20):
            x = r.integers(-(2**62), 2**62, n)
            gone = int(0.3 * n)
            for y in (x[gone:], np.concatenate([x[gone // 2 :], r.integers(-(2**62), 2**62, gone - gone // 2)])):
                if len(np.intersect1d(x, y)) >= 0.7 * len(np.union1d(x, y)):
                    batch = pa.RecordBatch.from_pydict({"rec": pa.array([1, 2]), "shingles": pa.array([x.tolist(), y.tolist()])})
                    sigs = {1: set(), 2: set()}
                    for part in sign(iter([batch])):
                        for s, k in zip(part.column("sig").to_pylist(), part.column("rec").to_pylist(), strict=True):
                            sigs[k].add(s)
                    assert sigs[1] & sigs[2]
