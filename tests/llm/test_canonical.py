from fractions import Fraction

import pytest

from tessellum.llm import canonical

LIST = [
    ("Brinkwater-1.0", "Brinkwater Permissive License version 1.0", []), ("Harrowick-1.0-only", "Harrowick Source Agreement version 1.0 only", ["HASA-1.0 only"]),
    ("Harrowick-1.0-or-later", "Harrowick Source Agreement version 1.0 or any later version", ["HASA-1.0+"]), ("Harrowick-2.0-only", "Harrowick Source Agreement version 2.0 only", ["HASA-2.0 only"]),
    ("Kestrigan", "Kestrigan Documentation License", ["KEDL", "Simple Kestrigan Notice"]), ("Vesperlin-2.0", "Vesperlin Free License version 2.0", None), ("Vesperlin-2.1", "Vesperlin Free License version 2.1", []),
]
WANT = {
    "Brinkwater-1.0": "Brinkwater-1.0", "brinkwater 1": "Brinkwater-1.0", "The Brinkwater Permissive Licence, ver. 1.0": "Brinkwater-1.0", "brnikwater v1.0": "Brinkwater-1.0", "Brinkwater-2.0": "UNMATCHED", "LicenseRef-Brinkwater_1": "Brinkwater-1.0",
    "HASA v1.0+": "Harrowick-1.0-or-later", "hasa_1 only": "Harrowick-1.0-only", "Harrowick 1 or, if you wish, any later version": "Harrowick-1.0-or-later", "Harowick2.0 and no other version": "Harrowick-2.0-only", "Harrowick 1.0": "UNMATCHED", "Harrowick": "UNMATCHED",
    "Harrowick-2.0-plus": "UNMATCHED", "HASB 1 only": "UNMATCHED", "kestrigen": "Kestrigan", "'KEDL'": "Kestrigan", "simple kestrigan notice (see COPYING)": "Kestrigan", "Kestrigan 3.0": "UNMATCHED", "Vesperlin family": "UNMATCHED", "vésperlin2.1\n": "Vesperlin-2.1",
    "Vesperlin-2.0 AND Kestrigan": "UNMATCHED", "Kestrigan / Brinkwater-1.0": "UNMATCHED", "Any Copyleft": "UNMATCHED", "n/a": "UNMATCHED", "???": "UNMATCHED", "custom " * 3000: "UNMATCHED",
}


def reference(spark):
    return spark.createDataFrame(LIST, "license_id string, title string, aliases array<string>")


def test_values(spark):
    rows = [(k, v) for k, v in enumerate([*WANT, None, "  ", "kestrigen"], 1)]
    df = spark.createDataFrame(rows, "id long, license string").selectExpr("id", "license", "1 AS license_id", "2 AS value", "3 AS l", "4 AS family")
    got = dict(map(tuple, canonical.resolve(df, reference(spark)).collect()))
    assert got == WANT
    found = dict(map(tuple, canonical.found(df, reference(spark)).collect()))
    assert found == {k: WANT[v] for k, v in rows if v and v.strip() and v != "Brinkwater-1.0"}


def test_empty_tables(spark):
    df, empty = spark.createDataFrame([(1, "x 1.0")], "id long, license string"), spark.createDataFrame([], "license_id string, title string, aliases array<string>")
    assert [tuple(r) for r in canonical.found(df, empty).collect()] == [(1, "UNMATCHED")]
    assert canonical.found(spark.createDataFrame([], "id long, license string"), reference(spark)).count() == 0


@pytest.mark.parametrize("threshold", [Fraction(3, 10), Fraction(1, 2), Fraction(4, 5)])
def test_prefix_join_finds_every_pair(spark, threshold):
    import random

    r = random.Random(4)
    sets = lambda n: [(f"s{k}", sorted({f"t{min(r.randrange(30), r.randrange(30))}" for _ in range(r.randint(1, 12))})) for k in range(n)]
    a, b = sets(40), sets(40)
    got = {(x.l, x.r) for x in canonical.prefix_join(spark.createDataFrame(a, "l string, tokens array<string>"), spark.createDataFrame(b, "r string, tokens array<string>"), threshold).collect()}
    assert got == {(l, q) for l, x in a for q, y in b if Fraction(len(set(x) & set(y)), len(set(x) | set(y))) >= threshold}


@pytest.mark.parametrize(("a", "b", "n"), [("abc", "acb", 1), ("abc", "abc", 0), ("abcd", "acbe", 2), ("abc", "xyz", 3), ("", "abcd", 3), ("kilnmarch", "klinmarch", 1)])
def test_typing_errors(a, b, n):
    assert canonical.typing_errors(a, b, 2) == n
