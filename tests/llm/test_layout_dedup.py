import random
import re

import pytest

from tessellum.llm import layout_dedup


def brute(rows):
    plain = lambda t: "".join(c for c in t.lower() if c.isalnum())
    field = re.compile(r"^[\W_]*[^\W\d_][\w.-]{0,40}( [\w.-]{1,40})?\s*[:=].*[^\W_]")
    parent, seen = {}, {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, text in rows:
        if i is None or text is None:
            continue
        find(i)
        parts = [p for p in re.split(r"[\r\n;]+", text) if plain(p)]
        keys = [plain(text)]
        if len(parts) >= 3 and all(field.match(p) for p in parts):
            keys.append(tuple(sorted(map(plain, parts))))
        for k in keys:
            a, b = find(seen.setdefault(k, i)), find(i)
            parent[max(a, b)] = min(a, b)
    return {(find(i), i) for i, t in rows if i is not None and t is not None and find(i) != i}


CASES = [
    (5, "Name: a\nVersion: 1\nFiles: x"), (3, "// version = 1; // NAME=A ; // files = X"), (9, "name: a version: 1 files: x"), (8, "Files: x\nName: a"), (7, "files:x name:a"),
    (1, "Hello, World"), (2, "hello world!"), (4, "HELLO\n\tWORLD"), (6, None), (None, "hello world"), (10, ""), (11, "***"), (12, "é x"), (13, "É-X"), (1, "Hello, World"), (14, "y" * 200_000), (15, "Y" * 200_000 + "."),
]


def found(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "id long, text string")
    if extra:
        df = df.selectExpr("id", "text", "1 AS key", "'x' AS part", "2 AS keep", "3 AS plain")
    return set(map(tuple, layout_dedup.found(df).collect()))


@pytest.mark.parametrize("extra", ["", "clash"])
def test_cases(spark, extra):
    assert found(spark, CASES, extra) == brute(CASES)


def test_plain_and_field_relations_meet(spark):
    rows = [(1, "a: 1\nb: 2\nc: 3"), (2, "c: 3\na: 1\nb: 2"), (3, "c3 a1 b2"), (4, "A1B2C3"), (5, "b: 2; c: 3; a: 1"), (6, "b2c3a1")]
    assert found(spark, rows) == {(1, k) for k in range(2, 7)}


def test_hot_group_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = random.Random(2)
        rows = [(k, r.choice(["A b!", "a-B", " ab "]) if k % 3 else f"text {r.randint(0, 400)}") for k in range(3000)]
        r.shuffle(rows)
        assert found(spark, rows) == brute(rows)
        counts = dict(map(tuple, layout_dedup.collapsed(spark.createDataFrame(rows, "id long, text string")).collect()))
        assert sum(counts.values()) == 3000 and counts[1] == 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark):
    assert found(spark, []) == set()
