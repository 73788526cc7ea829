import random

import pytest
from pyspark.sql import functions as F

from tessellum.functions import markup, snippet_edit
from tessellum.plans import processing

PAGES = {
    "<html>\n<p>one\n two</p><br/>three &amp; four</html>": [(2, "one two"), (3, "three & four")],
    "<?xml version='1.0'?>\n<!-- SPDX: a &lt; b -->\n<a><b>\n\n x</b></a>": [(2, "SPDX: a < b"), (5, "x")],
    "<style>p{}</style><SCRIPT>if (a < b) {}</SCRIPT>tail": [(1, "tail")], "no tags": [(1, "no tags")], "": [], "<p>open": [(1, "open")],
}


@pytest.mark.parametrize("page", PAGES)
def test_blocks(page):
    assert markup.blocks(page) == PAGES[page]


def test_looks_like_markup(spark):
    rows = [("a.html", "plain", False), ("a.html", "x <b>", True), ("a.txt", "<p>", False), ("a", "<?xml version", True), ("a", "  <!doctype HTML>", True), ("a", None, False)]
    df = spark.createDataFrame(rows, "p string, t string, want boolean")
    assert df.where(markup.looks_like_markup(F.col("p"), F.col("t")) != F.col("want")).count() == 0


def cut(line, limit):
    out = []
    while len(line) >= limit:
        at = next((k for k in range(limit, len(line)) if line[k] in markup.LINE_END), None)
        if at is None:
            break
        at += line[at] != '"'
        out.append(line[:at])
        line = line[at:]
    return [*out, line] if line or not out else out


def test_pieces(spark):
    r = random.Random(1)
    lines = ["".join(r.choice('abcdefghij ;{}"é') for _ in range(r.randint(0, 90))) for _ in range(150)] + ["", "x" * 500, '"' * 40, "x" * 12 + " "]
    df = spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "k long, line string")
    got = {row.k: row.p for row in df.select("k", markup.pieces(F.col("line"), 12).alias("p")).collect()}
    assert got == {k: cut(line, 12) for k, line in enumerate(lines)}
    text = "short\n" + "y" * 120 + " z\n" + "w" * 5
    assert [(x.original, x.text) for x in spark.createDataFrame([(text,)], "t string").select(markup.processed(F.col("t")).alias("p")).first().p] == [(1, "short"), (2, "y" * 120 + " "), (2, "z"), (3, "wwwww")]
    assert len(spark.createDataFrame([("a b\n" * 30 + "v" * 60_001 + " z",)], "t string").select(markup.processed(F.col("t")).alias("p")).first().p) == 31


def test_snippet_edit():
    text = "\n".join(["head", "licensed", "two words", "keyword here", "tail", "licensed", "end"])
    assert snippet_edit.minimal(text, 10, {3}, {1, 5}) == ("two words\nkeyword here\ntail", 12)
    assert snippet_edit.minimal(text, 10, set(), {1}) == (text, 10) and snippet_edit.minimal(text, 10, {3}, set()) == (text, 10)
    words = "a b c d e f g\nkeyword\nh i j k l m n"
    assert snippet_edit.edited(words, 1, {1}, set()) == ("c d e f g\nkeyword\nh i j k l", 1, True)
    assert snippet_edit.edited("x\n # Copyright (c) 2020 Me", 1, set(), set()) == ("x\n # Copyright (c) $SKIP10", 1, True)
    assert snippet_edit.edited("plain", 7, set(), set()) == ("plain", 7, False)


def test_spec_report(spark):
    spec = "%define major 3\nName: x\nVersion: %{major}.1\nVersion: 9\nLicense: A\nLicense:  B OR C  \nSource0: https://a/%{name}.tar\nSource: b\nURL: https://h\n# Legal-Review-Notice: look\n# twice\n%doc README\n%license COPYING\nGroup: G\nSummary: S\n"
    rows = processing.spec_report(spark.createDataFrame([(1, spec), (2, "%description\n")], "doc_id long, text string")).orderBy("doc_id").collect()
    a = rows[0].asDict()
    assert a == {"doc_id": 1, "licenses": ["A", "B OR C"], "sources": ["https://a/x.tar", "b"], "docs": ["README"], "license_files": ["COPYING"], "version": "3.1", "summary": "S", "group": "G", "url": "https://h", "notices": ["look\ntwice"], "incomplete": False}
    assert rows[1].incomplete and rows[1].licenses == [] and rows[1].url is None


def test_exclusions():
    assert processing.exclusions("# a: b\nfoo*: *.md rest\n x : y/z\nbad line\n") == [("foo*", "*.md")]
