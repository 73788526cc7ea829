import pytest
from pyspark.sql import functions as F

from tessellum.functions import legal_text, paths
from tessellum.functions.risk import clamp_priority, estimated_risk
from tessellum.functions.similarity import trigram_similarity, trigrams
from tessellum.functions.text import letters_digits, shingle_hashes, words
from tessellum.operators.expressions import canonical


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "x int").select(column.alias("v")).first().v


def test_letters_and_digits(spark):
    assert one(spark, letters_digits(F.col("a")), a=" Ab-c_Ä 9!\n") == "abcä9"


def test_words_and_shingles(spark):
    assert one(spark, words(F.col("a")), a="One, two_THREE 4") == ["one", "two", "three", "4"]
    assert len(one(spark, shingle_hashes(words(F.col("a")), 3), a="a b c a b c")) == 3
    assert one(spark, shingle_hashes(words(F.col("a")), 3), a="a b") == []


@pytest.mark.parametrize(("risk", "match", "want"), [(1, 1.0, 1), (1, 0.95, 1), (1, 0.85, 5), (5, 0.5, 7), (3, 0.0, 9), (9, 0.3, 9), (4, 0.9, 5)])
def test_estimated_risk(spark, risk, match, want):
    assert one(spark, estimated_risk(F.lit(risk), F.lit(match))) == want


def test_priority(spark):
    assert [one(spark, clamp_priority(F.lit(p).cast("int"))) for p in (0, 3, 40, None)] == [1, 3, 10, 5]


def test_license_names(spark):
    names = {"LICENSE": True, "a/Copying.txt": True, "LICENSE-main": True, "license.py": False, "licenses.json": False, "NOTICE.md": True, "third_party.txt": True, "src/eula": True, "mylicense": False}
    assert {n: one(spark, paths.is_license_filename(F.col("a")), a=n) for n in names} == names


def test_ancestors(spark):
    assert one(spark, paths.ancestors(F.col("a")), a="a/b/c.py") == ["", "a", "a/b"]
    assert one(spark, paths.ancestors(F.col("a")), a="c.py") == [""]


NORMAL = {
    " * You  MAY <b>use</b> it &amp; go\n * Copyright 2020 X\n * see https://x.example/y\nmail a@b.example\n// All Rights Reserved": "You MAY use it go",
    "  12 first line\n 4. clause\n00017 rest": "first line 4. clause rest", "/* block */\n\\fBbold\\fR \\&x": "block bold x", ".\\\" man text\n# - a\ndnl b\nREM c": "man text - a b c", "": "",
}


@pytest.mark.parametrize("text", NORMAL)
def test_normalized_license_text(spark, text):
    assert one(spark, legal_text.normalized_license_text(F.col("a")), a=text) == NORMAL[text]


NOTICES = {
    "// Copyright 2013 Duvunam Group,\n// released with x. More\nother": ["Copyright 2013 Duvunam Group, released with x. More"],
    "Copyright (c) 2019\n    One Author <one@x.example>\n    Two Author\n\nMIT": ["Copyright (c) 2019 One Author <one@x.example> Two Author"],
    "Copyright and related rights are waived\nCopyright Holder means\ncopyright 2020 x\nCOPYRIGHT 2020 X": [], "(c) You must retain\n(c) 2020 Foo, Inc. and others": ["(c) 2020 Foo, Inc. and others"],
    "Copyright (C) YEAR Name\nCopyright [name of copyright owner]\nCopyright <year> X": [], "© 2020 A\nAll rights reserved.\nRedistribution and use": ["© 2020 A All rights reserved."],
    "/* Copyright 2020 A */": ["Copyright 2020 A"], "Copyright 2020 A\nCopyright 2020 A": ["Copyright 2020 A"] * 2, "SPDX-FileCopyrightText: 2020 A": ["SPDX-FileCopyrightText: 2020 A"],
    "Copyright 2020 A,\n B,\n C,\n D,\n E,\n F": ["Copyright 2020 A, B, C, D, E,"], "Copyright 2020 " + "x" * 280: ["Copyright 2020 " + "x" * 280], "Copyright 2020 " + "x" * 290: [], "a\n" * 25_000 + "Copyright 2020 Z": ["Copyright 2020 Z"],
}


@pytest.mark.parametrize("text", NOTICES, ids=range(len(NOTICES)))
def test_copyrights(spark, text):
    assert one(spark, legal_text.copyrights(F.col("a")), a=text) == NOTICES[text]


def test_copyrights_of_nothing(spark):
    assert one(spark, legal_text.copyrights(F.col("a")), a="") == [] and legal_text.notices(None) == []


def test_addresses(spark):
    long = "https://x.test/" + "a" * 900
    text = f"see {long}, ftp://no http://www.example.com/x https://k.example/y;\nmail A.b@x.test, c@example.org d@sub.example.com <{'l' * 100}@y.test>"
    assert one(spark, legal_text.urls(F.col("a")), a=text) == [long, "https://k.example/y"]
    assert one(spark, legal_text.emails(F.col("a")), a=text) == ["a.b@x.test", "l" * 100 + "@y.test"]
    assert one(spark, legal_text.urls(F.col("a")), a="https://x.test/" + "a" * 5000) == [] and one(spark, legal_text.emails(F.col("a")), a="a" * 200_000 + " b@x.test") == ["b@x.test"]


REVIEWS = {
    "# Legal-Review-Notice: one\n# two\n#\n# three\nName: x": ["one\ntwo"], "## legal-review-notice: a  \n# Legal-Review-Notice: b\n###\n# c": ["a", "b"], "Legal-Review-Notice: none": [], "# x\n# Legal-Review-Notice: last": ["last"], "": [],
}


@pytest.mark.parametrize("text", REVIEWS)
def test_review_notices(spark, text):
    assert one(spark, legal_text.legal_review_notices(F.col("a")), a=text) == REVIEWS[text]


KINDS = {
    "src/a.c": (None, 0), "vendor/x/a.c": ("vendored", 1), "vendor/x/tests/a.c": ("test", 2), "a/Docs/vendor/b": ("documentation", 2), "docs": (None, 0), "vendor.obscpio._./x/y": ("vendored", 1), "lib/external/x": (None, 0), "licenses/MIT": ("license catalog", 2),
    "samples/testdata/x": ("example", 2), "x/contrib/fixtures/y/z": ("test", 2),
}


@pytest.mark.parametrize("path", KINDS)
def test_peripheral(spark, path):
    assert (one(spark, paths.peripheral_kind(F.col("a")), a=path), one(spark, paths.tier(F.col("a")), a=path)) == KINDS[path]


def test_trigram_similarity(spark):
    assert one(spark, trigram_similarity(trigrams(F.col("a")), trigrams(F.col("b"))), a="word", b="words") == pytest.approx(4 / 7)
    assert one(spark, trigram_similarity(trigrams(F.col("a")), trigrams(F.col("b"))), a="", b="") == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [("B OR A", "A OR B"), ("(A AND B) OR A", "A OR A AND B"), ("A AND (C OR B)", "(B OR C) AND A"), ("A WITH e AND B", "A WITH e AND B"), ("((A))", "A"), ("A or A", "A"), ("A AND", None), ("(A", None), ("", None), ("A B", None)],
)
def test_canonical_expression(text, want):
    assert canonical(text) == want
    assert want is None or canonical(want) == want
