import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellum.llm import residue

YES = [
    "# {{ project_name }}\n\nInstall it.", "Copyright $AUTHOR$ Foundation. The parser reads it.", "// This file belongs to XX_SUMMARY_XX (Group). It is long.", "Written for <insert name here>, see below.", "Title: [TODO: license]", "Réglé par «contact» ici.",
    "404 Not Found\n\nThe requested address /x.go does not exist on this server.", "Please enable JavaScript to view this page.\nSkip to content", "Bitte aktivieren Sie JavaScript, um https://a.example/x zu nutzen.", "Session expired Please sign in again to go on to https://a.example/x.",
    "Lorem ipsum dolor sit amet magna vitae odio felis mauris quis lectus. Vitae felis lorem ornare.", "# x\n\nLicense\nTBD\n\nOverview\nxxx\n\nUsage\nn/a", "Contenu à venir.\n" * 7, "Good words about a parser. " * 3 + "lorem ipsum dolor sit amet magna vitae odio felis mauris quis lectus turpis.",
]
NO = [
    "Write {{ author }} in the template and the header replaces it by the value from a.java.", "A line\nwith __LICENSE__ is kept as it is, since dutare uses that name for a loader.", "# The variable ${AUTHOR} must be exported\n# before you split it.", "The macro %{author} is set by zebojin.",
    "Fixed the font so that a missing file gives a 404 page instead of a blank patch.", 'The test for "page not found" now covers the archive.', 'Users who see "Access denied" in the monitor should check the rights.', "The viewer in X.js needs JavaScript; without scripts it shows a table.",
    "Removed the lorem ipsum text that the utility showed before rotamum 4.", "Source: %{name}-%{version}.tar.xz\n%files\n%license x", "// TODO in bulaber: copy the pipeline without locking the source.", "Placeholders such as <license> in the object are filled in by hogorus.", "",
]


MORE = ["foo bar baz " * 5, "Blindtext.\nBlindtext.\nBlindtext.\nBlindtext.", "word " * 400 + "{{ name }}", "The parser reads it. " * 3 + "one two three four " * 60 + "Please enable JavaScript to read /a.py."]


def labelled(text):
    return any(label for *_, label, _ in residue.weak_labels(text))


@pytest.mark.parametrize("text", YES + MORE)
def test_weak_label(text):
    assert labelled(text)


@pytest.mark.parametrize("text", NO)
def test_no_weak_label(text):
    assert not labelled(text)


def planted(seed, n):
    """Records of invented words, every eighth with residue of one of six kinds, and every eighth about the same subjects."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(3))
    plain = lambda: f"The {word()} of {word()} reads {word()}.py and writes its {word()} to the {word()} list. See https://{word()}.example/{word()} for more."
    slot = lambda: r.choice(["{{ %s }}", "<%%= %s %%>", "${%s}", "[[%s]]", "@@%s@@"]) % r.choice(["name", "year", "author", "summary"])
    about = [lambda: f"Write {slot()} in the template and {word()} replaces it.", lambda: f"Fixed {word()} so that a missing file gives a 404 page instead of a blank {word()}.", lambda: f"The viewer {word()} needs scripts; without them it shows a {word()}."]
    bad = [
        lambda: f"{plain()} {word()} is kept by {slot()} since {word()}. {plain()}", lambda: f"# {slot()}\n\n{plain()}", lambda: f"404 Not Found\n\nThe address /{word()} does not exist on this server.", lambda: f"Please enable JavaScript to read https://{word()}.example/{word()}.",
        lambda: " ".join(r.choice(sorted(residue.LATIN)) for _ in range(40)), lambda: f"# {word()}\n\nUsage\nTBD\n\nLicense\nxxx\n\nInstall\nn/a",
    ]
    for k in range(n):
        yield (k, r.choice(bad)(), True) if k % 8 == 0 else (k, " ".join([plain(), r.choice(about)(), plain()]), False) if k % 8 == 1 else (k, "\n".join(plain() for _ in range(r.randint(1, 6))), False)


def test_found_and_validation(spark):
    rows = list(planted(5, 4000))
    texts = [(k, t) for k, t, _ in rows] + [rows[0][:2], (None, YES[0]), (9001, None), (9002, "  \n"), (9003, "-- --"), (9004, " ".join(t for _, t, bad in rows if not bad and _ % 8 > 1))]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS label", "3 AS score")
    got = [r.doc_id for r in residue.found(df).collect()]
    want = {k for k, _, bad in rows if bad}
    assert len(got) == len(set(got)) and 9004 not in got
    assert len(want & set(got)) >= 0.97 * len(want) and len(want & set(got)) >= 0.97 * len(got)
    figures = residue.validation(df).first()
    assert figures.recall > 0.9 and figures.precision > 0.9 and figures.positives > 50


def test_without_labels(spark):
    df = spark.createDataFrame([(k, f"The parser {k} reads a file.") for k in range(50)], "doc_id long, text string")
    for some in (df, df.where("false")):
        assert residue.found(some).count() == 0 and residue.validation(some).count() == 0


def test_held_out_accuracy(spark, data):
    figures = residue.validation(spark.read.parquet(data.replace("sf0.001", "sf0.1") + "/documents.parquet")).first()
    assert figures.recall >= 0.9 and figures.precision >= 0.9


def test_features_stay_in_their_record():
    texts = ["{{ name }} is kept", "The parser", "x " * 3000, "$"]
    starts, each = residue.features(residue.coded(texts))
    for k, text in enumerate(texts):
        alone, own = residue.features(residue.coded([text]))
        n = len(residue.TOKEN.findall(text))
        assert (each[starts[k] : starts[k] + n] == own[alone[0] : alone[0] + n]).all()
    w = np.random.default_rng(1).normal(size=1 << residue.BITS)
    assert np.allclose(residue.best_scores(texts, w, 0.5), [residue.best_scores([t], w, 0.5)[0] for t in texts])


def test_every_record_counts_in_shards(spark, monkeypatch):
    """More records than one shard takes: all of them are fitted, set the threshold or are measured."""
    monkeypatch.setattr(residue, "SHARD", 1000)
    rows = list(planted(6, 4000))
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    base = residue._base(df, "doc_id", "text")
    parts = {r.part: r.n for r in base.groupBy(residue._part("doc_id", "text").alias("part")).agg(F.count("*").alias("n")).collect()}
    assert residue._training(base).select("doc_id").distinct().count() == sum(n for part, n in parts.items() if part > 1)
    seen, whole = [], residue.best_threshold
    monkeypatch.setattr(residue, "best_threshold", lambda score, label: seen.append(len(score)) or whole(score, label))
    figures = residue.validation(df).first()
    assert figures.records == parts[0] and seen == [parts[1]]
    assert figures.recall > 0.9 and figures.precision > 0.9
