from tessellum.llm import licensing
from tests.llm.test_canonical import LIST, reference


def test_rules(spark):
    files = [
        (1, 1, "LICENSE", 0), (2, 1, "src/a.c", 0), (3, 1, "src/lib/b.c", 0), (4, 1, "src/lib/COPYING", 0), (5, 1, "src/lib/deep/c.c", 0), (6, 1, "src/COPYING.txt", 0), (7, 1, "docs/d.c", 0), (8, 1, "x.c", 5),
        (10, 2, "a.c", 0), (11, 2, "b.c", 0), (12, 2, "LICENSE.c", 0), (20, 3, "a.c", 0), (30, 4, "LICENSE", 7), (40, 5, "x/LICENSE", 0), (41, 5, "y/COPYING", 0), (42, 5, "y/z.c", 0), (43, 5, None, 0), (1, 1, "LICENSE", 0),
    ]
    patterns = [(1, "Brinkwater-1.0"), (2, "kestrigen"), (3, "Vesperlin family"), (4, None), (5, "HASA v1.0+"), (6, "KEDL")]
    matches = [
        (1, 1, 1, 0, False), (2, 3, 2, 0, False), (3, 3, 6, 0, False), (4, 4, 2, 0, False), (5, 7, 3, 0, False), (6, 10, 1, 0, False), (7, 11, 5, 0, False), (8, 20, 1, 4, False), (9, 20, 2, 0, True), (10, 40, 1, 0, False), (11, 41, 2, 0, False),
        (12, None, 1, 0, False), (13, 2, None, 0, False), (14, 7, 4, 0, False), (15, 43, 5, 0, False), (1, 1, 1, 0, False),
    ]
    f = spark.createDataFrame(files, "id long, package long, filename string, generation int").selectExpr("*", "1 AS file", "'x' AS dir", "1 AS depth", "'l' AS license")
    p = spark.createDataFrame(patterns, "id long, license string").selectExpr("*", "1 AS pattern", "2 AS value")
    m = spark.createDataFrame(matches, "id long, file long, pattern long, generation int, ignored boolean").selectExpr("*", "'x' AS filename", "1 AS low")
    got = {(r.package_id, r.file_id): r.license for r in licensing.licenses(f, m, p, reference(spark)).collect()}
    assert got == {
        (1, 1): "Brinkwater-1.0", (1, 2): "Brinkwater-1.0", (1, 3): "Kestrigan", (1, 4): "Kestrigan", (1, 5): "Kestrigan", (1, 6): "Brinkwater-1.0", (1, 7): "Brinkwater-1.0", (1, 0): "Brinkwater-1.0",
        (2, 10): "Brinkwater-1.0", (2, 11): "Harrowick-1.0-or-later", (2, 12): "UNKNOWN", (2, 0): "CONFLICT", (3, 20): "UNKNOWN", (3, 0): "UNKNOWN",
        (5, 40): "Brinkwater-1.0", (5, 41): "Kestrigan", (5, 42): "Kestrigan", (5, 43): "Harrowick-1.0-or-later", (5, 0): "CONFLICT",
    }
    assert licensing.licenses(f.where("false"), m.where("false"), p.where("false"), reference(spark)).count() == 0


def test_automaton_leaves_other_words_to_the_join():
    forms = [("brinkwater", "brinkwater"), ("kestrigan", "kestrigan"), ("simple kestrigan notice", "kestrigan")]
    automaton = licensing.phrase_automaton(forms)
    of = {"brinkwater": [("Brinkwater-1.0", "1.0", "")], "kestrigan": [("Kestrigan", "", "")]}
    assert licensing.decide("Simple Kestrigan Notice", automaton, of) == "Kestrigan"
    assert licensing.decide("brinkwater 1", automaton, of) == "Brinkwater-1.0"
    assert licensing.decide("brinkwater 3", automaton, of) == "UNMATCHED"
    assert licensing.decide("brinkwater kestrigan", automaton, of) == "UNMATCHED"
    assert licensing.decide("strange brinkwater", automaton, of) is None
    assert len(LIST) == 7
