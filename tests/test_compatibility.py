from tessellum.plans import compatibility as c

FOUND = [
    (1, "src/x/a.c", "A", 3), (1, "src/y/b.c", "B", 2),  # two shipped files below src
    (1, "vendor/v/a.c", "A", 3), (1, "vendor/v/c.c", "C", 3),  # A and C meet in vendored code only
    (1, "tests/t.c", "D", 3), (1, "tests/t.c", "A", 1),  # one file, but a test and a guess
    (2, "one.c", "A", 3), (2, "one.c", "B", 3), (2, "docs/d", "C", 1), (2, "lib/q.c", "E", 1),
    (3, "a.c", "A", 3),
]
PAIRS = [(1, "A", "B"), (1, "A", "C"), (1, "A", "D"), (2, "A", "B"), (2, "A", "C"), (2, "C", "E"), (3, "A", "B")]
WANT = {
    (1, "A", "B"): (0, 2, 0, 1, 0, "src/x/a.c", "src/y/b.c"), (1, "A", "C"): (1, 3, 0, 2, 0, "vendor/v/a.c", "vendor/v/c.c"),
    # the whole package holds a sure A and a sure D: two files with sure evidence weigh more than one with a guess
    (1, "A", "D"): (2, 3, 0, 0, 0, "src/x/a.c", "tests/t.c"),
    (2, "A", "B"): (0, 3, 1, 0, 0, "one.c", "one.c"), (2, "A", "C"): (0, 1, 0, -1, 1, None, "docs/d"), (2, "C", "E"): (0, 1, 0, -1, 1, "docs/d", "lib/q.c"),
}


def frames(spark):
    return spark.createDataFrame(FOUND, "package long, path string, spdx string, confidence int"), spark.createDataFrame(PAIRS, "package long, a string, b string")


def test_proximity(spark):
    found, pairs = frames(spark)
    got = {(r.package, r.a, r.b): (r.tier, r.confidence, r.same_file, r.lca_depth, r.no_colocation, r.file_a, r.file_b) for r in c.proximity(found, pairs).collect()}
    assert got == WANT
    assert c.proximity(found.where("false"), pairs).count() == 0


def test_matrix_cells_and_ranks(spark):
    cells = spark.createDataFrame([("A", "B", "No"), ("B", "A", "No"), ("A", "C", "Unknown"), ("C", "E", "Unknown"), ("A", "D", "Check dependency")], "a string, b string, compatibility string")
    found, _ = frames(spark)
    kept = c.compatibility(found.select("package", "spdx").distinct(), cells)
    assert sorted((r.package, r.a, r.b) for r in kept.collect()) == [(1, "A", "B"), (1, "A", "D"), (1, "B", "A"), (2, "A", "B"), (2, "B", "A")]
    assert sorted((r.package, r.a, r.b) for r in c.hard(kept).collect()) == [(1, "A", "B"), (2, "A", "B")]
    got = [(r.package, r.place, r.a, r.b, r.mutual, r.location) for r in c.ranked(found, kept).orderBy("package", "place").collect()]
    assert got == [(1, 1, "A", "B", 1, None), (1, 2, "A", "D", 0, None), (2, 1, "A", "B", 1, "same file one.c")]
