"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.operators.intervals import inside, overlaps
from tessellum.plans.catalog import Tables, query


@query("JN01_inner", "SELECT m.id, p.license, f.filename FROM pattern_matches m JOIN license_patterns p ON m.pattern = p.id JOIN matched_files f ON m.file = f.id WHERE m.generation = 0")
def _(t: Tables) -> DataFrame:
    p, f = t.license_patterns.select(F.col("id").alias("pattern"), "license"), t.matched_files.select(F.col("id").alias("file"), "filename")
    return t.pattern_matches.where("generation = 0").select("id", "pattern", "file").join(p, "pattern").join(f, "file").select("id", "license", "filename")


@query("JN02_left_outer", "SELECT s.id, p.license AS closest FROM snippets s LEFT JOIN license_patterns p ON s.like_pattern = p.id")
def _(t: Tables) -> DataFrame:
    p = t.license_patterns.select(F.col("id").alias("like_pattern"), F.col("license").alias("closest"))
    return t.snippets.select("id", "like_pattern").join(p, "like_pattern", "left").select("id", "closest")


@query("JN03_left_chain", "SELECT c.id, b.name AS package_name, f.n AS files FROM package_components c LEFT JOIN bot_packages b ON c.package = b.id LEFT JOIN (SELECT package, count(*) AS n FROM matched_files WHERE generation = 0 GROUP BY package) f ON f.package = b.id")
def _(t: Tables) -> DataFrame:
    b = t.bot_packages.select(F.col("id").alias("package"), F.col("name").alias("package_name"))
    f = t.matched_files.where("generation = 0").groupBy("package").agg(F.count("*").alias("files"))
    return t.package_components.select("id", "package").join(b, "package", "left").join(f, "package", "left").select("id", "package_name", "files")


@query("JN04_semi", "SELECT id FROM snippets s WHERE EXISTS (SELECT 1 FROM file_snippets o WHERE o.snippet = s.id AND o.resolution = 'fold')")
def _(t: Tables) -> DataFrame:
    o = t.file_snippets.where("resolution = 'fold'").select(F.col("snippet").alias("id"))
    return t.snippets.select("id").join(o, "id", "left_semi")


@query("JN05_anti", "SELECT id FROM license_patterns p WHERE NOT EXISTS (SELECT 1 FROM pattern_matches m WHERE m.pattern = p.id)")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.select("id").join(t.pattern_matches.select(F.col("pattern").alias("id")), "id", "left_anti")


@query("JN06_in_and_not_in", "SELECT id FROM bot_packages WHERE id IN (SELECT package FROM package_components) AND id NOT IN (SELECT package FROM file_snippets WHERE package IS NOT NULL)")
def _(t: Tables) -> DataFrame:
    with_components, with_snippets = t.package_components.select(F.col("package").alias("id")), t.file_snippets.select(F.col("package").alias("id"))
    return t.bot_packages.select("id").join(with_components, "id", "left_semi").join(with_snippets, "id", "left_anti")


@query("JN07_orphans", "SELECT s.id FROM snippets s LEFT JOIN file_snippets o ON o.snippet = s.id WHERE o.id IS NULL")
def _(t: Tables) -> DataFrame:
    """Snippets that occur nowhere."""
    return t.snippets.select("id").join(t.file_snippets.select(F.col("snippet").alias("id")), "id", "left_anti")


@query("JN08_interval_overlap", "SELECT o.id AS occurrence, m.id AS match, greatest(o.sline, m.sline) AS first, least(o.eline, m.eline) AS last FROM file_snippets o JOIN pattern_matches m ON o.file = m.file AND m.sline <= o.eline AND m.eline >= o.sline WHERE o.generation = 0 AND m.generation = 0 AND NOT m.ignored")
def _(t: Tables) -> DataFrame:
    o = t.file_snippets.where("generation = 0").select(F.col("id").alias("occurrence"), "file", F.col("sline").alias("s"), F.col("eline").alias("e"))
    m = t.pattern_matches.where("generation = 0 AND NOT ignored").select(F.col("id").alias("match"), "file", "sline", "eline")
    return overlaps(o, m, "file", ("s", "e"), ("sline", "eline")).select("occurrence", "match", F.greatest("s", "sline").alias("first"), F.least("e", "eline").alias("last"))


@query("JN09_outside_licensed_spans", "SELECT k.id FROM pattern_matches k JOIN license_patterns kp ON k.pattern = kp.id AND coalesce(kp.license, '') = '' WHERE NOT EXISTS (SELECT 1 FROM pattern_matches l JOIN license_patterns lp ON l.pattern = lp.id AND coalesce(lp.license, '') <> '' WHERE l.file = k.file AND l.sline <= k.sline AND l.eline >= k.eline)")
def _(t: Tables) -> DataFrame:
    p = t.license_patterns.select(F.col("id").alias("pattern"), (F.coalesce("license", F.lit("")) != "").alias("licensed"))
    m = t.pattern_matches.select("id", "file", "pattern", "sline", "eline").join(p, "pattern")
    spans = m.where("licensed").select("file", F.col("sline").alias("s"), F.col("eline").alias("e"))
    return inside(m.where(~F.col("licensed")), spans, "file", ("sline", "eline"), ("s", "e"), "left_anti").select("id")


@query("JN10_array_membership", r"""WITH a AS (SELECT m.pattern, m.package, list(DISTINCT f.filename) AS files FROM pattern_matches m JOIN matched_files f ON f.id = m.file WHERE m.generation = 0 GROUP BY 1, 2)
  SELECT DISTINCT a.pattern, f.id AS file FROM a JOIN matched_files f ON f.package = a.package AND list_contains(a.files, regexp_replace(f.filename, '\.processed(\.[^./]+)?$', '\1')) WHERE f.generation = 0""")
def _(t: Tables) -> DataFrame:
    """Files whose name stands in an array of names: the array is opened and joined by equality."""
    names = t.matched_files.select(F.col("id").alias("file"), "filename")
    arrays = t.pattern_matches.where("generation = 0").join(names, "file").groupBy("pattern", "package").agg(F.collect_set("filename").alias("files"))
    listed = arrays.select("pattern", "package", F.explode("files").alias("filename"))
    files = t.matched_files.where("generation = 0").select(F.col("id").alias("file"), "package", F.regexp_replace("filename", r"\.processed(\.[^./]+)?$", "$1").alias("filename"))
    return listed.join(files, ["package", "filename"]).select("pattern", "file").distinct()


@query("JN12_lateral", "SELECT b.id, x.n FROM bot_packages b, LATERAL (SELECT least(count(*), 50) AS n FROM matched_files f WHERE f.package = b.id) x")
def _(t: Tables) -> DataFrame:
    counts = t.matched_files.groupBy(F.col("package").alias("id")).agg(F.least(F.count("*"), F.lit(50).cast("long")).alias("n"))
    return t.bot_packages.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("JN13_values", "SELECT b.id, v.label FROM bot_packages b JOIN (VALUES ('new', 'open'), ('unacceptable', 'blocked'), ('acceptable', 'done')) v(state, label) ON b.state = v.state")
def _(t: Tables) -> DataFrame:
    values = t.spark.createDataFrame([("new", "open"), ("unacceptable", "blocked"), ("acceptable", "done")], "state string, label string")
    return t.bot_packages.join(F.broadcast(values), "state").select("id", "label")  # a page of values


@query("JN14_previous_reviews", "SELECT a.id, b.id AS previous FROM bot_packages a JOIN bot_packages b ON a.name = b.name AND a.checkout_dir = b.checkout_dir AND b.id < a.id")
def _(t: Tables) -> DataFrame:
    """Earlier reviews of the same checkout."""
    b = t.bot_packages.select(F.col("id").alias("previous"), "name", "checkout_dir")
    return t.bot_packages.select("id", "name", "checkout_dir").join(b, ["name", "checkout_dir"]).where("previous < id").select("id", "previous")


@query("JN17_update_from", "SELECT m.id, m.ignored OR EXISTS (SELECT 1 FROM file_snippets o WHERE o.file = m.file AND o.resolution = 'clear' AND o.sline <= m.sline AND o.eline >= m.eline) AS ignored FROM pattern_matches m")
def _(t: Tables) -> DataFrame:
    m = t.pattern_matches.select("id", "file", "sline", "eline", "ignored")
    cleared = t.file_snippets.where("resolution = 'clear'").select("file", F.col("sline").alias("s"), F.col("eline").alias("e"))
    hit = inside(m, cleared, "file", ("sline", "eline"), ("s", "e"), "left_semi").select("id").distinct().withColumn("hit", F.lit(True))
    return m.join(hit, "id", "left").select("id", (F.col("ignored") | F.coalesce("hit", F.lit(False))).alias("ignored"))


@query("JN18_cascade", "SELECT id FROM pattern_matches WHERE file NOT IN (SELECT id FROM matched_files WHERE generation <> 0)")
def _(t: Tables) -> DataFrame:
    gone = t.matched_files.where("generation <> 0").select(F.col("id").alias("file"))
    return t.pattern_matches.select("id", "file").where("file is not null").join(gone, "file", "left_anti").select("id")


@query("JN20_as_of", "SELECT s.id, max(p.created) AS catalogue_at FROM snippets s JOIN license_patterns p ON p.id = s.like_pattern AND p.created <= s.created GROUP BY s.id")
def _(t: Tables) -> DataFrame:
    p = t.license_patterns.select(F.col("id").alias("like_pattern"), F.col("created").alias("at"))
    return t.snippets.select("id", "like_pattern", "created").join(p, "like_pattern").where("at <= created").groupBy("id").agg(F.max("at").alias("catalogue_at"))
