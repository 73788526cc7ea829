"""Listings, searches and statistics that reviewers ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.paths import dir_key
from tessellum.plans.catalog import NOW, Tables, query
from tessellum.plans.filters import contains_any, open_packages
from tessellum.plans.ordering import page

_NOW = f"TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}'"
_NTZ = f"timestamp_ntz'{NOW:%Y-%m-%d %H:%M:%S}'"


@query("Q01_open_reviews", "SELECT id, name, priority, unresolved_matches, count(*) OVER () AS total FROM bot_packages WHERE state = 'new' AND NOT obsolete AND priority >= 2 ORDER BY priority DESC, external_link NULLS LAST, unresolved_matches, name, id LIMIT 20")
def _(t: Tables) -> DataFrame:
    rows = open_packages(t.bot_packages).where("state = 'new'").select("id", "name", "priority", "unresolved_matches", "external_link")
    return page(rows, [F.desc("priority"), F.asc_nulls_last("external_link"), "unresolved_matches", "name", "id"], 20).drop("external_link")


@query("Q02_packages_of_name", "SELECT name, id, state, count(*) OVER (PARTITION BY name) AS reviews FROM bot_packages WHERE state IN ('new', 'unacceptable')")
def _(t: Tables) -> DataFrame:
    rows = t.bot_packages.where(F.col("state").isin("new", "unacceptable")).select("name", "id", "state")
    return rows.join(rows.groupBy("name").agg(F.count("*").alias("reviews")), "name")


@query("Q03_recent_reviews", f"SELECT id, name, reviewed, count(*) OVER () AS total FROM bot_packages WHERE reviewed > {_NOW} - INTERVAL 90 DAY AND state <> 'new' ORDER BY reviewed DESC, id LIMIT 25")
def _(t: Tables) -> DataFrame:
    rows = t.bot_packages.where((F.col("reviewed") > F.expr(f"{_NTZ} - interval 90 days")) & (F.col("state") != "new")).select("id", "name", "reviewed")
    return page(rows, [F.desc("reviewed"), "id"], 25)


@query("Q04_search_by_pattern", "SELECT b.id, b.name FROM bot_packages b WHERE NOT b.obsolete AND EXISTS (SELECT 1 FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern WHERE m.package = b.id AND p.risk >= 6 AND NOT m.ignored)")
def _(t: Tables) -> DataFrame:
    risky = t.license_patterns.where("risk >= 6").select(F.col("id").alias("pattern"))
    hit = t.pattern_matches.where(~F.col("ignored")).select("package", "pattern").distinct().join(risky, "pattern", "left_semi").select(F.col("package").alias("id")).distinct()
    return t.bot_packages.where(~F.col("obsolete")).select("id", "name").join(hit, "id", "left_semi")


@query("Q05_components", "SELECT c.id, b.name AS package_name, c.purl FROM package_components c JOIN bot_packages b ON b.id = c.package WHERE c.name ILIKE '%kit%' AND c.generation = 0 AND NOT b.embargoed AND NOT b.obsolete")
def _(t: Tables) -> DataFrame:
    b = t.bot_packages.where(~F.col("embargoed") & ~F.col("obsolete")).select(F.col("id").alias("package"), F.col("name").alias("package_name"))
    return t.package_components.where("generation = 0").where(contains_any("kit", "name")).select("id", "package", "purl").join(b, "package").select("id", "package_name", "purl")


@query("Q06_autocomplete", "SELECT name, n FROM (SELECT DISTINCT name, CAST(length(name) AS INT) AS n FROM bot_packages WHERE name ILIKE '%go%') ORDER BY NOT (name ILIKE 'go%'), n, name LIMIT 10")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.where(F.col("name").ilike("%go%")).select("name", F.length("name").alias("n")).distinct().orderBy(~F.col("name").ilike("go%"), "n", "name").limit(10)


@query("Q07_statistics", f"SELECT state, count(*) AS packages, CAST(coalesce(sum(unresolved_matches), 0) AS BIGINT) AS unresolved, count(*) FILTER (WHERE created > {_NOW} - INTERVAL 30 DAY) AS month FROM bot_packages GROUP BY state")
def _(t: Tables) -> DataFrame:
    recent = F.col("created") > F.expr(f"{_NTZ} - interval 30 days")
    return t.bot_packages.groupBy("state").agg(F.count("*").alias("packages"), F.coalesce(F.sum("unresolved_matches"), F.lit(0)).alias("unresolved"), F.count_if(recent).alias("month"))


@query("Q08_history", "SELECT id, name, lag(id) OVER (PARTITION BY name ORDER BY created, id) AS before, count(*) OVER (PARTITION BY name) AS reviews FROM bot_packages")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.select("id", "name", F.lag("id").over(Window.partitionBy("name").orderBy("created", "id")).alias("before"), F.count("*").over(Window.partitionBy("name")).alias("reviews"))


@query("Q09_retention", f"SELECT id FROM (SELECT id, imported, row_number() OVER (PARTITION BY name, checkout_dir ORDER BY id DESC) AS n FROM bot_packages WHERE checksum IS NOT NULL AND state <> 'new') WHERE n > 1 AND imported < {_NOW} - INTERVAL 7 DAY")
def _(t: Tables) -> DataFrame:
    newest = Window.partitionBy("name", "checkout_dir").orderBy(F.desc("id"))
    rows = t.bot_packages.where("checksum IS NOT NULL AND state <> 'new'").withColumn("n", F.row_number().over(newest))
    return rows.where((F.col("n") > 1) & (F.col("imported") < F.expr(f"{_NTZ} - interval 7 days"))).select("id")


@query("Q10_known_licenses", "SELECT license, min(risk) AS low, max(risk) AS high, count(*) AS patterns FROM license_patterns WHERE license ILIKE '%h%' GROUP BY license")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.where(contains_any("h", "license")).groupBy("license").agg(F.min("risk").alias("low"), F.max("risk").alias("high"), F.count("*").alias("patterns"))


@query("Q11_ignored_matches", "SELECT pattern, count(*) FILTER (WHERE ignored) AS ignored, count(*) AS matches FROM pattern_matches GROUP BY pattern HAVING count(*) FILTER (WHERE ignored) > 0")
def _(t: Tables) -> DataFrame:
    return t.pattern_matches.groupBy("pattern").agg(F.count_if("ignored").alias("ignored"), F.count("*").alias("matches")).where("ignored > 0")


@query("Q12_recent_patterns", "SELECT p.id, p.license, (SELECT count(*) FROM pattern_matches m WHERE m.pattern = p.id) AS matches FROM license_patterns p ORDER BY p.created DESC, p.id DESC LIMIT 11")
def _(t: Tables) -> DataFrame:
    recent = t.license_patterns.orderBy(F.desc("created"), F.desc("id")).limit(11).select("id", "license")  # a page
    counts = t.pattern_matches.join(F.broadcast(recent.select(F.col("id").alias("pattern"))), "pattern", "left_semi").groupBy(F.col("pattern").alias("id")).agg(F.count("*").alias("matches"))
    return recent.join(counts, "id", "left").na.fill(0, ["matches"])


@query("Q14_conflicting_patterns", "SELECT id, other FROM (SELECT id, min(id) OVER (PARTITION BY license, risk) AS other FROM license_patterns WHERE license <> '') WHERE other < id")
def _(t: Tables) -> DataFrame:
    """Patterns whose license and risk another one had before, with the first of those."""
    named = t.license_patterns.where("license <> ''").select("id", "license", "risk")
    first = named.groupBy("license", "risk").agg(F.min("id").alias("other"))
    return named.join(first, ["license", "risk"]).where("other < id").select("id", "other")


@query("Q15_for_license", "SELECT license, risk, count(*) AS patterns, max(length(pattern)) AS longest FROM license_patterns WHERE license IS NOT NULL GROUP BY license, risk")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.where("license is not null").groupBy("license", "risk").agg(F.count("*").alias("patterns"), F.max(F.length("pattern")).cast("long").alias("longest"))


@query("Q16_missing_spdx", "SELECT p.id, l.license_id AS spdx FROM license_patterns p JOIN license_list l ON lower(p.license) = lower(l.license_id) WHERE coalesce(p.spdx, '') = ''")
def _(t: Tables) -> DataFrame:
    l = t.license_list.select(F.col("license_id").alias("spdx"), F.lower("license_id").alias("key"))
    return t.license_patterns.where("coalesce(spdx, '') = ''").select("id", F.lower("license").alias("key")).join(F.broadcast(l), "key").select("id", "spdx")  # the list has a fixed size


@query("Q17_unclassified", "SELECT s.id, s.likelyness, count(o.id) AS occurrences FROM snippets s LEFT JOIN file_snippets o ON o.snippet = s.id AND o.generation = 0 WHERE NOT s.classified AND NOT s.approved GROUP BY s.id, s.likelyness")
def _(t: Tables) -> DataFrame:
    counts = t.file_snippets.where("generation = 0").groupBy(F.col("snippet").alias("id")).agg(F.count("*").alias("occurrences"))
    return t.snippets.where("NOT classified AND NOT approved").select("id", "likelyness").join(counts, "id", "left").na.fill(0, ["occurrences"])


@query("Q18_snippet_search", "SELECT s.id, count(*) AS occurrences, count(DISTINCT o.package) AS packages, min(o.file) AS example FROM snippets s JOIN file_snippets o ON o.snippet = s.id JOIN bot_packages b ON b.id = o.package WHERE s.text ILIKE '%warranty%' OR s.text ILIKE '%license%' AND o.generation = 0 AND NOT b.embargoed GROUP BY s.id")
def _(t: Tables) -> DataFrame:
    b = t.bot_packages.select(F.col("id").alias("package"), "embargoed")
    s = t.snippets.select(F.col("id").alias("snippet"), F.coalesce(F.col("text").ilike("%warranty%"), F.lit(False)).alias("w"), F.coalesce(F.col("text").ilike("%license%"), F.lit(False)).alias("l")).where("w OR l")
    rows = t.file_snippets.join(s, "snippet").join(b, "package").where(F.col("w") | (F.col("l") & (F.col("generation") == 0) & ~F.col("embargoed")))
    return rows.groupBy(F.col("snippet").alias("id")).agg(F.count("*").alias("occurrences"), F.countDistinct("package").alias("packages"), F.min("file").alias("example"))


@query("Q19_products", "SELECT split_part(name, '-', 1) AS product, count(*) AS packages, count(*) FILTER (WHERE state = 'new') AS open, max(created) AS updated FROM bot_packages GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.groupBy(F.split_part("name", F.lit("-"), F.lit(1)).alias("product")).agg(F.count("*").alias("packages"), F.count_if(F.col("state") == "new").alias("open"), F.max("created").alias("updated"))


@query("Q21_harvest", "SELECT package_name, source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS characters FROM documents GROUP BY package_name, source")
def _(t: Tables) -> DataFrame:
    return t.documents.groupBy("package_name", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))


@query("Q22_summary", """SELECT m.package, p.license || CASE WHEN bool_or(p.patent) THEN ':patent' ELSE '' END || CASE WHEN bool_or(p.eula) THEN ':eula' ELSE '' END AS name, max(p.risk) AS risk FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern WHERE m.generation = 0 AND NOT m.ignored AND coalesce(p.license, '') <> '' GROUP BY m.package, p.license HAVING max(p.risk) >= 2""")
def _(t: Tables) -> DataFrame:
    p = t.license_patterns.where("coalesce(license, '') <> ''").select(F.col("id").alias("pattern"), "license", "risk", "patent", "eula")
    g = t.pattern_matches.where("generation = 0 AND NOT ignored").select("package", "pattern").distinct().join(p, "pattern").groupBy("package", "license").agg(F.max("risk").alias("risk"), F.bool_or("patent").alias("patent"), F.bool_or("eula").alias("eula"))
    name = F.concat("license", F.when(F.col("patent"), ":patent").otherwise(""), F.when(F.col("eula"), ":eula").otherwise(""))
    return g.where("risk >= 2").select("package", name.alias("name"), "risk")


@query("Q23_status", "SELECT id, state, CASE WHEN unpacked IS NULL THEN 'unpacking' WHEN indexed IS NULL THEN 'indexing' WHEN reviewed IS NULL THEN 'waiting' ELSE 'done' END AS stage FROM bot_packages")
def _(t: Tables) -> DataFrame:
    stage = F.when(F.col("unpacked").isNull(), "unpacking").when(F.col("indexed").isNull(), "indexing").when(F.col("reviewed").isNull(), "waiting").otherwise("done")
    return t.bot_packages.select("id", "state", stage.alias("stage"))


@query("Q28_browser", "WITH f AS (SELECT package, string_split(filename, '/') AS s, id FROM matched_files WHERE generation = 0), m AS (SELECT DISTINCT file FROM pattern_matches WHERE generation = 0) SELECT f.package, s[1] AS entry, count(*) AS files, bool_or(len(s) > 1) AS directory, bool_or(m.file IS NOT NULL) AS has_match FROM f LEFT JOIN m ON m.file = f.id GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    m = t.pattern_matches.where("generation = 0").select(F.col("file").alias("id")).distinct().withColumn("hit", F.lit(True))
    f = t.matched_files.where("generation = 0").select("package", "id", F.split("filename", "/").alias("s")).join(m, "id", "left")
    return f.groupBy("package", F.col("s")[0].alias("entry")).agg(F.count("*").alias("files"), F.bool_or(F.size("s") > 1).alias("directory"), F.bool_or(F.coalesce("hit", F.lit(False))).alias("has_match"))


@query("Q30_donut", "SELECT CASE WHEN risk >= 9 THEN 'keyword' WHEN risk >= 5 THEN 'high' WHEN risk >= 3 THEN 'medium' ELSE 'low' END AS slice, count(*) AS patterns FROM license_patterns GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.groupBy(F.when(F.col("risk") >= 9, "keyword").when(F.col("risk") >= 5, "high").when(F.col("risk") >= 3, "medium").otherwise("low").alias("slice")).agg(F.count("*").alias("patterns"))


@query("Q28_directories", "SELECT package, regexp_replace(filename, '/[^/]*$', '') AS dir, count(*) AS files FROM matched_files WHERE generation = 0 GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.matched_files.where("generation = 0").groupBy("package", dir_key(F.col("filename")).alias("dir")).agg(F.count("*").alias("files"))
