"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.plans.catalog import Tables, query


@query("AGG01_match_counts", "SELECT pattern, count(*) AS matches, count(DISTINCT package) AS packages FROM pattern_matches GROUP BY pattern")
def _(t: Tables) -> DataFrame:
    return t.pattern_matches.groupBy("pattern").agg(F.count("*").alias("matches"), F.countDistinct("package").alias("packages"))


@query("AGG02_capped_counts", "SELECT pattern, least(count(*), 100) AS matches, count(*) > 100 AS more FROM pattern_matches GROUP BY pattern")
def _(t: Tables, cap: int = 100) -> DataFrame:
    return t.pattern_matches.groupBy("pattern").agg(F.least(F.count("*"), F.lit(cap).cast("long")).alias("matches"), (F.count("*") > cap).alias("more"))


@query("AGG03_filtered_counts", "SELECT count(*) FILTER (WHERE reviewed IS NOT NULL) AS performed, count(*) FILTER (WHERE state = 'acceptable') AS automated, count(*) FILTER (WHERE state = 'acceptable_by_lawyer') AS manual FROM bot_packages")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.agg(F.count_if(F.col("reviewed").isNotNull()).alias("performed"), F.count_if(F.col("state") == "acceptable").alias("automated"), F.count_if(F.col("state") == "acceptable_by_lawyer").alias("manual"))


@query("AGG04_distinct_filtered", "SELECT type, count(DISTINCT package) FILTER (WHERE license IS NOT NULL) AS licensed, count(DISTINCT package) FILTER (WHERE license IS NULL) AS unlicensed FROM package_components GROUP BY type")
def _(t: Tables) -> DataFrame:
    return t.package_components.groupBy("type").agg(F.countDistinct(F.when(F.col("license").isNotNull(), F.col("package"))).alias("licensed"), F.countDistinct(F.when(F.col("license").isNull(), F.col("package"))).alias("unlicensed"))


@query("AGG05_dashboard", "SELECT (SELECT count(*) FROM bot_packages WHERE state = 'new' AND NOT obsolete) AS open, (SELECT count(*) FROM license_patterns) AS patterns, (SELECT count(*) FROM snippets WHERE NOT classified) AS pending, (SELECT CAST(coalesce(sum(unresolved_matches), 0) AS BIGINT) FROM bot_packages WHERE NOT obsolete) AS unresolved")
def _(t: Tables) -> DataFrame:
    packages = t.bot_packages.agg(F.count_if((F.col("state") == "new") & ~F.col("obsolete")).alias("open"), F.coalesce(F.sum(F.when(~F.col("obsolete"), F.col("unresolved_matches"))), F.lit(0)).alias("unresolved"))
    # each side is a single row
    return packages.crossJoin(t.license_patterns.agg(F.count("*").alias("patterns"))).crossJoin(t.snippets.agg(F.count_if(~F.col("classified")).alias("pending")))


@query("AGG06_sum_or_zero", "SELECT name, CAST(coalesce(sum(unresolved_matches), 0) AS BIGINT) AS unresolved FROM bot_packages GROUP BY name")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.groupBy("name").agg(F.coalesce(F.sum("unresolved_matches"), F.lit(0)).alias("unresolved"))


@query("AGG07_bool_or", "SELECT license, bool_or(patent) AS patent, bool_or(eula) AS eula FROM license_patterns GROUP BY license")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.groupBy("license").agg(F.bool_or("patent").alias("patent"), F.bool_or("eula").alias("eula"))


@query("AGG08_distinct_risks", "SELECT license, list_sort(list(DISTINCT risk)) AS risks FROM license_patterns WHERE license IS NOT NULL GROUP BY license")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.where("license is not null").groupBy("license").agg(F.array_sort(F.collect_set("risk")).alias("risks"))


@query("AGG09_array_agg", "SELECT external_link, string_agg(name || '@' || checkout_dir, ',' ORDER BY name, checkout_dir) AS packages FROM bot_packages WHERE external_link IS NOT NULL GROUP BY external_link")
def _(t: Tables) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("name", "checkout_dir")))
    return t.bot_packages.where("external_link is not null").groupBy("external_link").agg(F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("@"), p["checkout_dir"])), ",").alias("packages"))


@query("AGG10_alias_cloud", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(title), ' ')) AS word FROM license_list) GROUP BY word")
def _(t: Tables) -> DataFrame:
    return t.license_list.select(F.explode(F.split(F.lower("title"), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("AGG11_first_pattern", "SELECT license, min(id) AS first FROM license_patterns WHERE license IS NOT NULL GROUP BY license")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.where("license is not null").groupBy("license").agg(F.min("id").alias("first"))


@query("AGG12_cover_risk", "SELECT m.file, max(p.risk) AS risk FROM pattern_matches m JOIN license_patterns p ON m.pattern = p.id WHERE m.generation = 0 AND NOT m.ignored AND NOT p.catch_all GROUP BY m.file")
def _(t: Tables) -> DataFrame:
    p = t.license_patterns.where(~F.col("catch_all")).select(F.col("id").alias("pattern"), "risk")
    return t.pattern_matches.where("generation = 0 AND NOT ignored").select("file", "pattern").join(p, "pattern").groupBy("file").agg(F.max("risk").alias("risk"))


@query("AGG13_group_by_expression", "SELECT coalesce(nullif(trim(name), ''), purl) AS component, count(*) AS n, max(package) AS last FROM package_components GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.package_components.groupBy(F.coalesce(F.nullif(F.trim("name"), F.lit("")), "purl").alias("component")).agg(F.count("*").alias("n"), F.max("package").alias("last"))


@query("AGG14_distinct_licenses", "SELECT count(*) AS licenses FROM (SELECT DISTINCT license FROM license_patterns WHERE coalesce(license, '') <> '')")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.where("coalesce(license, '') <> ''").agg(F.countDistinct("license").alias("licenses"))


@query("AGG16_snippet_groups", "SELECT snippet, count(*) AS occurrences, count(DISTINCT package) AS packages FROM file_snippets WHERE generation = 0 GROUP BY snippet")
def _(t: Tables) -> DataFrame:
    return t.file_snippets.where("generation = 0").groupBy("snippet").agg(F.count("*").alias("occurrences"), F.countDistinct("package").alias("packages"))


@query("AGG17_scalar_counts", "SELECT s.id, (SELECT count(*) FROM file_snippets o WHERE o.snippet = s.id) AS occurrences, (SELECT count(DISTINCT o.package) FROM file_snippets o WHERE o.snippet = s.id) AS packages FROM snippets s")
def _(t: Tables) -> DataFrame:
    counts = t.file_snippets.groupBy(F.col("snippet").alias("id")).agg(F.count("*").alias("occurrences"), F.countDistinct("package").alias("packages"))
    return t.snippets.select("id").join(counts, "id", "left").na.fill(0)


@query("AGG18_license_composition", """WITH c AS (SELECT p.license, count(DISTINCT m.file) AS files FROM pattern_matches m JOIN license_patterns p ON m.pattern = p.id WHERE m.generation = 0 AND NOT m.ignored AND coalesce(trim(p.license), '') <> '' GROUP BY p.license),
  r AS (SELECT *, row_number() OVER (ORDER BY files DESC, license) AS n FROM c) SELECT CASE WHEN n <= 7 THEN license ELSE 'Misc' END AS license, CAST(sum(files) AS BIGINT) AS files FROM r GROUP BY 1""")
def _(t: Tables, top: int = 7) -> DataFrame:
    p = t.license_patterns.where("coalesce(trim(license), '') <> ''").select(F.col("id").alias("pattern"), "license")
    counts = t.pattern_matches.where("generation = 0 AND NOT ignored").select("file", "pattern").join(p, "pattern").groupBy("license").agg(F.countDistinct("file").alias("files"))
    first = counts.orderBy(F.desc("files"), "license").limit(top)  # a top-k report; everything else is summed as Misc
    rest = counts.join(F.broadcast(first.select("license")), "license", "left_anti").agg(F.sum("files").alias("files")).where("files is not null").select(F.lit("Misc").alias("license"), "files")
    return first.union(rest)


@query("AGG19_unresolved", "SELECT package, count(DISTINCT snippet) AS unresolved FROM file_snippets WHERE generation = 0 AND resolution IS NULL GROUP BY package")
def _(t: Tables) -> DataFrame:
    return t.file_snippets.where("generation = 0 AND resolution IS NULL").groupBy("package").agg(F.countDistinct("snippet").alias("unresolved"))


@query("AGG20_missed_file_max", """WITH s AS (SELECT o.file, s.likelyness AS m, coalesce(p.risk, 9) AS risk FROM file_snippets o JOIN snippets s ON o.snippet = s.id LEFT JOIN license_patterns p ON p.id = s.like_pattern WHERE o.generation = 0 AND o.resolution IS NULL AND s.likelyness IS NOT NULL),
  e AS (SELECT file, m, CASE WHEN m < 0.9 AND floor(risk * m + 9 * (1 - m) + 0.5) <= 4 THEN 5 ELSE CAST(floor(risk * m + 9 * (1 - m) + 0.5) AS INT) END AS risk FROM s)
  SELECT file, max(risk) AS risk, max(m) FILTER (WHERE risk = top) AS match FROM (SELECT *, max(risk) OVER (PARTITION BY file) AS top FROM e) GROUP BY file""")
def _(t: Tables) -> DataFrame:
    from tessellum.functions.risk import estimated_risk

    p = t.license_patterns.select(F.col("id").alias("like_pattern"), "risk")
    s = t.snippets.where("likelyness is not null").select(F.col("id").alias("snippet"), "likelyness", "like_pattern").join(p, "like_pattern", "left")
    o = t.file_snippets.where("generation = 0 AND resolution IS NULL").select("file", "snippet").join(s, "snippet")
    rated = o.select("file", F.struct(estimated_risk(F.coalesce("risk", F.lit(9)), F.col("likelyness")).alias("risk"), F.col("likelyness").alias("match")).alias("s"))
    return rated.groupBy("file").agg(F.max("s").alias("s")).select("file", "s.risk", "s.match")


@query("AGG21_license_rollup", "SELECT license, max(risk) AS risk, concat_ws(',', CASE WHEN bool_or(patent) THEN 'patent' END, CASE WHEN bool_or(trademark) THEN 'trademark' END, CASE WHEN bool_or(cla) THEN 'cla' END, CASE WHEN bool_or(eula) THEN 'eula' END) AS flags FROM license_patterns WHERE license IS NOT NULL GROUP BY license")
def _(t: Tables) -> DataFrame:
    flags = [F.when(F.bool_or(c), F.lit(c)) for c in ("patent", "trademark", "cla", "eula")]
    return t.license_patterns.where("license is not null").groupBy("license").agg(F.max("risk").alias("risk"), F.concat_ws(",", *flags).alias("flags"))


@query("AGG22_harvest_totals", r"SELECT source, CAST(sum(len(regexp_extract_all(text, 'https?://[^\s,;)>]+'))) AS BIGINT) AS urls FROM documents GROUP BY source")
def _(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"https?://[^\s,;)>]+"), F.lit(0)))).alias("urls"))


@query("AGG23_consistency", "SELECT license, count(DISTINCT risk) AS risks, count(DISTINCT spdx) AS spdx, count(DISTINCT catch_all) AS catch_all FROM license_patterns WHERE license IS NOT NULL GROUP BY license HAVING count(DISTINCT risk) > 1 OR count(DISTINCT spdx) > 1 OR count(DISTINCT catch_all) > 1")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.where("license is not null").groupBy("license").agg(F.countDistinct("risk").alias("risks"), F.countDistinct("spdx").alias("spdx"), F.countDistinct("catch_all").alias("catch_all")).where("risks > 1 OR spdx > 1 OR catch_all > 1")


@query("AGG24_corpus_stats", "SELECT count(*) AS patterns, count(DISTINCT license) AS licenses, count(*) FILTER (WHERE license IS NULL) AS keywords, round(count(license) / count(DISTINCT license), 6) AS per_license FROM license_patterns")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.agg(F.count("*").alias("patterns"), F.countDistinct("license").alias("licenses"), F.count_if(F.col("license").isNull()).alias("keywords"), F.round(F.count("license") / F.countDistinct("license"), 6).alias("per_license"))


@query("AGG25_unused", "SELECT p.license, count(*) AS unused FROM license_patterns p LEFT JOIN (SELECT DISTINCT pattern FROM pattern_matches WHERE NOT ignored) m ON m.pattern = p.id WHERE m.pattern IS NULL GROUP BY p.license")
def _(t: Tables) -> DataFrame:
    used = t.pattern_matches.where(~F.col("ignored")).select(F.col("pattern").alias("id"))
    return t.license_patterns.join(used, "id", "left_anti").groupBy("license").agg(F.count("*").alias("unused"))


@query("AGG26_package_flags", "SELECT m.package, bool_or(p.patent) AS patent, bool_or(p.trademark) AS trademark, bool_or(p.export_restricted) AS export_restricted FROM pattern_matches m JOIN license_patterns p ON m.pattern = p.id WHERE m.generation = 0 AND NOT m.ignored GROUP BY m.package")
def _(t: Tables) -> DataFrame:
    p = t.license_patterns.select(F.col("id").alias("pattern"), "patent", "trademark", "export_restricted")
    used = t.pattern_matches.where("generation = 0 AND NOT ignored").select("package", "pattern").distinct()
    return used.join(p, "pattern").groupBy("package").agg(*[F.bool_or(c).alias(c) for c in ("patent", "trademark", "export_restricted")])


@query("AGG30_latest_member", "SELECT name, max(created) AS updated FROM bot_packages GROUP BY name")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.groupBy("name").agg(F.max("created").alias("updated"))


@query("WIN_share_of_license", "SELECT license, risk, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY license), 9) AS share FROM license_patterns WHERE license IS NOT NULL GROUP BY license, risk")
def _(t: Tables) -> DataFrame:
    counts = t.license_patterns.where("license is not null").groupBy("license", "risk").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("license")), 9))
