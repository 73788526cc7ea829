"""Sorting, pages and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.paths import depth
from tessellum.operators.ranking import global_rank
from tessellum.plans.catalog import Tables, query


def page(rows: DataFrame, order: list, limit: int = 10, offset: int = 0) -> DataFrame:
    """A page with `total`; a page behind the end is empty."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(total)  # a single total


@query("SRT01_offset_page", "SELECT id, name, count(*) OVER () AS total FROM bot_packages WHERE NOT obsolete ORDER BY id DESC LIMIT 10 OFFSET 20")
def _(t: Tables) -> DataFrame:
    return page(t.bot_packages.where(~F.col("obsolete")).select("id", "name"), [F.desc("id")], 10, 20)


@query("SRT02_keyset_page", "SELECT id, license FROM license_patterns WHERE id < (SELECT max(id) FROM license_patterns) ORDER BY id DESC LIMIT 11")
def _(t: Tables) -> DataFrame:
    last = t.license_patterns.agg(F.max("id").alias("before"))
    return t.license_patterns.join(F.broadcast(last), F.col("id") < F.col("before")).select("id", "license").orderBy(F.desc("id")).limit(11)  # a single key


@query("SRT03_review_queue", "SELECT id, row_number() OVER (ORDER BY priority DESC, external_link NULLS LAST, unresolved_matches, name, id) AS place FROM bot_packages WHERE state = 'new' AND NOT obsolete ORDER BY place LIMIT 50")
def _(t: Tables) -> DataFrame:
    order = [F.desc("priority"), F.asc_nulls_last("external_link"), F.col("unresolved_matches"), F.col("name"), F.col("id")]
    first = t.bot_packages.where("state = 'new'").where(~F.col("obsolete")).orderBy(*order).limit(50)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("id", "place")  # numbers one page


@query("SRT04_most_frequent", "SELECT s.id, count(o.id) AS occurrences FROM snippets s LEFT JOIN file_snippets o ON o.snippet = s.id GROUP BY s.id ORDER BY occurrences DESC, s.id DESC LIMIT 20")
def _(t: Tables) -> DataFrame:
    counts = t.file_snippets.groupBy(F.col("snippet").alias("id")).agg(F.count("*").alias("occurrences"))
    return t.snippets.select("id").join(counts, "id", "left").na.fill(0).orderBy(F.desc("occurrences"), F.desc("id")).limit(20)


@query("SRT05_prefix_first", "SELECT name, n FROM (SELECT DISTINCT name, CAST(length(name) AS INT) AS n, (name ILIKE 'li%') AS p FROM bot_packages WHERE name ILIKE '%li%') ORDER BY p DESC, n, name LIMIT 15")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.where(F.col("name").ilike("%li%")).select("name", F.length("name").alias("n")).distinct().orderBy(F.desc(F.col("name").ilike("li%")), "n", "name").limit(15)


@query("SRT06_byte_order", "SELECT license, row_number() OVER (ORDER BY license) AS place FROM (SELECT DISTINCT license FROM license_patterns WHERE license IS NOT NULL)")
def _(t: Tables) -> DataFrame:
    return global_rank(t.license_patterns.where("license is not null").select("license").distinct(), [F.col("license")])


@query("SRT07_top_unresolved", "SELECT package, snippet, n FROM (SELECT package, snippet, count(*) AS n, row_number() OVER (PARTITION BY package ORDER BY count(*) DESC, snippet) AS k FROM file_snippets WHERE generation = 0 AND resolution IS NULL GROUP BY package, snippet) WHERE k <= 10")
def _(t: Tables) -> DataFrame:
    counts = t.file_snippets.where("generation = 0 AND resolution IS NULL").groupBy("package", "snippet").agg(F.count("*").alias("n"))
    return counts.withColumn("k", F.row_number().over(Window.partitionBy("package").orderBy(F.desc("n"), "snippet"))).where("k <= 10").drop("k")


@query("SRT09_buckets", "SELECT package, CAST(greatest(n // 600, 1) AS BIGINT) AS buckets, CAST(ceil(n / greatest(n // 600, 1)) AS BIGINT) AS each FROM (SELECT package, count(*) AS n FROM matched_files GROUP BY package)")
def _(t: Tables, size: int = 600) -> DataFrame:
    n = t.matched_files.groupBy("package").agg(F.count("*").alias("n")).withColumn("buckets", F.greatest(F.floor(F.col("n") / size), F.lit(1)))
    return n.select("package", F.col("buckets").cast("long"), F.ceil(F.col("n") / F.col("buckets")).cast("long").alias("each"))


@query("SRT10_shallowest", "SELECT package, filename FROM (SELECT package, filename, row_number() OVER (PARTITION BY package ORDER BY len(filename) - len(replace(filename, '/', '')), filename, id) AS n FROM matched_files WHERE generation = 0) WHERE n <= 3")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("package").orderBy(depth(F.col("filename")), "filename", "id")
    return t.matched_files.where("generation = 0").withColumn("n", F.row_number().over(w)).where("n <= 3").select("package", "filename")


@query("SRT11_risk_descending", "SELECT package, string_agg(risk, '' ORDER BY risk DESC) AS risks FROM (SELECT DISTINCT m.package, CAST(p.risk AS VARCHAR) AS risk FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern WHERE m.generation = 0) GROUP BY package")
def _(t: Tables) -> DataFrame:
    p = t.license_patterns.select(F.col("id").alias("pattern"), F.col("risk").cast("string").alias("risk"))
    rows = t.pattern_matches.where("generation = 0").select("package", "pattern").join(p, "pattern")
    return rows.groupBy("package").agg(F.array_join(F.sort_array(F.collect_set("risk"), asc=False), "").alias("risks"))


@query("SRT13_keyset_batches", "SELECT (n - 1) // 400 AS batch, min(id) AS first, max(id) AS last, count(*) AS rows FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM bot_packages) GROUP BY 1")
def _(t: Tables, size: int = 400) -> DataFrame:
    n = global_rank(t.bot_packages.select("id"), [F.col("id")], "n")
    return n.groupBy(F.expr(f"(n - 1) div {size}").alias("batch")).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("rows"))


@query("SET01_unsettled", "SELECT DISTINCT package FROM (SELECT package FROM matched_files WHERE generation <> 0 UNION SELECT package FROM pattern_matches WHERE generation <> 0 UNION SELECT package FROM file_snippets WHERE generation <> 0 UNION SELECT package FROM package_components WHERE generation <> 0)")
def _(t: Tables) -> DataFrame:
    parts = [x.where("generation <> 0").select("package").distinct() for x in (t.matched_files, t.pattern_matches, t.file_snippets, t.package_components)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()


@query("SET02_union_of_lookups", "SELECT id FROM bot_packages WHERE external_link LIKE 'req#%' UNION SELECT id FROM bot_packages WHERE requesting_user = 1")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.where("external_link LIKE 'req#%'").select("id").union(t.bot_packages.where("requesting_user = 1").select("id")).distinct()


@query("SET03_distinct", "SELECT DISTINCT package, license FROM package_components WHERE license IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.package_components.where("license is not null").select("package", "license").distinct()


@query("SET04_new_licenses", "SELECT DISTINCT c.package, c.license FROM package_components c WHERE c.license IS NOT NULL AND NOT EXISTS (SELECT 1 FROM package_components o WHERE o.package = c.package - 1 AND o.license = c.license)")
def _(t: Tables) -> DataFrame:
    now = t.package_components.where("license is not null").select("package", "license").distinct()
    before = now.select((F.col("package") + 1).alias("package"), "license")
    return now.join(before, ["package", "license"], "left_anti")


@query("SET05_abandoned", "SELECT DISTINCT package FROM matched_files WHERE package NOT IN (SELECT id FROM bot_packages WHERE NOT obsolete)")
def _(t: Tables) -> DataFrame:
    kept = t.bot_packages.where(~F.col("obsolete")).select(F.col("id").alias("package"))
    return t.matched_files.select("package").where("package is not null").distinct().join(kept, "package", "left_anti")


@query("SET06_engine_difference", "SELECT file FROM ((SELECT DISTINCT file FROM pattern_matches EXCEPT SELECT DISTINCT file FROM file_snippets) UNION (SELECT DISTINCT file FROM file_snippets EXCEPT SELECT DISTINCT file FROM pattern_matches))")
def _(t: Tables) -> DataFrame:
    a, b = t.pattern_matches.select("file").distinct(), t.file_snippets.select("file").distinct()
    return a.join(b, "file", "left_anti").union(b.join(a, "file", "left_anti"))


@query("SET08_intersection", "SELECT DISTINCT external_link FROM bot_packages WHERE external_link IN (SELECT external_link FROM bot_packages WHERE embargoed)")
def _(t: Tables) -> DataFrame:
    held = t.bot_packages.where("embargoed").select("external_link")
    return t.bot_packages.select("external_link").where("external_link is not null").distinct().join(held, "external_link", "left_semi")
