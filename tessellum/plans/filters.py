"""Filters and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions.paths import dir_key, glob_regex, is_license_filename, peripheral_kind
from tessellum.operators.intervals import overlaps
from tessellum.plans import path_sql
from tessellum.plans.catalog import NOW, Tables, query

_NOW = f"TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}'"


def contains_any(term: str, *columns: str) -> Column:
    """ILIKE over several columns; wildcards in the term stay live."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False)) for c in columns])


@query("FLT01_ilike_any", "SELECT id, name FROM bot_packages WHERE coalesce(checksum ILIKE '%ab%', false) OR coalesce(external_link ILIKE '%req%', false) OR coalesce(name ILIKE '%perl%', false) OR coalesce(state ILIKE '%unacc%', false)")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.where(contains_any("ab", "checksum") | contains_any("req", "external_link") | contains_any("perl", "name") | contains_any("unacc", "state")).select("id", "name")


def open_packages(packages: DataFrame, priority: int | None = 2, in_progress: bool | None = None, search: str | None = None, obsolete: bool = False) -> DataFrame:
    """Optional filters, each of which adds a condition or nothing."""
    out = packages if obsolete else packages.where(~F.col("obsolete"))
    if priority:
        out = out.where(F.col("priority") >= priority)
    if in_progress is not None:
        running = F.col("unpacked").isNull() | F.col("indexed").isNull()
        out = out.where(running if in_progress else ~running)
    return out.where(contains_any(search, "name", "external_link", "checksum")) if search else out


@query("FLT02_optional_filters", "SELECT id, name, priority FROM bot_packages WHERE NOT obsolete AND priority >= 2 AND (name ILIKE '%lib%' OR coalesce(external_link ILIKE '%lib%', false) OR coalesce(checksum ILIKE '%lib%', false))")
def _(t: Tables) -> DataFrame:
    return open_packages(t.bot_packages, search="lib").select("id", "name", "priority")


@query("FLT03_priority_floor", "SELECT id, priority FROM bot_packages WHERE priority >= 5")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.where("priority >= 5").select("id", "priority")


@query("FLT04_in_progress", "SELECT id, name FROM bot_packages WHERE unpacked IS NULL OR indexed IS NULL")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.where(F.col("unpacked").isNull() | F.col("indexed").isNull()).select("id", "name")


@query("FLT05_visible_snippets", "SELECT s.id FROM snippets s LEFT JOIN bot_packages p ON p.id = s.package WHERE coalesce(p.embargoed, false) = false AND coalesce(p.obsolete, false) = false")
def _(t: Tables) -> DataFrame:
    owners = t.bot_packages.select(F.col("id").alias("package"), "embargoed", "obsolete")
    return t.snippets.join(owners, "package", "left").where(~F.coalesce("embargoed", F.lit(False)) & ~F.coalesce("obsolete", F.lit(False))).select("id")


@query("FLT06_recently_reviewed", f"SELECT id, reviewed FROM bot_packages WHERE reviewed > {_NOW} - INTERVAL 90 DAY")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.where(F.col("reviewed") > F.expr(f"timestamp_ntz'{NOW:%Y-%m-%d %H:%M:%S}' - interval 90 days")).select("id", "reviewed")


@query("FLT07_legal_flags", "SELECT id, license FROM license_patterns WHERE patent OR trademark OR export_restricted OR cla OR eula")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.where(F.col("patent") | F.col("trademark") | F.col("export_restricted") | F.col("cla") | F.col("eula")).select("id", "license")


@query("FLT08_needs_attention", "SELECT id, state FROM bot_packages WHERE state IN ('unacceptable', 'new')")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.where(F.col("state").isin("unacceptable", "new")).select("id", "state")


@query("FLT09_name_or_all", "SELECT p.id FROM bot_packages p WHERE p.name = 'lumenkit' AND p.id IN (SELECT package FROM package_components)")
def _(t: Tables) -> DataFrame:
    listed = t.package_components.select(F.col("package").alias("id")).distinct()
    return t.bot_packages.where(F.col("name") == "lumenkit").join(listed, "id", "left_semi").select("id")


@query("FLT10_null_safe_difference", "SELECT id FROM snippets WHERE score_version IS DISTINCT FROM 2")
def _(t: Tables) -> DataFrame:
    return t.snippets.where(~F.col("score_version").eqNullSafe(2)).select("id")


@query("FLT11_array_contains_all", "SELECT license_id FROM license_list WHERE list_has_all(aliases, ['TAFL-1.0+']) OR list_has_all(aliases, ['QUDL-1.0', 'TAFL-1.0+'])")
def _(t: Tables, wanted: tuple[tuple[str, ...], ...] = (("TAFL-1.0+",), ("QUDL-1.0", "TAFL-1.0+"))) -> DataFrame:
    """Rows whose array holds all values of one of the wanted sets."""
    has = [F.size(F.array_except(F.array(*map(F.lit, w)), "aliases")) == 0 for w in wanted]
    return t.license_list.where(F.coalesce(has[0] | has[1], F.lit(False))).select("license_id")


@query("FLT12_any_of", "SELECT id, type FROM package_components WHERE type = ANY(['npm', 'gem'])")
def _(t: Tables) -> DataFrame:
    return t.package_components.where(F.col("type").isin("npm", "gem")).select("id", "type")


@query("FLT13_glob", r"SELECT id, filename FROM matched_files WHERE regexp_matches(filename, '^.*/compat/.*\.js$') OR regexp_matches(filename, '^docs/.*$')")
def _(t: Tables) -> DataFrame:
    globs = [glob_regex("*/compat/*.js"), glob_regex("docs/*")]
    return t.matched_files.where(F.col("filename").rlike("|".join(f"(?:{g})" for g in globs))).select("id", "filename")


@query("FLT14_classifier_partition", "SELECT id FROM snippets WHERE license IS NOT NULL OR NOT classified")
def _(t: Tables) -> DataFrame:
    return t.snippets.where(F.col("license").isNotNull() | ~F.col("classified")).select("id")


@query("FLT15_resolution", "SELECT id, resolution FROM file_snippets WHERE generation = 0 AND resolution IN ('clear', 'overlap', 'covered')")
def _(t: Tables) -> DataFrame:
    return t.file_snippets.where("generation = 0").where(F.col("resolution").isin("clear", "overlap", "covered")).select("id", "resolution")


@query("FLT16_relevant_reviews", "SELECT DISTINCT a.id, b.id AS other FROM bot_packages a JOIN bot_packages b ON a.name = b.name AND a.id <> b.id WHERE b.priority >= 8 OR a.checksum = b.checksum")
def _(t: Tables) -> DataFrame:
    b = t.bot_packages.select(F.col("id").alias("other"), "name", F.col("checksum").alias("their"), F.col("priority").alias("their_priority"))
    return t.bot_packages.select("id", "name", "checksum").join(b, "name").where("id <> other").where((F.col("their_priority") >= 8) | F.coalesce(F.col("checksum") == F.col("their"), F.lit(False))).select("id", "other").distinct()


@query("FLT17_exists_probe", "SELECT EXISTS (SELECT 1 FROM license_patterns WHERE packname <> '') AS has_scoped, EXISTS (SELECT 1 FROM snippets WHERE NOT classified) AS has_pending")
def _(t: Tables) -> DataFrame:
    scoped = t.license_patterns.where("packname <> ''").limit(1).agg((F.count("*") > 0).alias("has_scoped"))
    return scoped.crossJoin(t.snippets.where(~F.col("classified")).limit(1).agg((F.count("*") > 0).alias("has_pending")))  # two single rows


@query("FLT18_line_range", "SELECT m.id AS match, o.id AS occurrence FROM pattern_matches m JOIN file_snippets o ON m.file = o.file WHERE m.eline >= o.sline - 1 AND m.sline <= o.eline + 1")
def _(t: Tables) -> DataFrame:
    o = t.file_snippets.select(F.col("id").alias("occurrence"), "file", F.col("sline").alias("s"), F.col("eline").alias("e"))
    m = t.pattern_matches.select(F.col("id").alias("match"), "file", "sline", "eline")
    return overlaps(o, m, "file", ("s", "e"), ("sline", "eline"), margin=1).select("match", "occurrence")


@query("FLT19_same_directory", "SELECT id, regexp_replace(filename, '/[^/]*$', '') AS dir FROM matched_files")
def _(t: Tables) -> DataFrame:
    return t.matched_files.select("id", dir_key(F.col("filename")).alias("dir"))


@query("FLT20_expansion_cap", "SELECT package, filename FROM (SELECT package, filename, dense_rank() OVER (PARTITION BY package ORDER BY filename) AS r FROM matched_files WHERE generation = 0) WHERE r <= 11")
def _(t: Tables, cap: int = 10) -> DataFrame:
    from pyspark.sql import Window

    ranked = t.matched_files.where("generation = 0").withColumn("r", F.dense_rank().over(Window.partitionBy("package").orderBy("filename")))
    return ranked.where(F.col("r") <= cap + 1).select("package", "filename")


@query("FLT21_length_bound", "SELECT id, length(purl) AS n FROM package_components WHERE length(purl) <= 30")
def _(t: Tables) -> DataFrame:
    return t.package_components.where(F.length("purl") <= 30).select("id", F.length("purl").cast("long").alias("n"))


@query("FLT22_document_candidates", f"""WITH c AS (SELECT package, filename, len(filename) - len(replace(filename, '/', '')) AS depth FROM matched_files WHERE generation = 0 AND {path_sql.license_file('filename')} AND {path_sql.kind('filename')} IS NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY depth, filename) AS n, count(*) OVER (PARTITION BY package) AS total FROM c)
  SELECT package, filename, CAST(greatest(total - 10, 0) AS BIGINT) AS dropped FROM r WHERE n <= 10""")
def _(t: Tables, most: int = 10) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("package")
    rows = t.matched_files.where("generation = 0").where(is_license_filename(F.col("filename")) & peripheral_kind(F.col("filename")).isNull()).withColumn("depth", F.size(F.split("filename", "/")))
    rows = rows.withColumn("n", F.row_number().over(by.orderBy("depth", "filename"))).withColumn("total", F.count("*").over(by))
    return rows.where(F.col("n") <= most).select("package", "filename", F.greatest(F.col("total") - most, F.lit(0)).alias("dropped"))


@query("FLT23_superseded", "SELECT a.id FROM file_snippets a WHERE a.generation = 0 AND a.resolution IS NULL AND NOT EXISTS (SELECT 1 FROM file_snippets b WHERE b.snippet = a.snippet AND b.resolution = 'fold')")
def _(t: Tables) -> DataFrame:
    answered = t.file_snippets.where("resolution = 'fold'").select("snippet").distinct()
    return t.file_snippets.where("generation = 0 AND resolution IS NULL").join(answered, "snippet", "left_anti").select("id")


@query("FLT24_not_expired", f"SELECT id, imported FROM bot_packages WHERE imported > {_NOW}")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.where(F.col("imported") > F.lit(NOW).cast("timestamp_ntz")).select("id", "imported")


@query("FLT25_arrays_overlap", "SELECT a.license_id, b.license_id AS other FROM license_list a JOIN license_list b ON a.license_id < b.license_id AND list_has_any(string_split(lower(a.title), ' '), ['font', 'free']) AND split_part(a.license_id, '-', 1) = split_part(b.license_id, '-', 1)")
def _(t: Tables) -> DataFrame:
    capable = F.arrays_overlap(F.split(F.lower("title"), " "), F.array(F.lit("font"), F.lit("free")))
    a = t.license_list.where(capable).select("license_id", F.split_part("license_id", F.lit("-"), F.lit(1)).alias("family"))
    b = t.license_list.select(F.col("license_id").alias("other"), F.split_part("license_id", F.lit("-"), F.lit(1)).alias("family"))
    return a.join(b, "family").where("license_id < other").select("license_id", "other")


@query("FLT26_list_files", r"SELECT package, filename FROM matched_files WHERE generation = 0 AND regexp_matches(filename, '^.*\.rst$')")
def _(t: Tables) -> DataFrame:
    return t.matched_files.where("generation = 0").where(F.col("filename").rlike(glob_regex("*.rst"))).select("package", "filename")


@query("FLT27_glob_matches_report", r"SELECT package, bool_or(regexp_matches(filename, '^.*/node_modules/.*$')) AS matches FROM matched_files WHERE generation = 0 GROUP BY package")
def _(t: Tables) -> DataFrame:
    return t.matched_files.where("generation = 0").groupBy("package").agg(F.bool_or(F.col("filename").rlike(glob_regex("*/node_modules/*"))).alias("matches"))
