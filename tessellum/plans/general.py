"""Grouping sets, percentiles, frames, set operations, user-defined aggregates, held-out figures and further listings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.paths import glob_regex
from tessellum.functions.risk import percent
from tessellum.operators import engine, phrase_match
from tessellum.plans import analytics
from tessellum.plans.analytics import _SCORES, best_licenses, license_scores, shingle_rows
from tessellum.plans.catalog import Tables, query
from tessellum.session import cut, shuffled

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


@query("AGG29_grouping_sets", "SELECT type, complete, CAST(grouping(type) * 2 + grouping(complete) AS BIGINT) AS level, count(*) AS rows, count(DISTINCT package) AS packages FROM package_components GROUP BY ROLLUP (type, complete)")
def _(t: Tables) -> DataFrame:
    """Components by type and completeness, with the totals of each level."""
    return t.package_components.rollup("type", "complete").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("rows"), F.countDistinct("package").alias("packages"))


@query("AGG29_cube", "SELECT risk, catch_all, count(*) AS patterns FROM license_patterns GROUP BY CUBE (risk, catch_all)")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.cube("risk", "catch_all").agg(F.count("*").alias("patterns"))


@query("AGG29_percentiles", "SELECT source, quantile_cont(n_chars, 0.5) AS half, quantile_cont(n_chars, 0.9) AS most, count(*) AS documents FROM documents GROUP BY source")
def _(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.percentile("n_chars", 0.5).alias("half"), F.percentile("n_chars", 0.9).alias("most"), F.count("*").alias("documents"))


@query("WIN15_frames", "SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after, rank() OVER (PARTITION BY name ORDER BY priority DESC) AS rank, dense_rank() OVER (PARTITION BY name ORDER BY priority DESC) AS dense, ntile(3) OVER w AS third, sum(priority) OVER (PARTITION BY name ORDER BY id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM bot_packages WINDOW w AS (PARTITION BY name ORDER BY id)")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("name").orderBy("id")
    by_priority = Window.partitionBy("name").orderBy(F.desc("priority"))
    return t.bot_packages.select("id", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"), F.rank().over(by_priority).alias("rank"), F.dense_rank().over(by_priority).alias("dense"), F.ntile(3).over(w).alias("third"), F.sum("priority").over(w.rowsBetween(-2, 0)).alias("recent"))


@query("SET07_intersect_except", "(SELECT 'both' AS side, package FROM (SELECT package FROM pattern_matches WHERE generation = 0 INTERSECT SELECT package FROM package_components WHERE NOT complete)) UNION ALL (SELECT 'first', package FROM (SELECT package FROM file_snippets WHERE resolution IS NULL EXCEPT SELECT package FROM file_snippets WHERE resolution = 'fold'))")
def _(t: Tables) -> DataFrame:
    both = t.pattern_matches.where("generation = 0").select("package").intersect(t.package_components.where("NOT complete").select("package"))
    first = t.file_snippets.where("resolution is null").select("package").exceptAll(t.file_snippets.where("false").select("package")).distinct().subtract(t.file_snippets.where("resolution = 'fold'").select("package"))
    return both.select(F.lit("both").alias("side"), "package").union(first.select(F.lit("first"), "package"))


@query("UDF06_grouped_aggregate", "SELECT license, median(risk) AS middle, count(*) AS patterns FROM license_patterns WHERE license IS NOT NULL AND risk IS NOT NULL GROUP BY license")
def _(t: Tables) -> DataFrame:
    """A user-defined aggregate beside a built-in one. It sees a group at once: for groups of bounded size, as the patterns of a license."""

    @F.pandas_udf("double")
    def middle(risk: pd.Series) -> float:
        return float(risk.median())

    rows = t.license_patterns.where("license is not null and risk is not null").groupBy("license")
    counts = t.license_patterns.where("license is not null and risk is not null").groupBy("license").agg(F.count("*").alias("patterns"))
    return rows.agg(middle("risk").alias("middle")).join(counts, "license")


@query("UDF01_signatures_after_removal", f"""WITH s AS (SELECT DISTINCT id, license, array_to_string(w[i:i + 2], ',') AS s FROM (SELECT id, license, w, unnest(generate_series(1, len(w) - 2)) AS i FROM (SELECT id, license, {_WORDS.format('pattern')} AS w FROM license_patterns WHERE license <> '' AND pattern IS NOT NULL AND NOT catch_all) WHERE len(w) >= 3))
  SELECT DISTINCT license, s FROM s""")
def _(t: Tables) -> DataFrame:
    """The inverted index kept in step with removed patterns: a shingle of a license stays as long as another of its patterns has it.
    Counts per (license, shingle) make a removal a difference; the whole index is not built again. Here the catch-alls are removed."""
    rows = t.license_patterns.where("license <> ''").select("id", "license", "catch_all", F.col("pattern").alias("text"))
    s = shingle_rows(rows.where(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) >= analytics.K), "text", "id", "license", "catch_all")
    index = s.groupBy("license", "s").agg(F.count("*").alias("n"))
    removed = s.where("catch_all").groupBy("license", "s").agg((-F.count("*")).alias("n"))
    return index.union(removed).groupBy("license", "s").agg(F.sum("n").alias("n")).where("n > 0").select("license", "s")


@query("STM10_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, k""")
def _(t: Tables) -> DataFrame:
    """Sessions of a user: events less than half an hour apart. The same expression runs on a stream behind a watermark."""
    timed = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    sessions = timed.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events"))
    return sessions.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "events")


#: Parts of the catalogue of which one is held out, thresholds, and the least lead over the runner-up.
FOLDS, THRESHOLDS, MARGIN = 5, (0.80, 0.85, 0.90, 0.95, 0.99), 0.15


def held_out(t: Tables, folds: int = FOLDS, margin: float = MARGIN) -> DataFrame:
    """(threshold, texts, accepted, right): the texts of one part of the patterns are scored against the other parts; accepted are
    those whose best license reaches the threshold with the margin, right those of which it is the license."""
    named = t.license_patterns.where("license <> '' AND pattern IS NOT NULL")
    texts = cut(named.where(F.col("id") % folds == 0).select("id", F.col("pattern").alias("text"), F.col("license").alias("truth")))
    best = best_licenses(license_scores(texts.select("id", "text"), named.where(F.col("id") % folds != 0)))
    rows = texts.select("id", "truth").join(shuffled(best), "id", "left").withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    ok = F.coalesce((F.col("match") >= F.col("threshold")) & (F.round(F.col("match") - F.col("second"), 9) >= margin), F.lit(False))
    return rows.groupBy("threshold").agg(F.count("*").alias("texts"), F.count_if(ok).alias("accepted"), F.count_if(ok & (F.col("license") == F.col("truth"))).alias("right"))


_OVER = _SCORES.replace("FROM license_patterns", "FROM kp").replace("FROM snippets", "FROM ht")
_HELD = f"""WITH kp AS (SELECT * FROM license_patterns WHERE license <> '' AND pattern IS NOT NULL AND id % {FOLDS} <> 0), ht AS (SELECT id, pattern AS text, license AS truth FROM license_patterns WHERE license <> '' AND pattern IS NOT NULL AND id % {FOLDS} = 0), {_OVER},
  rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, first, license) AS k FROM sc), bl AS (SELECT id, max(license) FILTER (WHERE k = 1) AS license, max(score) FILTER (WHERE k = 1) AS match, coalesce(max(score) FILTER (WHERE k = 2), 0.0) AS second FROM rk GROUP BY id),
  hx AS (SELECT x.threshold, ht.truth, bl.license, coalesce(bl.match >= x.threshold AND round(bl.match - bl.second, 9) >= {MARGIN}, false) AS ok FROM ht LEFT JOIN bl ON bl.id = ht.id CROSS JOIN (VALUES {', '.join(f'({x}::DOUBLE)' for x in THRESHOLDS)}) x(threshold)),
  ho AS (SELECT threshold, count(*) AS texts, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE ok AND license = truth) AS "right" FROM hx GROUP BY 1)"""


@query("LA42_fold_calibration", f"{_HELD} SELECT * FROM ho")
def _(t: Tables) -> DataFrame:
    return held_out(t)


@query("AGG27_precision_recall", f"""{_HELD} SELECT threshold, CASE WHEN accepted > 0 THEN round("right" / accepted, 9) END AS precision, CASE WHEN texts > 0 THEN round("right" / texts, 9) END AS recall FROM ho""")
def _(t: Tables) -> DataFrame:
    share = lambda of: F.when(F.col(of) > 0, F.round(F.col("right") / F.col(of), 9))
    return held_out(t).select("threshold", share("accepted").alias("precision"), share("texts").alias("recall"))


@query("Q27_rescored", f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, first, license) AS k FROM sc), b AS (SELECT id, max(license) FILTER (WHERE k = 1) AS license, max(score) FILTER (WHERE k = 1) AS likelyness, coalesce(max(score) FILTER (WHERE k = 2), 0.0) AS second_match FROM r GROUP BY id)
  SELECT s.id, b.license, coalesce(b.likelyness, 0.0) AS likelyness, coalesce(b.second_match, 0.0) AS second_match, 2 AS score_version FROM snippets s LEFT JOIN b ON b.id = s.id WHERE s.score_version IS DISTINCT FROM 2""")
def _(t: Tables) -> DataFrame:
    """New scores for all snippets with those of an older formula; one without a winner has none."""
    stale = t.snippets.where(~F.col("score_version").eqNullSafe(2)).select("id", "text")
    best = best_licenses(license_scores(stale, t.license_patterns))
    rows = stale.select("id").join(shuffled(best), "id", "left")
    return rows.select("id", "license", F.coalesce("match", F.lit(0.0)).alias("likelyness"), F.coalesce("second", F.lit(0.0)).alias("second_match"), F.lit(2).alias("score_version"))


_BY_PATTERN = _SCORES.replace("FROM license_patterns", "FROM bp")
_PATTERNS = f"WITH bp AS (SELECT id, pattern, CAST(id AS VARCHAR) AS license FROM license_patterns WHERE license <> '' AND pattern IS NOT NULL), {_BY_PATTERN}"


def pattern_scores(t: Tables, most: int) -> DataFrame:
    """(id, pattern, score): per snippet the patterns with enough rare shared shingles that have the highest weight of what they share
    by that of the snippet, the `most` best and perhaps others. Every pattern has a signature of its own here."""
    each = t.license_patterns.where("license <> '' AND pattern IS NOT NULL").withColumn("license", F.col("id").cast("string"))
    return license_scores(t.snippets, each, most).select("id", F.col("first").alias("pattern"), "score")


@query("LA14_closest_patterns", f"{_PATTERNS} SELECT id, first AS pattern, score, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, first) AS k FROM sc) WHERE k <= 3")
def _(t: Tables, most: int = 3) -> DataFrame:
    """The patterns that are most like each snippet."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "pattern")).cast("long")
    return pattern_scores(t, most).withColumn("place", place).where(F.col("place") <= most)


@query("LA45_closest_other_pattern", f"{_PATTERNS}, o AS (SELECT sc.*, row_number() OVER (PARTITION BY sc.id ORDER BY score DESC, first) AS k FROM sc JOIN snippets s ON s.id = sc.id AND s.like_pattern IS DISTINCT FROM sc.first) SELECT id, first AS pattern, floor(score * 1000 + 0.5) / 10.0 AS percent FROM o WHERE k = 1")
def _(t: Tables) -> DataFrame:
    """The pattern most like a snippet other than the one that it is filed under, in percent with one decimal."""
    filed = t.snippets.select("id", "like_pattern")
    rows = pattern_scores(t, 2).join(shuffled(filed), "id").where(~F.col("like_pattern").eqNullSafe(F.col("pattern")))
    best = rows.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("less"), "pattern")).alias("b"))
    return best.select("id", "b.pattern", percent(-F.col("b.less")).alias("percent"))


@query("UDF02_engine_functions", rf"""SELECT id, CAST(len({_WORDS.format('pattern')}) AS INT) AS words, contains(' ' || array_to_string({_WORDS.format('pattern')}, ' ') || ' ', ' copyright holder ') AS names_holder FROM license_patterns WHERE pattern IS NOT NULL AND NOT regexp_matches(pattern, '(?i)\$skip')""")
def _(t: Tables) -> DataFrame:
    """The matcher's functions in SQL text."""
    engine.register(t.spark)
    t.license_patterns.createOrReplaceTempView("tessellum_patterns")
    return t.spark.sql("SELECT id, size(pattern_tokens(pattern)) AS words, pattern_in_text('copyright holder', pattern) AS names_holder FROM tessellum_patterns WHERE pattern IS NOT NULL AND NOT lower(pattern) LIKE '%$skip%'")


@query("LA41_pattern_in_text", rf"""SELECT s.id, contains(' ' || array_to_string({_WORDS.format('s.text')}, ' ') || ' ', ' ' || array_to_string({_WORDS.format('p.pattern')}, ' ') || ' ') AS matches FROM snippets s JOIN license_patterns p ON p.id = s.like_pattern WHERE s.text IS NOT NULL AND p.pattern IS NOT NULL AND NOT regexp_matches(p.pattern, '(?i)\$skip') AND len({_WORDS.format('p.pattern')}) > 0""")
def _(t: Tables) -> DataFrame:
    """Whether a snippet holds the pattern that it resembles, word by word."""

    @F.pandas_udf("boolean")
    def holds(pattern: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([phrase_match.pattern_in_text(p, x) for p, x in zip(pattern, text, strict=True)])

    p = t.license_patterns.where(F.col("pattern").rlike(r"[\p{L}\p{N}]") & ~F.col("pattern").rlike(r"(?i)\$skip")).select(F.col("id").alias("like_pattern"), "pattern")
    return t.snippets.where("text is not null").select("id", "text", "like_pattern").join(shuffled(p), "like_pattern").select("id", holds("pattern", "text").alias("matches"))


def upserted(existing: DataFrame, batch: DataFrame, keys: list[str], count: str = "hits") -> DataFrame:
    """existing after a batch: counts of known keys add up, new keys are inserted."""
    return existing.select(*keys, count).union(batch.select(*keys, count)).groupBy(*keys).agg(F.sum(count).alias(count))


@query("SNK02_upserted_urls", r"""SELECT package_name, host, count(*) AS hits FROM (SELECT package_name, unnest(regexp_extract_all(text, 'https?://([^/\s,;)>\x22''`]+)', 1)) AS host FROM documents WHERE created IS NOT NULL) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    """Hosts of the documents of one batch added to those of the batches before; batches split at the middle of 2024."""
    rows = t.documents.where("created is not null").select("package_name", (F.col("created") < F.lit("2024-07-01").cast("timestamp_ntz")).alias("old"), F.explode(F.regexp_extract_all("text", F.lit("https?://([^/\\s,;)>\"'`]+)"), F.lit(1))).alias("host"))
    counts = lambda part: part.groupBy("package_name", "host").agg(F.count("*").alias("hits"))
    return upserted(counts(rows.where("old")), counts(rows.where("NOT old")), ["package_name", "host"])


@query("Q04_search_by_component", "SELECT b.id, b.name FROM bot_packages b WHERE NOT b.obsolete AND EXISTS (SELECT 1 FROM package_components c WHERE c.package = b.id AND c.generation = 0 AND c.purl ILIKE '%npm/%a%')")
def _(t: Tables) -> DataFrame:
    hit = t.package_components.where("generation = 0").where(F.col("purl").ilike("%npm/%a%")).select(F.col("package").alias("id")).distinct()
    return t.bot_packages.where(~F.col("obsolete")).select("id", "name").join(shuffled(hit), "id", "left_semi")


@query("Q04_search_by_ignored", "SELECT b.id, b.name, count(*) AS ignored FROM bot_packages b JOIN pattern_matches m ON m.package = b.id AND m.ignored AND m.generation = 0 WHERE NOT b.obsolete GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    counts = t.pattern_matches.where("ignored AND generation = 0").groupBy(F.col("package").alias("id")).agg(F.count("*").alias("ignored"))
    return t.bot_packages.where(~F.col("obsolete")).select("id", "name").join(shuffled(counts), "id")


@query("Q04_search_by_name", "SELECT id, name, state, count(*) OVER () AS total FROM bot_packages WHERE NOT obsolete AND name ILIKE '%go%'")
def _(t: Tables) -> DataFrame:
    rows = t.bot_packages.where(~F.col("obsolete") & F.col("name").ilike("%go%")).select("id", "name", "state")
    return rows.crossJoin(rows.agg(F.count("*").alias("total")))  # a single count


@query("Q11_ignored_files", r"SELECT g.name AS pattern, count(f.id) AS files, count(DISTINCT f.package) AS packages FROM (VALUES ('*.md', '\.md$'), ('docs/*', '^docs/'), ('*/tests/*', '/tests/'), ('*.never', '\.never$')) g(name, r) LEFT JOIN matched_files f ON f.generation = 0 AND regexp_matches(f.filename, g.r) GROUP BY 1")
def _(t: Tables, globs: tuple[str, ...] = ("*.md", "docs/*", "*/tests/*", "*.never")) -> DataFrame:
    """How many live files each ignored glob takes out. The globs are tested on each file, which is read once."""
    hits = F.filter(F.array(*[F.when(F.col("filename").rlike(glob_regex(g)), F.lit(g)) for g in globs]), lambda g: g.isNotNull())
    counts = t.matched_files.where("generation = 0").select("id", "package", F.explode(hits).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("files"), F.countDistinct("package").alias("packages"))
    return t.spark.createDataFrame([(g,) for g in globs], "pattern string").join(counts, "pattern", "left").na.fill(0, ["files", "packages"])


@query("Q15_full_texts", r"SELECT license, max_by(pattern, (length(pattern), -id)) AS text FROM license_patterns WHERE license <> '' AND NOT regexp_matches(pattern, '(?i)\$skip') GROUP BY license")
def _(t: Tables) -> DataFrame:
    named = t.license_patterns.where("license <> ''").where(~F.col("pattern").rlike(r"(?i)\$skip"))
    return named.groupBy("license").agg(F.max_by("pattern", F.struct(F.length("pattern"), -F.col("id"))).alias("text"))


@query("Q16_backfilled_identifiers", "SELECT p.id, l.license_id AS spdx FROM license_patterns p JOIN license_list l ON lower(trim(p.license)) = lower(l.license_id) WHERE coalesce(p.spdx, '') = ''")
def _(t: Tables) -> DataFrame:
    """Patterns without an identifier whose license is a listed one."""
    listed = t.license_list.select(F.lower("license_id").alias("key"), F.col("license_id").alias("spdx"))
    missing = t.license_patterns.where("coalesce(spdx, '') = ''").select("id", F.lower(F.trim("license")).alias("key"))
    return missing.join(F.broadcast(listed), "key").select("id", "spdx")  # the list has a fixed size


@query("Q17_pending_by_likelyness", "SELECT id, likelyness FROM snippets WHERE NOT approved ORDER BY likelyness DESC NULLS LAST, id LIMIT 50")
def _(t: Tables, limit: int = 50) -> DataFrame:
    return t.snippets.where(~F.col("approved")).select("id", "likelyness").orderBy(F.desc_nulls_last("likelyness"), "id").limit(limit)  # the page


@query("Q17_pending_by_files", "SELECT s.id, count(DISTINCT o.file) AS files FROM snippets s JOIN file_snippets o ON o.snippet = s.id AND o.generation = 0 WHERE NOT s.approved GROUP BY 1 ORDER BY files DESC, s.id LIMIT 50")
def _(t: Tables, limit: int = 50) -> DataFrame:
    pending = t.snippets.where(~F.col("approved")).select(F.col("id").alias("snippet"))
    counts = t.file_snippets.where("generation = 0").groupBy("snippet").agg(F.countDistinct("file").alias("files"))
    return counts.join(shuffled(pending), "snippet", "left_semi").select(F.col("snippet").alias("id"), "files").orderBy(F.desc("files"), "id").limit(limit)  # the page


@query("SNK06_notice_text", r"""WITH p AS (SELECT id, coalesce(nullif(spdx, ''), license) AS license FROM license_patterns WHERE NOT catch_all AND coalesce(nullif(spdx, ''), license) <> ''), u AS (SELECT DISTINCT m.package, p.license, f.filename FROM pattern_matches m JOIN p ON p.id = m.pattern JOIN matched_files f ON f.id = m.file AND f.generation = 0 AND f.filename IS NOT NULL WHERE m.generation = 0 AND NOT m.ignored),
  l AS (SELECT DISTINCT u.package, u.license, t.title FROM u LEFT JOIN license_list t ON t.license_id = u.license), g AS (SELECT package, count(*) FILTER (WHERE title IS NULL) AS gaps, count(*) AS licenses FROM l GROUP BY 1)
  SELECT package, 0 AS part, '' AS license, '' AS item, 'Terms are at hand for ' || (licenses - gaps) || ' of ' || licenses || ' licenses' AS line FROM g
  UNION ALL SELECT package, 1, license, '', 'License: ' || license FROM l UNION ALL SELECT package, 2, license, filename, '  in ' || filename FROM u UNION ALL SELECT package, 3, license, '', coalesce(title, 'no terms at hand') FROM l""")
def _(t: Tables) -> DataFrame:
    """The lines of each package's notice: what is complete, then per license its files and its terms or the gap. Ordered by
    (package, license, part, item) they are the text; rows can be written in parts."""
    p = t.license_patterns.where(~F.col("catch_all")).select(F.col("id").alias("pattern"), F.coalesce(F.nullif("spdx", F.lit("")), "license").alias("license")).where("license <> ''")
    f = t.matched_files.where("generation = 0 AND filename IS NOT NULL").select(F.col("id").alias("file"), "filename")
    used = t.pattern_matches.where("generation = 0 AND NOT ignored").select("package", "file", "pattern").join(p, "pattern").join(shuffled(f), "file").select("package", "license", "filename").distinct()
    terms = used.select("package", "license").distinct().join(F.broadcast(t.license_list.select(F.col("license_id").alias("license"), "title")), "license", "left")  # the list has a fixed size
    found = F.count("title").cast("string")
    row = lambda rows, part, item, line, name=None: rows.select("package", F.lit(part).alias("part"), (F.col("license") if name is None else F.lit(name)).alias("license"), item.alias("item"), line.alias("line"))
    none = F.lit("")
    head = terms.groupBy("package").agg(F.concat(F.lit("Terms are at hand for "), found, F.lit(" of "), F.count("*").cast("string"), F.lit(" licenses")).alias("text"))
    out = row(head, 0, none, F.col("text"), "").union(row(terms, 1, none, F.concat(F.lit("License: "), "license")))
    return out.union(row(used, 2, F.col("filename"), F.concat(F.lit("  in "), "filename"))).union(row(terms, 3, none, F.coalesce("title", F.lit("no terms at hand"))))


@query("SNK10_report_lines", """SELECT m.package, p.risk, 'Risk ' || p.risk || ': ' || p.license || ' (' || count(DISTINCT m.file) || ' files)' AS line FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern WHERE m.generation = 0 AND NOT m.ignored AND coalesce(p.license, '') <> '' GROUP BY m.package, p.risk, p.license""")
def _(t: Tables) -> DataFrame:
    """The lines of the plain-text report."""
    p = t.license_patterns.where("coalesce(license, '') <> ''").select(F.col("id").alias("pattern"), "risk", "license")
    rows = t.pattern_matches.where("generation = 0 AND NOT ignored").join(p, "pattern").groupBy("package", "risk", "license").agg(F.countDistinct("file").alias("files"))
    return rows.select("package", "risk", F.concat(F.lit("Risk "), F.col("risk").cast("string"), F.lit(": "), "license", F.lit(" ("), F.col("files").cast("string"), F.lit(" files)")).alias("line"))
