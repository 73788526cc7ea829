"""Scalar functions over dates, numbers, arrays, JSON, hashes and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions import paths
from tessellum.functions.risk import clamp_priority, estimated_risk, percent
from tessellum.plans import path_sql
from tessellum.plans.catalog import NOW, Tables, query

_NOW = f"TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}'"


@query("SC01_epoch", "SELECT id, epoch_us(created) / 1000000.0 AS epoch FROM bot_packages")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.select("id", (F.unix_micros(F.col("created").cast("timestamp")) / 1000000.0).alias("epoch"))


@query("SC02_truncated", "SELECT id, date_trunc('hour', created) AS hour, CAST(date_trunc('day', created) AS TIMESTAMP) AS day FROM bot_packages")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.select("id", F.date_trunc("hour", "created").cast("timestamp_ntz").alias("hour"), F.date_trunc("day", "created").cast("timestamp_ntz").alias("day"))


@query("SC03_labels", "SELECT id, strftime(created, '%H:00') AS hour, strftime(created, '%a') AS day FROM bot_packages")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.select("id", F.date_format("created", "HH:00").alias("hour"), F.date_format("created", "E").alias("day"))


@query("SC04_series", f"SELECT CAST(hour AS TIMESTAMP) AS hour FROM (SELECT unnest(generate_series({_NOW} - INTERVAL 23 HOUR, {_NOW}, INTERVAL 1 HOUR)) AS hour)")
def _(t: Tables) -> DataFrame:
    now = f"timestamp_ntz'{NOW:%Y-%m-%d %H:%M:%S}'"
    return t.spark.sql(f"SELECT explode(sequence({now} - interval 23 hours, {now}, interval 1 hour)) AS hour")


@query("SC06_estimated_risk", "SELECT s.id, CASE WHEN s.likelyness < 0.9 AND floor(p.risk * s.likelyness + 9 * (1 - s.likelyness) + 0.5) <= 4 THEN 5 ELSE CAST(floor(p.risk * s.likelyness + 9 * (1 - s.likelyness) + 0.5) AS INT) END AS risk FROM snippets s JOIN license_patterns p ON p.id = s.like_pattern WHERE s.likelyness IS NOT NULL")
def _(t: Tables) -> DataFrame:
    p = t.license_patterns.select(F.col("id").alias("like_pattern"), "risk")
    return t.snippets.where("likelyness is not null").join(p, "like_pattern").select(F.col("id"), estimated_risk(F.col("risk"), F.col("likelyness")).alias("risk"))


@query("SC07_percent", "SELECT id, CAST(floor(m * 1000 + 0.5) / 10.0 AS DOUBLE) AS one, CAST(floor(m * 100 + 0.5) AS BIGINT) AS rounded, CAST(floor(m * 100) AS BIGINT) AS cut FROM (SELECT id, CAST(likelyness AS DOUBLE) AS m FROM snippets WHERE likelyness IS NOT NULL)")
def _(t: Tables) -> DataFrame:
    m = F.col("likelyness").cast("double")
    return t.snippets.where(m.isNotNull()).select("id", percent(m).alias("one"), F.floor(m * 100 + F.lit(0.5)).alias("rounded"), F.floor(m * 100).alias("cut"))


@query("SC08_priority", "SELECT id, 60 + greatest(1, least(10, coalesce(priority, 5))) - 5 AS job_priority FROM bot_packages")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.select("id", (F.lit(60) + clamp_priority(F.col("priority")) - 5).alias("job_priority"))


@query("SC09_greatest", "SELECT id, greatest(coalesce(unresolved_matches, 0), priority) AS most FROM bot_packages")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.select("id", F.greatest(F.coalesce("unresolved_matches", F.lit(0)), "priority").alias("most"))


@query("SC10_spdx_or_license", "SELECT id, coalesce(nullif(spdx, ''), license) AS expression FROM license_patterns")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.select("id", F.coalesce(F.nullif("spdx", F.lit("")), "license").alias("expression"))


@query("SC11_exact_rank", "SELECT license_id, CASE WHEN lower(license_id) IN (lower('Foxglade'), 'kestrigan') THEN 0 ELSE 1 END AS rank FROM license_list")
def _(t: Tables) -> DataFrame:
    return t.license_list.select("license_id", F.when(F.lower("license_id").isin("foxglade", "kestrigan"), 0).otherwise(1).alias("rank"))


@query("SC12_array_edits", "SELECT license_id, len(list_concat(aliases, ['x'])) AS grown, len([a FOR a IN aliases IF a <> aliases[1]]) AS fewer FROM license_list WHERE len(aliases) > 0")
def _(t: Tables) -> DataFrame:
    rows = t.license_list.where(F.size("aliases") > 0)
    return rows.select("license_id", F.size(F.concat("aliases", F.array(F.lit("x")))).cast("long").alias("grown"), F.size(F.array_remove("aliases", F.col("aliases")[0])).cast("long").alias("fewer"))


@query("SC13_json_field", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"))


@query("SC14_json_search", "SELECT event_id FROM events WHERE CAST(props AS VARCHAR) ILIKE '%1%'")
def _(t: Tables) -> DataFrame:
    return t.events.where(F.col("props").ilike("%1%")).select("event_id")


@query("SC15_md5", "SELECT id, md5(purl) AS identity FROM package_components")
def _(t: Tables) -> DataFrame:
    return t.package_components.select("id", F.md5("purl").alias("identity"))


@query("SC17_sha512")
def _(t: Tables) -> DataFrame:
    return t.snippets.where("text is not null").select("id", F.sha2("text", 512).alias("digest"))


@query("SC18_short_name", """WITH r AS (SELECT m.package, p.risk, coalesce(nullif(p.spdx, ''), p.license) AS name FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern WHERE m.generation = 0 AND NOT m.ignored AND coalesce(p.license, '') <> ''),
  k AS (SELECT package, max(risk) AS risk FROM r GROUP BY package) SELECT b.id, coalesce(min(r.name), 'Unknown') || '-' || coalesce(k.risk, 0) || ':' || substr(md5(coalesce(b.checksum, '')), 1, 4) AS short
  FROM bot_packages b LEFT JOIN k ON k.package = b.id LEFT JOIN r ON r.package = b.id AND r.risk = k.risk GROUP BY b.id, k.risk, b.checksum""")
def _(t: Tables) -> DataFrame:
    """The license and risk that stand out in a package's live report, and four digits of its checksum in place of random ones."""
    p = t.license_patterns.where("coalesce(license, '') <> ''").select(F.col("id").alias("pattern"), "risk", F.coalesce(F.nullif("spdx", F.lit("")), "license").alias("name"))
    live = t.pattern_matches.where("generation = 0 AND NOT ignored").join(p, "pattern")
    worst = live.groupBy(F.col("package").alias("id")).agg(F.min(F.struct((-F.col("risk")).alias("less"), "name")).alias("w"))
    rows = t.bot_packages.select("id", "checksum").join(worst, "id", "left")
    return rows.select("id", F.concat(F.coalesce("w.name", F.lit("Unknown")), F.lit("-"), F.coalesce(-F.col("w.less"), F.lit(0)), F.lit(":"), F.substring(F.md5(F.coalesce("checksum", F.lit(""))), 1, 4)).alias("short"))


@query("SC19_report_checksum", """WITH l AS (SELECT DISTINCT m.package, 'LIC:' || p.license AS line FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern WHERE m.generation = 0 AND NOT m.ignored AND p.risk <> 0 AND p.license IS NOT NULL),
  s AS (SELECT DISTINCT o.package, 'SNIPPET:' || s.hash AS line FROM file_snippets o JOIN snippets s ON s.id = o.snippet WHERE o.generation = 0 AND o.resolution IS NULL AND s.hash IS NOT NULL)
  SELECT package, md5(string_agg(line, chr(10) ORDER BY line)) AS checksum FROM (SELECT * FROM l UNION SELECT * FROM s) GROUP BY package""")
def _(t: Tables) -> DataFrame:
    p = t.license_patterns.where("risk <> 0 AND license IS NOT NULL").select(F.col("id").alias("pattern"), F.concat(F.lit("LIC:"), "license").alias("line"))
    s = t.snippets.where("hash is not null").select(F.col("id").alias("snippet"), F.concat(F.lit("SNIPPET:"), "hash").alias("line"))
    lines = t.pattern_matches.where("generation = 0 AND NOT ignored").join(p, "pattern").select("package", "line").union(t.file_snippets.where("generation = 0 AND resolution IS NULL").join(s, "snippet").select("package", "line"))
    # one package's report lines: bounded by the catalogue and the package's own snippets
    return lines.distinct().groupBy("package").agg(F.md5(F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("checksum"))


def human_size(size: Column) -> Column:
    """Bytes in B, KiB, MiB or GiB with one decimal."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit("B")))
    for unit, power in (("KiB", 1), ("MiB", 2)):
        out = out.when(size < 1024 ** (power + 1), F.concat(F.round(size / float(1024**power), 1).cast("string"), F.lit(unit)))
    return out.otherwise(F.concat(F.round(size / float(1024**3), 1).cast("string"), F.lit("GiB")))


@query("SC20_human_size", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || 'B' WHEN n_chars < 1048576 THEN CAST(round(CAST(n_chars AS DOUBLE) / 1024, 1) AS VARCHAR) || 'KiB' ELSE CAST(round(CAST(n_chars AS DOUBLE) / 1048576, 1) AS VARCHAR) || 'MiB' END AS size FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", human_size(F.col("n_chars")).alias("size"))


# What a file is for, by its MIME type; the first that fits.
PURPOSES = (
    ("archive", r"zip|tar|gzip|compress|x-xz|bzip|7z|x-rpm"), ("executable", r"^application/x-(?:executable|sharedlib|pie-executable|elf)|^(?:text|application)/x-(?:perl|python|shellscript|sh)"),
    ("documentation", r"^text/html|pdf"), ("source", r"^text/|^application/(?:javascript|json|xml)"),
)
_PURPOSES = " ".join(f"WHEN regexp_matches(mimetype, '{form}') THEN '{name}'" for name, form in PURPOSES)


@query("SC20_file_purpose", f"SELECT id, CASE {_PURPOSES} ELSE 'file' END AS purpose FROM matched_files")
def _(t: Tables) -> DataFrame:
    purpose = F
    for name, form in PURPOSES:
        purpose = purpose.when(F.col("mimetype").rlike(form), name)
    return t.matched_files.select("id", purpose.otherwise("file").alias("purpose"))


@query("SC21_catch_all_name", r"SELECT id, coalesce(regexp_matches(license, '(^|[\s(])Any |-Unspecified([\s)]|$)'), false) AS catch_all FROM license_patterns")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.select("id", F.coalesce(F.col("license").rlike(r"(?:^|[\s(])Any |-Unspecified(?:[\s)]|$)"), F.lit(False)).alias("catch_all"))


#: What a deployment says of its links: form, address with \1 for what the form captures, label. The first that fits counts.
LINKS = ((r"^req#(\d+)$", r"https://requests.example/show/\1", "request"), (r"^git#(\d+)$", r"https://git.example/commit/\1", "commit"))


@query("SC22_external_link", r"""SELECT id, CASE WHEN regexp_matches(external_link, '^req#\d+$') THEN CAST(substr(external_link, 5) AS BIGINT) END AS request,
  CASE WHEN regexp_matches(external_link, '^req#\d+$') THEN 'https://requests.example/show/' || substr(external_link, 5) WHEN regexp_matches(external_link, '^git#\d+$') THEN 'https://git.example/commit/' || substr(external_link, 5) END AS url,
  CASE WHEN regexp_matches(external_link, '^req#\d+$') THEN 'request' WHEN regexp_matches(external_link, '^git#\d+$') THEN 'commit' END AS label FROM bot_packages WHERE external_link IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    """The request of a link, and its address and label by the configured forms; none where no form fits."""
    link = F.col("external_link")
    url, label = F, F
    for form, address, name in LINKS:
        url, label = url.when(link.rlike(form), F.regexp_replace(link, form, address.replace("\\1", "$1"))), label.when(link.rlike(form), name)
    request = F.when(link.rlike(LINKS[0][0]), F.regexp_extract(link, LINKS[0][0], 1).cast("long"))
    return t.bot_packages.where("external_link is not null").select("id", request.alias("request"), url.alias("url"), label.alias("label"))


@query("SC16_content_hashes", r"""SELECT id, md5(array_to_string([CASE WHEN regexp_matches(x, '^\$skip') THEN '$' ELSE x END FOR x IN regexp_extract_all(lower(pattern), '\$skip\d*|[\p{L}\p{N}]+')], ' ')) AS tokens, md5(pattern || chr(10)) AS lines FROM license_patterns WHERE pattern IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    """Two 128-bit hashes of a pattern: of its tokens, with all gaps alike, and of its lines as they stand."""
    tokens = F.transform(F.regexp_extract_all(F.lower("pattern"), F.lit(r"\$skip\d*|[\p{L}\p{N}]+"), F.lit(0)), lambda x: F.when(x.startswith("$skip"), "$").otherwise(x))
    return t.license_patterns.where("pattern is not null").select("id", F.md5(F.array_join(tokens, " ")).alias("tokens"), F.md5(F.concat("pattern", F.lit("\n"))).alias("lines"))


@query("SC05_sliding_cutoffs", f"SELECT id, created > {_NOW} - INTERVAL 30 DAY AS month, created > {_NOW} - INTERVAL 1 YEAR AS year FROM bot_packages")
def _(t: Tables) -> DataFrame:
    """Whether a package is younger than a month and a year, from a present that is given."""
    now = f"timestamp_ntz'{NOW:%Y-%m-%d %H:%M:%S}'"
    return t.bot_packages.select("id", (F.col("created") > F.expr(f"{now} - interval 30 days")).alias("month"), (F.col("created") > F.expr(f"{now} - interval 1 year")).alias("year"))


@query("SC28_capped_flags", "SELECT pattern, least(count(*), 20) AS shown, count(*) > 20 AS more, greatest(count(DISTINCT package), 1) AS packages FROM pattern_matches GROUP BY pattern")
def _(t: Tables, most: int = 20) -> DataFrame:
    counts = t.pattern_matches.groupBy("pattern").agg(F.count("*").alias("n"), F.countDistinct("package").alias("p"))
    return counts.select("pattern", F.least("n", F.lit(most).cast("long")).alias("shown"), (F.col("n") > most).alias("more"), F.greatest("p", F.lit(1).cast("long")).alias("packages"))


@query("SC23_valid_tags", "SELECT license_id, [trim(a) FOR a IN aliases IF length(trim(a)) BETWEEN 1 AND 32][1:16] AS tags FROM license_list WHERE len(aliases) > 0")
def _(t: Tables) -> DataFrame:
    kept = F.filter(F.transform("aliases", lambda a: F.trim(a)), lambda a: F.length(a).between(1, 32))
    return t.license_list.where(F.size("aliases") > 0).select("license_id", F.slice(F.array_distinct(kept), 1, 16).alias("tags"))


@query("SC24_ancestors", "WITH p AS (SELECT id, string_split(filename, '/') AS s FROM matched_files) SELECT id, '' AS dir, 0 AS depth FROM p UNION ALL SELECT id, array_to_string(s[1:n], '/') AS dir, CAST(n AS INT) AS depth FROM (SELECT id, s, unnest(generate_series(1, len(s) - 1)) AS n FROM p)")
def _(t: Tables) -> DataFrame:
    return t.matched_files.select("id", F.posexplode(paths.ancestors(F.col("filename"))).alias("depth", "dir"))


@query("SC25_peripheral", f"SELECT id, {path_sql.kind('filename')} AS kind, {path_sql.tier('filename')} AS tier FROM matched_files")
def _(t: Tables) -> DataFrame:
    return t.matched_files.select("id", paths.peripheral_kind(F.col("filename")).alias("kind"), paths.tier(F.col("filename")).alias("tier"))


@query("SC26_license_filename", f"SELECT id, {path_sql.license_file('filename')} AS license_file FROM matched_files")
def _(t: Tables) -> DataFrame:
    return t.matched_files.select("id", paths.is_license_filename(F.col("filename")).alias("license_file"))


def purl(kind: Column, name: Column, version: Column) -> Column:
    """The package URL of a component: an @ in front of a scope is escaped, Python names are normalized, groups become paths."""
    plain = F.when(kind == "pypi", F.regexp_replace(F.lower(name), "[-_.]+", "-")).when(kind == "maven", F.regexp_replace(name, ":", "/")).otherwise(F.regexp_replace(name, "^@", "%40"))
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), plain, F.when(version.isNotNull(), F.concat(F.lit("@"), version)).otherwise(F.lit("")))


@query("SC27_purl", "SELECT id, 'pkg:' || type || '/' || CASE WHEN type = 'pypi' THEN regexp_replace(lower(trim(name)), '[-_.]+', '-', 'g') WHEN type = 'maven' THEN replace(trim(name), ':', '/') ELSE regexp_replace(trim(name), '^@', '%40') END || coalesce('@' || version, '') AS built FROM package_components WHERE trim(name) <> ''")
def _(t: Tables) -> DataFrame:
    return t.package_components.where("trim(name) <> ''").select("id", purl(F.col("type"), F.trim("name"), F.col("version")).alias("built"))


@query("SC30_state_precedence", "SELECT name, CASE WHEN bool_or(state = 'unacceptable') THEN 'unacceptable' WHEN bool_or(state = 'acceptable_by_lawyer') THEN 'acceptable_by_lawyer' WHEN bool_or(state = 'acceptable') THEN 'acceptable' ELSE 'none' END AS state FROM bot_packages GROUP BY name")
def _(t: Tables) -> DataFrame:
    has = lambda s: F.bool_or(F.col("state") == s)
    return t.bot_packages.groupBy("name").agg(F.when(has("unacceptable"), "unacceptable").when(has("acceptable_by_lawyer"), "acceptable_by_lawyer").when(has("acceptable"), "acceptable").otherwise("none").alias("state"))
