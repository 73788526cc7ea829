"""Imports, upserts and exports, as the tables that they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions import legal_text, spec_macros
from tessellum.plans.catalog import Tables, query
from tessellum.plans.text import _URLS
from tessellum.session import shuffled

_BLACKLIST = r"^(?:audio|image|video)/|octet-stream|x-executable|x-sharedlib"
#: A character that the end of a cut text breaks off, byte by byte.
_PARTIAL_UTF8 = r"(?:[\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]?|[\xf0-\xf4][\x80-\xbf]{0,2})\z"


@query("SRC01_unpacked_files", f"SELECT id, package, filename, (row_number() OVER (PARTITION BY package ORDER BY filename, id) - 1) // 600 AS bucket FROM matched_files WHERE NOT coalesce(regexp_matches(mimetype, '{_BLACKLIST}'), false) AND NOT contains(filename, '.report.')")
def _(t: Tables, size: int = 600) -> DataFrame:
    """The files to be matched, in buckets of so many in the order of their paths."""
    rows = t.matched_files.where(~F.coalesce(F.col("mimetype").rlike(_BLACKLIST), F.lit(False)) & ~F.contains("filename", F.lit(".report."))).select("id", "package", "filename")
    place = F.row_number().over(Window.partitionBy("package").orderBy("filename", "id")) - 1
    return rows.withColumn("place", place).select("id", "package", "filename", F.expr(f"place div {size}").alias("bucket"))


@query("SRC02_file_stats", "SELECT package_name, count(*) AS files, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM documents GROUP BY package_name")
def _(t: Tables) -> DataFrame:
    return t.documents.groupBy("package_name").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0).cast("long")).alias("bytes"))


@query("SRC03_decoded_head", "SELECT doc_id, CASE WHEN strlen(text) <= 30000 THEN text ELSE substr(text, 1, list_max([n FOR n IN generate_series(7500, 30000) IF strlen(substr(text, 1, n)) <= 30000])) END AS head FROM documents")
def _(t: Tables, most: int = 30_000) -> DataFrame:
    """The first bytes of a file without a character that they cut, strict UTF-8 or else Latin-1."""
    latin = F.decode(F.substring(F.col("text").cast("binary"), 1, most), "ISO-8859-1")  # a character per byte
    whole = F.regexp_replace(latin, _PARTIAL_UTF8, "")
    return t.documents.select("doc_id", F.coalesce(F.try_validate_utf8(F.encode(whole, "ISO-8859-1").cast("string")), whole).alias("head"))


@query("SRC04_lines", "SELECT doc_id, n AS line, printf('%6d  ', n) || substr(lines[n], 1, 8000) AS numbered FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))")
def _(t: Tables, first: int = 1, last: int | None = None) -> DataFrame:
    """Numbered lines from the first to the last of a range, or to the end."""
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    rows = rows.withColumn("line", (F.col("at") + 1).cast("long")).where(F.col("line") >= first)
    rows = rows if last is None else rows.where(F.col("line") <= last)
    return rows.select("doc_id", "line", F.concat(F.format_string("%6d  ", "line"), F.substring("text", 1, 8000)).alias("numbered"))


@query("SRC07_uploads", "SELECT name, checkout_dir, min(id) AS id FROM bot_packages GROUP BY name, checkout_dir")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.groupBy("name", "checkout_dir").agg(F.min("id").alias("id"))


def imported_patterns(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """The incoming patterns whose token checksum is neither known nor that of an earlier one among them; null checksums are none."""
    first = incoming.where("token_hexsum is not null").groupBy("token_hexsum").agg(F.min("id").alias("id"))
    return first.join(shuffled(existing.select("token_hexsum").distinct()), "token_hexsum", "left_anti")


@query("SRC09_new_patterns", "SELECT min(id) AS id, token_hexsum FROM license_patterns n WHERE created >= TIMESTAMP '2024-01-01' AND token_hexsum IS NOT NULL AND NOT EXISTS (SELECT 1 FROM license_patterns o WHERE o.created < TIMESTAMP '2024-01-01' AND o.token_hexsum = n.token_hexsum) GROUP BY token_hexsum")
def _(t: Tables, since: str = "2024-01-01") -> DataFrame:
    """What an import brings: the catalogue after a day against the one before it."""
    day = F.lit(since).cast("timestamp_ntz")
    return imported_patterns(t.license_patterns.where(F.col("created") >= day), t.license_patterns.where(F.col("created") < day)).select("id", "token_hexsum")


@query("SRC10_labels", "WITH l AS (SELECT lower(hash) AS h, bool_or(license IS NOT NULL) AS good FROM snippets WHERE approved AND hash IS NOT NULL GROUP BY 1) SELECT s.id, l.good FROM snippets s JOIN l ON l.h = lower(s.hash) WHERE NOT s.approved")
def _(t: Tables) -> DataFrame:
    """Labels brought in by hash, for snippets that nobody has approved; here those of the approved ones."""
    labels = t.snippets.where("approved AND hash IS NOT NULL").groupBy(F.lower("hash").alias("h")).agg(F.bool_or(F.col("license").isNotNull()).alias("good"))
    return t.snippets.where("NOT approved").select("id", F.lower("hash").alias("h")).join(shuffled(labels), "h").select("id", "good")


@query("SRC11_spec_fields", r"SELECT doc_id, regexp_extract(text, '(?m)^License:\s*(.+)$', 1) AS license, regexp_extract(text, '(?m)^Version:\s*(.+)$', 1) AS version, len(regexp_extract_all(text, '(?m)^BuildRequires:')) AS requires FROM documents WHERE source = 'spec_file' AND text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    spec = t.documents.where("source = 'spec_file' AND text IS NOT NULL")
    return spec.select("doc_id", F.regexp_extract("text", r"(?m)^License:\s*(.+)$", 1).alias("license"), F.regexp_extract("text", r"(?m)^Version:\s*(.+)$", 1).alias("version"), F.size(F.regexp_extract_all("text", F.lit(r"(?m)^BuildRequires:"), F.lit(0))).cast("long").alias("requires"))


@query("SRC13_expanded_macros")
def _(t: Tables) -> DataFrame:
    spec = t.documents.where("source = 'spec_file' AND text IS NOT NULL")
    return spec.select("doc_id", spec_macros.expanded(F.col("text")).alias("expanded"))


def promoted(rows: DataFrame, builds: DataFrame) -> DataFrame:
    """rows after the given builds (package, build) went live: their rows become generation 0 in place of the package's older
    ones, every other row stays as it is, other unfinished builds too."""
    marked = rows.join(shuffled(builds), "package", "left")
    return marked.where("build IS NULL OR generation <> 0").withColumn("generation", F.when(F.col("generation") == F.col("build"), 0).otherwise(F.col("generation"))).drop("build")


@query("SNK01_promoted_build", """WITH g AS (SELECT m.package, max(m.generation) AS build FROM pattern_matches m JOIN bot_packages b ON b.id = m.package WHERE m.generation <> 0 AND b.indexed IS NOT NULL GROUP BY 1)
  SELECT m.id, m.package, 0 AS generation FROM pattern_matches m LEFT JOIN g ON g.package = m.package WHERE CASE WHEN g.build IS NULL THEN m.generation = 0 ELSE m.generation = g.build END
  UNION ALL SELECT m.id, m.package, m.generation FROM pattern_matches m LEFT JOIN g ON g.package = m.package WHERE m.generation <> 0 AND m.generation IS DISTINCT FROM g.build""")
def _(t: Tables) -> DataFrame:
    """The newest build of each package whose indexing ended is promoted; builds that are still being made stay hidden."""
    done = t.bot_packages.where("indexed is not null").select(F.col("id").alias("package"))
    builds = t.pattern_matches.where("generation <> 0").join(shuffled(done), "package", "left_semi").groupBy("package").agg(F.max("generation").alias("build"))
    return promoted(t.pattern_matches.select("id", "package", "generation"), builds).select("id", "package", "generation")


@query("SNK02_merged_urls", f"SELECT package_name, url, count(*) AS hits FROM (SELECT package_name, unnest({_URLS}) AS url FROM documents) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.documents.select("package_name", F.explode(legal_text.urls(F.col("text"))).alias("url")).groupBy("package_name", "url").agg(F.count("*").alias("hits"))


@query("SNK03_merged_files", "SELECT pattern, package, list_sort(list(DISTINCT file)) AS files FROM pattern_matches WHERE generation = 0 GROUP BY pattern, package")
def _(t: Tables) -> DataFrame:
    return t.pattern_matches.where("generation = 0").groupBy("pattern", "package").agg(F.array_sort(F.collect_set("file")).alias("files"))


@query("SNK04_merged_components", "SELECT package, purl, min_by(license, id) FILTER (WHERE license IS NOT NULL) AS license FROM package_components WHERE generation = 0 GROUP BY package, purl")
def _(t: Tables) -> DataFrame:
    first = F.min(F.when(F.col("license").isNotNull(), F.struct("id", "license")))
    return t.package_components.where("generation = 0").groupBy("package", "purl").agg(first.alias("m")).select("package", "purl", "m.license")


@query("SNK05_sbom_elements", "SELECT id, CAST(json_object('type', 'software_Package', 'spdxId', 'pkg-' || id, 'name', name, 'purl', purl) AS VARCHAR) AS element FROM package_components WHERE generation = 0 AND trim(name) <> ''")
def _(t: Tables) -> DataFrame:
    element = F.to_json(F.struct(F.lit("software_Package").alias("type"), F.concat(F.lit("pkg-"), "id").alias("spdxId"), "name", "purl"))
    return t.package_components.where("generation = 0 AND trim(name) <> ''").select("id", element.alias("element"))


@query("SNK06_notice_lines", "SELECT coalesce(nullif(p.spdx, ''), p.license) AS license, string_agg(DISTINCT f.filename, chr(10) ORDER BY f.filename) AS files FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern JOIN matched_files f ON f.id = m.file AND f.generation = 0 WHERE m.generation = 0 AND NOT m.ignored AND NOT p.catch_all AND coalesce(nullif(p.spdx, ''), p.license) <> '' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """The files of every license in the live reports, whatever its risk; catch-alls name no license."""
    name = F.coalesce(F.nullif("spdx", F.lit("")), "license")
    p = t.license_patterns.where(~F.col("catch_all")).select(F.col("id").alias("pattern"), name.alias("license")).where("license <> ''")
    f = t.matched_files.where("generation = 0").select(F.col("id").alias("file"), "filename")
    rows = t.pattern_matches.where("generation = 0 AND NOT ignored").join(p, "pattern").join(f, "file").select("license", "filename").distinct()
    return rows.groupBy("license").agg(F.array_join(F.array_sort(F.collect_list("filename")), "\n").alias("files"))


@query("SNK07_component_export", "SELECT CAST(json_object('package', b.name, 'type', c.type, 'name', c.name, 'version', c.version) AS VARCHAR) AS line FROM package_components c JOIN bot_packages b ON b.id = c.package WHERE c.generation = 0 AND NOT b.embargoed AND NOT b.obsolete AND c.name IS NOT NULL AND c.version IS NOT NULL")
def _(t: Tables) -> DataFrame:
    b = t.bot_packages.where(~F.col("embargoed") & ~F.col("obsolete")).select(F.col("id").alias("p"), F.col("name").alias("owner"))
    c = t.package_components.where("generation = 0 AND name IS NOT NULL AND version IS NOT NULL")
    return c.join(b, F.col("package") == F.col("p")).select(F.to_json(F.struct(F.col("owner").alias("package"), "type", "name", "version")).alias("line"))


@query("SNK08_pattern_export", "SELECT unique_id, CAST(json_object('license', license, 'risk', risk) AS VARCHAR) AS line FROM license_patterns WHERE license IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.where("license is not null").select("unique_id", F.to_json(F.struct("license", "risk")).alias("line"))


@query("SNK09_training_export", r"SELECT CASE WHEN s.license IS NOT NULL THEN 'good' ELSE 'bad' END AS label, s.id, regexp_replace(s.text, '\$SKIP\d+', '', 'g') AS text FROM snippets s LEFT JOIN bot_packages b ON b.id = s.package WHERE s.approved AND NOT coalesce(b.embargoed, false)")
def _(t: Tables) -> DataFrame:
    b = t.bot_packages.select(F.col("id").alias("package"), "embargoed")
    rows = t.snippets.where("approved").join(b, "package", "left").where(~F.coalesce("embargoed", F.lit(False)))
    return rows.select(F.when(F.col("license").isNotNull(), "good").otherwise("bad").alias("label"), "id", F.regexp_replace("text", r"\$SKIP\d+", "").alias("text"))
