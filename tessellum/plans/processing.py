"""Preparation of files before they are matched: markup, long lines, spec files, services, exclusions, reference keys."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.functions import legal_text, markup, snippet_edit, spec_macros
from tessellum.functions.paths import glob_regex
from tessellum.operators.intervals import overlaps
from tessellum.plans.catalog import Tables, query
from tessellum.session import shuffled

_PIECES = f"""CASE WHEN length(line) < {markup.LIMIT} THEN [line] ELSE regexp_extract_all(line, '.{{{markup.LIMIT}}}[^{markup.LINE_END}]*[{markup.LINE_END[:-1]}]?|.+') END"""
_PROCESSED = f"""WITH l AS (SELECT doc_id, n, lines[n] AS line, list_max([length(x) FOR x IN lines]) AS longest FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
  p AS (SELECT doc_id, n, k, pieces[k] AS text FROM (SELECT *, unnest(generate_series(1, len(pieces))) AS k FROM (SELECT doc_id, n, CASE WHEN longest > {markup.TOO_LONG} THEN [line] ELSE {_PIECES} END AS pieces FROM l)))"""


@query("ST19_wrapped_lines", f"{_PROCESSED} SELECT doc_id, n AS original, k AS piece, text FROM p WHERE k > 1 OR length(text) >= {markup.LIMIT}")
def _(t: Tables) -> DataFrame:
    """The pieces of the lines that are too long."""
    lines = t.documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"), (F.array_max(F.transform(F.split("text", "\n"), F.length)) > markup.TOO_LONG).alias("kept"))
    cut = lines.select("doc_id", (F.col("at") + 1).cast("long").alias("original"), F.posexplode(F.when(F.col("kept"), F.array("line")).otherwise(markup.pieces(F.col("line")))).alias("piece", "text"))
    return cut.withColumn("piece", (F.col("piece") + 1).cast("long")).where((F.col("piece") > 1) | (F.length("text") >= markup.LIMIT))


@query("ST20_original_lines", f"{_PROCESSED} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS processed, n AS original FROM p")
def _(t: Tables) -> DataFrame:
    """For each line of the processed text the line of the original."""
    rows = t.documents.where("text is not null").select("doc_id", F.posexplode(markup.processed(F.col("text"))).alias("at", "p"))
    return rows.select("doc_id", (F.col("at") + 1).cast("long").alias("processed"), F.col("p.original").cast("long").alias("original"))


_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("ST18_stripped_markup", r"""WITH s AS (SELECT id, text, coalesce(license, 'none') AS license FROM snippets WHERE text IS NOT NULL AND regexp_matches(text, '[^\s\p{Z}]'))
  SELECT id, 1 AS n, CAST(3 + len(regexp_extract(text, '^[\s\p{Z}]*', 0)) - len(replace(regexp_extract(text, '^[\s\p{Z}]*', 0), chr(10), '')) AS INT) AS line, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS text FROM s
  UNION ALL SELECT id, 2, CAST(3 + len(text) - len(replace(text, chr(10), '')) AS INT), 'License: ' || license FROM s""")
def _(t: Tables) -> DataFrame:
    """Pages made of snippets, with a style, a script and a comment, read back: their text and comments with the lines that they stand
    on. The tables hold no markup."""
    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<!DOCTYPE html>\n<html><head><style>p { x: y }</style></head>\n<body><p>"), text, F.lit("</p><script>var license = 1;</script><!-- License: "), F.coalesce("license", F.lit("none")), F.lit(" --></body></html>"))
    pages = t.snippets.where(F.col("text").rlike(r"\S")).select("id", page.alias("page")).where(markup.looks_like_markup(F.lit("x"), F.col("page")))
    rows = pages.select("id", F.posexplode(markup.stripped(F.col("page"))).alias("at", "b"))
    return rows.select("id", (F.col("at") + 1).alias("n"), "b.line", "b.text")


@query("ST14_edited_snippets")
def _(t: Tables) -> DataFrame:
    """(occurrence, text, start, changed): each live snippet cut to its keywords, as a proposal for a pattern."""
    text = t.snippets.where("text is not null").select(F.col("id").alias("snippet"), "text")
    o = t.file_snippets.where("generation = 0 AND sline IS NOT NULL").select(F.col("id").alias("occurrence"), "file", "snippet", F.col("sline").alias("s"), F.col("eline").alias("e"))
    p = t.license_patterns.select(F.col("id").alias("pattern"), (F.coalesce("license", F.lit("")) != "").alias("licensed"))
    m = t.pattern_matches.where("generation = 0 AND NOT ignored").join(p, "pattern").select("file", "sline", "eline", "licensed")
    lines = overlaps(o.select("occurrence", "file", "s", "e"), m, "file", ("s", "e"), ("sline", "eline")).select("occurrence", "licensed", F.explode(F.transform(F.sequence("sline", "eline"), lambda x: x - F.col("s"))).alias("line"))
    # lines of one snippet
    sets = lines.groupBy("occurrence").agg(F.collect_set(F.when(~F.col("licensed"), F.col("line"))).alias("keywords"), F.collect_set(F.when(F.col("licensed"), F.col("line"))).alias("matches"))

    @F.pandas_udf("struct<text: string, start: int, changed: boolean>")
    def edit(text: pd.Series, start: pd.Series, keywords: pd.Series, matches: pd.Series) -> pd.DataFrame:
        rows = [snippet_edit.edited(x, int(s), set(k if k is not None else ()), set(m if m is not None else ())) for x, s, k, m in zip(text, start, keywords, matches, strict=True)]
        return pd.DataFrame(rows, columns=["text", "start", "changed"])

    rows = o.join(shuffled(text), "snippet").join(shuffled(sets), "occurrence", "left")
    return rows.select("occurrence", edit("text", "s", "keywords", "matches").alias("x")).select("occurrence", "x.text", "x.start", "x.changed")


def spec_report(rows: DataFrame) -> DataFrame:
    """(doc_id, ...) of spec files (doc_id, text): what they declare, after their macros are expanded. The first of several
    versions, summaries, groups and addresses counts; a file without a license or version is incomplete."""
    every = lambda tag: F.regexp_extract_all("x", F.lit(rf"(?m)^{tag}[ \t]*(\S.*?)[ \t\r]*$"), F.lit(1))
    first = lambda tag: F.get(every(tag), F.lit(0))
    out = rows.select("doc_id", spec_macros.expanded(F.col("text")).alias("x")).select(
        "doc_id", every("License:").alias("licenses"), every(r"Source\d*:").alias("sources"), every("%doc").alias("docs"), every("%license").alias("license_files"),
        first("Version:").alias("version"), first("Summary:").alias("summary"), first("Group:").alias("group"), first("(?i:Url):").alias("url"), legal_text.legal_review_notices(F.col("x")).alias("notices"),
    )
    return out.withColumn("incomplete", (F.size("licenses") == 0) | F.col("version").isNull())


@query("SRC11_spec_report")
def _(t: Tables) -> DataFrame:
    return spec_report(t.documents.where("source = 'spec_file' AND text IS NOT NULL").select("doc_id", "text"))


# Modes in which a service changes nothing on the server, and the service that never does.
SAFE_MODES, SAFE_NAMES = ("buildtime", "localonly", "manual", "disabled"), ("product_converter",)


@query("SRC12_services", f"SELECT id, name AS service, coalesce(nullif(state, ''), 'Default') AS mode, coalesce(nullif(state, ''), 'Default') IN {SAFE_MODES} OR name IN ('product_converter') AS safe FROM (SELECT id, name, CASE state WHEN 'obsolete' THEN 'disabled' WHEN 'acceptable' THEN 'manual' WHEN 'new' THEN '' ELSE state END AS state FROM bot_packages)")
def _(t: Tables) -> DataFrame:
    """The services of service files and whether the sources are complete without the server. The tables hold no such files, so one
    is written for each package, of its name and state."""
    mode = F.when(F.col("state") == "obsolete", "disabled").when(F.col("state") == "acceptable", "manual").when(F.col("state") != "new", F.col("state"))
    xml = F.concat(F.lit("<services>\n  <!-- <service/> -->\n  <service name='"), "name", F.lit("'"), F.coalesce(F.concat(F.lit(' mode="'), mode, F.lit('"')), F.lit("")), F.lit("><param/></service>\n</services>"))
    tags = t.bot_packages.select("id", F.explode(F.regexp_extract_all(xml, F.lit(r"<service\s[^>]*>"), F.lit(0))).alias("tag"))
    value = lambda key: F.regexp_extract("tag", rf"""\s{key}\s*=\s*["']([^"']*)["']""", 1)
    rows = tags.select("id", value("name").alias("service"), F.coalesce(F.nullif(value("mode"), F.lit("")), F.lit("Default")).alias("mode")).where("service <> ''")
    return rows.withColumn("safe", F.col("mode").isin(*SAFE_MODES) | F.col("service").isin(*SAFE_NAMES))


def exclusions(text: str) -> list[tuple[str, str]]:
    """(package glob, file glob) of a list of exclusions: one `package: file` a line, comments after a # ."""
    return [m.groups() for line in text.split("\n") if (m := re.match(r"\s*([^\s#]\S+)\s*:\s*(\S+)(?:\s.*)?$", line))]


EXCLUDED = "# what is not unpacked\nlib*: tests/*\n*-tools: *.md and more\n go*: vendor/*\nbroken line\n"


@query("SRC08_unpacked_without_excluded", "SELECT f.id FROM matched_files f LEFT JOIN bot_packages b ON b.id = f.package WHERE f.filename IS NOT NULL AND NOT coalesce(b.name LIKE 'lib%' AND f.filename LIKE 'tests/%' OR b.name LIKE '%-tools' AND f.filename LIKE '%.md' OR b.name LIKE 'go%' AND f.filename LIKE 'vendor/%', false)")
def _(t: Tables, rules: str = EXCLUDED) -> DataFrame:
    """Files that no rule for their package excludes; * in a glob also matches slashes."""
    b = t.bot_packages.select(F.col("id").alias("package"), "name")
    gone = F.lit(False)
    for package, file in exclusions(rules):
        gone = gone | (F.col("name").rlike(glob_regex(package)) & F.col("filename").rlike(glob_regex(file)))
    return t.matched_files.where("filename is not null").join(b, "package", "left").where(~F.coalesce(gone, F.lit(False))).select("id")


@query("SRC14_reference_keys", "SELECT DISTINCT lower(trim(key)) AS key, license_id FROM (SELECT license_id AS key, license_id FROM license_list UNION ALL SELECT title, license_id FROM license_list UNION ALL SELECT unnest(aliases), license_id FROM license_list) WHERE key <> ''")
def _(t: Tables) -> DataFrame:
    """Every name under which the reference list knows a license."""
    names = F.concat(F.array("license_id", "title"), F.coalesce("aliases", F.array().cast("array<string>")))
    return t.license_list.select(F.explode(names).alias("key"), "license_id").where("key <> ''").select(F.lower(F.trim("key")).alias("key"), "license_id").distinct()


@query("SRC15_whole_catalogue", "SELECT id, pattern, license, risk FROM license_patterns")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.select("id", "pattern", "license", "risk")
