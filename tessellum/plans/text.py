"""Text search, normalization and harvest."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.functions import legal_text
from tessellum.functions.markup import MARKUP_NAME
from tessellum.functions.similarity import trigram_similarity, trigrams
from tessellum.functions.text import words
from tessellum.operators.expressions import canonical_expression
from tessellum.operators.set_join import prefix_join
from tessellum.plans.catalog import Tables, query
from tessellum.session import cut

_TRIGRAMS = """t AS (SELECT DISTINCT s, substr('  ' || w || ' ', CAST(i AS BIGINT), 3) AS g FROM (SELECT s, w, unnest(generate_series(1, length(w) + 1)) AS i FROM (SELECT s, unnest(regexp_extract_all(lower(s), '[\\p{L}\\p{N}]+')) AS w FROM (SELECT DISTINCT name AS s FROM bot_packages)))),
  n AS (SELECT s, count(*) AS n FROM t GROUP BY s)"""


def similar_names(names: DataFrame, least: Fraction) -> DataFrame:
    """(a, b, similarity) of names, a < b, by a join of their rarest trigrams."""
    listed = cut(names.select("name", trigrams(F.col("name")).alias("tokens")).where("name is not null").distinct())
    pairs = prefix_join(listed.withColumnRenamed("name", "l"), listed.withColumnRenamed("name", "r"), least)
    return pairs.where("l < r").select(F.col("l").alias("a"), F.col("r").alias("b"), F.round("similarity", 9).alias("similarity"))


@query("ST01_trigram_similarity", f"WITH {_TRIGRAMS}, p AS (SELECT x.s AS a, y.s AS b, count(*) AS k FROM t x JOIN t y ON x.g = y.g AND x.s < y.s GROUP BY 1, 2) SELECT a, b, round(k / (na.n + nb.n - k), 9) AS similarity FROM p JOIN n na ON na.s = a JOIN n nb ON nb.s = b WHERE round(k / (na.n + nb.n - k), 9) >= 0.3")
def _(t: Tables) -> DataFrame:
    return similar_names(t.bot_packages, Fraction(3, 10))


@query("ST02_like_name", f"WITH {_TRIGRAMS}, q AS (SELECT DISTINCT substr('  ' || w || ' ', CAST(i AS BIGINT), 3) AS g FROM (SELECT w, unnest(generate_series(1, length(w) + 1)) AS i FROM (VALUES ('python'), ('vinedax')) v(w))), k AS (SELECT t.s, count(*) AS k FROM t JOIN q ON q.g = t.g GROUP BY 1) SELECT b.id, b.name, round(k / (n + (SELECT count(*) FROM q) - k), 9) AS similarity FROM bot_packages b JOIN k ON k.s = b.name JOIN n ON n.s = b.name WHERE round(k / (n + (SELECT count(*) FROM q) - k), 9) > 0.3")
def _(t: Tables) -> DataFrame:
    wanted = trigrams(F.lit("python-vinedax"))
    return t.bot_packages.select("id", "name", F.round(trigram_similarity(trigrams(F.col("name")), wanted), 9).alias("similarity")).where("similarity > 0.3")


@query("ST03_full_text", r"SELECT id FROM snippets WHERE text IS NOT NULL AND list_has_all(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ['license', 'terms']) AND NOT list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 'patent')")
def _(t: Tables) -> DataFrame:
    """All of some words, none of others; words are compared as they stand, without stemming."""
    w = words(F.col("text"))
    return t.snippets.where(F.array_contains(w, "license") & F.array_contains(w, "terms") & ~F.array_contains(w, "patent")).select("id")


@query("ST03_phrase", r"SELECT id FROM snippets WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ', ' charging for help ')")
def _(t: Tables) -> DataFrame:
    flat = F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" "))
    return t.snippets.where(F.contains(flat, F.lit(" charging for help "))).select("id")


def _sql_normalized(text: str) -> str:
    for pattern, instead in legal_text.NORMALIZING:
        text = f"regexp_replace({text}, '{pattern}', '{instead}', 'g')"
    return f"trim(regexp_replace(array_to_string([x FOR x IN string_split({text}, chr(10)) IF NOT regexp_matches(x, '{legal_text.DROPPED_LINE}')], chr(10)), '\\s+', ' ', 'g'), ' ')"


@query("ST04_normalized_text", f"SELECT id, {_sql_normalized('text')} AS normalized FROM snippets WHERE text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.snippets.where("text is not null").select("id", legal_text.normalized_license_text(F.col("text")).alias("normalized"))


@query("ST05_normalized_expression", r"""WITH e AS (SELECT DISTINCT license, replace(replace(regexp_replace(lower(trim(license, ' ')), '\s+', ' ', 'g'), 'licenseref-', ''), '+', '-or-later') AS x FROM license_patterns WHERE license IS NOT NULL)
  SELECT license, CASE WHEN regexp_matches(x, ' or ') AND NOT regexp_matches(x, ' and | with |[()]') THEN array_to_string(list_sort(list_distinct(string_split(x, ' or '))), ' or ') ELSE x END AS normalized FROM e""")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.where("license is not null").select("license").distinct().select("license", legal_text.normalized_expression(F.col("license")).alias("normalized"))


@query("ST06_known_ids", r"SELECT p.id, l.license_id FROM (SELECT DISTINCT id, ' ' || regexp_replace(license, '[^\w.+-]+', ' ', 'g') || ' ' AS x FROM license_patterns WHERE license IS NOT NULL) p JOIN license_list l ON contains(lower(p.x), ' ' || lower(l.license_id) || ' ')")
def _(t: Tables) -> DataFrame:
    atoms = t.license_patterns.where("license is not null").select("id", F.explode(F.split(F.regexp_replace("license", r"[^\w.+-]+", " "), " ")).alias("atom")).select("id", F.lower("atom").alias("atom")).distinct()
    known = t.license_list.select("license_id", F.lower("license_id").alias("atom"))
    return atoms.join(F.broadcast(known), "atom").select("id", "license_id")  # the list has a fixed size


@query("ST07_identifiers", r"""WITH x AS (SELECT DISTINCT license, unnest(string_split_regex(trim(regexp_replace(license, '[()+\s]+', ' ', 'g'), ' '), ' ')) AS atom FROM license_patterns WHERE license <> '')
  SELECT license, coalesce(list_sort(list(DISTINCT l.license_id) FILTER (WHERE l.license_id IS NOT NULL)), []) AS identifiers, bool_and(l.license_id IS NOT NULL OR atom IN ('AND', 'OR', 'WITH')) AND count(l.license_id) > 0 AS only FROM x LEFT JOIN license_list l ON l.license_id = x.atom GROUP BY license""")
def _(t: Tables) -> DataFrame:
    """The listed identifiers in an expression, as they are written, and whether nothing but these and operators is in it."""
    atoms = t.license_patterns.where("license <> ''").select("license").distinct().select("license", F.explode(F.split(F.trim(F.regexp_replace("license", r"[()+\s]+", " ")), " ")).alias("atom"))
    known = atoms.join(F.broadcast(t.license_list.select("license_id", F.col("license_id").alias("atom"))), "atom", "left")  # the list has a fixed size
    fits = F.col("license_id").isNotNull() | F.col("atom").isin("AND", "OR", "WITH")
    return known.groupBy("license").agg(F.array_sort(F.collect_set("license_id")).alias("identifiers"), (F.bool_and(fits) & (F.count("license_id") > 0)).alias("only"))


@query("ST08_canonical_expression", None)
def _(t: Tables) -> DataFrame:
    return t.license_patterns.where("license is not null").select("license").distinct().select("license", canonical_expression(F.col("license")).alias("canonical"))


def _sql_addresses(text: str, pattern: str, longest: int) -> str:
    return f"[x FOR x IN regexp_extract_all({text}, '{pattern}') IF length(x) <= {longest} AND NOT regexp_matches(x, '{legal_text.RESERVED}')]"


_URLS, _EMAILS = _sql_addresses("text", legal_text.URL.replace("'", "''"), legal_text.LONGEST_URL), _sql_addresses("lower(text)", legal_text.EMAIL, legal_text.LONGEST_EMAIL)


@query("ST11_urls_and_emails", f"SELECT doc_id, len({_URLS}) AS urls, len({_EMAILS}) AS emails FROM documents WHERE text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.size(legal_text.urls(F.col("text"))).cast("long").alias("urls"), F.size(legal_text.emails(F.col("text"))).cast("long").alias("emails"))


@query("ST12_copyrights", None)
def _(t: Tables) -> DataFrame:
    """Each notice of a document with the number of times that it stands there."""
    found = t.documents.where("text is not null").select("doc_id", F.explode(legal_text.copyrights(F.col("text"))).alias("notice"))
    return found.groupBy("doc_id", "notice").agg(F.count("*").alias("hits"))


@query("ST13_review_notices")
def _(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.posexplode(legal_text.legal_review_notices(F.col("text"))).alias("n", "notice"))


@query("ST15_skips", r"SELECT id, regexp_matches(pattern, '\$SKIP\d*') AS has_skip, regexp_matches(trim(pattern), '^\$SKIP\d*|\$SKIP\d*$') AS redundant FROM license_patterns WHERE pattern IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.where("pattern is not null").select("id", F.col("pattern").rlike(r"\$SKIP\d*").alias("has_skip"), F.trim("pattern").rlike(r"^\$SKIP\d*|\$SKIP\d*$").alias("redundant"))


UNEXPLAINED_SQL = r"""WITH o AS (SELECT DISTINCT o.file, o.sline, o.eline, s.text FROM file_snippets o LEFT JOIN snippets s ON s.id = o.snippet WHERE o.generation = 0 AND o.eline >= o.sline),
  l AS (SELECT file, string_split(text, chr(10))[line - sline + 1] AS text, line FROM (SELECT *, unnest(generate_series(sline, eline)) AS line FROM o)),
  h AS (SELECT file, line, bool_and(coalesce(NOT regexp_matches(text, '\S'), false)) AS blank FROM l GROUP BY 1, 2),
  c AS (SELECT DISTINCT file, unnest(generate_series(m.sline, m.eline)) AS line FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern WHERE m.generation = 0 AND NOT m.ignored AND p.license <> '')
  SELECT h.file, count(*) FILTER (WHERE NOT blank AND c.line IS NULL) AS lines FROM h LEFT JOIN c ON c.file = h.file AND c.line = h.line GROUP BY 1"""


def unexplained(t: Tables) -> DataFrame:
    """Lines of the live snippets of a file that are not blank and in no licensed span, each once. A file whose lines are
    all explained has 0. Catch-alls explain, keywords and ignored matches do not."""
    texts = t.snippets.select(F.col("id").alias("snippet"), F.split("text", "\n").alias("text"))
    spans = t.file_snippets.where("generation = 0").select("file", "snippet", "sline", "eline").distinct().join(texts, "snippet", "left")
    lines = spans.where("eline >= sline").select("file", "sline", "text", F.explode(F.sequence("sline", "eline")).alias("line"))
    blank = F.coalesce(~F.get("text", F.col("line") - F.col("sline")).rlike(r"\S"), F.lit(False))  # a line without text is not known to be blank
    here = lines.groupBy("file", "line").agg(F.min(blank).alias("blank"))
    p = t.license_patterns.where("license <> ''").select(F.col("id").alias("pattern"))
    m = t.pattern_matches.where("generation = 0 AND NOT ignored AND eline >= sline").join(p, "pattern").select("file", "sline", "eline").distinct()
    covered = m.select("file", F.explode(F.sequence("sline", "eline")).alias("line")).distinct().withColumn("covered", F.lit(True))
    return here.join(covered, ["file", "line"], "left").groupBy("file").agg(F.count_if(~F.col("blank") & F.col("covered").isNull()).alias("lines"))


@query("ST17_unexplained_lines", UNEXPLAINED_SQL)
def _(t: Tables) -> DataFrame:
    return unexplained(t)


@query("ST18_markup", f"SELECT id, regexp_matches(filename, '{MARKUP_NAME}') AS markup FROM matched_files")
def _(t: Tables) -> DataFrame:
    return t.matched_files.select("id", F.col("filename").rlike(MARKUP_NAME).alias("markup"))


@query("ST21_original_name", r"SELECT id, regexp_replace(filename, '\.processed(\.[^./]+)?$', '\1') AS filename FROM matched_files")
def _(t: Tables) -> DataFrame:
    return t.matched_files.select("id", F.regexp_replace("filename", r"\.processed(\.[^./]+)?$", "$1").alias("filename"))


@query("ST22_escaped", "SELECT id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM snippets WHERE text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.snippets.where("text is not null").select("id", F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")).alias("html"))


@query("ST23_preview", "SELECT id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' || (length(text) - 80) ELSE text END AS preview FROM snippets WHERE text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.snippets.where("text is not null").select("id", F.when(F.length("text") > 80, F.concat(F.substring("text", 1, 80), F.lit("..."), (F.length("text") - 80).cast("string"))).otherwise(F.col("text")).alias("preview"))
