"""License analytics: matching, blocks, scores and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.paths import ancestors, dir_key, glob_regex, is_license_filename, peripheral_kind
from tessellum.functions.text import words
from tessellum.operators import phrase_match, postings
from tessellum.operators.intervals import overlaps
from tessellum.plans import path_sql
from tessellum.plans.catalog import Tables, query
from tessellum.plans.text import UNEXPLAINED_SQL, unexplained
from tessellum.plans.windows import BLOCKS_SQL, closure
from tessellum.session import cut, shuffled

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
#: Words per shingle, rarest shingles that choose candidates, shared rare shingles that a winner needs, and their weight.
K, PROBE, SHARED, RARE = 3, 20, 2, 4.0


@query("LA01_tokens", rf"""WITH l AS (SELECT id, n, {_WORDS.format("lines[n]")} AS w FROM (SELECT id, lines, unnest(generate_series(1, len(lines))) AS n FROM (SELECT id, string_split(pattern, chr(10)) AS lines FROM license_patterns WHERE pattern IS NOT NULL))),
  x AS (SELECT id, n, k, w[k] AS token FROM (SELECT *, unnest(generate_series(1, len(w))) AS k FROM l)) SELECT id, row_number() OVER (PARTITION BY id ORDER BY n, k) - 1 AS place, token, CAST(n AS INT) AS line FROM x""")
def _(t: Tables) -> DataFrame:
    """The tokens of a text with their places and lines."""
    rows = t.license_patterns.where("pattern is not null").select("id", F.posexplode(phrase_match.words_of_lines(F.col("pattern"))).alias("place", "x"))
    return rows.select("id", F.col("place").cast("long").alias("place"), F.col("x.w").alias("token"), "x.line")


def catalogue_as_files(t: Tables) -> DataFrame:
    """(id, filename, text): the texts of the catalogue as the files to be matched, named by their package. The tables hold no
    other text in which its patterns stand."""
    name = F.concat(F.coalesce(F.nullif("packname", F.lit("")), F.lit("common")), F.lit("/"), F.col("id").cast("string"), F.when(F.col("license") != "", ".txt").otherwise(".kw"))
    return t.license_patterns.where("pattern is not null").select("id", name.alias("filename"), F.col("pattern").alias("text"))


@query("LA02_matches")
def _(t: Tables) -> DataFrame:
    """Pattern and lines of the matches that win where they overlap."""
    return phrase_match.matches(catalogue_as_files(t), t.license_patterns, "id", "text").select(F.col("text_id").alias("file"), F.col("pattern_id").alias("pattern"), "sline", "eline")


@query("LA02_texts_with_pattern", rf"""WITH w AS (SELECT id, ' ' || array_to_string({_WORDS.format('pattern')}, ' ') || ' ' AS x, regexp_matches(pattern, '(?i)\$SKIP') AS gaps FROM license_patterns WHERE len({_WORDS.format('pattern')}) > 0)
  SELECT s.id AS text_id, p.id AS pattern_id FROM w s JOIN w p ON NOT p.gaps AND contains(s.x, p.x)""")
def _(t: Tables) -> DataFrame:
    plain = t.license_patterns.where(~F.col("pattern").rlike(r"(?i)\$SKIP"))
    return phrase_match.matches(catalogue_as_files(t), plain, "id", "text", resolve=False).select("text_id", "pattern_id").distinct()


@query("LA02_plain_matches", rf"""WITH t AS (SELECT id, list(token ORDER BY n, k) AS w, list(n ORDER BY n, k) AS l FROM (SELECT id, n, k, w[k] AS token FROM (SELECT *, unnest(generate_series(1, len(w))) AS k FROM (SELECT id, n, {_WORDS.format('lines[n]')} AS w FROM (SELECT id, lines, unnest(generate_series(1, len(lines))) AS n
    FROM (SELECT id, string_split(pattern, chr(10)) AS lines FROM license_patterns WHERE pattern IS NOT NULL))))) GROUP BY id),
  p AS (SELECT t.* FROM t JOIN license_patterns q ON q.id = t.id AND NOT regexp_matches(q.pattern, '(?i)\$skip')),
  c AS (SELECT t.id AS file, p.id AS pattern, t.w, t.l, p.w AS v, unnest(generate_series(1, len(t.w) - len(p.w) + 1)) AS i FROM t JOIN p ON contains(' ' || array_to_string(t.w, ' ') || ' ', ' ' || array_to_string(p.w, ' ') || ' '))
  SELECT file, pattern, CAST(l[i] AS INT) AS sline, CAST(l[i + len(v) - 1] AS INT) AS eline FROM c WHERE w[i:i + len(v) - 1] = v""")
def _(t: Tables) -> DataFrame:
    """Every match of the patterns without gaps, with its lines, before overlaps are decided."""
    plain = t.license_patterns.where(~F.col("pattern").rlike(r"(?i)\$SKIP"))
    return phrase_match.matches(catalogue_as_files(t), plain, "id", "text", resolve=False).select(F.col("text_id").alias("file"), F.col("pattern_id").alias("pattern"), "sline", "eline")


@query("LA04_indexed_files")
def _(t: Tables, ignored: tuple[str, ...] = ("*.kw",)) -> DataFrame:
    """What indexing leaves of each file with a match: its matches, or only the first one, ignored, if a glob takes the file out."""
    files = catalogue_as_files(t)
    named = files.select(F.col("id").alias("file"), F.col("filename").rlike("|".join(f"(?:{glob_regex(g)})" for g in ignored)).alias("ignored"))
    m = phrase_match.matches(files, t.license_patterns, "id", "text").select(F.col("text_id").alias("file"), F.col("pattern_id").alias("pattern"), "sline", "eline").join(shuffled(named), "file")
    first = m.where("ignored").groupBy("file").agg(F.min(F.struct("sline", "eline", "pattern")).alias("m")).select("file", "m.pattern", "m.sline", "m.eline", F.lit(True).alias("ignored"))
    return m.where(~F.col("ignored")).select("file", "pattern", "sline", "eline", "ignored").union(first)


@query("LA03_scoped_patterns", "SELECT b.id AS package, count(*) AS patterns FROM bot_packages b JOIN license_patterns p ON p.packname = b.name GROUP BY b.id")
def _(t: Tables) -> DataFrame:
    scoped = t.license_patterns.where("packname <> ''").groupBy(F.col("packname").alias("name")).agg(F.count("*").alias("patterns"))
    return t.bot_packages.select(F.col("id").alias("package"), "name").join(scoped, "name").select("package", "patterns")


@query("LA05_snippet_blocks", BLOCKS_SQL)
def _(t: Tables) -> DataFrame:
    """Blocks around keyword lines that no licensed span explains, grown through all matches at most six lines away."""
    return closure(t.pattern_matches, t.license_patterns)


@query("LA06_content_hash", "SELECT id, md5(text || chr(10)) AS content, coalesce(lower(hash) = md5(text || chr(10)), false) AS agrees FROM snippets WHERE text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    content = F.md5(F.concat("text", F.lit("\n")))
    return t.snippets.where("text is not null").select("id", content.alias("content"), F.coalesce(F.lower("hash") == content, F.lit(False)).alias("agrees"))


@query("LA07_find_or_create", """WITH o AS (SELECT o.snippet, bool_and(coalesce(b.embargoed, false)) AS hidden FROM file_snippets o LEFT JOIN bot_packages b ON b.id = o.package GROUP BY 1)
  SELECT md5(s.text) AS content, min(s.id) AS id, count(*) AS rows, bool_and(coalesce(o.hidden, b.embargoed, false)) AS embargoed FROM snippets s LEFT JOIN o ON o.snippet = s.id LEFT JOIN bot_packages b ON b.id = s.package WHERE s.text IS NOT NULL GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    """One snippet per content. It is under embargo as long as every package that it was found in is; one found nowhere, as its own."""
    b = t.bot_packages.select(F.col("id").alias("package"), "embargoed")
    found = t.file_snippets.select("snippet", "package").join(b, "package", "left").groupBy(F.col("snippet").alias("id")).agg(F.bool_and(F.coalesce("embargoed", F.lit(False))).alias("hidden"))
    rows = t.snippets.where("text is not null").select("id", "package", F.md5("text").alias("content")).join(b, "package", "left").join(shuffled(found), "id", "left")
    return rows.groupBy("content").agg(F.min("id").alias("id"), F.count("*").alias("rows"), F.bool_and(F.coalesce("hidden", "embargoed", F.lit(False))).alias("embargoed"))


def shingles(word_array: Column) -> Column:
    """Distinct shingles of K words; a shorter text has its single words."""
    n = F.size(word_array)
    long = F.transform(F.sequence(F.lit(1), n - (K - 1)), lambda i: F.array_join(F.slice(word_array, i, K), ","))
    return F.array_distinct(F.when(n >= K, long).otherwise(word_array))


def shingle_rows(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row (keep, s) per distinct shingle of a text. The words stand in a column of their own: inside the shingles they
    would be found anew for each of them."""
    return rows.where(F.col(text).isNotNull()).select(*keep, words(F.col(text)).alias("w")).select(*keep, F.explode(shingles(F.col("w"))).alias("s"))


def _sql_shingles(table: str, text: str, keep: str, where: str) -> str:
    w = _WORDS.format(text)
    return (
        f"(SELECT DISTINCT {keep}, CASE WHEN len(w) >= {K} THEN array_to_string(w[i:i + {K - 1}], ',') ELSE w[i] END AS s FROM (SELECT *, unnest(generate_series(1, CASE WHEN len(w) >= {K} THEN len(w) - {K - 1} ELSE len(w) END)) AS i"
        f" FROM (SELECT *, {w} AS w FROM {table} WHERE {where})))"
    )


_NAMED = "license IS NOT NULL AND license <> ''"
_SIGNATURES = f"sig AS {_sql_shingles('license_patterns', 'pattern', 'license', _NAMED)}, nl AS (SELECT count(DISTINCT license) AS n FROM sig), idf AS (SELECT s, ln((n + 1) / (count(*) + 1)) + 1 AS w FROM sig, nl GROUP BY s, n)"


def signatures(patterns: DataFrame) -> DataFrame:
    """(license, s): the shingles of all patterns of a license; keyword patterns have none."""
    named = patterns.where("license is not null and license <> ''")
    return shingle_rows(named, "pattern", "license").distinct()


def weights(sig: DataFrame) -> DataFrame:
    """(s, w): the inverse license frequency of each shingle, ln((N + 1) / (df + 1)) + 1."""
    n = sig.agg(F.countDistinct("license").alias("n"))
    return sig.groupBy("s").agg(F.count("*").alias("df")).crossJoin(n).select("s", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("w"))  # a single count


@query("LA08_shingles", f"SELECT id, count(*) AS n FROM {_sql_shingles('snippets', 'text', 'id', 'text IS NOT NULL')} GROUP BY id")
def _(t: Tables) -> DataFrame:
    return shingle_rows(t.snippets, "text", "id").groupBy("id").agg(F.count("*").alias("n"))


@query("LA09_shingle_ids", f"SELECT s AS shingle, CAST('0x' || substr(md5(s), 1, 15) AS BIGINT) AS shingle_id FROM (SELECT DISTINCT s FROM {_sql_shingles('license_patterns', 'pattern', 'license', 'license IS NOT NULL')})")
def _(t: Tables) -> DataFrame:
    s = shingle_rows(t.license_patterns.where("license is not null"), "pattern").select(F.col("s").alias("shingle")).distinct()
    return s.select("shingle", F.conv(F.substring(F.md5("shingle"), 1, 15), 16, 10).cast("long").alias("shingle_id"))


@query("LA10_signature_sizes", f"WITH {_SIGNATURES} SELECT license, count(*) AS shingles, round(sum(w), 6) AS weight FROM sig JOIN idf USING (s) GROUP BY license")
def _(t: Tables) -> DataFrame:
    sig = signatures(t.license_patterns)
    return sig.join(shuffled(weights(sig)), "s").groupBy("license").agg(F.count("*").alias("shingles"), F.round(F.sum("w"), 6).alias("weight"))


@query("AGG15_license_idf", f"WITH {_SIGNATURES} SELECT s, round(w, 9) AS idf FROM idf")
def _(t: Tables) -> DataFrame:
    return weights(signatures(t.license_patterns)).select("s", F.round("w", 9).alias("idf"))


def license_index(patterns: DataFrame) -> postings.Index:
    """The index of the shingles of each license; first is its smallest pattern. All patterns of a license come to one task, so that
    its distinct shingles are found there."""
    named = patterns.where("license is not null and license <> ''").select(F.col("license").alias("owner"), F.col("pattern").alias("text"), F.min("id").over(Window.partitionBy("license")).alias("first"))
    return postings.build(shingle_rows(named, "text", "owner").distinct(), named, K)


def license_scores(snippets: DataFrame, patterns: DataFrame, most: int = 2) -> DataFrame:
    """(id, license, score, first): per snippet the licenses with enough rare shared shingles that have the highest weight of the
    shared shingles by that of all, the `most` best and perhaps others; first is the license's smallest pattern. Candidates come
    from the rarest shingles."""
    index = license_index(patterns)
    return scores_by(postings.numbered(snippets, index, "id"), index, most)


def scores_by(texts: DataFrame, index: postings.Index, most: int = 2) -> DataFrame:
    """The same of numbered texts and an index."""
    return postings.best(texts, index, most, PROBE, RARE, SHARED).select("id", F.col("owner").alias("license"), F.round("score", 9).alias("score"), "first")


_SCORES = f"""{_SIGNATURES}, own AS {_sql_shingles('snippets', 'text', 'id', 'text IS NOT NULL')}, wd AS (SELECT own.id, own.s, coalesce(idf.w, 1.0) AS w, idf.w IS NOT NULL AS known FROM own LEFT JOIN idf ON idf.s = own.s),
  tot AS (SELECT id, sum(w) AS total FROM wd GROUP BY id), rr AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY w DESC, s) AS k FROM wd WHERE known),
  pr AS (SELECT DISTINCT rr.id, sig.license FROM rr JOIN sig ON sig.s = rr.s WHERE k <= {PROBE}), sh AS (SELECT wd.id, sig.license, sum(w) AS both_w, count(*) FILTER (WHERE w >= {RARE}) AS rare FROM wd JOIN sig ON sig.s = wd.s WHERE known GROUP BY 1, 2),
  fi AS (SELECT license, min(id) AS first FROM license_patterns WHERE coalesce(license, '') <> '' GROUP BY license),
  sc AS (SELECT sh.id, sh.license, round(both_w / total, 9) AS score, fi.first FROM sh JOIN pr ON pr.id = sh.id AND pr.license = sh.license JOIN tot ON tot.id = sh.id JOIN fi ON fi.license = sh.license WHERE rare >= {SHARED})"""


def best_licenses(scores: DataFrame) -> DataFrame:
    """(id, license, match, second): the winner, ties to the smallest pattern, and the score of the runner-up."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "first", "license"))
    top = scores.withColumn("k", place).where("k <= 2")
    return top.groupBy("id").agg(F.max(F.when(F.col("k") == 1, F.col("license"))).alias("license"), F.max(F.when(F.col("k") == 1, F.col("score"))).alias("match"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("score"))), F.lit(0.0)).alias("second"))


@query("LA11_best_license", f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, first, license) AS k FROM sc) SELECT id, max(license) FILTER (WHERE k = 1) AS license, max(score) FILTER (WHERE k = 1) AS match, coalesce(max(score) FILTER (WHERE k = 2), 0.0) AS second FROM r GROUP BY id")
def _(t: Tables) -> DataFrame:
    return best_licenses(license_scores(t.snippets, t.license_patterns))


@query("LA13_stale_scores", "SELECT DISTINCT o.package, s.id FROM snippets s JOIN file_snippets o ON o.snippet = s.id WHERE s.score_version IS DISTINCT FROM 2")
def _(t: Tables) -> DataFrame:
    stale = t.snippets.where(~F.col("score_version").eqNullSafe(2)).select("id")
    return t.file_snippets.select("package", F.col("snippet").alias("id")).join(stale, "id").select("package", "id").distinct()


def gates(t: Tables, threshold: float = 0.95, margin: float = 0.15, most_risk: int = 4, clear: float = 0.95, guard: float = 0.9) -> DataFrame:
    """One row per live occurrence with the verdict of each gate: fold, clear, overlap, covered."""
    p = t.license_patterns.select(F.col("id").alias("like_pattern"), F.col("license").alias("closest"), F.col("risk").alias("closest_risk"), F.col("catch_all").alias("closest_any"))
    s = t.snippets.select(F.col("id").alias("snippet"), F.col("likelyness").cast("double").alias("m"), F.coalesce(F.col("second_match").cast("double"), F.lit(0.0)).alias("second"), "score_version", "like_pattern", (F.col("license").isNotNull() | ~F.col("classified")).alias("legal")).join(p, "like_pattern", "left")
    o = t.file_snippets.where("generation = 0").select("id", "package", "file", "snippet", "sline", "eline")
    rows = o.join(s, "snippet")
    q = t.license_patterns.where("license is not null and license <> ''").where(~F.col("catch_all")).select(F.col("id").alias("pattern"), F.col("license").alias("found"), "risk")
    m = t.pattern_matches.where("generation = 0 AND NOT ignored").select("file", "pattern", F.col("sline").alias("s"), F.col("eline").alias("e")).join(q, "pattern")
    over = overlaps(o.select("id", "file", "sline", "eline"), m, "file", ("sline", "eline"), ("s", "e")).groupBy("id").agg(F.collect_set("found").alias("overlapping"))
    f = t.matched_files.select(F.col("id").alias("file"), dir_key(F.col("filename")).alias("dir"))
    cover = m.join(f, "file").join(t.matched_files.select(F.col("id").alias("file"), "package"), "file").groupBy("package", "dir").agg(F.max("risk").alias("cover"))
    rows = rows.join(over, "id", "left").join(f, "file", "left").join(cover, ["package", "dir"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    named, current = F.col("closest").isNotNull() & (F.col("closest") != ""), F.col("score_version").eqNullSafe(2)
    return rows.select(
        "id",
        yes(F.col("legal") & current & named & (F.col("m") >= threshold) & (F.round(F.col("m") - F.col("second"), 9) >= margin) & (F.col("closest_risk") <= most_risk)).alias("fold"),
        yes(F.col("legal") & current & named & (F.col("m") >= clear)).alias("clear"),
        (F.col("overlapping").isNotNull() & ~yes(named & (F.col("m") >= guard) & ~F.array_contains("overlapping", F.col("closest")))).alias("overlap"),
        yes(F.col("cover") >= F.when(named, F.col("closest_risk")).otherwise(0)).alias("covered"),
    )


_GATES = """WITH s AS (SELECT s.id AS snippet, CAST(s.likelyness AS DOUBLE) AS m, coalesce(CAST(s.second_match AS DOUBLE), 0.0) AS second, s.score_version, s.license IS NOT NULL OR NOT s.classified AS legal, p.license AS closest, p.risk AS closest_risk FROM snippets s LEFT JOIN license_patterns p ON p.id = s.like_pattern),
  m AS (SELECT m.file, m.sline, m.eline, p.license, p.risk FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern WHERE m.generation = 0 AND NOT m.ignored AND coalesce(p.license, '') <> '' AND NOT p.catch_all),
  f AS (SELECT id, package, regexp_replace(filename, '/[^/]*$', '') AS dir FROM matched_files), c AS (SELECT f.package, f.dir, max(m.risk) AS cover FROM m JOIN f ON f.id = m.file GROUP BY 1, 2),
  o AS (SELECT o.*, (SELECT list(DISTINCT m.license) FROM m WHERE m.file = o.file AND m.sline <= o.eline AND m.eline >= o.sline) AS ov FROM file_snippets o WHERE o.generation = 0),
  g AS (SELECT o.id, coalesce(s.legal AND s.score_version IS NOT DISTINCT FROM 2 AND coalesce(s.closest, '') <> '' AND s.m >= 0.95 AND round(s.m - s.second, 9) >= 0.15 AND s.closest_risk <= 4, false) AS fold,
  coalesce(s.legal AND s.score_version IS NOT DISTINCT FROM 2 AND coalesce(s.closest, '') <> '' AND s.m >= 0.95, false) AS clear,
  o.ov IS NOT NULL AND NOT coalesce(coalesce(s.closest, '') <> '' AND s.m >= 0.9 AND NOT list_contains(o.ov, s.closest), false) AS overlap,
  coalesce(c.cover >= CASE WHEN coalesce(s.closest, '') <> '' THEN s.closest_risk ELSE 0 END, false) AS covered
  FROM o JOIN s ON s.snippet = o.snippet LEFT JOIN f ON f.id = o.file LEFT JOIN c ON c.package = o.package AND c.dir = f.dir) """


@query("LA17_20_gates", _GATES + "SELECT id, fold, clear, overlap, covered FROM g")
def _(t: Tables) -> DataFrame:
    return gates(t)


@query("LA21_resolution", _GATES + "SELECT id, CASE WHEN fold THEN 'fold' WHEN clear THEN 'clear' WHEN overlap THEN 'overlap' WHEN covered THEN 'covered' END AS resolution FROM g")
def _(t: Tables) -> DataFrame:
    return gates(t).select("id", F.when(F.col("fold"), "fold").when(F.col("clear"), "clear").when(F.col("overlap"), "overlap").when(F.col("covered"), "covered").alias("resolution"))


@query("LA23_report_facts", "SELECT m.package, p.license, p.risk, count(DISTINCT m.file) AS files, count(*) AS matches FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern WHERE m.generation = 0 AND NOT m.ignored AND coalesce(p.license, '') <> '' GROUP BY 1, 2, 3")
def _(t: Tables) -> DataFrame:
    p = t.license_patterns.where("coalesce(license, '') <> ''").select(F.col("id").alias("pattern"), "license", "risk")
    return t.pattern_matches.where("generation = 0 AND NOT ignored").join(p, "pattern").groupBy("package", "license", "risk").agg(F.countDistinct("file").alias("files"), F.count("*").alias("matches"))


@query("LA29_legal_documents", f"""WITH u AS ({UNEXPLAINED_SQL}) SELECT f.package, f.id AS file, count(m.id) AS matches, coalesce(any_value(u.lines), 0) AS unexplained FROM matched_files f LEFT JOIN pattern_matches m ON m.file = f.id AND m.generation = 0 LEFT JOIN u ON u.file = f.id
  WHERE f.generation = 0 AND {path_sql.license_file('f.filename')} AND {path_sql.kind('f.filename')} IS NULL GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    """The legal documents of each package with their matches and the lines at hand that no license explains."""
    legal = t.matched_files.where("generation = 0").where(is_license_filename(F.col("filename")) & peripheral_kind(F.col("filename")).isNull()).select("package", F.col("id").alias("file"))
    counts = t.pattern_matches.where("generation = 0").groupBy("file").agg(F.count("*").alias("matches"))
    lines = unexplained(t).withColumnRenamed("lines", "unexplained")
    return legal.distinct().join(shuffled(counts), "file", "left").join(shuffled(lines), "file", "left").na.fill(0, ["matches", "unexplained"]).select("package", "file", "matches", "unexplained")


@query("LA34_backfilled_components", r"""WITH d AS (SELECT package, regexp_replace(source, '/[^/]*$', '') AS dir, count(DISTINCT purl) AS n, min(id) AS id FROM package_components WHERE generation = 0 AND contains(source, '/') GROUP BY 1, 2),
  l AS (SELECT f.package, d.dir, min(p.spdx) AS low, max(p.spdx) AS high FROM d JOIN matched_files f ON f.package = d.package AND starts_with(f.filename, d.dir || '/') JOIN pattern_matches m ON m.file = f.id AND m.generation = 0 AND NOT m.ignored JOIN license_patterns p ON p.id = m.pattern AND p.spdx <> '' GROUP BY 1, 2)
  SELECT d.id, l.low AS license FROM d JOIN l ON l.package = d.package AND l.dir = d.dir WHERE d.n = 1 AND l.low = l.high""")
def _(t: Tables) -> DataFrame:
    """The one license found at or below the directory of a component that is alone there."""
    d = t.package_components.where("generation = 0 AND contains(source, '/')").groupBy("package", dir_key(F.col("source")).alias("dir")).agg(F.countDistinct("purl").alias("n"), F.min("id").alias("id")).where("n = 1")
    p = t.license_patterns.where("spdx <> ''").select(F.col("id").alias("pattern"), "spdx")
    f = t.matched_files.select(F.col("id").alias("file"), F.col("package"), F.explode(ancestors(F.col("filename"))).alias("dir"))
    near = f.join(shuffled(d.select("package", "dir")), ["package", "dir"], "left_semi")
    m = t.pattern_matches.where("generation = 0 AND NOT ignored").select("file", "pattern").join(p, "pattern").select("file", "spdx").distinct()
    l = near.join(shuffled(m), "file").groupBy("package", "dir").agg(F.min("spdx").alias("low"), F.max("spdx").alias("high")).where("low = high")
    return d.join(l, ["package", "dir"]).select("id", F.col("low").alias("license"))


@query("LA36_delta_score", r"""WITH r AS (SELECT m.package, p.license, max(p.risk) AS risk FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern WHERE m.generation = 0 AND NOT m.ignored AND coalesce(p.license, '') <> '' GROUP BY 1, 2),
  s AS (SELECT DISTINCT o.package, md5(s.text) AS h FROM file_snippets o JOIN snippets s ON s.id = o.snippet WHERE o.generation = 0 AND o.resolution IS NULL AND s.text IS NOT NULL),
  b AS (SELECT id, lag(id) OVER w AS before, regexp_extract(coalesce(checksum, ''), '^(.*)-[0-9]+:', 1) AS spec, regexp_extract(coalesce(lag(checksum) OVER w, ''), '^(.*)-[0-9]+:', 1) AS old FROM bot_packages WINDOW w AS (PARTITION BY name ORDER BY id))
  SELECT b.id, CAST((CASE WHEN spec <> old THEN 1000 ELSE 0 END) + 10 * (SELECT count(*) FROM s WHERE s.package = b.id AND NOT EXISTS (SELECT 1 FROM s o WHERE o.package = b.before AND o.h = s.h))
    + 10 * coalesce((SELECT sum(r.risk) FROM r WHERE r.package = b.id AND NOT EXISTS (SELECT 1 FROM r o WHERE o.package = b.before AND o.license = r.license)), 0) AS BIGINT) AS score FROM b WHERE before IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    """How far a report is from that of the review before it: 1000 if the declared license differs, 10 for each new unresolved
    snippet, 10 times the risk of each new license. The declared license is what the report's checksum begins with."""
    p = t.license_patterns.where("coalesce(license, '') <> ''").select(F.col("id").alias("pattern"), "license", "risk")
    r = t.pattern_matches.where("generation = 0 AND NOT ignored").join(p, "pattern").groupBy("package", "license").agg(F.max("risk").alias("risk"))
    text = t.snippets.where("text is not null").select(F.col("id").alias("snippet"), F.md5("text").alias("h"))
    s = t.file_snippets.where("generation = 0 AND resolution IS NULL").join(shuffled(text), "snippet").select("package", "h").distinct()
    spec = F.regexp_extract(F.coalesce("checksum", F.lit("")), "^(.*)-[0-9]+:", 1)
    order = Window.partitionBy("name").orderBy("id")
    b = t.bot_packages.withColumn("spec", spec).select("id", F.lag("id").over(order).alias("before"), "spec", F.lag("spec").over(order).alias("old")).where("before is not null")

    def added(rows: DataFrame, key: str) -> DataFrame:
        new = b.select("id", "before").join(shuffled(rows), F.col("id") == F.col("package")).drop("package")
        return new.join(shuffled(rows.select(F.col("package").alias("before"), key)), ["before", key], "left_anti")

    licenses = added(r, "license").groupBy("id").agg(F.sum("risk").alias("risks"))
    snippets = added(s, "h").groupBy("id").agg(F.count("*").alias("snippets"))
    rows = b.join(shuffled(licenses), "id", "left").join(shuffled(snippets), "id", "left").na.fill(0, ["risks", "snippets"])
    return rows.select("id", (F.when(F.col("spec") != F.col("old"), 1000).otherwise(0) + F.col("snippets") * 10 + F.col("risks") * 10).cast("long").alias("score"))


@query("JN15_inverted_index", f"WITH {_SIGNATURES}, own AS {_sql_shingles('snippets', 'text', 'id', 'text IS NOT NULL')} SELECT own.id, sig.license, count(*) AS shared FROM own JOIN sig ON sig.s = own.s GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    named = t.license_patterns.where("license is not null and license <> ''").select(F.col("license").alias("owner"), F.col("pattern").alias("text"))
    return postings.counted(t.snippets, named, K).withColumnRenamed("owner", "license")


@query("WIN12_rarest_shingles", f"WITH {_SIGNATURES}, own AS {_sql_shingles('snippets', 'text', 'id', 'text IS NOT NULL')}, r AS (SELECT own.id, own.s, row_number() OVER (PARTITION BY own.id ORDER BY idf.w DESC, own.s) AS k FROM own JOIN idf ON idf.s = own.s) SELECT id, s, k FROM r WHERE k <= {PROBE}")
def _(t: Tables) -> DataFrame:
    own = shingle_rows(t.snippets, "text", "id")
    known = own.join(shuffled(weights(signatures(t.license_patterns))), "s")
    return known.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("w"), "s")).cast("long")).where(F.col("k") <= PROBE).select("id", "s", "k")


@query("LA12_closest_pattern", f"""WITH {_SCORES}, best AS (SELECT id, license FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, first, license) AS k FROM sc) WHERE k = 1),
  ps AS {_sql_shingles('license_patterns', 'pattern', 'id AS pattern, license', _NAMED)},
  c AS (SELECT best.id, ps.pattern, round(sum(idf.w), 6) AS w FROM best JOIN own ON own.id = best.id JOIN ps ON ps.s = own.s AND ps.license = best.license JOIN idf ON idf.s = own.s GROUP BY 1, 2)
  SELECT id, pattern FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, pattern) AS k FROM c) WHERE k = 1""")
def _(t: Tables) -> DataFrame:
    index = license_index(t.license_patterns)
    texts = cut(postings.numbered(t.snippets, index, "id"))
    best = best_licenses(scores_by(texts, index)).select("id", F.col("license").alias("owner"))
    named = t.license_patterns.where("license is not null and license <> ''").select(F.col("license").alias("owner"), F.col("id"), F.col("pattern").alias("text"))
    of = postings.numbered(named, index, "owner", "id").select("owner", F.col("id").alias("pattern"), "places")
    return postings.closest(texts.select("id", "places").join(shuffled(best), "id"), of, index)


@query("JN16_pairs_present", """WITH f AS (SELECT DISTINCT m.package, p.spdx FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern WHERE m.generation = 0 AND NOT m.ignored AND p.spdx <> ''),
  x(a, b) AS (SELECT a.license_id, b.license_id FROM license_list a JOIN license_list b ON a.license_id LIKE '%-only' AND b.license_id LIKE '%-or-later' AND split_part(a.license_id, '-', 1) <> split_part(b.license_id, '-', 1))
  SELECT f.package, x.a, x.b FROM f JOIN x ON x.a = f.spdx JOIN f g ON g.package = f.package AND g.spdx = x.b""")
def _(t: Tables) -> DataFrame:
    """Licenses that a package has at the same time, through a directed matrix of pairs; the one here is made up of the list."""
    p = t.license_patterns.where("spdx <> ''").select(F.col("id").alias("pattern"), "spdx")
    f = t.pattern_matches.where("generation = 0 AND NOT ignored").join(p, "pattern").select("package", "spdx").distinct()
    family = F.split_part("license_id", F.lit("-"), F.lit(1))
    only, later = t.license_list.where("license_id LIKE '%-only'").select(F.col("license_id").alias("a"), family.alias("x")), t.license_list.where("license_id LIKE '%-or-later'").select(F.col("license_id").alias("b"), family.alias("y"))
    matrix = only.join(F.broadcast(later), F.col("x") != F.col("y")).select("a", "b")  # two parts of a list of fixed size
    return f.withColumnRenamed("spdx", "a").join(F.broadcast(matrix), "a").join(f.withColumnRenamed("spdx", "b"), ["package", "b"]).select("package", "a", "b")


@query("LA40_deterministic_occurrence", "SELECT snippet, package, file, sline, eline FROM (SELECT *, row_number() OVER (PARTITION BY snippet ORDER BY package, file, sline, eline, id) AS k FROM file_snippets WHERE generation = 0) WHERE k = 1")
def _(t: Tables) -> DataFrame:
    first = F.min(F.struct("package", "file", "sline", "eline")).alias("m")
    return t.file_snippets.where("generation = 0").groupBy("snippet").agg(first).select("snippet", "m.package", "m.file", "m.sline", "m.eline")


@query("LA39_overlap_positions", "SELECT o.id AS occurrence, m.id AS match, CASE WHEN m.sline <= o.sline AND m.eline >= o.eline THEN 'contains' WHEN m.sline >= o.sline AND m.eline <= o.eline THEN 'inside' WHEN m.sline < o.sline THEN 'head' ELSE 'tail' END AS position FROM file_snippets o JOIN pattern_matches m ON m.file = o.file AND m.sline <= o.eline AND m.eline >= o.sline WHERE o.generation = 0 AND m.generation = 0")
def _(t: Tables) -> DataFrame:
    o = t.file_snippets.where("generation = 0").select(F.col("id").alias("occurrence"), "file", F.col("sline").alias("s"), F.col("eline").alias("e"))
    m = t.pattern_matches.where("generation = 0").select(F.col("id").alias("match"), "file", "sline", "eline")
    rows = overlaps(o, m, "file", ("s", "e"), ("sline", "eline"))
    where = F.when((F.col("sline") <= F.col("s")) & (F.col("eline") >= F.col("e")), "contains").when((F.col("sline") >= F.col("s")) & (F.col("eline") <= F.col("e")), "inside").when(F.col("sline") < F.col("s"), "head").otherwise("tail")
    return rows.select("occurrence", "match", where.alias("position"))


@query("LA46_license_edits", """SELECT p.id, max(p.risk) OVER (PARTITION BY p.license) AS risk, coalesce(nullif(p.spdx, ''), l.license_id, max(nullif(p.spdx, '')) OVER (PARTITION BY p.license)) AS spdx FROM license_patterns p LEFT JOIN license_list l ON l.license_id = p.license WHERE p.license IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    """The three edits of a license's patterns as a new version of them: its risk for all, and where the identifier is missing the
    one that its name is, else that of its other patterns."""
    named = t.license_patterns.where("license is not null").select("id", "license", "risk", F.nullif("spdx", F.lit("")).alias("own"))
    of = named.groupBy("license").agg(F.max("risk").alias("highest"), F.max("own").alias("other"))
    listed = t.license_list.select(F.col("license_id").alias("license"), F.col("license_id").alias("parsed"))
    rows = named.join(of, "license").join(F.broadcast(listed), "license", "left")  # the list has a fixed size
    return rows.select("id", F.col("highest").alias("risk"), F.coalesce("own", "parsed", "other").alias("spdx"))