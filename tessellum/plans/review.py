"""What a review shows: painted lines, overlapping matches, evidence, terms, findings."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.paths import dir_key
from tessellum.functions.similarity import trigrams
from tessellum.operators.intervals import inside, overlaps
from tessellum.operators.set_join import prefix_join
from tessellum.plans.catalog import Tables, query
from tessellum.plans.text import _TRIGRAMS
from tessellum.session import bounded_broadcast, cut, shuffled

_NAMED = "coalesce(license, '') <> ''"
_LINES = """m AS (SELECT m.file, p.risk, p.id AS pattern, unnest(generate_series(m.sline, m.eline)) AS line FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern WHERE m.generation = 0 AND NOT m.ignored AND m.eline >= m.sline),
  x AS (SELECT file, line, risk, pattern FROM (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY risk DESC, pattern) AS k FROM m) WHERE k = 1),
  o AS (SELECT file, id, coalesce(resolution, 'unresolved') AS resolution, unnest(generate_series(sline, eline)) AS line FROM file_snippets WHERE generation = 0 AND eline >= sline),
  y AS (SELECT file, line, arg_min(resolution, id) AS resolution, min(id) AS occurrence FROM o GROUP BY 1, 2), painted AS (SELECT coalesce(x.file, y.file) AS file, coalesce(x.line, y.line) AS line, x.risk, x.pattern, y.resolution FROM x FULL JOIN y ON y.file = x.file AND y.line = x.line)"""


def painted_lines(t: Tables) -> DataFrame:
    """(file, line, risk, pattern, resolution): for each line in a live match or snippet the pattern of the highest risk, the
    smallest of several, and how the first snippet on it was resolved."""
    p = t.license_patterns.select(F.col("id").alias("pattern"), "risk")
    m = t.pattern_matches.where("generation = 0 AND NOT ignored AND eline >= sline").select("file", "pattern", "sline", "eline").distinct().join(p, "pattern")
    worst = F.min(F.struct((-F.col("risk")).alias("less"), "pattern")).alias("w")
    x = m.select("file", "risk", "pattern", F.explode(F.sequence("sline", "eline")).alias("line")).groupBy("file", "line").agg(worst).select("file", "line", (-F.col("w.less")).alias("risk"), "w.pattern")
    o = t.file_snippets.where("generation = 0 AND eline >= sline").select("file", "id", F.coalesce("resolution", F.lit("unresolved")).alias("resolution"), F.explode(F.sequence("sline", "eline")).alias("line"))
    y = o.groupBy("file", "line").agg(F.min_by("resolution", "id").alias("resolution"))
    return x.join(shuffled(y), ["file", "line"], "full").select("file", "line", "risk", "pattern", "resolution")


@query("LA22_painted_lines", f"WITH {_LINES} SELECT * FROM painted")
def _(t: Tables) -> DataFrame:
    return painted_lines(t)


@query("LA43_annotated_source", f"""WITH {_LINES}, s AS (SELECT o.id AS occurrence, o.file, o.sline, string_split(s.text, chr(10)) AS lines FROM file_snippets o JOIN snippets s ON s.id = o.snippet WHERE o.generation = 0 AND o.sline IS NOT NULL AND s.text IS NOT NULL),
  l AS (SELECT occurrence, file, sline + n - 1 AS line, lines[n] AS text FROM (SELECT *, unnest(generate_series(1, len(lines))) AS n FROM s)) SELECT l.occurrence, l.line, l.text, p.risk, p.resolution FROM l LEFT JOIN painted p ON p.file = l.file AND p.line = l.line""")
def _(t: Tables) -> DataFrame:
    """The lines of each snippet where it stands, with their paint. The tables hold no lines around snippets."""
    text = t.snippets.where("text is not null").select(F.col("id").alias("snippet"), F.split("text", "\n").alias("lines"))
    s = t.file_snippets.where("generation = 0 AND sline IS NOT NULL").select(F.col("id").alias("occurrence"), "file", "snippet", "sline").join(shuffled(text), "snippet")
    l = s.select("occurrence", "file", "sline", F.posexplode("lines").alias("at", "text")).select("occurrence", "file", (F.col("sline") + F.col("at")).alias("line"), "text")
    return l.join(shuffled(painted_lines(t).drop("pattern")), ["file", "line"], "left").select("occurrence", "line", "text", "risk", "resolution")


@query("LA44_match_explained", """WITH m AS (SELECT id, file, sline, eline FROM pattern_matches WHERE generation = 0 AND NOT ignored AND eline >= sline) SELECT a.id, 'match' AS kind, b.id AS other FROM m a JOIN m b ON b.file = a.file AND b.sline <= a.eline AND b.eline >= a.sline AND b.id <> a.id
  UNION ALL SELECT a.id, 'snippet', o.id FROM m a JOIN file_snippets o ON o.file = a.file AND o.generation = 0 AND o.sline <= a.sline AND o.eline >= a.eline""")
def _(t: Tables) -> DataFrame:
    """What overlaps a match and which snippets enclose it."""
    m = t.pattern_matches.where("generation = 0 AND NOT ignored").select("id", "file", "sline", "eline")
    other = m.select(F.col("id").alias("other"), "file", F.col("sline").alias("s"), F.col("eline").alias("e"))
    o = t.file_snippets.where("generation = 0").select(F.col("id").alias("other"), "file", F.col("sline").alias("s"), F.col("eline").alias("e"))
    near = overlaps(m, other, "file", ("sline", "eline"), ("s", "e")).where("id <> other").select("id", F.lit("match").alias("kind"), "other")
    around = overlaps(m, o, "file", ("sline", "eline"), ("s", "e")).where("s <= sline AND e >= eline").select("id", F.lit("snippet").alias("kind"), "other")
    return near.union(around)


@query("LA24_ignored_by_hash", """WITH g AS (SELECT DISTINCT md5(text) AS h FROM snippets WHERE approved AND license IS NULL OR confidence >= 95), o AS (SELECT o.file, o.sline, o.eline FROM file_snippets o JOIN snippets s ON s.id = o.snippet AND md5(s.text) IN (SELECT h FROM g) WHERE o.generation = 0)
  SELECT m.id, EXISTS (SELECT 1 FROM o WHERE o.file = m.file AND o.sline <= m.sline AND o.eline >= m.eline) AS ignored FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern AND p.risk = 9 WHERE m.generation = 0 AND m.sline IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    """Matches of the highest risk in a stretch whose content hash is among the ignored ones: here those of snippets that were
    judged not to be legal text, or judged with certainty."""
    content = F.md5("text")
    hashes = t.snippets.where("(approved AND license IS NULL) OR confidence >= 95").select(content.alias("h")).where("h is not null").distinct()
    known = t.snippets.select(F.col("id").alias("snippet"), content.alias("h")).join(shuffled(hashes), "h", "left_semi").select("snippet")
    o = t.file_snippets.where("generation = 0").join(shuffled(known), "snippet", "left_semi").select("file", F.col("sline").alias("s"), F.col("eline").alias("e"))
    p = t.license_patterns.where("risk = 9").select(F.col("id").alias("pattern"))
    m = t.pattern_matches.where("generation = 0 AND sline IS NOT NULL").join(p, "pattern").select("id", "file", "sline", "eline")
    hit = inside(m, o, "file", ("sline", "eline"), ("s", "e"), "left_semi").select("id", F.lit(True).alias("hit"))
    return m.join(shuffled(hit), "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("ignored"))


_KEY = r"regexp_replace(replace(lower(trim({0}, ' ')), '+', '-or-later'), '\s+', ' ', 'g')"
_GRAMS = "SELECT DISTINCT s, substr('  ' || w || ' ', CAST(i AS BIGINT), 3) AS g FROM (SELECT s, w, unnest(generate_series(1, length(w) + 1)) AS i FROM (SELECT s, unnest(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}]+')) AS w FROM ({0})))"


@query("LA15_closest_licenses", f"""WITH v AS (SELECT DISTINCT license AS s FROM license_patterns WHERE license <> ''), a AS ({_GRAMS.format('SELECT s FROM v')}), b AS ({_GRAMS.format('SELECT license_id AS s FROM license_list')}), na AS (SELECT s, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT s, count(*) AS n FROM b GROUP BY 1),
  x AS (SELECT v.s, l.license_id FROM v JOIN license_list l ON {_KEY.format('v.s')} = {_KEY.format('l.license_id')}), c AS (SELECT a.s, b.s AS license_id, count(*) AS k FROM a JOIN b ON b.g = a.g WHERE a.s NOT IN (SELECT s FROM x) GROUP BY 1, 2),
  r AS (SELECT c.s, c.license_id, round(k / (na.n + nb.n - k), 9) AS similarity FROM c JOIN na ON na.s = c.s JOIN nb ON nb.s = c.license_id WHERE 10 * k >= 3 * (na.n + nb.n - k))
  SELECT s AS license, license_id, 1.0 AS similarity FROM x UNION ALL SELECT s, license_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY similarity DESC, license_id) AS n FROM r) WHERE n <= 10""")
def _(t: Tables, most: int = 10) -> DataFrame:
    """The listed license that an expression is once normalized, else the ten of the most similar names."""
    key = lambda c: F.regexp_replace(F.replace(F.lower(F.trim(F.col(c))), F.lit("+"), F.lit("-or-later")), r"\s+", " ")
    values = cut(t.license_patterns.where("license <> ''").select("license").distinct())
    exact = values.withColumn("key", key("license")).join(F.broadcast(t.license_list.select(key("license_id").alias("key"), "license_id")), "key").select("license", "license_id", F.lit(1.0).alias("similarity"))  # the list has a fixed size
    rest = values.join(shuffled(exact), "license", "left_anti").select(F.col("license").alias("l"), trigrams(F.col("license")).alias("tokens"))
    near = prefix_join(rest, t.license_list.select(F.col("license_id").alias("r"), trigrams(F.col("license_id")).alias("tokens")), Fraction(3, 10))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("similarity"), "r"))
    return exact.union(near.withColumn("similarity", F.round("similarity", 9)).withColumn("n", place).where(F.col("n") <= most).select("l", "r", "similarity"))


@query("LA30_license_evidence", f"""WITH e AS (SELECT m.package, coalesce(nullif(p.spdx, ''), p.license) AS license, m.file, f.filename, max(m.eline - m.sline + 1) AS lines FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern AND {_NAMED.replace('license', 'p.license')} AND NOT p.catch_all JOIN matched_files f ON f.id = m.file WHERE m.generation = 0 AND NOT m.ignored GROUP BY 1, 2, 3, 4)
  SELECT package, license, files, filename AS evidence, lines FROM (SELECT *, count(*) OVER (PARTITION BY package, license) AS files, row_number() OVER (PARTITION BY package, license ORDER BY lines DESC, filename, file) AS k FROM e) WHERE k = 1""")
def _(t: Tables) -> DataFrame:
    """The licenses of each package, in how many files, and the file with the longest match for each."""
    p = t.license_patterns.where(f"{_NAMED} AND NOT catch_all").select(F.col("id").alias("pattern"), F.coalesce(F.nullif("spdx", F.lit("")), "license").alias("license"))
    f = t.matched_files.select(F.col("id").alias("file"), "filename")
    e = t.pattern_matches.where("generation = 0 AND NOT ignored").join(p, "pattern").groupBy("package", "license", "file").agg(F.max(F.col("eline") - F.col("sline") + 1).alias("lines")).join(shuffled(f), "file")
    best = F.min(F.struct((-F.col("lines")).alias("less"), "filename", "file")).alias("b")
    return e.groupBy("package", "license").agg(F.count("*").alias("files"), best).select("package", "license", "files", F.col("b.filename").alias("evidence"), (-F.col("b.less")).alias("lines"))


@query("LA31_notice_terms", """WITH n AS (SELECT license, max_by(pattern, (length(pattern), -id)) AS terms FROM license_patterns WHERE coalesce(license, '') <> '' AND NOT catch_all AND length(pattern) >= 400 AND NOT regexp_matches(pattern, '(?i)\\$skip') GROUP BY 1),
  l AS (SELECT DISTINCT p.license, l.title FROM license_patterns p LEFT JOIN license_list l ON l.license_id = p.license WHERE coalesce(p.license, '') <> '' AND NOT p.catch_all),
  a AS (SELECT l.license, CASE WHEN l.title IS NOT NULL THEN 'listed' WHEN n.terms IS NOT NULL THEN 'catalogue' ELSE 'gap' END AS source, coalesce(l.title, n.terms) AS terms FROM l LEFT JOIN n ON n.license = l.license)
  SELECT license, source, terms, source <> 'gap' AND license = min(license) OVER (PARTITION BY terms) AS printed FROM a""")
def _(t: Tables, least: int = 400) -> DataFrame:
    """What a notice prints for each license: the listed text, else the longest full text of the catalogue, else a gap. One text
    is printed once, with the first of its licenses."""
    named = t.license_patterns.where(f"{_NAMED} AND NOT catch_all")
    full = named.where((F.length("pattern") >= least) & ~F.col("pattern").rlike(r"(?i)\$skip")).groupBy("license").agg(F.max_by("pattern", F.struct(F.length("pattern"), -F.col("id"))).alias("full"))
    listed = t.license_list.select(F.col("license_id").alias("license"), "title")
    rows = named.select("license").distinct().join(F.broadcast(listed), "license", "left").join(shuffled(full), "license", "left")  # the list has a fixed size
    rows = rows.select("license", F.when(F.col("title").isNotNull(), "listed").when(F.col("full").isNotNull(), "catalogue").otherwise("gap").alias("source"), F.coalesce("title", "full").alias("terms"))
    first = rows.where("terms is not null").groupBy("terms").agg(F.min("license").alias("first"))
    return rows.join(shuffled(first), "terms", "left").select("license", "source", "terms", F.coalesce(F.col("license") == F.col("first"), F.lit(False)).alias("printed"))


@query("LA35_file_findings", f"""WITH p AS (SELECT id, coalesce(nullif(spdx, ''), 'LicenseRef-tessellum-' || trim(regexp_replace(lower(license), '[^a-z0-9.]+', '-', 'g'), '-')) AS reference FROM license_patterns WHERE {_NAMED} AND NOT catch_all),
  x AS (SELECT package, file, pattern FROM pattern_matches WHERE generation = 0 AND NOT ignored UNION SELECT o.package, o.file, s.like_pattern FROM file_snippets o JOIN snippets s ON s.id = o.snippet WHERE o.generation = 0 AND o.resolution = 'fold')
  SELECT DISTINCT x.package, x.file, p.reference FROM x JOIN p ON p.id = x.pattern""")
def _(t: Tables) -> DataFrame:
    """The references that each file states, by its matches and by the snippets that were folded into a license; keywords and
    catch-alls state none."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("license"), r"[^a-z0-9.]+", "-"), "^-+|-+$", "")
    p = t.license_patterns.where(f"{_NAMED} AND NOT catch_all").select(F.col("id").alias("pattern"), F.coalesce(F.nullif("spdx", F.lit("")), F.concat(F.lit("LicenseRef-tessellum-"), slug)).alias("reference"))
    like = t.snippets.select(F.col("id").alias("snippet"), F.col("like_pattern").alias("pattern"))
    folded = t.file_snippets.where("generation = 0 AND resolution = 'fold'").join(shuffled(like), "snippet").select("package", "file", "pattern")
    return t.pattern_matches.where("generation = 0 AND NOT ignored").select("package", "file", "pattern").union(folded).join(p, "pattern").select("package", "file", "reference").distinct()


@query("LA39_enriched_snippets", """WITH p AS (SELECT id, coalesce(license, '') AS license, risk, catch_all FROM license_patterns), m AS (SELECT m.id, m.package, m.file, m.sline, m.eline, p.license, p.risk, p.catch_all, regexp_replace(f.filename, '/[^/]*$', '') AS dir FROM pattern_matches m JOIN p ON p.id = m.pattern JOIN matched_files f ON f.id = m.file WHERE m.generation = 0 AND NOT m.ignored),
  c AS (SELECT package, dir, license FROM (SELECT *, row_number() OVER (PARTITION BY package, dir ORDER BY risk DESC, license) AS k FROM m WHERE license <> '' AND NOT catch_all) WHERE k = 1),
  o AS (SELECT o.id, o.file, o.package, o.sline, o.eline, regexp_replace(f.filename, '/[^/]*$', '') AS dir FROM file_snippets o LEFT JOIN matched_files f ON f.id = o.file WHERE o.generation = 0),
  x AS (SELECT o.id, count(DISTINCT m.id) FILTER (WHERE m.license = '') AS keywords, coalesce(list_sort(list(DISTINCT m.license) FILTER (WHERE m.license <> '')), []) AS overlapping FROM o JOIN m ON m.file = o.file AND m.sline <= o.eline AND m.eline >= o.sline GROUP BY 1)
  SELECT o.id, coalesce(x.keywords, 0) AS keywords, coalesce(x.overlapping, []) AS overlapping, c.license AS covered_by FROM o LEFT JOIN x ON x.id = o.id LEFT JOIN c ON c.package = o.package AND c.dir = o.dir""")
def _(t: Tables) -> DataFrame:
    """Each live snippet with the number of keywords in it, the licenses that overlap it, and the concrete license of the highest
    risk in its directory."""
    p = t.license_patterns.select(F.col("id").alias("pattern"), F.coalesce("license", F.lit("")).alias("license"), "risk", "catch_all")
    f = t.matched_files.select(F.col("id").alias("file"), dir_key(F.col("filename")).alias("dir"))
    m = t.pattern_matches.where("generation = 0 AND NOT ignored").select(F.col("id").alias("match"), "package", "file", "pattern", F.col("sline").alias("s"), F.col("eline").alias("e")).join(p, "pattern").join(shuffled(f), "file")
    best = F.min(F.struct((-F.col("risk")).alias("less"), "license")).alias("b")
    cover = m.where("license <> '' AND NOT catch_all").groupBy("package", "dir").agg(best).select("package", "dir", F.col("b.license").alias("covered_by"))
    o = t.file_snippets.where("generation = 0").select("id", "file", "package", "sline", "eline")
    met = overlaps(o.select("id", "file", "sline", "eline"), m.select("match", "file", "license", "s", "e"), "file", ("sline", "eline"), ("s", "e"))
    named = F.when(F.col("license") != "", F.col("license"))
    inner = met.groupBy("id").agg(F.count_if(F.col("license") == "").alias("keywords"), F.array_sort(F.collect_set(named)).alias("overlapping"))
    rows = o.join(shuffled(f), "file", "left").join(shuffled(inner), "id", "left").join(shuffled(cover), ["package", "dir"], "left")
    return rows.select("id", F.coalesce("keywords", F.lit(0)).alias("keywords"), F.coalesce("overlapping", F.array().cast("array<string>")).alias("overlapping"), "covered_by")


@query("Q22_report_files", """WITH m AS (SELECT m.package, m.file, max(p.risk) AS risk, count(DISTINCT p.license) FILTER (WHERE p.license <> '') AS licenses FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern WHERE m.generation = 0 AND NOT m.ignored GROUP BY 1, 2),
  u AS (SELECT file, count(DISTINCT snippet) AS unresolved FROM file_snippets WHERE generation = 0 AND resolution IS NULL GROUP BY 1)
  SELECT f.package, f.id AS file, f.filename, coalesce(m.risk, 0) AS risk, coalesce(m.licenses, 0) AS licenses, coalesce(u.unresolved, 0) AS unresolved FROM matched_files f LEFT JOIN m ON m.file = f.id AND m.package = f.package LEFT JOIN u ON u.file = f.id WHERE f.generation = 0 AND (m.file IS NOT NULL OR u.file IS NOT NULL)""")
def _(t: Tables) -> DataFrame:
    """The files of each report with their highest risk, their licenses and their unresolved snippets."""
    p = t.license_patterns.select(F.col("id").alias("pattern"), "risk", F.nullif("license", F.lit("")).alias("license"))
    m = t.pattern_matches.where("generation = 0 AND NOT ignored").join(p, "pattern").groupBy("package", "file").agg(F.max("risk").alias("risk"), F.countDistinct("license").alias("licenses"))
    u = t.file_snippets.where("generation = 0 AND resolution IS NULL").groupBy("file").agg(F.countDistinct("snippet").alias("unresolved"))
    f = t.matched_files.where("generation = 0").select("package", F.col("id").alias("file"), "filename")
    rows = f.join(shuffled(m), ["package", "file"], "left").join(shuffled(u), "file", "left").where("risk IS NOT NULL OR unresolved IS NOT NULL")
    return rows.na.fill(0, ["risk", "licenses", "unresolved"]).select("package", "file", "filename", "risk", "licenses", "unresolved")


@query("Q08_requests", r"SELECT CAST(substr(external_link, 5) AS BIGINT) AS request, count(*) AS packages, list_sort(list(DISTINCT state)) AS states, max(id) AS newest FROM bot_packages WHERE regexp_matches(external_link, '^req#\d+$') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """The packages and states of each request."""
    rows = t.bot_packages.where(F.col("external_link").rlike(r"^req#\d+$"))
    return rows.groupBy(F.substring("external_link", 5, 30).cast("long").alias("request")).agg(F.count("*").alias("packages"), F.array_sort(F.collect_set("state")).alias("states"), F.max("id").alias("newest"))
