"""Window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.plans.catalog import NOW, Tables, query

#: Lines between a match and a marked line up to which both are one block.
DELTA = 6

_NOW = f"TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}'"


@query("WIN01_page_total", "SELECT id, name, count(*) OVER () AS total FROM bot_packages WHERE state = 'new' ORDER BY priority DESC, id LIMIT 20")
def _(t: Tables, limit: int = 20) -> DataFrame:
    rows = t.bot_packages.where("state = 'new'").select("id", "name", "priority")
    page = rows.orderBy(F.desc("priority"), "id").limit(limit)  # the page
    return page.crossJoin(rows.agg(F.count("*").alias("total"))).select("id", "name", "total")  # a single total


@query("WIN02_older_duplicates", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY checkout_dir, name ORDER BY id DESC) AS n FROM bot_packages) WHERE n > 1")
def _(t: Tables) -> DataFrame:
    newest = Window.partitionBy("checkout_dir", "name").orderBy(F.desc("id"))
    return t.bot_packages.withColumn("n", F.row_number().over(newest)).where("n > 1").select("id")


@query("WIN03_older_reviewed", f"SELECT id FROM (SELECT id, imported, row_number() OVER (PARTITION BY name ORDER BY id DESC) AS n FROM bot_packages WHERE state <> 'new') WHERE n > 1 AND imported < {_NOW} - INTERVAL 60 DAY")
def _(t: Tables) -> DataFrame:
    newest = Window.partitionBy("name").orderBy(F.desc("id"))
    old = F.col("imported") < F.expr(f"timestamp_ntz'{NOW:%Y-%m-%d %H:%M:%S}' - interval 60 days")
    return t.bot_packages.where("state <> 'new'").withColumn("n", F.row_number().over(newest)).where((F.col("n") > 1) & old).select("id")


@query("WIN04_distinct_on", "SELECT DISTINCT ON (license) license, id, risk FROM license_patterns WHERE license IS NOT NULL ORDER BY license, id")
def _(t: Tables) -> DataFrame:
    return t.license_patterns.where("license is not null").groupBy("license").agg(F.min(F.struct("id", "risk")).alias("first")).select("license", "first.id", "first.risk")


@query("WIN05_longest_evidence", "SELECT license, file, sline FROM (SELECT p.license, m.file, m.sline, row_number() OVER (PARTITION BY p.license ORDER BY m.eline - m.sline DESC, f.filename, m.sline, m.file) AS n FROM pattern_matches m JOIN license_patterns p ON m.pattern = p.id JOIN matched_files f ON f.id = m.file WHERE m.generation = 0 AND p.license IS NOT NULL) WHERE n = 1")
def _(t: Tables) -> DataFrame:
    p = t.license_patterns.where("license is not null").select(F.col("id").alias("pattern"), "license")
    f = t.matched_files.select(F.col("id").alias("file"), "filename")
    rows = t.pattern_matches.where("generation = 0").join(p, "pattern").join(f, "file")
    best = rows.groupBy("license").agg(F.min(F.struct((F.col("sline") - F.col("eline")).alias("shorter"), "filename", "sline", "file")).alias("best"))  # one partial aggregate instead of a sort per license
    return best.select("license", "best.file", "best.sline")


@query("WIN06_first_shown", "SELECT package, snippet, file FROM (SELECT o.package, o.snippet, o.file, row_number() OVER (PARTITION BY o.package, o.snippet ORDER BY f.filename, f.id, o.sline) AS n FROM file_snippets o JOIN matched_files f ON f.id = o.file WHERE o.generation = 0) WHERE n = 1")
def _(t: Tables) -> DataFrame:
    f = t.matched_files.select(F.col("id").alias("file"), "filename")
    first = t.file_snippets.where("generation = 0").join(f, "file").groupBy("package", "snippet").agg(F.min(F.struct("filename", "file", "sline")).alias("first"))
    return first.select("package", "snippet", "first.file")


def islands(spans: DataFrame, gap: int) -> DataFrame:
    """Spans (file, sline, eline) joined to blocks: spans that are at most `gap` lines apart belong together."""
    before = Window.partitionBy("file").orderBy("sline", "eline").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("sline", "eline").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = spans.withColumn("reach", F.max("eline").over(before)).withColumn("new", F.when(F.col("reach").isNull() | (F.col("sline") > F.col("reach") + gap), 1).otherwise(0))
    return starts.withColumn("block", F.sum("new").over(upto)).groupBy("file", "block").agg(F.min("sline").alias("sline"), F.max("eline").alias("eline")).drop("block")


def closure(matches: DataFrame, patterns: DataFrame, delta: int = DELTA) -> DataFrame:
    """(file, sline, eline): blocks of lines. Seeds are the keyword matches in no licensed span, with a line around each;
    a block takes in every match at most delta lines away from its lines, again and again. Blocks are the runs of matches in
    the order of their lines that reach each other, if a seed is among them: two running maxima and a running sum per file."""
    p = patterns.select(F.col("id").alias("pattern"), (F.coalesce("license", F.lit("")) != "").alias("licensed"))
    m = matches.where("generation = 0 AND NOT ignored").select("file", "pattern", "sline", "eline").join(p, "pattern").select("file", "sline", "eline", "licensed").distinct()
    upto = Window.partitionBy("file").orderBy("sline")
    reach = F.max(F.when(F.col("licensed"), F.col("eline"))).over(upto.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    m = m.withColumn("seed", (~F.col("licensed") & (F.coalesce(reach, F.lit(-1)) < F.col("eline"))).cast("int"))
    order = Window.partitionBy("file").orderBy("sline", "eline", "seed")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    end, marked = F.max("eline").over(before), F.max(F.col("eline") + F.col("seed")).over(before)
    near = F.coalesce((F.col("sline") <= marked + delta) | ((F.col("seed") == 1) & (F.col("sline") <= end + delta + 1)), F.lit(False))
    runs = m.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("block", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = runs.groupBy("file", "block").agg(F.max("seed").alias("seed"), F.greatest(F.min(F.col("sline") - F.col("seed")), F.lit(1)).alias("sline"), F.max(F.col("eline") + F.col("seed")).alias("eline"))
    return blocks.where("seed = 1").select("file", "sline", "eline")


#: Statement of the blocks: the licensed span that reaches farthest from a line at or above a keyword decides whether it is a seed.
BLOCKS_SQL = f"""WITH m AS (SELECT DISTINCT m.file, m.sline, m.eline, coalesce(p.license, '') <> '' AS licensed FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern WHERE m.generation = 0 AND NOT m.ignored),
  s AS (SELECT m.*, CASE WHEN licensed OR EXISTS (SELECT 1 FROM m l WHERE l.licensed AND l.file = m.file AND l.sline <= m.sline AND l.eline >= m.eline) THEN 0 ELSE 1 END AS seed FROM m),
  r AS (SELECT *, max(eline + seed) OVER w AS marked, max(eline) OVER w AS reach FROM s WINDOW w AS (PARTITION BY file ORDER BY sline, eline, seed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  b AS (SELECT *, sum(CASE WHEN sline <= marked + {DELTA} OR seed = 1 AND sline <= reach + {DELTA + 1} THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY sline, eline, seed ROWS UNBOUNDED PRECEDING) AS block FROM r)
  SELECT file, greatest(min(sline - seed), 1) AS sline, max(eline + seed) AS eline FROM b GROUP BY file, block HAVING max(seed) = 1"""


_ISLANDS = """WITH s AS (SELECT DISTINCT file, sline, eline FROM {table}), r AS (SELECT *, max(eline) OVER (PARTITION BY file ORDER BY sline, eline ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
  b AS (SELECT *, sum(CASE WHEN reach IS NULL OR sline > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY sline, eline) AS block FROM r)
  SELECT file, min(sline) AS sline, max(eline) AS eline FROM b GROUP BY file, block"""


@query("WIN07_line_blocks", _ISLANDS.format(table="pattern_matches WHERE generation = 0", gap=1))
def _(t: Tables) -> DataFrame:
    return islands(t.pattern_matches.where("generation = 0").select("file", "sline", "eline").distinct(), 1)


@query("WIN08_closure", BLOCKS_SQL)
def _(t: Tables) -> DataFrame:
    """The closure over all matches within six lines of what the keywords mark."""
    return closure(t.pattern_matches, t.license_patterns)


@query("WIN09_line_context", "SELECT id, lag(eline) OVER w AS before, lead(sline) OVER w AS after, coalesce(lead(sline) OVER w - eline > 6, false) AS gap FROM file_snippets WHERE generation = 0 WINDOW w AS (PARTITION BY file ORDER BY sline, id)")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("file").orderBy("sline", "id")
    rows = t.file_snippets.where("generation = 0").withColumn("before", F.lag("eline").over(w)).withColumn("after", F.lead("sline").over(w))
    return rows.select("id", "before", "after", F.coalesce(F.col("after") - F.col("eline") > 6, F.lit(False)).alias("gap"))


@query("WIN10_filled_gaps", _ISLANDS.format(table="file_snippets WHERE generation = 0", gap=5))
def _(t: Tables) -> DataFrame:
    return islands(t.file_snippets.where("generation = 0").select("file", "sline", "eline").distinct(), 5)


@query("WIN11_winner_runner_up", """WITH c AS (SELECT m.file, p.license, count(*) AS n, min(p.id) AS first FROM pattern_matches m JOIN license_patterns p ON m.pattern = p.id WHERE m.generation = 0 AND p.license IS NOT NULL GROUP BY m.file, p.license),
  r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, first) AS k FROM c) SELECT file, max(license) FILTER (WHERE k = 1) AS winner, max(license) FILTER (WHERE k = 2) AS second FROM r GROUP BY file""")
def _(t: Tables) -> DataFrame:
    p = t.license_patterns.where("license is not null").select(F.col("id").alias("pattern"), "license")
    c = t.pattern_matches.where("generation = 0").select("file", "pattern").join(p, "pattern").groupBy("file", "license").agg(F.count("*").alias("n"), F.min("pattern").alias("first"))
    r = c.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "first"))).where("k <= 2")
    return r.groupBy("file").agg(F.max(F.when(F.col("k") == 1, F.col("license"))).alias("winner"), F.max(F.when(F.col("k") == 2, F.col("license"))).alias("second"))


@query("WIN13_max_risk_paint", """WITH l AS (SELECT m.file, unnest(generate_series(m.sline, m.eline)) AS line, p.risk, m.id FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern WHERE m.generation = 0 AND NOT m.ignored AND m.eline >= m.sline)
  SELECT file, CAST(line AS INT) AS line, max(risk) AS risk FROM l GROUP BY file, line""")
def _(t: Tables) -> DataFrame:
    p = t.license_patterns.select(F.col("id").alias("pattern"), "risk")
    lines = t.pattern_matches.where("generation = 0 AND NOT ignored AND eline >= sline").join(p, "pattern").select("file", F.explode(F.sequence("sline", "eline")).alias("line"), "risk")
    return lines.groupBy("file", "line").agg(F.max("risk").alias("risk"))
