"""Which licenses of a package may not meet: the compatibility matrix, how near both licenses of a pair lie, and their ranks.

The matrix of a deployment is an input (a, b, compatibility): outbound license, inbound license, and No, Check dependency or
Unknown; compatible cells are left out. The one here is made up of the names on the license list, so that there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions import paths
from tessellum.operators.expressions import strip_exception
from tessellum.plans import path_sql
from tessellum.plans.catalog import Tables, query
from tessellum.session import shuffled

#: Kind of the outbound and of the inbound license, and the cell of the matrix here.
RULES = (("only", "only", "No"), ("only", "later", "Check dependency"), ("later", "only", "Unknown"), ("plain", "only", "No"))
#: Evidence of a license in a file: a match, a resolved fold, a guess.
MATCH, FOLD, GUESS = 3, 2, 1


def matrix(t: Tables) -> DataFrame:
    """(a, b, compatibility) over the license list, whose size is fixed."""
    kind = F.when(F.col("license_id").endswith("-only"), "only").when(F.col("license_id").endswith("-or-later"), "later").otherwise("plain")
    listed = t.license_list.select("license_id", kind.alias("kind"), F.split_part("license_id", F.lit("-"), F.lit(1)).alias("family"))
    side = lambda name: listed.select(*(F.col(c).alias(f"{c}_{name}") for c in listed.columns))
    rules = t.spark.createDataFrame(list(RULES), "kind_a string, kind_b string, compatibility string")
    cells = side("a").join(F.broadcast(rules), "kind_a").join(F.broadcast(side("b")), "kind_b").where("family_a <> family_b")
    return cells.select(F.col("license_id_a").alias("a"), F.col("license_id_b").alias("b"), "compatibility")


_KIND = "CASE WHEN license_id LIKE '%-only' THEN 'only' WHEN license_id LIKE '%-or-later' THEN 'later' ELSE 'plain' END"
_RULES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in RULES)
_MATRIX = f"""k AS (SELECT license_id, {_KIND} AS kind, split_part(license_id, '-', 1) AS family FROM license_list),
  mx AS (SELECT a.license_id AS a, b.license_id AS b, r.compatibility FROM k a JOIN (VALUES {_RULES}) r(x, y, compatibility) ON r.x = a.kind JOIN k b ON b.kind = r.y AND b.family <> a.family)"""


def evidence(t: Tables) -> DataFrame:
    """(package, path, spdx, confidence): the licenses of each live file, with the best evidence for each."""
    p = t.license_patterns.where("spdx <> ''").select(F.col("id").alias("pattern"), "spdx")
    found = t.pattern_matches.where("generation = 0 AND NOT ignored").select("file", "pattern", F.lit(MATCH).alias("confidence"))
    like = t.snippets.select(F.col("id").alias("snippet"), F.col("like_pattern").alias("pattern"))
    o = t.file_snippets.where("generation = 0 AND (resolution = 'fold' OR resolution IS NULL)").join(shuffled(like), "snippet")
    guessed = o.select("file", "pattern", F.when(F.col("resolution") == "fold", FOLD).otherwise(GUESS).alias("confidence"))
    best = found.union(guessed).join(p, "pattern").groupBy("file", "spdx").agg(F.max("confidence").alias("confidence"))
    files = t.matched_files.where("generation = 0 AND filename IS NOT NULL").select(F.col("id").alias("file"), "package", F.col("filename").alias("path"))
    return best.join(shuffled(files), "file").groupBy("package", "path", "spdx").agg(F.max("confidence").alias("confidence"))


_EVIDENCE = f"""g AS (SELECT file, pattern, {MATCH} AS c FROM pattern_matches WHERE generation = 0 AND NOT ignored
    UNION ALL SELECT o.file, s.like_pattern, CASE WHEN o.resolution = 'fold' THEN {FOLD} ELSE {GUESS} END FROM file_snippets o JOIN snippets s ON s.id = o.snippet WHERE o.generation = 0 AND coalesce(o.resolution, 'fold') = 'fold'),
  ev AS (SELECT f.package, f.filename AS path, p.spdx, max(g.c) AS confidence FROM g JOIN license_patterns p ON p.id = g.pattern AND p.spdx <> '' JOIN matched_files f ON f.id = g.file AND f.generation = 0 GROUP BY 1, 2, 3)"""


def compatibility(present: DataFrame, cells: DataFrame) -> DataFrame:
    """(package, a, b, compatibility): the cells between licenses that a package has at once, as far as both take part in one
    that is No or Check dependency. present: (package, spdx); the cells are a table of fixed size."""
    met = present.withColumnRenamed("spdx", "a").join(F.broadcast(cells), "a").join(shuffled(present.withColumnRenamed("spdx", "b")), ["package", "b"])
    bad = met.where(F.col("compatibility").isin("No", "Check dependency"))
    axes = bad.select("package", F.col("a").alias("x")).union(bad.select("package", "b")).distinct()
    keep = lambda df, side: df.join(shuffled(axes.withColumnRenamed("x", side)), ["package", side], "left_semi")
    return keep(keep(met, "a"), "b").select("package", "a", "b", "compatibility")


_KEPT = f"""{_MATRIX}, {_EVIDENCE}, pr AS (SELECT DISTINCT package, spdx FROM ev),
  ce AS (SELECT x.package, mx.a, mx.b, mx.compatibility FROM pr x JOIN mx ON mx.a = x.spdx JOIN pr y ON y.package = x.package AND y.spdx = mx.b),
  ax AS (SELECT package, a AS x FROM ce WHERE compatibility IN ('No', 'Check dependency') UNION SELECT package, b FROM ce WHERE compatibility IN ('No', 'Check dependency')),
  kept AS (SELECT * FROM ce WHERE (package, a) IN (SELECT package, x FROM ax) AND (package, b) IN (SELECT package, x FROM ax))"""


@query("LA25_compatibility", f"WITH {_KEPT} SELECT * FROM kept")
def _(t: Tables) -> DataFrame:
    return compatibility(evidence(t).select("package", "spdx").distinct(), matrix(t))


def flagged(kept: DataFrame) -> DataFrame:
    """(package, a, b), a < b: the pairs with a cell in either direction."""
    return kept.where("a <> b").select("package", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def proximity(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(package, a, b, tier, confidence, same_file, lca_depth, no_colocation, file_a, file_b): the nearest place of each pair that
    has any evidence. Tier 0 is shipped source, 1 counts vendored code in, 2 everything. A lower tier wins, then the weaker
    confidence of both sides, one file before two, the deeper common directory, and the first paths. Guesses count only in
    their own file; a pair that meets nowhere is kept as not co-located if one side is known by guesses alone.

    Licenses are rolled up to the directories above their files before pairs are formed, so no pairs of files are."""
    placed = found.withColumn("own", paths.tier(F.col("path")))
    sure = placed.where(F.col("confidence") >= FOLD)
    up = sure.select("package", "path", "spdx", "confidence", F.explode(paths.ancestors(F.col("path"))).alias("dir"), "own").select("*", F.explode(F.sequence("own", F.lit(2))).alias("tier"))
    best = F.min(F.struct((-F.col("confidence")).alias("less"), "path")).alias("m")
    rolled = up.groupBy("package", "dir", "tier", "spdx").agg(best).select("package", "dir", "tier", "spdx", (-F.col("m.less")).alias("confidence"), "m.path")

    def both(rows: DataFrame, at: list[str]) -> DataFrame:
        side = lambda name: rows.select(*at, F.col("spdx").alias(name), F.col("confidence").alias(f"c_{name}"), F.col("path").alias(f"file_{name}"))
        met = side("a").join(shuffled(pairs), ["package", "a"]).join(shuffled(side("b")), [*at, "b"])
        return met.withColumn("confidence", F.least("c_a", "c_b"))

    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    columns = ["package", "a", "b", "tier", "confidence", "same_file", "lca_depth", "file_a", "file_b"]
    near = both(rolled, ["package", "dir", "tier"]).withColumn("same_file", F.lit(0)).withColumn("lca_depth", depth).select(columns)
    same = both(placed.withColumn("tier", F.col("own")).withColumn("at", F.col("path")), ["package", "at", "tier"]).withColumn("same_file", F.lit(1)).withColumn("lca_depth", paths.depth(F.col("file_a"))).select(columns)
    rank = F.struct("tier", (-F.col("confidence")).alias("c"), (-F.col("same_file")).alias("s"), (-F.col("lca_depth")).alias("d"), "file_a", "file_b")
    located = near.union(same).groupBy("package", "a", "b").agg(F.min(rank).alias("r")).select("package", "a", "b", "r.tier", (-F.col("r.c")).alias("confidence"), (-F.col("r.s")).alias("same_file"), (-F.col("r.d")).alias("lca_depth"), F.lit(0).alias("no_colocation"), "r.file_a", "r.file_b")
    # guesses on one side at least, and no place in common
    known = found.groupBy("package", "spdx").agg(F.max("confidence").alias("known"), F.min("path").alias("path"))
    of = lambda name: known.select("package", F.col("spdx").alias(name), F.when(F.col("known") < FOLD, F.col("path")).alias(f"file_{name}"))
    rest = pairs.join(shuffled(located), ["package", "a", "b"], "left_anti").join(shuffled(of("a")), ["package", "a"]).join(shuffled(of("b")), ["package", "b"])
    weak = rest.where("file_a IS NOT NULL OR file_b IS NOT NULL").select("package", "a", "b", F.lit(0), F.lit(GUESS), F.lit(0), F.lit(-1), F.lit(1), "file_a", "file_b")
    return located.union(weak)


_DEPTH = "(len({0}) - len(replace({0}, '/', '')))"
_NEAR = f"""{_KEPT}, fp AS (SELECT DISTINCT package, least(a, b) AS a, greatest(a, b) AS b FROM kept WHERE a <> b),
  pl AS (SELECT *, {path_sql.tier('path')} AS own FROM ev), seg AS (SELECT *, string_split(path, '/') AS p FROM pl WHERE confidence >= {FOLD}),
  up AS (SELECT package, path, spdx, confidence, array_to_string(p[1:n], '/') AS dir, n AS depth, unnest(generate_series(own, 2)) AS tier FROM (SELECT *, unnest(generate_series(0, len(p) - 1)) AS n FROM seg)),
  ro AS (SELECT package, dir, depth, tier, spdx, confidence, path FROM (SELECT *, row_number() OVER (PARTITION BY package, dir, tier, spdx ORDER BY confidence DESC, path) AS k FROM up) WHERE k = 1),
  ca AS (SELECT fp.*, x.tier, least(x.confidence, y.confidence) AS confidence, 0 AS same_file, x.depth AS lca_depth, x.path AS file_a, y.path AS file_b FROM fp JOIN ro x ON x.package = fp.package AND x.spdx = fp.a JOIN ro y ON y.package = fp.package AND y.spdx = fp.b AND y.dir = x.dir AND y.tier = x.tier
    UNION ALL SELECT fp.*, x.own, least(x.confidence, y.confidence), 1, {_DEPTH.format('x.path')}, x.path, y.path FROM fp JOIN pl x ON x.package = fp.package AND x.spdx = fp.a JOIN pl y ON y.package = fp.package AND y.spdx = fp.b AND y.path = x.path),
  lo AS (SELECT * EXCLUDE (k) FROM (SELECT *, 0 AS no_colocation, row_number() OVER (PARTITION BY package, a, b ORDER BY tier, confidence DESC, same_file DESC, lca_depth DESC, file_a, file_b) AS k FROM ca) WHERE k = 1),
  kn AS (SELECT package, spdx, CASE WHEN max(confidence) < {FOLD} THEN min(path) END AS path FROM ev GROUP BY 1, 2),
  px AS (SELECT package, a, b, tier, confidence, same_file, lca_depth, no_colocation, file_a, file_b FROM lo UNION ALL SELECT fp.package, fp.a, fp.b, 0, {GUESS}, 0, -1, 1, x.path, y.path FROM fp JOIN kn x ON x.package = fp.package AND x.spdx = fp.a JOIN kn y ON y.package = fp.package AND y.spdx = fp.b
    WHERE (x.path IS NOT NULL OR y.path IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM lo WHERE lo.package = fp.package AND lo.a = fp.a AND lo.b = fp.b))"""


@query("LA26_pair_proximity", f"WITH {_NEAR} SELECT * FROM px")
def _(t: Tables) -> DataFrame:
    found = evidence(t)
    return proximity(found, flagged(compatibility(found.select("package", "spdx").distinct(), matrix(t))))


def hard(kept: DataFrame) -> DataFrame:
    """(package, a, b), a < b: both directions are No."""
    no = kept.where("compatibility = 'No' AND a <> b").select("package", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a") < F.col("b")).alias("forth"))
    return no.distinct().groupBy("package", "a", "b").agg(F.count("*").alias("n")).where("n = 2").select("package", "a", "b")


_HARD = "SELECT x.package, x.a, x.b FROM kept x JOIN kept y ON y.package = x.package AND y.a = x.b AND y.b = x.a WHERE x.a < x.b AND x.compatibility = 'No' AND y.compatibility = 'No'"


@query("LA27_hard_incompatibilities", f"WITH {_KEPT} {_HARD}")
def _(t: Tables) -> DataFrame:
    return hard(compatibility(evidence(t).select("package", "spdx").distinct(), matrix(t)))


def ranked(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(package, place, a, b, mutual, no_colocation, tier, confidence, same_file, lca_depth, location): the pairs of each package
    in the order of their weight. The pairs of a package are bounded by the pairs of listed licenses."""
    pairs = flagged(kept)
    rows = pairs.join(shuffled(proximity(found, pairs)), ["package", "a", "b"], "left").join(shuffled(hard(kept).withColumn("mutual", F.lit(1))), ["package", "a", "b"], "left")
    rows = rows.na.fill(0, ["mutual", "tier", "confidence", "same_file"]).na.fill(-1, ["lca_depth"]).na.fill(1, ["no_colocation"])
    one = (F.col("same_file") == 1) | (F.col("file_a") == F.col("file_b"))
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    together = (folder("file_a") != "") & (folder("file_a") == folder("file_b"))
    location = F.when(one, F.concat(F.lit("same file "), "file_a")).when(together, F.concat(F.lit("same directory "), folder("file_a"), F.lit(": "), "file_a", F.lit(", "), "file_b"))
    order = Window.partitionBy("package").orderBy("no_colocation", "tier", F.desc("confidence"), F.desc("same_file"), F.desc("lca_depth"), F.desc("mutual"), "a", "b")
    return rows.select("package", F.row_number().over(order).cast("long").alias("place"), "a", "b", "mutual", "no_colocation", "tier", "confidence", "same_file", "lca_depth", location.alias("location"))


_FOLDER = "regexp_extract({0}, '^(.*)/[^/]*$', 1)"
_RANKED = f"""{_NEAR}, hd AS ({_HARD}), rk AS (SELECT fp.package, fp.a, fp.b, CASE WHEN hd.a IS NULL THEN 0 ELSE 1 END AS mutual, coalesce(no_colocation, 1) AS no_colocation, coalesce(tier, 0) AS tier, coalesce(confidence, 0) AS confidence, coalesce(same_file, 0) AS same_file, coalesce(lca_depth, -1) AS lca_depth,
  CASE WHEN same_file = 1 OR file_a = file_b THEN 'same file ' || file_a WHEN {_FOLDER.format('file_a')} <> '' AND {_FOLDER.format('file_a')} = {_FOLDER.format('file_b')} THEN 'same directory ' || {_FOLDER.format('file_a')} || ': ' || file_a || ', ' || file_b END AS location
  FROM fp LEFT JOIN px USING (package, a, b) LEFT JOIN hd USING (package, a, b))"""


@query("SRT12_ranked_incompatibilities", f"WITH {_RANKED} SELECT package, row_number() OVER (PARTITION BY package ORDER BY no_colocation, tier, confidence DESC, same_file DESC, lca_depth DESC, mutual DESC, a, b) AS place, * EXCLUDE (package) FROM rk")
def _(t: Tables) -> DataFrame:
    found = evidence(t)
    return ranked(found, compatibility(found.select("package", "spdx").distinct(), matrix(t)))


@query("WIN14_directory_masks", f"""WITH {_NEAR}, ix AS (SELECT package, x AS spdx, row_number() OVER (PARTITION BY package ORDER BY x) - 1 AS bit FROM ax)
  SELECT up.package, up.dir, up.tier, bit_or(CASE WHEN bit < 63 THEN CAST(1 AS BIGINT) << bit ELSE 0 END) AS low, bit_or(CASE WHEN bit >= 63 THEN CAST(1 AS BIGINT) << (bit - 63) ELSE 0 END) AS high FROM up JOIN ix ON ix.package = up.package AND ix.spdx = up.spdx GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    """The licenses at or below each directory as bits, by tier; a package's licenses are numbered in their order. Two words
    hold more licenses than the list has."""
    found = evidence(t)
    kept = compatibility(found.select("package", "spdx").distinct(), matrix(t))
    bad = kept.where(F.col("compatibility").isin("No", "Check dependency"))
    axes = bad.select("package", F.col("a").alias("spdx")).union(bad.select("package", "b")).distinct()
    numbered = axes.withColumn("bit", F.row_number().over(Window.partitionBy("package").orderBy("spdx")) - 1)
    rows = found.where(F.col("confidence") >= FOLD).join(shuffled(numbered), ["package", "spdx"]).withColumn("own", paths.tier(F.col("path")))
    up = rows.select("package", "bit", F.explode(paths.ancestors(F.col("path"))).alias("dir"), "own").select("package", "bit", "dir", F.explode(F.sequence("own", F.lit(2))).alias("tier"))
    bits = lambda at: F.bit_or(F.when(F.col("bit").between(at, at + 62), F.expr(f"shiftleft(1L, bit - {at})")).otherwise(F.lit(0)))
    return up.groupBy("package", "dir", "tier").agg(bits(0).alias("low"), bits(63).alias("high"))


_ATOMS = r"' ' || regexp_replace(license, '[^\w.+-]+', ' ', 'g') || ' '"


@query("LA28_classification", f"""SELECT DISTINCT p.license, l.license_id, regexp_extract(l.title, '(\\w+) (?:License|Agreement|Terms)', 1) AS class FROM (SELECT DISTINCT license, lower({_ATOMS}) AS x FROM license_patterns WHERE license <> '') p
  JOIN license_list l ON contains(p.x, ' ' || lower(l.license_id) || ' ')""")
def _(t: Tables) -> DataFrame:
    """The listed licenses that an expression names, with what the data set says of each; exceptions relax no duty here, so an
    identifier under an exception is classified, too. The data set is the list: its class is the word in the title."""
    atoms = t.license_patterns.where("license <> ''").select("license").distinct().select("license", F.explode(F.split(F.regexp_replace("license", r"[^\w.+-]+", " "), " ")).alias("atom")).select("license", F.lower("atom").alias("atom")).distinct()
    data = t.license_list.select(F.lower("license_id").alias("atom"), "license_id", F.regexp_extract("title", r"(\w+) (?:License|Agreement|Terms)", 1).alias("class"))
    return atoms.join(F.broadcast(data), "atom").select("license", "license_id", "class")  # the list has a fixed size


@query("ST16_stripped_exception", r"SELECT id, regexp_replace(license, '(?i)\b[\w.-]+-only WITH \w+-exception-[\d.]+\b', '', 'g') AS license FROM (SELECT id, license || ' WITH Linking-exception-1.0 OR ' || license AS license FROM license_patterns WHERE license <> '')")
def _(t: Tables) -> DataFrame:
    """Identifiers under an exception that permits the combination are taken out before the pairs are looked for. The tables name no
    exceptions, so each license stands once with one and once without."""
    both = F.concat("license", F.lit(" WITH Linking-exception-1.0 OR "), "license")
    return t.license_patterns.where("license <> ''").select("id", strip_exception(both, r"[\w.-]+-only", r"\w+-exception-[\d.]+").alias("license"))
