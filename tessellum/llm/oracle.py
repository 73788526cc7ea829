"""SQL for the queries of this subpackage that SQL can express, written from the statements of the problems."""

from __future__ import annotations

from tessellum.functions.paths import LICENSE_NAMES, SOURCE_EXTENSIONS

_W = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def _near(table: str, text: str) -> str:
    w = _W.format(text)
    return f"""SELECT '{table}' AS source_table, a.id AS id_a, b.id AS id_b FROM (SELECT a.id AS i, b.id AS j, count(*) AS k FROM {table}_s a JOIN {table}_s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
      JOIN {table}_n a ON a.id = i JOIN {table}_n b ON b.id = j WHERE 10 * k >= 7 * (a.n + b.n - k)""", f"""{table}_s AS (SELECT DISTINCT id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM (SELECT id, {w} AS w FROM {table} WHERE {text} IS NOT NULL) WHERE len(w) >= 3)),
      {table}_n AS (SELECT id, count(*) AS n FROM {table}_s GROUP BY id)"""


_SNIPPETS, _PATTERNS = _near("snippets", "text"), _near("license_patterns", "pattern")
P2_FOUND = f"WITH {_SNIPPETS[1]}, {_PATTERNS[1]} {_SNIPPETS[0]} UNION ALL {_PATTERNS[0]}"

P4_FOUND = """WITH o AS (SELECT DISTINCT o.file, o.snippet, s.text FROM file_snippets o JOIN snippets s ON s.id = o.snippet WHERE o.generation = 0 AND length(s.text) >= 200),
  w AS (SELECT file, snippet, i, md5(substr(text, i, 200)) AS h FROM (SELECT *, unnest(generate_series(1, length(text) - 199)) AS i FROM o)),
  h AS (SELECT h, min(file) AS low, max(file) AS high FROM w GROUP BY h HAVING min(file) <> max(file)),
  c AS (SELECT w.file, w.snippet, w.i, lead(w.i) OVER (PARTITION BY w.file, w.snippet ORDER BY w.i) AS next FROM w JOIN h ON h.h = w.h)
  SELECT file AS file_id, snippet AS snippet_id, CAST(sum(least(coalesce(next, i + 200) - i, 200)) AS BIGINT) AS shared_chars FROM c GROUP BY 1, 2"""

_FIELD = r"^[^\p{L}\p{N}]*\p{L}[\p{L}\p{N}_.-]{0,40}( [\p{L}\p{N}_.-]{1,40})?\s*[:=].*[\p{L}\p{N}]"
P6_FOUND = rf"""WITH RECURSIVE s AS (SELECT id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]', '', 'g') AS plain, [x FOR x IN string_split_regex(text, '[\r\n;]+') IF regexp_matches(x, '[\p{{L}}\p{{N}}]')] AS parts FROM snippets WHERE text IS NOT NULL),
  k AS (SELECT id, plain AS key FROM s UNION ALL SELECT id, '/' || array_to_string(list_sort([regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]', '', 'g') FOR x IN parts]), '/') FROM s WHERE len(parts) >= 3 AND len([x FOR x IN parts IF NOT regexp_matches(x, '{_FIELD}')]) = 0),
  e AS (SELECT DISTINCT a.id AS x, b.id AS y FROM k a JOIN k b ON a.key = b.key),
  r AS (SELECT id AS x, id AS y FROM s UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
  SELECT DISTINCT min(y) OVER (PARTITION BY x) AS keep_id, x AS copy_id FROM r QUALIFY min(y) OVER (PARTITION BY x) <> x"""


_BASE = "regexp_extract(filename, '[^/]*$')"
_FOLD = r"regexp_replace(lower({0}), '[_.\s]+', '-', 'g')"
# Written out once more, by directories, whole names, endings and beginnings, not by the expressions of the operator.
_COPIES = "'vendor', '_vendor', 'vendored', '_vendored', 'thirdparty', 'third_party', 'third-party', '3rdparty', '3rd_party', '3rd-party', 'external', 'externals', 'bundled', 'node_modules', 'bower_components', 'jspm_packages', 'subprojects', 'godeps', '_workspace', 'site-packages'"
_MADE = "'gen', 'autogen', 'autogenerated', 'auto-generated', '__generated__', 'generated', 'autom4te.cache', " + ", ".join(f"'generated{sep}{x}'" for sep in "_-" for x in ("source", "sources", "src", "code"))
_NAMES = "'configure', 'makefile.in', 'config.h.in', 'aclocal.m4', 'bindata.go', 'r.java', 'buildconfig.java', 'config.guess', 'config.sub', 'ltmain.sh', 'depcomp', 'libtool.m4', 'y.output', 'package-lock.json', 'npm-shrinkwrap.json', 'yarn.lock', 'pnpm-lock.yaml', 'cargo.lock', 'composer.lock', 'gemfile.lock', 'poetry.lock', 'pipfile.lock', 'go.sum', 'flake.lock'"
_ENDS = ", ".join(f"'{x}'" for x in (
    *(f".pb{gw}.{x}" for gw in ("", ".gw") for x in ("go", "cc", "h", "c")), "_pb2.py", "_pb2.pyi", "_pb2_grpc.py", "_pb2_grpc.pyi", ".pb.dart", ".pb.swift", "_pb.js", "_pb.rb", "_pb.d.ts", *(f"{sep}gen.{x}" for sep in "._-" for x in ("h", "hpp", "c", "cc", "cpp", "go", "ts", "js", "rs", "java", "py")),
    ".g.dart", ".g.cs", ".g.i.cs", ".freezed.dart", ".graphql.ts", ".graphql.tsx", ".generated.ts", ".generated.tsx", ".designer.cs", ".designer.vb", "_wrap.cxx", "_wrap.cpp", "_wrap.c", *(f".tab.{x}" for x in ("c", "h", "cpp", "hpp", "cc", "hc", "cxx", "hxx")), ".yy.c", ".yy.cc", ".yy.cpp", ".yy.cxx", ".swagger.json",
    *(f"{sep}min.{x}" for sep in "._-" for x in ("js", "mjs", "cjs", "css")), *(f".{k}.{x}" for k in ("bundle", "pack", "packed", "compressed", "compiled", "chunk") for x in ("js", "mjs", "css")), ".js.map", ".mjs.map", ".css.map",
    ".xpm", ".xbm", *(f".{k}.{x}" for k in ("bin", "dat", "raw", "rom") for x in ("c", "h", "inc", "cpp")), ".hex.h", ".hex.c", ".hex.inc", "_rom.inc", "_rom.h", "_rom.c", *(f"_{k}.{x}" for k in ("blob", "bitmap", "image", "bytes") for x in ("h", "c", "inc", "xpm")), *(f"{sep}{k}.{x}" for sep in "._-" for k in ("b64", "base64") for x in ("js", "ts", "css", "py", "h", "c")),
    ".wasm.js", ".dump.sql", "_dump.sql", "-dump.sql",
))
_OTHER = r"[._-](auto)?generated\.\w+$|_grpc[._]pb\.\w+$|^zz_generated\.|^(moc|qrc|ui)_\w+\.(cpp|cxx|cc|h)$|^ui_\w+\.py$|^lex\.\w+\.(c|cc|cpp|cxx)$|[.-][0-9a-f]{8,}(\.chunk|\.bundle|\.min)?\.(js|mjs|css)$|_(ucd|unicode|lookup|lut|crc)_(table|tables|data)\.\w+$|_(wordlist|lut|dict|table)_data\.\w+$|^embedded_\w+_(png|jpg|jpeg|gif|ico|ttf|svg|wav|pdf)\.\w+$"
P1_FOUND = rf"""WITH c AS (SELECT package, {_FOLD.format("trim(n)")} AS n FROM (SELECT package, regexp_extract(trim(name), '[^/:]*$') AS n FROM package_components UNION ALL SELECT package, regexp_extract(purl, '^pkg:[^/]+/(?:[^@?#]*/)?([^/@?#]+)', 1) FROM package_components)),
  own AS (SELECT id AS package, {_FOLD.format("trim(name)")} AS n FROM bot_packages), d AS (SELECT DISTINCT package, n FROM c WHERE n <> '' AND (package, n) NOT IN (SELECT package, n FROM own WHERE n IS NOT NULL)),
  f AS (SELECT id, package, s, lower(s[len(s)]) AS base, [lower(x) FOR x IN s[1:len(s) - 1]] AS dirs FROM (SELECT id, package, string_split(filename, '/') AS s FROM matched_files WHERE filename <> '')),
  p AS (SELECT id, package, unnest(list_concat(list_concat(s[1:len(s) - 1], [regexp_replace(x, '[-@_]v?\d[\w.+~-]*$', '') FOR x IN s[1:len(s) - 1]]), [regexp_extract(s[len(s)], '^[^.]+')])) AS x FROM f)
  SELECT id AS file_id FROM f WHERE list_has_any(dirs, [{_COPIES}]) OR len([x FOR x IN dirs IF regexp_matches(x, '^vendor\.tar\.[a-z0-9]+\._\.$')]) > 0 OR list_has_any(dirs, [{_MADE}]) OR base IN ({_NAMES}) OR len([x FOR x IN [{_ENDS}] IF ends_with(base, x)]) > 0 OR regexp_matches(base, '{_OTHER}')
  UNION SELECT p.id FROM p JOIN d ON d.package = p.package AND d.n = {_FOLD.format("p.x")}"""

# Values are read with one pass of replacements, their names compared by edit distance instead of a similarity join.
_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(trim(lower(strip_accents(v)), ' ' || chr(9) || chr(10) || chr(13)), '^license\s*:\s*|^licenseref-', ''), '\(see copying\)|\[declared\]', ' ', 'g'), '+', ' plus '), '[^a-z0-9./]+', ' ', 'g'), '(^|[^0-9])\.+', '\1 ', 'g'), '\.+($|[^0-9])', ' \1', 'g'))"""
_LATER = "or if you wish any later version|or any later version|or later|or newer|plus"
_ONLY = "and no other version|this version only|only"
_PARSED = rf"""(SELECT v, regexp_matches(t, '\b(and|or)\b|/') AS several, q, regexp_extract(t, '([0-9]+(?:\.[0-9]+)*)', 1) AS ver,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(\bver(sion)?|\bv)? *[0-9]+(\.[0-9]+)*', ' ', 'g'), '\b(ver|version|v)\b', ' ', 'g'), '\b(license|licence|lic|terms|family|unspecified|the|see copying|declared)\b', ' ', 'g'), ' +', ' ', 'g')) AS name
  FROM (SELECT v, CASE WHEN regexp_matches(x, '\b({_LATER})\b') THEN 'later' WHEN regexp_matches(x, '\b({_ONLY})\b') THEN 'only' ELSE '' END AS q, regexp_replace(x, '\b({_LATER}|{_ONLY})\b', ' ', 'g') AS t
  FROM (SELECT v, regexp_replace(regexp_replace({_CLEAN}, '([0-9])([a-z])', '\1 \2', 'g'), '([a-z])(v?[0-9])', '\1 \2', 'g') AS x FROM ({{0}}))))"""
_RESOLVED = f"""vals AS (SELECT DISTINCT license AS v FROM license_patterns WHERE regexp_matches(license, '\\S')),
  par AS {_PARSED.format("SELECT v FROM vals")}, lp AS (SELECT v AS license_id, name AS family, q AS hq, CASE WHEN ver = '' THEN '' WHEN contains(ver, '.') THEN ver ELSE ver || '.0' END AS hv FROM {_PARSED.format("SELECT replace(license_id, '-or-later', ' or later') AS v FROM license_list")}),
  ids AS (SELECT license_id, replace(license_id, '-or-later', ' or later') AS k FROM license_list), ent AS (SELECT ids.license_id, lp.family, lp.hq, lp.hv FROM ids JOIN lp ON lp.license_id = ids.k),
  written AS (SELECT license_id, license_id AS x FROM license_list UNION ALL SELECT license_id, title FROM license_list UNION ALL SELECT license_id, unnest(aliases) FROM license_list),
  forms AS (SELECT DISTINCT f.name AS form, ent.family FROM (SELECT license_id, name FROM written JOIN {_PARSED.format("SELECT DISTINCT replace(x, '-or-later', ' or later') AS v FROM written")} p ON p.v = replace(written.x, '-or-later', ' or later')) f JOIN ent ON ent.license_id = f.license_id WHERE f.name <> ''),
  near AS (SELECT par.v, forms.family, min(damerau_levenshtein(par.name, forms.form)) AS d FROM par JOIN forms ON par.name = forms.form OR length(forms.form) > 5 AND abs(length(par.name) - length(forms.form)) <= 2 AND damerau_levenshtein(par.name, forms.form) <= 2 WHERE NOT par.several GROUP BY 1, 2),
  fam AS (SELECT v, min(family) AS family FROM (SELECT *, min(d) OVER (PARTITION BY v) AS least FROM near) WHERE d = least GROUP BY v HAVING count(DISTINCT family) = 1),
  hit AS (SELECT fam.v, min(ent.license_id) AS low, max(ent.license_id) AS high FROM fam JOIN par ON par.v = fam.v JOIN ent ON ent.family = fam.family AND (par.q = '' OR par.q = ent.hq) AND (par.ver = '' OR CASE WHEN contains(par.ver, '.') THEN par.ver ELSE par.ver || '.0' END = ent.hv) GROUP BY fam.v),
  res AS (SELECT vals.v, CASE WHEN vals.v IN (SELECT license_id FROM license_list) THEN vals.v WHEN hit.low = hit.high THEN hit.low ELSE 'UNMATCHED' END AS license_id FROM vals LEFT JOIN hit ON hit.v = vals.v)"""
P3_FOUND = f"WITH {_RESOLVED} SELECT p.id AS pattern_id, res.license_id FROM license_patterns p JOIN res ON res.v = p.license WHERE p.license NOT IN (SELECT license_id FROM license_list)"
P3_VALUES = f"WITH {_RESOLVED} SELECT v AS value, license_id FROM res"

_LICENSE_FILE = rf"regexp_matches({_BASE}, '(?i){LICENSE_NAMES}') AND NOT regexp_matches({_BASE}, '(?i)\.(?:{'|'.join(SOURCE_EXTENSIONS)})$')"
P5_FOUND = f"""WITH {_RESOLVED}, f AS (SELECT DISTINCT id, package, filename, {_LICENSE_FILE} AS lf, CASE WHEN contains(filename, '/') THEN regexp_replace(filename, '/[^/]*$', '') ELSE '' END AS dir, len(string_split(filename, '/')) AS depth FROM matched_files WHERE generation = 0),
  st AS (SELECT DISTINCT m.file, res.license_id AS l FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern JOIN res ON res.v = p.license AND res.license_id <> 'UNMATCHED' WHERE m.generation = 0 AND NOT m.ignored),
  t AS (SELECT f.*, st.l FROM f JOIN st ON st.file = f.id), dl AS (SELECT package, dir, min(l) AS low, max(l) AS high FROM t WHERE lf GROUP BY 1, 2),
  up AS (SELECT f.id, f.package, dl.low, dl.high, row_number() OVER (PARTITION BY f.id ORDER BY length(dl.dir) DESC) AS k FROM f JOIN dl ON dl.package = f.package AND (dl.dir = '' OR dl.dir = f.dir OR starts_with(f.dir, dl.dir || '/')) WHERE f.id NOT IN (SELECT id FROM t)),
  r AS (SELECT package, id, min(l) AS low, max(l) AS high FROM t GROUP BY 1, 2 UNION ALL SELECT f.package, f.id, up.low, up.high FROM f LEFT JOIN up ON up.id = f.id AND up.k = 1 WHERE f.id NOT IN (SELECT id FROM t)),
  pl AS (SELECT package, min(l) AS low, max(l) AS high FROM (SELECT *, min(depth) OVER (PARTITION BY package) AS top FROM t WHERE lf) WHERE depth = top GROUP BY 1),
  pa AS (SELECT f.package, min(t.l) AS low, max(t.l) AS high FROM f LEFT JOIN t ON t.id = f.id GROUP BY 1),
  a AS (SELECT * FROM r UNION ALL SELECT pa.package, 0, coalesce(pl.low, pa.low), coalesce(pl.high, pa.high) FROM pa LEFT JOIN pl ON pl.package = pa.package)
  SELECT package AS package_id, id AS file_id, CASE WHEN low IS NULL THEN 'UNKNOWN' WHEN low = high THEN low ELSE 'CONFLICT' END AS license FROM a"""


def _groups(table: str, text: str) -> tuple[str, str]:
    w = _W.format(text)
    return f"""SELECT '{table}' AS source_table, k.id, coalesce(g.y, k.rec) AS group_id, coalesce(d.n, 0) AS links FROM {table}_k k LEFT JOIN (SELECT x, min(y) AS y FROM {table}_r GROUP BY x) g ON g.x = k.rec LEFT JOIN (SELECT x, count(*) AS n FROM {table}_e GROUP BY x) d ON d.x = k.rec""", f"""{table}_k AS (SELECT id, min(id) OVER (PARTITION BY w) AS rec FROM (SELECT id, array_to_string({w}, ' ') AS w FROM {table} WHERE {text} IS NOT NULL AND len({w}) >= 3)),
      {table}_p AS (SELECT id_a AS a, id_b AS b FROM found WHERE source_table = '{table}' AND id_a IN (SELECT rec FROM {table}_k) AND id_b IN (SELECT rec FROM {table}_k)), {table}_e AS (SELECT a AS x, b AS y FROM {table}_p UNION SELECT b, a FROM {table}_p),
      {table}_r AS (SELECT x, x AS y FROM {table}_e UNION SELECT r.x, e.y FROM {table}_r r JOIN {table}_e e ON e.x = r.y)"""


_G1, _G2 = _groups("snippets", "text"), _groups("license_patterns", "pattern")
P2_GROUPS = f"WITH RECURSIVE found AS ({P2_FOUND}), {_G1[1]}, {_G2[1]} {_G1[0]} UNION ALL {_G2[0]}"

P4_FILES = f"""WITH f AS ({P4_FOUND}), o AS (SELECT DISTINCT o.file, o.snippet, length(s.text) AS chars FROM file_snippets o JOIN snippets s ON s.id = o.snippet WHERE o.generation = 0 AND o.file IS NOT NULL AND s.text IS NOT NULL),
  a AS (SELECT o.file AS file_id, CAST(sum(o.chars) AS BIGINT) AS chars, CAST(sum(coalesce(f.shared_chars, 0)) AS BIGINT) AS shared_chars FROM o LEFT JOIN f ON f.file_id = o.file AND f.snippet_id = o.snippet GROUP BY 1)
  SELECT *, CASE WHEN chars > 0 THEN shared_chars / chars ELSE 0.0 END AS share FROM a"""

P6_COLLAPSED = f"WITH f AS ({P6_FOUND}) SELECT s.id AS keep_id, count(f.copy_id) + 1 AS copies FROM snippets s LEFT JOIN f ON f.keep_id = s.id WHERE s.text IS NOT NULL AND s.id NOT IN (SELECT copy_id FROM f) GROUP BY 1"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_groups": P2_GROUPS, "p3_found": P3_FOUND, "p3_values": P3_VALUES, "p4_found": P4_FOUND, "p4_files": P4_FILES, "p5_found": P5_FOUND, "p6_found": P6_FOUND, "p6_collapsed": P6_COLLAPSED}
