"""Components that manifest files declare, and what is built from components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.plans.catalog import Tables, query
from tessellum.sources import manifests


def _text(kind: Column) -> Column:
    """The manifest that declares a row's component, as its ecosystem writes it."""
    name, version, license_ = (F.coalesce(F.trim(c) if c == "name" else F.col(c), F.lit("")) for c in ("name", "version", "license"))
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r'([\\"])', r"\\$1"), "\t", r"\\t"), "\n", r"\\n"), F.lit('"'))
    plain = lambda c: F.regexp_replace(c, r"\s+", " ")
    join = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    json = F.to_json(F.struct(name.alias("name"), version.alias("version"), license_.alias("license")))
    return (
        F.when(kind == "npm", json).when(kind == "composer", join('{"packages": [', json, "]}")).when(kind == "cargo", join("[package]\nname = ", quoted(name), "\nversion = ", quoted(version), "\nlicense = ", quoted(license_), "\n"))
        .when(kind == "pypi", join("Name: ", name, "\nVersion: ", version, "\nLicense: ", plain(license_), "\n\nText")).when(kind == "maven", join("groupId=", F.split_part(name, F.lit(":"), F.lit(1)), "\nartifactId=", F.split_part(name, F.lit(":"), F.lit(2)), "\nversion=", version))
        .when(kind == "golang", join("# ", name, " ", version, "\n## explicit\n")).when(kind == "gem", join("s.name = '", name, "'\ns.version = '", version, "'\ns.license = '", F.regexp_replace(license_, "'", ""), "'"))
        .otherwise(join("<id>", name, "</id><version>", version, "</version>"))
    )


def manifest_files(t: Tables) -> DataFrame:
    """(id, package, path, content): the manifest of every live component, written out. The tables hold no contents of files."""
    live = t.package_components.where("generation = 0 AND trim(name) <> ''").where(~F.trim("name").rlike(r"\s"))
    return live.select("id", "package", F.col("source").alias("path"), _text(F.col("type")).alias("content"))


_PURL = "'pkg:' || type || '/' || CASE WHEN type = 'pypi' THEN regexp_replace(lower(trim(name)), '[-_.]+', '-', 'g') WHEN type = 'maven' THEN replace(trim(name), ':', '/') ELSE regexp_replace(trim(name), '^@', '%40') END || coalesce('@' || nullif(version, ''), '')"
_LIVE = r"generation = 0 AND trim(name) <> '' AND NOT regexp_matches(trim(name), '\s') AND (type <> 'maven' OR contains(name, ':')) AND contains(source, '/')"


@query("LA32_detected_components", f"SELECT id, source, type, trim(name) AS name, nullif(version, '') AS version, {_PURL} AS purl FROM package_components WHERE {_LIVE} AND (len(string_split(source, '/')) > 2 OR regexp_matches(source, '(modules.txt|installed.json)$'))")
def _(t: Tables) -> DataFrame:
    """Eight ecosystems: written out as manifests and read again, every component comes back."""
    found = manifests.components(manifest_files(t), keep=("id",))
    return found.where(F.col("purl").isNotNull() & F.contains("source", F.lit("/"))).select("id", "source", "type", "name", "version", "purl")


@query("LA33_own_manifests", """WITH w AS (SELECT package, count(DISTINCT split_part(filename, '/', 1)) = 1 AND bool_and(contains(filename, '/')) AS wrapped FROM matched_files WHERE filename IS NOT NULL GROUP BY 1)
  SELECT c.id, NOT regexp_matches(c.source, '(^|/)(modules.txt|installed.json)$') AND (NOT contains(c.source, '/') OR len(string_split(c.source, '/')) = 2 AND coalesce(w.wrapped, false)) AS own FROM package_components c LEFT JOIN w ON w.package = c.package WHERE c.source IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    """Which manifests describe the package itself: at its top, or below the one directory that wraps all of its files."""
    top, inner = F.split_part("filename", F.lit("/"), F.lit(1)), F.contains("filename", F.lit("/"))
    wrapped = t.matched_files.where("filename is not null").groupBy("package").agg(((F.min(top) == F.max(top)) & F.bool_and(inner)).alias("wrapped"))
    rows = t.package_components.where("source is not null").select("id", "package", "source").join(wrapped, "package", "left")
    return rows.select("id", manifests.own_manifest(F.col("source"), F.coalesce("wrapped", F.lit(False))).alias("own"))


@query("UDF03_detectors", "SELECT type, count(*) AS rows FROM package_components WHERE regexp_matches(source, '(^|/)(package.json|Cargo.toml|METADATA|PKG-INFO|pom.properties|go.mod|modules.txt|composer.json|installed.json)$|.nuspec$|.gemspec$') GROUP BY type")
def _(t: Tables) -> DataFrame:
    """Which detector of the registry takes a path, by its form."""
    taken = F
    for kind, form, _ in manifests.READERS:
        taken = taken.when(F.col("source").rlike(form), kind)
    return t.package_components.select(taken.alias("type")).where("type is not null").groupBy("type").agg(F.count("*").alias("rows"))


_ELEMENTS = """SELECT 'CreationInfo' AS type, 'creation' AS spdx_id, CAST(json_object('type', 'CreationInfo', 'specVersion', '3.0.1', 'package', id) AS VARCHAR) AS element, id AS package FROM bot_packages
  UNION ALL SELECT 'software_Sbom', 'sbom', CAST(json_object('type', 'software_Sbom', 'spdxId', 'sbom', 'name', name) AS VARCHAR), id FROM bot_packages
  UNION ALL SELECT 'software_Package', 'component-' || id, CAST(json_object('type', 'software_Package', 'spdxId', 'component-' || id, 'name', trim(name), 'purl', purl) AS VARCHAR), package FROM package_components WHERE generation = 0 AND trim(name) <> '' AND purl IS NOT NULL
  UNION ALL SELECT 'software_File', 'file-' || id, CAST(json_object('type', 'software_File', 'spdxId', 'file-' || id, 'name', filename) AS VARCHAR), package FROM matched_files WHERE generation = 0 AND filename IS NOT NULL
  UNION ALL SELECT DISTINCT 'software_Snippet', 'snippet-' || file || '-' || snippet || '-' || sline, CAST(json_object('type', 'software_Snippet', 'spdxId', 'snippet-' || file || '-' || snippet || '-' || sline, 'begin', sline, 'end', max(eline)) AS VARCHAR), package FROM file_snippets WHERE generation = 0 AND sline IS NOT NULL GROUP BY package, file, snippet, sline
  UNION ALL SELECT DISTINCT 'simplelicensing_LicenseExpression', 'license-' || md5(x.name), CAST(json_object('type', 'simplelicensing_LicenseExpression', 'spdxId', 'license-' || md5(x.name), 'licenseExpression', x.name) AS VARCHAR), x.package FROM used x WHERE x.known
  UNION ALL SELECT DISTINCT 'expandedlicensing_CustomLicense', 'license-' || md5(x.name), CAST(json_object('type', 'expandedlicensing_CustomLicense', 'spdxId', 'license-' || md5(x.name), 'name', x.name) AS VARCHAR), x.package FROM used x WHERE NOT x.known
  UNION ALL SELECT DISTINCT 'Relationship', 'found-' || x.file || '-' || md5(x.name), CAST(json_object('type', 'Relationship', 'spdxId', 'found-' || x.file || '-' || md5(x.name), 'from', 'file-' || x.file, 'relationshipType', 'hasConcludedLicense', 'to', 'license-' || md5(x.name)) AS VARCHAR), x.package FROM used x
  UNION ALL SELECT 'Relationship', 'contains-' || id, CAST(json_object('type', 'Relationship', 'spdxId', 'contains-' || id, 'from', 'sbom', 'relationshipType', 'contains', 'to', 'component-' || id) AS VARCHAR), package FROM package_components WHERE generation = 0 AND trim(name) <> '' AND purl IS NOT NULL
  UNION ALL SELECT 'Annotation', 'note-' || id, CAST(json_object('type', 'Annotation', 'spdxId', 'note-' || id, 'statement', result) AS VARCHAR), id FROM bot_packages WHERE result <> ''"""
_USED = """WITH used AS (SELECT DISTINCT m.package, m.file, coalesce(nullif(p.spdx, ''), p.license) AS name, coalesce(p.spdx, '') <> '' AS known FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern WHERE m.generation = 0 AND NOT m.ignored AND NOT p.catch_all AND coalesce(p.license, '') <> '')"""


@query("SNK05_sbom_graph", f"{_USED} {_ELEMENTS}")
def _(t: Tables) -> DataFrame:
    """The typed elements of each package's document: its description, components, files, snippets, licenses known to the list or
    its own, relationships and notes. Rows can be written in parts; nothing is gathered per package."""

    def element(rows: DataFrame, type_: str, spdx_id: Column | str, *fields: Column, show: bool = True) -> DataFrame:
        name = spdx_id if isinstance(spdx_id, Column) else F.lit(spdx_id)
        body = F.to_json(F.struct(F.lit(type_).alias("type"), *([name.alias("spdxId")] if show else []), *fields))
        return rows.select(F.lit(type_).alias("type"), name.alias("spdx_id"), body.alias("element"), "package")

    of = lambda prefix, *cols: F.concat_ws("-", F.lit(prefix), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols])
    b = t.bot_packages.withColumn("package", F.col("id"))
    c = t.package_components.where("generation = 0 AND trim(name) <> '' AND purl IS NOT NULL")
    f = t.matched_files.where("generation = 0 AND filename IS NOT NULL")
    s = t.file_snippets.where("generation = 0 AND sline IS NOT NULL").groupBy("package", "file", "snippet", "sline").agg(F.max("eline").alias("eline"))
    p = t.license_patterns.where("NOT catch_all AND coalesce(license, '') <> ''").select(F.col("id").alias("pattern"), F.coalesce(F.nullif("spdx", F.lit("")), "license").alias("name"), (F.coalesce("spdx", F.lit("")) != "").alias("known"))
    used = t.pattern_matches.where("generation = 0 AND NOT ignored").join(p, "pattern").select("package", "file", "name", "known").distinct()
    licenses = used.select("package", "name", "known").distinct()
    digest = F.md5("name")
    parts = [
        element(b, "CreationInfo", "creation", F.lit("3.0.1").alias("specVersion"), F.col("id").alias("package"), show=False), element(b, "software_Sbom", "sbom", F.col("name")),
        element(c, "software_Package", of("component", "id"), F.trim("name").alias("name"), F.col("purl")), element(f, "software_File", of("file", "id"), F.col("filename").alias("name")),
        element(s, "software_Snippet", of("snippet", "file", "snippet", "sline"), F.col("sline").alias("begin"), F.col("eline").alias("end")),
        element(licenses.where("known"), "simplelicensing_LicenseExpression", of("license", digest), F.col("name").alias("licenseExpression")), element(licenses.where("NOT known"), "expandedlicensing_CustomLicense", of("license", digest), F.col("name")),
        element(used.select("package", "file", "name").distinct(), "Relationship", of("found", "file", digest), of("file", "file").alias("from"), F.lit("hasConcludedLicense").alias("relationshipType"), of("license", digest).alias("to")),
        element(c, "Relationship", of("contains", "id"), F.lit("sbom").alias("from"), F.lit("contains").alias("relationshipType"), of("component", "id").alias("to")),
        element(b.where("result <> ''"), "Annotation", of("note", "id"), F.col("result").alias("statement")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query("ST09_key_suggestion", r"""WITH k AS (SELECT license_id, lower(license_id) AS key FROM license_list) SELECT p.license, k.license_id AS suggestion FROM (SELECT DISTINCT license, trim(regexp_replace(lower(license), '[^a-z0-9.]+', '-', 'g'), '-') AS slug FROM license_patterns WHERE license <> '') p JOIN k ON k.key = p.slug""")
def _(t: Tables) -> DataFrame:
    """The listed key that a license name becomes as a slug."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("license"), r"[^a-z0-9.]+", "-"), "^-+|-+$", "")
    names = t.license_patterns.where("license <> ''").select("license").distinct().withColumn("key", slug)
    return names.join(F.broadcast(t.license_list.select(F.lower("license_id").alias("key"), F.col("license_id").alias("suggestion"))), "key").select("license", "suggestion")  # the list has a fixed size


@query("ST10_license_reference", r"""WITH k AS (SELECT license_id, lower(license_id) AS key FROM license_list) SELECT DISTINCT p.license, p.spdx, p.catch_all, CASE WHEN p.catch_all THEN NULL ELSE coalesce(nullif(p.spdx, ''), k.license_id, 'LicenseRef-tessellum-' || p.slug) END AS reference
  FROM (SELECT license, spdx, catch_all, trim(regexp_replace(lower(license), '[^a-z0-9.]+', '-', 'g'), '-') AS slug FROM license_patterns WHERE license <> '') p LEFT JOIN k ON k.key = p.slug""")
def _(t: Tables) -> DataFrame:
    """What a document calls a license: its identifier, else that of the listed key, else a reference of its own; a catch-all has none."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("license"), r"[^a-z0-9.]+", "-"), "^-+|-+$", "")
    names = t.license_patterns.where("license <> ''").select("license", "spdx", "catch_all").distinct().withColumn("key", slug)
    listed = names.join(F.broadcast(t.license_list.select(F.lower("license_id").alias("key"), "license_id")), "key", "left")  # the list has a fixed size
    reference = F.coalesce(F.nullif("spdx", F.lit("")), "license_id", F.concat(F.lit("LicenseRef-tessellum-"), "key"))
    return listed.select("license", "spdx", "catch_all", F.when(~F.col("catch_all"), reference).alias("reference"))
