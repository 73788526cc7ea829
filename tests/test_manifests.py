from pyspark.sql import functions as F

from tessellum.sources.manifests import components

FILES = [
    ("a/node_modules/x/package.json", '{"name": "@s/x", "version": "1.2", "license": {"type": "MIT"}}', "pkg:npm/%40s/x@1.2", "MIT"),
    ("a/vendor/y/composer.json", '{"name": "v/y", "license": ["A", "B"]}', "pkg:composer/v/y", "A OR B"),
    ("a/vendor/z/Cargo.toml", '[package]\nname = "z"\nversion = "0.1"\nlicense = "X"\n', "pkg:cargo/z@0.1", "X"),
    ("a/lib/w-1.dist-info/METADATA", "Name: W_w.x\nVersion: 3\nLicense: L\n\nName: other", "pkg:pypi/w-w-x@3", "L"),
    ("a/b/pom.properties", "groupId=org.q\nartifactId=q\nversion=9\n", "pkg:maven/org.q/q@9", None),
    ("a/b/go.mod", "module code.x/y\n\ngo 1.2\n", "pkg:golang/code.x/y", None),
    ("a/b/r.gemspec", "s.name = 'r'\ns.version = '2'\ns.licenses = ['Z']", "pkg:gem/r@2", "Z"),
    ("a/b/n.nuspec", "<id>N</id><version>4</version><license type='x'>P</license>", "pkg:nuget/N@4", "P"),
]
LISTINGS = [("vendor/modules.txt", "# code.x/y v1.2\n## explicit\ncode.x/y/z\n# code.x/w v3\n", ["pkg:golang/code.x/y@v1.2", "pkg:golang/code.x/w@v3"]), ("vendor/composer/installed.json", '{"packages": [{"name": "a/b", "version": "1"}, {"name": "c/d"}]}', ["pkg:composer/a/b@1", "pkg:composer/c/d"]), ("installed.json", '[{"name": "e/f"}]', ["pkg:composer/e/f"])]
NOTHING = [("package.json", '{"name": "own"}'), ("a/package.json", '{"name": "own"}'), ("a/b/package.json", "{broken"), ("a/c/package.json", None), ("a/d/package.json", "[]"), ("a/b/readme.md", "x"), (None, "{}"), ("a/e/Cargo.toml", ""), ("a/f/package.json", "")]


def test_components(spark):
    df = spark.createDataFrame([f[:2] for f in FILES] + NOTHING, "path string, content string")
    assert {(r.source, r.purl, r.license) for r in components(df).collect()} == {(p, u, l) for p, _, u, l in FILES}
    assert components(df.where("false")).count() == 0


def test_listings_and_own_manifests(spark):
    df = spark.createDataFrame([f[:2] for f in LISTINGS] + [("a/package.json", '{"name": "own"}'), ("a/b/METADATA", "Name: n\nLicense: " + "x" * 700)], "path string, content string").selectExpr("*", "7 AS id")
    got = components(df, keep=("id",)).collect()
    assert sorted(r.purl for r in got) == sorted([p for *_, of in LISTINGS for p in of] + ["pkg:pypi/n"]) and {r.id for r in got} == {7}
    assert [r.license for r in got if r.type == "pypi"] == ["x" * 512]
    assert "pkg:npm/own" in {r.purl for r in components(df, wrapped=F.lit(False)).collect()}
