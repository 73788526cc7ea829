import pytest

from tessellum.llm import origin

PATHS = {
    "lib/a.pb.go": "generated", "src/autogen/x.c": "generated", "src/regenerate/x.c": None, "pkg/api/zz_generated.x.go": "generated", "configure": "generated", "configure.ac": None, "Makefile.am": None, "src/pb_manual_helpers.py": None, "app/x.proto": None, "a/yarn.lock": "generated", "a/x_pb.js": "generated", "a/BuildConfig.java": "generated", "a/x.js.map": "minified", "a/roadmap": None,
    "dist/x.bundle.js": "minified", "lib/x-bundle.js": None, "assets/x-min.css": "minified", "lib/minimal_x.js": None, "lib/admin_x.js": None, "build/static/js/main.9667b862.js": "minified", "tools/minify_x.py": None,
    "data/x_lut_data.c": "data", "tests/blob_x_store.ts": None, "lib/x_bitmap.xpm": "data", "db/x_dump.sql": "data", "src/dump_x.c": None,
    "Vendor/x/y.go": "third_party", "src/vendor_x.go": None, "app/models/vendors.py": None, "vendor.tar.zst._./x/LEGAL": "third_party", "src/third_party_x_notice.go": None,
    "lib/zabisio-0.12.6/q.ts": "third_party", "lib/compat/rejix.js": "third_party", "lib/compat/other.js": None, "mypkg-1.0/src/main.c": None, "src/mypkg/x.c": None, "internal/code.x.example/go/deten/a.go": "third_party", "src/Zab_Core/x.py": "third_party", "a/elsewhere/x.py": None,
}
COMPONENTS = [(1, "pkg:npm/zabisio@0.12.6", " "), (1, "pkg:npm/%40s/rejix", "@S/REJIX"), (1, "pkg:golang/code.x.example/go/deten@1", None), (1, "pkg:npm/mypkg@1.0", "mypkg"), (1, None, "zab-core"), (2, "pkg:npm/elsewhere@1", "elsewhere"), (None, "pkg:npm/compat@1", "compat"), (1, None, None)]


def test_paths(spark):
    rows = [(k, 1, p, 0) for k, p in enumerate(PATHS, 1)] + [(900, 1, None, 0), (901, None, "lib/rejix/x.c", 0), (902, 1, "", 0), (1, 1, next(iter(PATHS)), 0)]
    files = spark.createDataFrame(rows, "id long, package long, filename string, generation int").selectExpr("*", "1 AS kind", "2 AS component", "3 AS file_id")
    components = spark.createDataFrame(COMPONENTS, "package long, purl string, name string").selectExpr("*", "1 AS component")
    packages = spark.createDataFrame([(1, "MyPkg"), (2, None)], "id long, name string")
    got = {r.file_id: r.kind for r in origin.classify(files, components, packages).collect()}
    assert got == {k: PATHS[p] for k, p in enumerate(PATHS, 1) if PATHS[p]}
    assert {r.file_id for r in origin.found(files, components, packages).collect()} == set(got)
    assert origin.found(files.where("false"), components.where("false"), packages.where("false")).count() == 0


HAND = "int add(int a, int b) {\n    // sums\n    return a + b;\n}\n\nstatic void show(const char *s) {\n    if (s) {\n        puts(s);\n    }\n}\n"


@pytest.mark.parametrize(("text", "want"), [(None, "empty"), ("  \n", "empty"), (HAND, "hand_written"), ("".join(f"function a{k}(b){{if(b){{c();d();e()}}return b+{k}}}" for k in range(60)), "minified"), ("".join(f"  REGISTER(name{k}, kind{k});\n" for k in range(60)), "generated"), ("t = [" + ", ".join(f"0x{k:06x}" for k in range(900)) + "]\n", "data")])
def test_layout(text, want):
    assert origin.layout_kind(text) == want


def test_source_layout(spark):
    df = spark.createDataFrame([(1, HAND), (2, None), (3, "x" * 100_000)], "id long, text string")
    assert {r.id: r.kind for r in origin.source_layout(df, "id", "text").collect()} == {1: "hand_written", 2: "empty", 3: "hand_written"}
