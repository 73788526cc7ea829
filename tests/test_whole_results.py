"""Whole results on small tables, written out or computed by brute force."""

import random

import pytest

from tessellum.plans import catalog

PATTERNS = "id long, pattern string, license string, spdx string, risk int, catch_all boolean"
MATCHES = "id long, file long, package long, pattern long, sline int, eline int, ignored boolean, generation int"
FILES = "id long, package long, filename string, generation int"


@pytest.fixture
def run(spark, tmp_path):
    """Rows of a query over tables given as {name: (rows, schema)}."""

    def rows(name, **tables):
        for table, (values, schema) in tables.items():
            spark.createDataFrame(values, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect()))

    return rows


def test_notice_has_licenses_of_every_risk(run):
    patterns = [(1, "", "MIT like", "MIT", 1, False), (2, "", "Own", "", 9, False), (3, "", "Any", "", 9, True), (4, "", "", "", 7, False), (5, "", None, "", 7, False), (6, "", "MIT too", "MIT", 2, False)]
    files = [(1, 1, "b", 0), (2, 1, "a", 0), (3, 1, "c", 5)]
    found = [(1, 1, False, 0), (2, 6, False, 0), (1, 2, False, 0), (2, 2, True, 0), (3, 2, False, 0), (2, 2, False, 5), (1, 3, False, 0), (1, 4, False, 0), (1, 5, False, 0), (1, 1, False, 0)]
    matches = [(k, file, 1, pattern, 1, 1, ignored, generation) for k, (file, pattern, ignored, generation) in enumerate(found)]
    got = run("SNK06_notice_lines", license_patterns=(patterns, PATTERNS), matched_files=(files, FILES), pattern_matches=(matches, MATCHES))
    assert got == [("MIT", "a\nb"), ("Own", "b")]


def test_head_has_the_first_bytes_and_no_broken_character(run):
    texts = [(1, "x" * 30_005), (2, "é" * 301), (3, "x" * 29_999 + "é"), (4, "x" * 29_998 + "é"), (5, "x" * 29_997 + "😀"), (6, None), (7, "")]
    want = [(1, "x" * 30_000), (2, "é" * 301), (3, "x" * 29_999), (4, "x" * 29_998 + "é"), (5, "x" * 29_997), (6, None), (7, "")]
    assert run("SRC03_decoded_head", documents=(texts, "doc_id long, text string")) == want


def test_head_that_is_not_utf8_is_latin1(run):
    assert run("SRC03_decoded_head", documents=([(1, bytearray(b"caf\xe9 au lait"))], "doc_id long, text binary")) == [(1, "café au lait")]


def test_every_line_is_read(run):
    texts = [(1, "\n".join("abcdef")), (2, None), (3, "")]
    assert run("SRC04_lines", documents=(texts, "doc_id long, text string")) == [*((1, k + 1, f"{k + 1:6d}  {c}") for k, c in enumerate("abcdef")), (3, 1, "     1  ")]


SPECS = {
    "%define major 3\n%global mainver %{major}.1\nName: x\nVersion: %{mainver}\nSource: %{name}-%version.tar": "%define major 3\n%global mainver 3.1\nName: x\nVersion: 3.1\nSource: x-3.1.tar",
    "Source: %{name}-%{version}-%{release}": "Source: %{name}-%{version}-%{release}",
    "Release: 7 \nVersion: 1 beta\nx %release %{version} %%{version} %%version %{?version} %{unknown} %unknown": "Release: 7 \nVersion: 1 beta\nx 7 1 beta %%{version} %%version %{?version} %{unknown} %unknown",
    "  %define a 1\n%define a 2\n%define version 9\nVersion: 1\n%a %{version}": "  %define a 1\n%define a 2\n%define version 9\nVersion: 1\n1 9",
    "%define none\n%define a %{b}\n%define b %{a}\n%a": None,
}


def literal(text):
    """The substitutions one reference at a time, character by character, for at most ten rounds."""
    macros = {}
    for line in text.split("\n"):
        parts = line.split(None, 2)
        if len(parts) == 3 and parts[0] in ("%define", "%global"):
            macros.setdefault(parts[1], parts[2].strip())
    for line in text.split("\n"):
        for tag in ("Name:", "Version:", "Release:"):
            if line.startswith(tag) and line[len(tag) :].strip():
                macros.setdefault(tag[:-1].lower(), line[len(tag) :].strip())
    for _ in range(10):
        for left, right in (("%{", "}"), ("%", "")):
            out, at = "", 0
            while at < len(text):
                end = at + len(left)
                while end < len(text) and (text[end].isalnum() or text[end] == "_"):
                    end += 1
                name = text[at + len(left) : end]
                if text.startswith(left, at) and name and text.startswith(right, end) and text[at - 1 : at] != "%":
                    out, at = out + macros.get(name, left + name + right), end + len(right)
                else:
                    out, at = out + text[at], at + 1
            text = out
    return text


def test_spec_macros_are_expanded(run):
    rows = [(k, text, "spec_file") for k, text in enumerate(SPECS)]
    got = dict(run("SRC13_expanded_macros", documents=([*rows, (98, None, "spec_file"), (99, "%{name}", "readme")], "doc_id long, text string, source string")))
    assert got == {k: literal(text) for k, text, _ in rows}
    assert all(want is None or got[k] == want for k, want in enumerate(SPECS.values()))


KEYWORD, LICENSE = 1, 2


def blocks_by_lines(matches):
    """Lines painted one by one until nothing changes, with a flag per line of the file."""
    size = max(e for _, e, _ in matches) + 20
    on = [False] * size
    for s, e, pattern in matches:
        if pattern == KEYWORD and not any(q == LICENSE and a <= s and e <= b for a, b, q in matches):
            for x in range(s - 1, e + 2):
                on[x] = x > 0
    while True:
        old = list(on)
        for s, e, _ in matches:
            for x in range(max(s - 6, 1), s + 1):
                if on[x]:
                    on[x : e + 1] = [True] * (e + 1 - x)
                    break
            for x in range(e, e + 7):
                if on[x]:
                    on[s : x + 1] = [True] * (x + 1 - s)
                    break
        if on == old:
            break
    starts = [x for x in range(1, size) if on[x] and not on[x - 1]]
    return [(s, next(x for x in range(s, size) if x + 1 == size or not on[x + 1])) for s in starts]


@pytest.mark.parametrize("name", ["LA05_snippet_blocks", "WIN08_closure"])
def test_blocks_grow_through_all_matches(run, name):
    files = {
        1: [(10, 10, KEYWORD), (17, 20, LICENSE), (26, 26, KEYWORD)],  # a license between two keywords
        2: [(10, 10, KEYWORD), (18, 20, LICENSE)],  # seven lines away
        3: [(1, 5, LICENSE), (2, 2, KEYWORD), (40, 41, LICENSE)],  # no keyword outside of a license
        4: [(1, 1, KEYWORD), (9, 9, KEYWORD), (30, 30, LICENSE)],  # keywords whose lines around are seven lines apart
    }
    r = random.Random(5)
    for file in range(5, 60):
        spans = [(s, s + r.randint(0, 4)) for s in (r.randint(1, 60) for _ in range(r.randint(1, 7)))]
        files[file] = sorted({(s, e, r.choice([KEYWORD, LICENSE])) for s, e in spans}, key=lambda m: (m[0], m[1], m[2] == LICENSE))
    matches = [(k, file, 1, pattern, s, e, False, 0) for k, (file, (s, e, pattern)) in enumerate((f, m) for f, of in files.items() for m in of)]
    matches += [(9001, 1, 1, LICENSE, 30, 60, True, 0), (9002, 1, 1, LICENSE, 30, 60, False, 5)]
    patterns = [(KEYWORD, "", None, "", 0, False), (LICENSE, "", "MIT", "MIT", 1, False)]
    got = run(name, license_patterns=(patterns, PATTERNS), pattern_matches=(matches, MATCHES))
    assert [g[1:] for g in got if g[0] < 5] == [(9, 27), (9, 11), (1, 2), (8, 10)]
    assert got == sorted((file, *b) for file, of in files.items() for b in blocks_by_lines(of))


def test_unexplained_lines_are_counted_once_and_without_licenses(run):
    snippets = [(1, "a\nb\n \nd"), (2, "c\nd"), (3, None), (4, "only")]
    spans = [(1, 1, 1, 4), (1, 2, 4, 5), (1, 1, 1, 4), (2, 4, 7, 7), (3, 3, 2, 4), (4, 4, 1, 1), (4, 99, 8, 9), (5, 4, 1, 1)]
    occurrences = [(k, 1, file, snippet, s, e, 5 if file == 5 else 0) for k, (file, snippet, s, e) in enumerate(spans)]
    patterns = [(1, "", None, "", 0, False), (2, "", "MIT", "", 1, False), (3, "", "Any", "", 1, True), (4, "", "", "", 1, False)]
    found = [(1, 2, 2, 2, False, 0), (1, 2, 1, 2, True, 0), (1, 1, 4, 5, False, 0), (1, 4, 4, 5, False, 0), (1, 2, 5, 5, False, 7), (2, 3, 1, 90, False, 0), (3, 2, 3, 3, False, 0)]
    matches = [(k, file, 1, pattern, s, e, ignored, generation) for k, (file, pattern, s, e, ignored, generation) in enumerate(found)]
    tables = {"snippets": (snippets, "id long, text string"), "file_snippets": (occurrences, "id long, package long, file long, snippet long, sline int, eline int, generation int"), "license_patterns": (patterns, PATTERNS), "pattern_matches": (matches, MATCHES)}
    assert run("ST17_unexplained_lines", **tables) == [(1, 3), (2, 0), (3, 2), (4, 3)]


def test_only_the_given_builds_are_promoted(run):
    rows = [(1, 1, 0), (2, 1, 5), (3, 1, 7), (4, 2, 0), (5, 2, 9), (6, 3, 4)]
    matches = [(k, 1, package, 1, 1, 1, False, generation) for k, package, generation in rows]
    packages = [(1, "2025-01-01"), (2, None), (3, None)]
    got = run("SNK01_promoted_build", pattern_matches=(matches, MATCHES), bot_packages=(packages, "id long, indexed string"))
    assert got == [(2, 1, 5), (3, 1, 0), (4, 2, 0), (5, 2, 9), (6, 3, 4)]


def test_sha512(run):
    import hashlib

    assert run("SC17_sha512", snippets=([(1, "é"), (2, None)], "id long, text string")) == [(1, hashlib.sha512("é".encode()).hexdigest())]


def test_component_takes_the_one_license_below_its_directory(run):
    components = [(1, 1, "vendor/a/package.json", "pkg:npm/a", 0), (2, 1, "vendor/b/package.json", "pkg:npm/b", 0), (3, 1, "vendor/c/package.json", "pkg:npm/c", 0), (4, 1, "vendor/c/METADATA", "pkg:pypi/d", 0), (5, 2, "vendor/a/package.json", "pkg:npm/a", 0)]
    files = [(1, 1, "vendor/a/src/x.c", 0), (2, 1, "vendor/b/LICENSE", 0), (3, 1, "vendor/b/y.c", 0), (4, 1, "vendor/c/z.c", 0), (5, 1, "vendor/ab/w.c", 0)]
    patterns = [(1, "", "MIT", "MIT", 1, False), (2, "", "BSD", "BSD", 1, False), (3, "", "x", "", 1, False)]
    matches = [(1, 1, 1, 1, 1, 1, False, 0), (2, 1, 1, 3, 1, 1, False, 0), (3, 2, 1, 1, 1, 1, False, 0), (4, 3, 1, 2, 1, 1, False, 0), (5, 4, 1, 1, 1, 1, False, 0), (6, 5, 1, 2, 1, 1, False, 0), (7, 1, 1, 2, 1, 1, True, 0)]
    tables = {"package_components": (components, "id long, package long, source string, purl string, generation int"), "matched_files": (files, FILES), "license_patterns": (patterns, PATTERNS), "pattern_matches": (matches, MATCHES)}
    assert run("LA34_backfilled_components", **tables) == [(1, "MIT")]
