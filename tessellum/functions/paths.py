"""Column expressions over paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellum.functions.text import basename

# Fixed values, which the statement of problem 5 asks for: endings of source files, and names of license files.
SOURCE_EXTENSIONS = (
    "asm awk bash c cc cjs cpp cs cxx dart el go gradle groovy h hh hpp java jl js jsx kt lua mjs mm "
    "php pl pm py rb rs scala sh sql swift tcl ts tsx vim"
).split()
LICENSE_NAMES = r"^(?:LICEN[CS]E|COPYING|COPYRIGHT|NOTICE|EULA|LEGAL|UNLICENSE|THIRD[_-]?PARTY)(?:[.\-]|$)"


def is_license_filename(path: Column) -> Column:
    """Whether the last part of a path names a license file; false for null."""
    base = basename(path)
    return F.coalesce(base.rlike(f"(?i){LICENSE_NAMES}") & ~base.rlike(rf"(?i)\.(?:{'|'.join(SOURCE_EXTENSIONS)})$"), F.lit(False))


def dir_key(path: Column) -> Column:
    """The directory of a path; a file of the top directory stands for itself."""
    return F.regexp_replace(path, "/[^/]*$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def ancestors(path: Column) -> Column:
    """All directories above a path, from the empty top one down."""
    parts = F.split(path, "/")
    inner = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("")), inner)


def glob_regex(glob: str) -> str:
    """A regular expression for a glob in which * also matches slashes."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


# Names of directories that hold no code of the package itself.
PERIPHERAL = {
    "documentation": ("doc", "docs", "documentation"),
    "test": ("test", "tests", "testing", "testdata", "test-data", "test_data", "__tests__", "fixtures"),
    "example": ("example", "examples", "sample", "samples"),
    "vendored": ("vendor", "vendored", "_vendor", "third_party", "third-party", "3rdparty", "contrib", "node_modules", "gomodcache"),
    "license catalog": ("licenses",),
}
PACKED_VENDORED = r"(?:^|_)(?:node_modules|vendor|vendored|third_party|3rdparty)\."


def peripheral_kind(path: Column) -> Column:
    """The kind of the directories that a file lies in, or null for the package's own code. The outermost kind other than
    vendored counts, because the tests of a vendored copy are tests; else vendored, if any directory is."""
    parts = F.split(F.lower(path), "/")

    def kind(part: Column) -> Column:
        out = F
        for name, members in PERIPHERAL.items():
            out = out.when(part.isin(*members), name)
        return out.when(part.rlike(PACKED_VENDORED), "vendored")

    kinds = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), kind)
    return F.coalesce(F.get(F.filter(kinds, lambda k: k != "vendored"), F.lit(0)), F.when(F.array_contains(kinds, "vendored"), F.lit("vendored")))


def tier(path: Column) -> Column:
    """0 for shipped source, 1 for vendored code, 2 for tests, documents, examples and license catalogs."""
    kind = peripheral_kind(path)
    return F.when(kind.isNull(), 0).when(kind == "vendored", 1).otherwise(2)
