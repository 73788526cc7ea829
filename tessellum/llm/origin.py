"""Problem 1: files that were generated, minified, copied from a third party, or that are data stored as code.

The tables of this project hold paths, not contents, so the named method is applied to what there is: each path is lexed
into its directories, stem words and endings, and these are compared with the forms in which tools name what they emit and
with the components that the same package lists. `source_layout` applies the method as named to source texts.

Defined results: a null or empty filename is no case; a null package has no components; names are compared without
regard to case, and _ and . count as -; blank component names fall back to the purl; repeated rows count once; an empty
component table leaves the rules on names; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions.text import basename
from tessellum.session import salted_join, shuffled

SALTS = 16

#: Directories that hold copies of other projects, whatever the letter case.
VENDOR = r"(?:_?vendor(?:ed)?|vendor\.tar\.[a-z0-9]+\._\.|third[_-]?party|3rd[_-]?party|externals?|bundled|node_modules|bower_components|jspm_packages|subprojects|godeps|_workspace|site-packages)"

#: What tools call their output: compilers of interfaces, grammars, bindings, forms and build descriptions.
GENERATED = (
    r"\.pb(?:\.gw)?\.(?:go|cc|h|c)$", r"_pb2(?:_grpc)?\.pyi?$", r"_grpc\.pb\.\w+$", r"_grpc_pb\.\w+$",
    r"[._-](?:auto)?generated\.\w+$", r"^zz_generated\.", r"[._-]gen\.(?:h|hpp|c|cc|cpp|go|ts|js|rs|java|py)$", r"\.g\.(?:dart|cs)$", r"\.freezed\.dart$",
    r"\.(?:graphql|generated)\.tsx?$", r"\.designer\.(?:cs|vb)$", r"^(?:moc|qrc|ui)_\w+\.(?:cpp|cxx|cc|h)$", r"_wrap\.(?:cxx|cpp|c)$",
    r"\.tab\.[ch](?:pp|c|xx)?$", r"^lex\.\w+\.c(?:c|pp|xx)?$", r"\.yy\.c(?:c|pp|xx)?$", r"^bindata\.go$", r"^aclocal\.m4$", r"^configure$", r"^makefile\.in$", r"^config\.h\.in$",
    r"\.pb\.(?:dart|swift)$", r"_pb\.(?:js|rb|d\.ts)$", r"\.g\.i\.cs$", r"^ui_\w+\.py$", r"^(?:r|buildconfig)\.java$", r"\.swagger\.json$", r"^(?:config\.guess|config\.sub|ltmain\.sh|depcomp|libtool\.m4)$", r"^y\.output$",
    r"^(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|composer\.lock|gemfile\.lock|poetry\.lock|pipfile\.lock|go\.sum|flake\.lock)$",
)
GENERATED_DIRECTORIES = r"(?:autogen|auto-?generated|__generated__|generated(?:[_-](?:sources?|src|code))?|gen|autom4te\.cache)"
#: Minified, packed or bundled for delivery, also by a content hash in the name.
MINIFIED = (
    r"[._-]min\.(?:m?js|cjs|css)$", r"\.(?:bundle|pack|packed|compressed|compiled|chunk)\.(?:m?js|css)$", r"[.-][0-9a-f]{8,}(?:\.chunk|\.bundle|\.min)?\.(?:m?js|css)$", r"\.(?:m?js|css)\.map$",
)
#: Tables, images and binaries written as source.
DATA = (
    r"\.xpm$", r"\.xbm$", r"\.(?:bin|dat|raw|rom)\.(?:c|h|inc|cpp)$", r"\.hex\.(?:h|c|inc)$", r"_rom\.(?:inc|h|c)$", r"_(?:blob|bitmap|image|bytes)\.(?:h|c|inc|xpm)$", r"[._-](?:b64|base64)\.(?:js|ts|css|py|h|c)$", r"\.wasm\.js$",
    r"_(?:ucd|unicode|lookup|lut|crc)_(?:tables?|data)\.\w+$", r"_(?:wordlist|lut|dict|table)_data\.\w+$", r"^embedded_\w+_(?:png|jpe?g|gif|ico|ttf|svg|wav|pdf)\.\w+$", r"[._-]dump\.sql$",
)


def _any(patterns: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def kind_by_name(filename: Column) -> Column:
    """third_party, generated, minified or data by the path alone; null if its form tells nothing."""
    base = basename(filename)
    return (
        F.when(filename.rlike(rf"(?i)(?:^|/){VENDOR}/"), "third_party")
        .when(base.rlike(_any(GENERATED)) | filename.rlike(rf"(?i)(?:^|/){GENERATED_DIRECTORIES}/"), "generated")
        .when(base.rlike(_any(MINIFIED)), "minified")
        .when(base.rlike(_any(DATA)), "data")
    )


def _folded(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[_.\s]+", "-")


def _short(name: Column) -> Column:
    """The last part of a component name, without its scope, group or host."""
    return F.regexp_extract(F.trim(name), r"([^/:]*)$", 1)


def component_names(components: DataFrame, packages: DataFrame) -> DataFrame:
    """(package, component): the short names of the components that a package lists, other than the package itself."""
    of_purl = F.regexp_extract("purl", r"^pkg:[^/]+/(?:[^@?#]*/)?([^/@?#]+)", 1)
    names = components.select(F.col("package").cast("long").alias("package"), F.explode(F.array(_short(F.col("name")), of_purl)).alias("component"))
    names = names.where(F.col("package").isNotNull()).select("package", _folded(F.col("component")).alias("component")).where("component <> ''").distinct()
    own = packages.select(F.col("id").cast("long").alias("package"), _folded(F.col("name")).alias("component")).distinct()
    return names.join(shuffled(own), ["package", "component"], "left_anti")


def classify(files: DataFrame, components: DataFrame, packages: DataFrame) -> DataFrame:
    """(file_id, kind): one row per distinct file row with a kind; a kind told by the name comes before the components."""
    rows = files.select(F.col("id").cast("long").alias("file_id"), F.col("package").cast("long").alias("package"), "filename").where("file_id is not null and filename <> ''").distinct().withColumn("kind", kind_by_name(F.col("filename")))
    named = rows.where("kind is not null").select("file_id", "kind")
    parts = F.split("filename", "/")
    directories = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda d: F.regexp_replace(d, r"[-@_]v?\d[\w.+~-]*$", ""))
    # a directory may also carry the digits in its name, so it is compared with and without them
    lexed = F.array_distinct(F.transform(F.concat(directories, F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.regexp_extract(F.element_at(parts, -1), r"^([^.]+)", 1))), _folded))
    open_rows = rows.where("kind is null and package is not null").select("file_id", "package", F.explode(lexed).alias("component"))
    copies = salted_join(open_rows, component_names(components, packages), ["package", "component"], SALTS, ["file_id"]).select("file_id").distinct()
    return named.union(copies.select("file_id", F.lit("third_party").alias("kind")))


def found(files: DataFrame, components: DataFrame, packages: DataFrame) -> DataFrame:
    """(file_id) of every file that was not written by hand for its package."""
    return classify(files, components, packages).select("file_id").distinct()


#: Lexemes of C-like and script languages: comments, strings, numbers, names, line ends, other signs.
LEXEME = re.compile(r"(?P<comment>//[^\n]*|/\*.*?\*/|\#[^\n]*)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<number>\b0x[0-9a-fA-F]+\b|\b\d[\w.]*)|(?P<name>[^\W\d]\w*)|(?P<sign>[^\w\s])", re.S)
#: Growth under canonical formatting from which a text counts as minified; share of literals from which it is data;
#: share of the commonest line form from which it is generated, with at least so many lines.
EXPANSION, LITERALS, UNIFORM, LINES = 1.6, 0.6, 0.8, 20


def layout_figures(text: str) -> tuple[float, float, float, int]:
    """(expansion, literal share, uniformity, lines) of a source text. Canonical formatting puts a line end after every ; { and
    } with an indentation by depth, and one space around signs and names."""
    kinds, out, depth, at_start, literal, total = Counter(), 0, 0, True, 0, 0
    for m in LEXEME.finditer(text):
        kind, lexeme = m.lastgroup, m.group()
        kinds[kind] += 1
        if kind in ("string", "number"):
            literal += len(lexeme)
        if kind != "comment":
            total += len(lexeme)
        if lexeme == "}":
            depth = max(0, depth - 1)
        out += len(lexeme) + (4 * depth if at_start else 1)
        at_start = lexeme in (";", "{", "}") or kind == "comment"
        if at_start:
            out += 1
        if lexeme == "{":
            depth += 1
    lines = [line.strip() for line in text.split("\n") if line.strip()]
    forms = Counter(re.sub(r"\d+", "0", re.sub(r"\"[^\"]*\"|'[^']*'", "s", re.sub(r"[^\W\d]\w*", "n", line))) for line in lines)
    uniform = max(forms.values()) / len(lines) if lines else 0.0
    return out / max(len(text), 1), literal / max(total, 1), uniform, len(lines)


def layout_kind(text: str | None) -> str:
    """hand_written, minified, generated, data or empty, from the layout of a text alone."""
    if text is None or not text.strip():
        return "empty"
    expansion, literals, uniform, lines = layout_figures(text)
    if literals >= LITERALS:
        return "data"
    if expansion >= EXPANSION and len(text) / max(lines, 1) > 200:
        return "minified"
    if uniform >= UNIFORM and lines >= LINES:
        return "generated"
    return "hand_written"


def source_layout(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, expansion, literals, uniform): the layout comparison over source texts."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, layout_kind(t), *layout_figures(t or "")[:3]) for i, t in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["id", "kind", "expansion", "literals", "uniform"])

    return texts.select(F.col(id_col).cast("long"), F.col(text_col)).mapInPandas(of, "id long, kind string, expansion double, literals double, uniform double")
