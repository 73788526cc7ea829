"""Components declared by manifest files of eight ecosystems."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest value that is kept.
LONGEST = 512
Found = tuple[str | None, str | None, str | None]  # name, version, license


def _header(text: str) -> dict[str, str]:
    return {k.lower(): v.strip() for k, v in re.findall(r"(?m)^([A-Za-z-]+)[ \t]*[:=][ \t]*(.+)$", text)}


def _npm(text: str) -> Found:
    d = json.loads(text)
    license_ = d.get("license")
    return d.get("name"), d.get("version"), license_.get("type") if isinstance(license_, dict) else license_


def _composer(text: str) -> Found:
    d = json.loads(text)
    license_ = d.get("license")
    return d.get("name"), d.get("version"), " OR ".join(license_) if isinstance(license_, list) else license_


def _cargo(text: str) -> Found:
    d = tomllib.loads(text).get("package", {})
    return d.get("name"), d.get("version"), d.get("license")


def _pypi(text: str) -> Found:
    h = _header(text.split("\n\n", 1)[0])
    return h.get("name"), h.get("version"), h.get("license-expression") or h.get("license")


def _maven(text: str) -> Found:
    h = _header(text)
    return (f"{h['groupid']}:{h['artifactid']}" if "groupid" in h and "artifactid" in h else None), h.get("version"), None


def _go(text: str) -> Found:
    m = re.search(r"(?m)^module\s+(\S+)", text)
    return m and m.group(1), None, None


def _gem(text: str) -> Found:
    value = lambda key: (m := re.search(rf"\.{key}\s*=\s*[\[\s]*[\"']([^\"']+)[\"']", text)) and m.group(1)
    return value("name"), value("version"), value("licenses?")


def _nuget(text: str) -> Found:
    value = lambda tag: (m := re.search(rf"<{tag}(?:\s[^>]*)?>\s*([^<]+?)\s*</{tag}>", text)) and m.group(1)
    return value("id"), value("version"), value("license")


def _go_vendored(text: str) -> list[Found]:
    return [(m[0], m[1] or None, None) for m in re.findall(r"(?m)^# (\S+)(?: (\S+))?", text)]


def _composer_installed(text: str) -> list[Found]:
    d = json.loads(text)
    return [_composer(json.dumps(p)) for p in (d.get("packages", []) if isinstance(d, dict) else d)]


#: Ecosystem, form of the path, reader of a file that declares one component or lists several.
READERS: tuple[tuple[str, str, Callable[[str], Found | list[Found]]], ...] = (
    ("golang", r"(?:^|/)modules\.txt$", _go_vendored), ("composer", r"(?:^|/)installed\.json$", _composer_installed),
    ("npm", r"(?:^|/)package\.json$", _npm), ("composer", r"(?:^|/)composer\.json$", _composer), ("cargo", r"(?:^|/)Cargo\.toml$", _cargo), ("pypi", r"(?:^|/)(?:METADATA|PKG-INFO)$", _pypi),
    ("maven", r"(?:^|/)pom\.properties$", _maven), ("golang", r"(?:^|/)go\.mod$", _go), ("gem", r"\.gemspec$", _gem), ("nuget", r"\.nuspec$", _nuget),
)


def purl(kind: str, name: str, version: str | None) -> str:
    plain = re.sub(r"[-_.]+", "-", name.lower()) if kind == "pypi" else name.replace(":", "/") if kind == "maven" else re.sub(r"^@", "%40", name)
    return f"pkg:{kind}/{plain}" + (f"@{version}" if version else "")


#: Files that list other components and declare none of their own.
LISTING = r"(?:^|/)(?:modules\.txt|installed\.json)$"


def own_manifest(path: Column, wrapped: Column) -> Column:
    """Whether a manifest describes the package that it lies in: at the top, or below the one directory that all files of
    the package lie in. Files that list other components never do."""
    level = F.size(F.split(path, "/")) - 1
    return ~path.rlike(LISTING) & ((level == 0) | ((level == 1) & wrapped))


def components(files: DataFrame, path_col: str = "path", text_col: str = "content", wrapped: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., source, type, name, version, license, purl) of the manifests among files. The package's own manifest is left out
    (see own_manifest; without `wrapped`, all packages are taken as wrapped). Files that cannot be read as what their name
    says, and null ones, give nothing."""
    manifest = "|".join(f"(?:{form})" for _, form, _ in READERS)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *kept, path, text in batch.itertuples(index=False):
                kind, _, reader = next(r for r in READERS if re.search(r[1], path))
                try:
                    found = reader(text)
                except (ValueError, AttributeError, TypeError):
                    continue
                for one in found if isinstance(found, list) else [found]:
                    name, version, license_ = (str(v).strip()[:LONGEST] if v else None for v in one)
                    if name:
                        rows.append((*kept, path, kind, name, version or None, license_ or None, purl(kind, name, version)))
            yield pd.DataFrame(rows, columns=[*keep, "source", "type", "name", "version", "license", "purl"])

    foreign = files.where(F.col(path_col).rlike(manifest) & F.col(text_col).isNotNull()).where(~own_manifest(F.col(path_col), F.lit(True) if wrapped is None else wrapped))
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for c in keep for f in files.schema if f.name == c)
    return foreign.select(*keep, path_col, text_col).mapInPandas(of, kept + "source string, type string, name string, version string, license string, purl string")
