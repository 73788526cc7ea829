"""SQL for the tests on paths, from the fixed values in one place."""

from __future__ import annotations

from tessellum.functions.paths import LICENSE_NAMES, PACKED_VENDORED, PERIPHERAL, SOURCE_EXTENSIONS


def license_file(path: str) -> str:
    return rf"(regexp_matches(regexp_extract({path}, '[^/]*$'), '(?i){LICENSE_NAMES}') AND NOT regexp_matches({path}, '(?i)\.(?:{'|'.join(SOURCE_EXTENSIONS)})$'))"


_SEGMENT = " ".join(f"WHEN s IN ({', '.join(repr(x) for x in members)}) THEN '{kind}'" for kind, members in PERIPHERAL.items())


def kind(path: str) -> str:
    kinds = f"[CASE {_SEGMENT} WHEN regexp_matches(s, '{PACKED_VENDORED}') THEN 'vendored' END FOR s IN string_split(lower({path}), '/')[:-2]]"
    return f"coalesce([k FOR k IN {kinds} IF k <> 'vendored'][1], CASE WHEN list_contains({kinds}, 'vendored') THEN 'vendored' END)"


def tier(path: str) -> str:
    return f"CASE coalesce({kind(path)}, '') WHEN '' THEN 0 WHEN 'vendored' THEN 1 ELSE 2 END"
