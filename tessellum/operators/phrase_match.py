"""Multi-pattern phrase matching over whole texts, with gaps.

A pattern is a sequence of words and gaps ($SKIPn: up to n words). Every pattern is filed under the hash of the first words of its
longest part without gaps, as many of them as the largest of RUNS that fits: long runs stand in few texts, while many patterns begin
with the same few words. The runs of a text are hashed where the text is and shuffled only if they pass a filter of the
patterns' keys, of bounded size; an equi join brings candidates together, and the rest of a candidate is compared word by word, in both
directions. Among overlapping matches of a text the longest wins, then the one that starts first, then the newer pattern."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions.text import words
from tessellum.session import shuffled

#: Words of the runs that patterns are filed under.
RUNS = (1, 2, 3, 4, 5, 6, 8, 12, 16)
#: Bits of the filter per pattern, as a power of two, and of the largest filter (32 MB).
FILTER_BITS, FILTER_MOST = 6, 28
#: Most words of a gap.
MOST_SKIP = 99
_GAP = re.compile(r"\$skip(\d*)")


def pattern_tokens(pattern: str) -> list[str]:
    """Lower-case words; a gap is written as a # and its length. Gaps at either end say nothing and are dropped."""
    out: list[str] = []
    for part in re.split(r"(\$skip\d*)", pattern.lower()):
        if m := _GAP.fullmatch(part):
            gap = min(int(m.group(1) or MOST_SKIP), MOST_SKIP)
            if out and out[-1][0] == "#":
                gap = min(gap + int(out.pop()[1:]), MOST_SKIP)
            out.append(f"#{gap}")
        else:
            out += re.findall(r"[^\W_]+", part)
    while out and out[0][0] == "#":
        out.pop(0)
    while out and out[-1][0] == "#":
        out.pop()
    return out


def match_end(tokens: list[str], text: list[str], at: int) -> int:
    """The farthest end (exclusive) of a match of tokens that begins at a place of the text; -1 if there is none."""
    ends = {at}
    for token in tokens:
        if token[0] == "#":
            ends = {e + k for e in ends for k in range(int(token[1:]) + 1) if e + k <= len(text)}
        else:
            ends = {e + 1 for e in ends if e < len(text) and text[e] == token}
        if not ends:
            return -1
    return max(ends)


def match_starts(tokens: list[str], text: list[str], at: int) -> set[int]:
    """The places of the text from which tokens lead to a place."""
    starts = {at}
    for token in reversed(tokens):
        if token[0] == "#":
            starts = {s - k for s in starts for k in range(int(token[1:]) + 1) if s >= k}
        else:
            starts = {s - 1 for s in starts if s > 0 and text[s - 1] == token}
    return starts


def spans_at(tokens: list[str], part: int, text: list[str], at: int, pattern: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, pattern) of the matches whose token number `part` stands at a place of the text."""
    for start in match_starts(tokens[:part], text, at) if text[at] == tokens[part] else ():
        if (end := match_end(tokens, text, start)) > start:
            yield start, end, pattern


_CODES: dict[str, int] = {}


def word_code(word: str) -> int:
    """64 bits of a word. Remembers a bounded number of words."""
    if (code := _CODES.get(word)) is None:
        if len(_CODES) > 500_000:
            _CODES.clear()
        _CODES[word] = code = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest())
    return code


def run_keys(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(run, key of the words from each place on) for all RUNS that fit, of the codes of words."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    for run in range(1, min(RUNS[-1], len(codes)) + 1):
        sums = sums[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[run - 1 :]
        if run in RUNS:
            x = (sums ^ np.uint64(run)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            yield run, x ^ (x >> np.uint64(31))


def filed(tokens: list[str]) -> tuple[str, int, int]:
    """The tokens as one string, where the longest part without gaps begins, and the key of its first words."""
    if not tokens:
        return "", 0, 0
    gaps = [-1, *(k for k, t in enumerate(tokens) if t[0] == "#"), len(tokens)]
    part, end = max(((a + 1, b) for a, b in zip(gaps, gaps[1:])), key=lambda x: x[1] - x[0])
    codes = np.array([word_code(t) for t in tokens[part : min(end, part + RUNS[-1])]], np.uint64)
    *_, (_, keys) = run_keys(codes)
    return " ".join(tokens), part, int(keys[:1].view(np.int64)[0])


def pattern_in_text(pattern: str, text: str) -> bool:
    """Whether a single pattern matches anywhere in a text."""
    tokens, found = pattern_tokens(pattern), re.findall(r"[^\W_]+", text.lower())
    return bool(tokens) and any(match_end(tokens, found, at) > at for at in range(len(found)))


def choose(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans (start, end, pattern), those that win where they overlap, in text order."""
    kept: list[tuple[int, int, int]] = []
    for span in sorted(spans, key=lambda s: (s[0] - s[1], s[0], -s[2])):
        if all(span[1] <= k[0] or k[1] <= span[0] for k in kept):
            kept.append(span)
    return sorted(kept)


def words_of_lines(text: Column) -> Column:
    """Array of (w, line): the words of a text with their lines from 1."""
    of_line = lambda line, at: F.transform(words(line), lambda w: F.struct(w.alias("w"), (at + 1).alias("line")))
    return F.flatten(F.transform(F.split(text, "\n"), of_line))


def matches(texts: DataFrame, patterns: DataFrame, id_col: str, text_col: str, pattern_id: str = "id", pattern_col: str = "pattern", resolve: bool = True) -> DataFrame:
    """(text_id, pattern_id, start, end, sline, eline): word positions from 0, end exclusive, and lines from 1. With `resolve`,
    overlaps are decided."""

    size = min(FILTER_MOST, FILTER_BITS + max(patterns.count(), 16).bit_length())

    @F.pandas_udf("tokens string, part int, key long")
    def filed_under(pattern: pd.Series) -> pd.DataFrame:
        rows = [filed(pattern_tokens(p)) for p in pattern]
        return pd.DataFrame({"tokens": [t for t, _, _ in rows], "part": pd.array([k for _, k, _ in rows], "int32"), "key": pd.array([k for _, _, k in rows], "int64")})

    coded = patterns.where(F.col(pattern_col).isNotNull()).select(F.col(pattern_id).cast("long").alias("pattern_id"), filed_under(pattern_col).alias("f")).select("pattern_id", "f.*").where("tokens <> ''")
    bits = coded.select(F.shiftrightunsigned("key", 64 - size + 6).alias("word"), F.expr("shiftleft(1L, CAST(key & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    among = np.zeros(1 << (size - 6), np.uint64)
    among[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(among)  # of bounded size

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = shared.value
        for batch in batches:
            w = batch["w"].flatten().dictionary_encode()
            codes = np.array([word_code(x) for x in w.dictionary.to_pylist()], np.uint64)[w.indices.to_numpy()]
            n = batch["w"].value_lengths().to_numpy()
            end, text = np.repeat(np.cumsum(n), n), np.repeat(batch["text_id"].to_numpy(), n)
            place = np.arange(len(codes))
            start = end - np.repeat(n, n)
            for run, keys in run_keys(codes):
                passed = among[keys >> np.uint64(64 - size + 6)] >> (keys & np.uint64(63)) & np.uint64(1) != 0
                at = np.flatnonzero(passed & (place[: len(keys)] + run <= end[: len(keys)]))
                yield pa.RecordBatch.from_arrays([pa.array(text[at], pa.int64()), pa.array((place - start)[at], pa.int32()), pa.array(keys[at].view(np.int64))], ["text_id", "at", "key"])

    given = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("text_id"), F.col(text_col).alias("text"))
    placed = given.select("text_id", words(F.col("text")).alias("w")).mapInArrow(hits, "text_id long, at int, key long")
    met = placed.join(shuffled(coded), "key").groupBy("text_id").agg(F.collect_list(F.struct("pattern_id", "tokens", "part", "at")).alias("met"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, w, line, out = batch["of"].offsets.to_pylist(), batch["of"].values.field("w"), batch["of"].values.field("line"), []
            for k, (i, met) in enumerate(zip(batch["text_id"].to_pylist(), batch["met"], strict=True)):
                text, lines = w[of[k] : of[k + 1]].to_pylist(), line[of[k] : of[k + 1]].to_pylist()
                found = {s for m in met.as_py() for s in spans_at(m["tokens"].split(" "), m["part"], text, m["at"], m["pattern_id"])}
                out += [(i, pattern, s, e, lines[s], lines[e - 1]) for s, e, pattern in (choose(list(found)) if resolve else found)]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 4, strict=True)], ["text_id", "pattern_id", "start", "end", "sline", "eline"])

    # the candidates and matches of one text
    both = given.join(shuffled(met), "text_id").select("text_id", words_of_lines(F.col("text")).alias("of"), "met")
    return both.mapInArrow(spans, "text_id long, pattern_id long, start int, end int, sline int, eline int")
