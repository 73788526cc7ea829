"""Problem 4: long stretches of text that stand verbatim in the text of another file.

Fixed-block anchors. Any stretch of at least `span` characters contains a whole block of span / 2 characters of any text that
holds it, if that text is cut into blocks that do not overlap. So

1. the blocks of all texts are indexed by hash; per hash only the smallest and the largest file are kept, which answers "does it
   stand in another file" without listing the texts of a block;
2. every rolling window of every text is probed against the index (a rolling hash, computed for all positions at once). A Bloom
   filter of the block hashes is asked first, so that about one row a hit leaves the text and not one a window; filters have a
   bounded size, and an index that is too large for one is probed in several rounds, each with the filter of its share of
   the hashes. Windows whose block stands only in the text's own file end here;
3. hits are extended to the maximal exact repeats: around each anchor, on both sides, all windows of the full span are
   hashed with 128 bits over the characters themselves and met by equality; runs of met windows are the maximal repeats, and
   the characters under them are counted.

Each step is a partial aggregate or a join with a unique key, so a block that stands in a third of all texts costs as much
as any other one; no pairs of texts are ever listed. A text that stands as a whole in two files is shared as a whole and is
not probed.

Defined results: null texts and texts shorter than the span share nothing; repeated rows count once; occurrences
without a file or snippet are ignored; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.session import cut, salted_join, shuffled

#: Least length of a shared stretch, in characters.
SPAN = 200
#: Parts over which the windows of one hash are spread before the join with the index, whose keys are unique.
SALTS = 4
#: Bits of the filter per block of the index, and the most bits of one filter (32 MB).
FILTER_BITS, FILTER_MOST = 16, 1 << 28
#: Rolling hashes are polynomials modulo 2^64 in an odd base. They only choose anchors; equality is decided later.
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def rolling_hashes(text: str, width: int) -> np.ndarray:
    """The hash of text[i : i + width] for every i."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < width:
        return np.empty(0, np.uint64)
    power = np.full(len(codes), np.uint64(BASE))
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate((codes + np.uint64(1)) * power)])
    window = sums[width:] - sums[:-width]
    back = np.full(len(window), np.uint64(pow(BASE, -1, 1 << 64)))
    back[0] = 1
    value = window * np.multiply.accumulate(back)
    return value ^ (value >> np.uint64(29))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the public SplitMix64 constants)."""
    x = x.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rows(hashes: np.ndarray, at: np.ndarray, text_id: int) -> Iterator[pa.RecordBatch]:
    for part in range(0, len(at), 100_000):
        sub = at[part : part + 100_000]
        yield pa.RecordBatch.from_pydict({"hash": hashes[sub].view(np.int64), "text_id": np.full(len(sub), text_id), "at": sub.astype(np.int64)})


def _blocks(width: int):
    """(hash, text_id, at) of the blocks of each text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text_id, text in zip(batch.column("text_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hashes = rolling_hashes(text, width)
                yield from _rows(hashes, np.arange(0, len(hashes), width), text_id)

    return of


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a filter of `bits` bits, a power of two."""
    mixed, mask = _mix(hashes), np.uint64(bits - 1)
    return mixed & mask, (mixed >> np.uint64(32)) & mask


def _share(hashes: np.ndarray, rounds: int) -> np.ndarray:
    """The round in which a hash is probed."""
    return (_mix(hashes ^ np.int64(1)) >> np.uint64(8)) % np.uint64(rounds)


def _windows(width: int, shared, bits: int, rounds: int, turn: int):
    """(hash, text_id, at) of all windows of each text whose hash may be in the index."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        held = lambda place: (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        for batch in batches:
            for text_id, text in zip(batch.column("text_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hashes = rolling_hashes(text, width).view(np.int64)
                if rounds > 1:
                    at = np.flatnonzero(_share(hashes, rounds) == turn)
                else:
                    at = np.arange(len(hashes))
                one, two = _places(hashes[at], bits)
                yield from _rows(hashes, at[held(one) & held(two)], text_id)

    return of


def _filter(index: DataFrame, bits: int, rounds: int, turn: int) -> np.ndarray:
    """The filter of one round: 64-bit words, at most FILTER_MOST / 64 of them whatever the size of the index."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hash").to_numpy(zero_copy_only=False)
            both = np.concatenate(_places(hashes[_share(hashes, rounds) == turn], bits))
            yield pa.RecordBatch.from_pydict({"word": (both >> np.uint64(6)).astype(np.int32), "bit": (np.uint64(1) << (both & np.uint64(63))).view(np.int64)})

    table = index.select("hash").mapInArrow(places, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(max(bits // 64, 1), np.uint64)
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return words


def _probed(texts: DataFrame, index: DataFrame, width: int, most: int) -> DataFrame:
    """(hash, text_id, at) of the windows of the texts that may stand in the index: every one that does, and few others."""
    blocks = max(index.count(), 1)
    rounds = -(-blocks * FILTER_BITS // most)
    bits = min(most, max(64, 1 << (blocks * FILTER_BITS - 1).bit_length()))
    out = None
    for turn in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast(_filter(index, bits, rounds, turn))  # bounded by FILTER_MOST
        part = texts.mapInArrow(_windows(width, shared, bits, rounds, turn), "hash long, text_id long, at long")
        out = part if out is None else out.union(part)
    return out


def _spans(span: int, width: int):
    """(high, low, text_id, at, first_file, last_file): a 128-bit digest of each window of the span that holds one of a text's
    anchors."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for text_id, text, first, last, anchors in zip(*(batch.column(c).to_pylist() for c in ("text_id", "text", "first_file", "last_file", "anchors")), strict=True):
                near = np.zeros(max(len(text) - span + 1, 0) + 1, np.int64)
                for a in anchors:
                    near[min(max(a - (span - width), 0), len(near) - 1)] += 1
                    near[min(a + 1, len(near) - 1)] -= 1
                at = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                for part in range(0, len(at), 100_000):
                    sub = at[part : part + 100_000]
                    digests = [xxhash.xxh3_128_intdigest(text[i : i + span].encode("utf-8", "surrogatepass")) for i in sub]
                    yield pa.RecordBatch.from_pydict({
                        "high": np.array([d >> 64 for d in digests], np.uint64).view(np.int64),
                        "low": np.array([d & _MASK for d in digests], np.uint64).view(np.int64),
                        "text_id": np.full(len(sub), text_id), "at": sub.astype(np.int64), "first_file": np.full(len(sub), first), "last_file": np.full(len(sub), last),
                    })

    return of


def shared_characters(texts: DataFrame, span: int = SPAN, most: int = FILTER_MOST) -> DataFrame:
    """(text_id, shared) for distinct texts (text_id, text, first_file, last_file): the characters of each text that lie in a
    stretch of at least `span` that also stands in a text of another file. Texts that share nothing are left out."""
    width = span // 2
    texts = texts.where(F.length("text") >= span)
    several = texts.where("first_file <> last_file").select("text_id", F.length("text").cast("long").alias("shared"))
    single = texts.where("first_file = last_file")
    files = texts.select("text_id", "first_file", "last_file")

    blocks = texts.select("text_id", "text").mapInArrow(_blocks(width), "hash long, text_id long, at long")
    index = cut(blocks.join(shuffled(files), "text_id").groupBy("hash").agg(F.min("first_file").alias("f0"), F.max("last_file").alias("f1")))
    probes = _probed(single.select("text_id", "text"), index, width, most)
    # the file of a probe comes with its text only after the index has been met
    met = salted_join(probes, index, ["hash"], SALTS, ["text_id", "at"])
    own = single.select("text_id", F.col("first_file").alias("file"))
    hits = cut(met.join(shuffled(own), "text_id").where("f0 <> file or f1 <> file").select("hash", "text_id", "at"))
    # the blocks that were hit, in the texts that hold them
    held = blocks.join(shuffled(hits.select("hash").distinct()), "hash", "left_semi").select("text_id", "at")
    # anchors of one text: at most as many as it has characters
    anchors = hits.select("text_id", "at").union(held).groupBy("text_id").agg(F.collect_set("at").alias("anchors"))
    around = texts.join(shuffled(anchors), "text_id").select("text_id", "text", "first_file", "last_file", "anchors")
    windows = cut(around.mapInArrow(_spans(span, width), "high long, low long, text_id long, at long, first_file long, last_file long"))
    equal = windows.groupBy("high", "low").agg(F.min("first_file").alias("f0"), F.max("last_file").alias("f1")).where("f0 <> f1")
    repeats = salted_join(windows.where("first_file = last_file"), equal, ["high", "low"], SALTS, ["text_id", "at"]).select("text_id", "at")

    @F.pandas_udf("long")
    def covered(starts: pd.Series) -> pd.Series:
        out = []
        for s in starts:
            a = np.sort(np.asarray(s))
            out.append(int(np.minimum(np.diff(a), span).sum() + span))
        return pd.Series(out, dtype="int64")

    partly = repeats.groupBy("text_id").agg(F.collect_set("at").alias("starts")).select("text_id", covered("starts").alias("shared"))
    return several.union(partly)


def live_occurrences(file_snippets: DataFrame) -> DataFrame:
    return file_snippets.where("generation = 0 and file is not null and snippet is not null").select(F.col("file").cast("long").alias("file"), F.col("snippet").cast("long").alias("snippet")).distinct()


def occurrences_shared(file_snippets: DataFrame, snippets: DataFrame, span: int = SPAN) -> DataFrame:
    """(file, snippet, chars, shared): every live pair of file and snippet with the length of its text and how much of it is
    shared."""
    pairs = live_occurrences(file_snippets)
    owned = pairs.groupBy("snippet").agg(F.min("file").alias("f0"), F.max("file").alias("f1"))
    text = snippets.select(F.col("id").cast("long").alias("snippet"), "text").where("text is not null").dropDuplicates(["snippet"])
    digest = F.sha2("text", 256)
    with_files = text.join(shuffled(owned), "snippet")
    # snippets with the same text are one text; it is named by the smallest snippet
    keyed = cut(with_files.select("snippet", digest.alias("key"), F.length("text").cast("long").alias("chars"), "f0", "f1"))
    named = keyed.groupBy("key").agg(F.min("snippet").alias("text_id"), F.min("f0").alias("first_file"), F.max("f1").alias("last_file"))
    texts = cut(text.join(shuffled(named), text.snippet == named.text_id).select("text_id", "text", "first_file", "last_file"))
    amounts = shared_characters(texts, span)
    per_snippet = keyed.join(shuffled(named.select("key", "text_id")), "key").join(shuffled(amounts), "text_id", "left").select("snippet", "chars", F.coalesce("shared", F.lit(0)).alias("shared"))
    return salted_join(pairs, per_snippet, ["snippet"], 16, ["file"]).select("file", "snippet", "chars", "shared")


def found(file_snippets: DataFrame, snippets: DataFrame, span: int = SPAN) -> DataFrame:
    """(file_id, snippet_id, shared_chars), where something is shared."""
    return occurrences_shared(file_snippets, snippets, span).where("shared > 0").select(F.col("file").alias("file_id"), F.col("snippet").alias("snippet_id"), F.col("shared").alias("shared_chars"))


def per_file(file_snippets: DataFrame, snippets: DataFrame, span: int = SPAN) -> DataFrame:
    """(file_id, chars, shared_chars, share): how much of each file's snippet texts stands in other files."""
    rows = occurrences_shared(file_snippets, snippets, span).groupBy(F.col("file").alias("file_id")).agg(F.sum("chars").alias("chars"), F.sum("shared").alias("shared_chars"))
    return rows.withColumn("share", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(F.lit(0.0)))
