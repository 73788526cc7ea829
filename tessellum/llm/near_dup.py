"""Problem 2: records that share most of their content, by pigeonring filtering.

The set of word shingles of a record is a 0/1 vector. The vector is divided into a ring of m segments by hash. With d
differences and u shingles in the union, a Jaccard similarity of at least t is the same as d <= (1 - t) * u over the whole
ring. If that holds for the ring, some segment starts a chain of consecutive segments for which it holds after every
step (the cycle lemma), so that each prefix of the chain stays within a budget proportional to its size. Hence

* candidates must agree on the first segment of a chain within its own budget. A segment of a shingles may lose at most
  floor((1 - t) * a) of them; the record is listed under the hash of every remainder, and two records meet at the
  intersection. No true pair is lost. Segments hold about two or three shingles, so most are listed just once.
* candidates are pruned by the chains of two and four segments that go on from there, and by the whole ring, with
  bit sketches whose differences never exceed the true ones;
* signatures are shuffled and sorted once; runs of equal ones are compared as they stream by. A signature that many records
  share, such as one of boilerplate alone, is not compared as it is: its records are listed again under the signature together
  with the remainders of the chain of two segments that begins there, which is in its budget for every true pair, too.
  What is still shared by many is split into blocks of records, and every pair of blocks is a key of its own;
* what is left is compared in full.

m depends on the size of the set in powers of two. The larger of two records that can be similar is at most one power
higher, so a record is listed at its own level and at that of its smallest possible partner.

Defined results: null texts and texts with fewer words than a shingle are in no pair; records with the same words are one
class and take part once; repeated rows with one id count once; an empty table gives no pairs; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.functions.text import shingle_hashes, words
from tessellum.operators.components import connected_components
from tessellum.session import cut, shuffled

#: A ring has as many segments as a set has shingles divided by this number, rounded down to a power of two.
SEGMENT = 1.5
#: Records that may share a signature before its chain is lengthened, and the segments of the longer chain.
HOT, LONGER = 256, 2
SIGNATURES = "sig long, rec long, n int, ring long, chain long"
SIGNATURE = ("sig", "rec", "n", "ring", "chain")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the public SplitMix64 constants)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _level(n: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.floor(np.log2(np.maximum(n / SEGMENT, 1)))).astype(np.int64)


def _signatures(rec: np.ndarray, sizes: np.ndarray, shingles: np.ndarray, levels: np.ndarray, slack: float) -> dict[str, np.ndarray]:
    """Signature rows of a batch at one level per record. shingles: the sets one after the other, sizes[i] of rec[i]."""
    x = _mix(shingles.view(np.uint64))
    owner = np.repeat(np.arange(len(rec)), sizes)
    ring_bits = np.zeros(len(rec), np.uint64)
    np.bitwise_xor.at(ring_bits, owner, np.uint64(1) << ((x >> np.uint64(50)) & np.uint64(63)))
    m = np.int64(1) << levels
    base = np.concatenate([[0], np.cumsum(m)])
    cell = base[owner] + (x & (m[owner] - 1).astype(np.uint64)).astype(np.int64)
    cells = int(base[-1])
    count = np.bincount(cell, minlength=cells).astype(np.int64)
    total, bits = np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
    np.add.at(total, cell, x)
    np.bitwise_xor.at(bits, cell, np.uint64(1) << ((x >> np.uint64(40)) % np.uint64(24)))
    of = np.repeat(np.arange(len(rec)), m)
    place = np.arange(cells) - base[of]
    chains = {}
    for length in (2, 4):
        c, b = count.copy(), bits.copy()
        for step in range(1, length):
            on = m[of] > step
            after = base[of] + (place + step) % m[of]
            c += np.where(on, count[after], 0)
            b ^= np.where(on, bits[after], np.uint64(0))
        chains[length] = c, b
    chain = chains[2][1] | (chains[4][1] << np.uint64(24)) | (np.minimum(chains[2][0], 255).astype(np.uint64) << np.uint64(48)) | (np.minimum(chains[4][0], 127).astype(np.uint64) << np.uint64(56))
    seed = _mix((levels[of].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64))
    # the whole of each segment that isn't empty, then each with one shingle less, then the rare larger remainders
    whole = np.flatnonzero(count)
    losing = np.floor(slack * count + 1e-9).astype(np.int64)
    one = np.flatnonzero(losing[cell] >= 1)
    listed, sums = [whole, cell[one]], [total[whole], total[cell[one]] - x[one]]
    many = np.flatnonzero(losing >= 2)
    if len(many):
        order = np.argsort(cell, kind="stable")
        start = np.searchsorted(cell[order], many)
        for k, s in zip(many, start, strict=True):
            held = [int(v) for v in x[order[s : s + count[k]]]]
            rest = [sum(gone) for r in range(2, losing[k] + 1) for gone in combinations(held, r)]
            listed.append(np.full(len(rest), k))
            sums.append((total[k] - np.array([v & 0xFFFFFFFFFFFFFFFF for v in rest], np.uint64)).astype(np.uint64))
    at, value = np.concatenate(listed), np.concatenate(sums)
    return {"sig": _mix(value ^ seed[at]).view(np.int64), "rec": rec[of[at]], "n": sizes[of[at]].astype(np.int32), "ring": ring_bits[of[at]].view(np.int64), "chain": chain[at].view(np.int64), "place": place[at]}


def _signer(threshold: Fraction):
    slack = float(1 - threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):  # bounds the memory of a step, whatever the batch size
                batch = whole.slice(at, 2000)
                rec = batch.column("rec").to_numpy(zero_copy_only=False)
                lists = batch.column("shingles")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                shingles = lists.flatten().to_numpy(zero_copy_only=False)
                own = _level(sizes)
                least = _level(np.ceil(sizes * float(threshold) - 1e-9))
                parts = [_signatures(rec, sizes, shingles, own, slack)]
                if (low := least != own).any():
                    parts.append(_signatures(rec[low], sizes[low], shingles[np.repeat(low, sizes)], least[low], slack))
                for part in parts:
                    yield pa.RecordBatch.from_pydict({c: part[c] for c in SIGNATURE})

    return sign


def _longer(threshold: Fraction):
    """Rows (rec, shingles, sigs) to signature rows for the longer chains of those signatures."""
    slack = float(1 - threshold)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict[str, np.ndarray]] = []
            held_rows = 0
            for rec, held, wanted in zip(batch.column("rec").to_pylist(), batch.column("shingles"), batch.column("sigs"), strict=True):
                shingles, wanted = np.array(held.as_py(), np.int64), np.array(wanted.as_py(), np.int64)
                sizes = np.array([len(shingles)], np.int64)
                x = _mix(shingles.view(np.uint64))
                for level in sorted({int(_level(sizes)[0]), int(_level(np.ceil(sizes * float(threshold) - 1e-9))[0])}):
                    rows = _signatures(np.array([rec]), sizes, shingles, np.array([level]), slack)
                    m, place = 1 << level, (x & np.uint64((1 << level) - 1)).astype(np.int64)
                    hit = np.isin(rows["sig"], wanted)
                    for k in np.flatnonzero(hit):
                        start = rows["place"][k]
                        block = [int(v) for v in x[(place - start) % m < LONGER]]
                        total, losing = sum(block), int(slack * len(block) + 1e-9)
                        rest = [total - sum(gone) for r in range(losing + 1) for gone in combinations(block, r)]
                        keys = _mix(np.array([v & 0xFFFFFFFFFFFFFFFF for v in rest], np.uint64) ^ rows["sig"][k : k + 1].view(np.uint64)).view(np.int64)
                        out.append({"sig": keys, **{c: np.repeat(rows[c][k], len(keys)) for c in ("rec", "n", "ring", "chain")}})
                        held_rows += len(keys)
                if held_rows > 50_000:
                    yield pa.RecordBatch.from_pydict({c: np.concatenate([o[c] for o in out]) for c in out[0]})
                    out, held_rows = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({c: np.concatenate([o[c] for o in out]) for c in out[0]})

    return of


def _pairs(rows: dict[str, np.ndarray], first: np.ndarray, second: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Which pairs of places pass the filters: the sizes, the chains of two and four segments, the whole ring. Sketches never
    differ in more bits than the sets in shingles; sizes of chains are cut off where they fill their bits, and then say nothing."""
    ratio = float((1 - threshold) / (1 + threshold))
    n = rows["n"].astype(np.int64)
    a, b = n[first], n[second]
    ok = np.minimum(a, b) * threshold.denominator >= np.maximum(a, b) * threshold.numerator
    ring, chain = rows["ring"].view(np.uint64), rows["chain"].view(np.uint64)
    ok &= np.bitwise_count(ring[first] ^ ring[second]) <= (a + b) * ratio + 1e-9
    for at, size_at, full in ((0, 48, 255), (24, 56, 127)):
        bits, size = (chain >> np.uint64(at)) & np.uint64((1 << 24) - 1), ((chain >> np.uint64(size_at)) & np.uint64(full)).astype(np.int64)
        x, y = size[first], size[second]
        ok &= (x >= full) | (y >= full) | (np.bitwise_count(bits[first] ^ bits[second]) <= (x + y) * ratio + 1e-9)
    return ok


def _runs(threshold: Fraction, hot: int):
    """Sorted signature rows to (hot, a, b): candidate pairs of the runs of up to `hot` rows, and (true, sig, rec) for every row
    of a longer run. A run is held only up to that length, however long it is."""

    def listed(kind: bool, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_pydict({"hot": np.full(len(a[at : at + 100_000]), kind), "a": a[at : at + 100_000], "b": b[at : at + 100_000]})

    def compared(rows: dict[str, np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for size in np.unique(sizes[sizes > 1]):
            i, j = np.triu_indices(int(size), 1)
            of = starts[sizes == size]
            for at in range(0, len(of), step := max(1, 500_000 // len(i))):
                first, second = ((of[at : at + step, None] + k[None, :]).ravel() for k in (i, j))
                ok = _pairs(rows, first, second, threshold)
                a, b = rows["rec"][first[ok]], rows["rec"][second[ok]]
                one = a != b
                yield from listed(False, np.minimum(a, b)[one], np.maximum(a, b)[one])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] | None = None
        long_run = None  # the signature of a run that is known to be hot
        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in SIGNATURE}
            rows = {c: np.concatenate([kept[c], rows[c]]) for c in SIGNATURE} if kept is not None else rows
            if not len(rows["sig"]):
                continue
            starts = np.flatnonzero(np.concatenate([[True], rows["sig"][1:] != rows["sig"][:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(rows["sig"])]]))
            many = (sizes > hot) | (rows["sig"][starts] == long_run) if long_run is not None else sizes > hot
            of_many = np.repeat(many, sizes)
            yield from listed(True, rows["sig"][of_many], rows["rec"][of_many])
            # the last run may go on in the next batch
            if many[-1]:
                long_run, kept = rows["sig"][-1], {c: rows[c][:0] for c in SIGNATURE}
            else:
                long_run, kept = None, {c: rows[c][starts[-1] :] for c in SIGNATURE}
            inner = ~many
            inner[-1] = False
            yield from compared(rows, starts[inner], sizes[inner])
        if kept is not None and len(kept["sig"]):
            yield from compared(kept, np.array([0]), np.array([len(kept["sig"])]))

    return of


def _met(signed: DataFrame, threshold: Fraction, hot: int) -> DataFrame:
    """(hot, a, b) of the signature rows, by one shuffle and a sort that spills."""
    return cut(signed.repartition("sig").sortWithinPartitions("sig").mapInArrow(_runs(threshold, hot), "hot boolean, a long, b long").distinct())


def _blocks(signed: DataFrame, many: DataFrame) -> DataFrame:
    """The signature rows of the signatures (sig, blocks) under new signatures, one for each pair of blocks: a record stands in a
    block by its hash, and in all pairs with it. Two records share at least one pair of blocks, and no pair has more than two."""
    rows = signed.join(shuffled(many), "sig").withColumn("b", F.pmod(F.xxhash64("rec"), F.col("blocks")).cast("int"))
    rows = rows.select(*SIGNATURE, "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    return rows.select(F.xxhash64("sig", F.least("b", "o"), F.greatest("b", "o")).alias("sig"), *SIGNATURE[1:])


def similar_sets(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b), a < b: all pairs of rows (rec, shingles) whose sets have a Jaccard similarity of at least `threshold`."""
    met = _met(sets.where(F.size("shingles") > 0).mapInArrow(_signer(threshold), SIGNATURES), threshold, HOT)
    candidates = met.where("NOT hot").select("a", "b")
    hot = met.where("hot").select(F.col("a").alias("sig"), F.col("b").alias("rec"))
    if not hot.isEmpty():
        # signatures of one record: bounded by its own size
        again = hot.groupBy("rec").agg(F.collect_set("sig").alias("sigs")).join(shuffled(sets), "rec")
        refined = cut(again.select("rec", "shingles", "sigs").mapInArrow(_longer(threshold), SIGNATURES))
        met = _met(refined, threshold, HOT)
        candidates = candidates.union(met.where("NOT hot").select("a", "b"))
        sizes = cut(met.where("hot").groupBy(F.col("a").alias("sig")).agg(F.ceil(F.count("*") / HOT).cast("int").alias("blocks")))
        if not sizes.isEmpty():
            candidates = candidates.union(_met(_blocks(refined, sizes), threshold, 1 << 62).select("a", "b"))
    candidates = candidates.distinct()
    left, right = sets.select(F.col("rec").alias("a"), F.col("shingles").alias("of_a")), sets.select(F.col("rec").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - both
    return candidates.join(shuffled(left), "a").join(shuffled(right), "b").where(both * F.lit(threshold.denominator) >= either * F.lit(threshold.numerator)).select("a", "b")


def classes(rows: DataFrame, id_col: str, text_col: str, words_per_shingle: int) -> tuple[DataFrame, DataFrame]:
    """Members (rec, id) of the classes of rows with the same words, and the set (rec, shingles) of each class. A class is
    named by its smallest id."""
    base = rows.select(F.col(id_col).cast("long").alias("id"), words(F.col(text_col)).alias("w")).where(F.col("id").isNotNull() & (F.size("w") >= words_per_shingle))
    keyed = base.select("id", F.sha2(F.array_join("w", " "), 256).alias("key"))
    named = keyed.groupBy("key").agg(F.min("id").alias("rec"))
    members = cut(keyed.join(shuffled(named), "key").select("rec", "id").distinct())
    firsts = members.where("rec = id").select("rec")
    sets = base.join(shuffled(firsts), base.id == firsts.rec, "left_semi").select(F.col("id").alias("rec"), shingle_hashes(F.col("w"), words_per_shingle).alias("shingles")).dropDuplicates(["rec"])
    return members, cut(sets)


def found(rows: DataFrame, id_col: str, text_col: str, threshold: Fraction, words_per_shingle: int) -> DataFrame:
    """(id_a, id_b): every pair of rows of at least this similarity, the smaller id first. Pairs are searched between
    classes of equal texts and spread to their rows only at the end."""
    members, sets = classes(rows, id_col, text_col, words_per_shingle)
    links = similar_sets(sets, threshold)
    a, b = members.select(F.col("rec").alias("a"), F.col("id").alias("i")), members.select(F.col("rec").alias("b"), F.col("id").alias("j"))
    between = links.join(shuffled(a), "a").join(shuffled(b), "b").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
    within = a.join(shuffled(b), F.col("a") == F.col("b")).where("i < j").select(F.col("i").alias("id_a"), F.col("j").alias("id_b"))
    return between.union(within)


def groups(rows: DataFrame, id_col: str, text_col: str, threshold: Fraction, words_per_shingle: int) -> DataFrame:
    """(id, group_id, links): one row per row with at least as many words as a shingle; group_id is the smallest id of those
    reachable over similar pairs, links the number of other texts that the row's text is similar to."""
    members, sets = classes(rows, id_col, text_col, words_per_shingle)
    links = cut(similar_sets(sets, threshold))
    component = connected_components(links)
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("rec")).agg(F.count("*").alias("links"))
    return members.join(shuffled(component), F.col("rec") == F.col("node"), "left").join(shuffled(degree), "rec", "left").select("id", F.coalesce("component", "rec").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
