"""Problem 7: texts of varying length in containers of a fixed number of tokens.

The plan is made on the histogram of lengths, which has at most `capacity` entries whatever the number of texts:

1. texts longer than a container are cut into pieces; full pieces are containers of their own;
2. the other lengths are rounded up to units, and all patterns of up to three different lengths that fill a container of
   units are enumerated. Non-negative least squares fits how often each pattern is repeated to the histogram; the repeats
   are rounded down. The shortest texts, as many as the rounding to units leaves room for, are held back;
3. what is left goes where it leaves the least room: into the room that patterns left, then into new containers.

A plan says which ranks among the texts of a length go to which containers; it is a short table of ranges. Texts get
their ranks from counts per length and hash part, so that no task sees more than one part of a length, and look up
their container by binary search.

Defined results: null and empty texts have no tokens and no container; texts of the same length are interchangeable and
ranked by id; repeated rows with one id count once; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm.tokens import TOKENIZER, with_tokens
from tessellum.session import cut, shuffled

CAPACITY = 2048
#: Lengths are rounded up to this part of a container to enumerate patterns.
UNITS = 64
#: Rows of one length that a task ranks at a time.
PART = 100_000


def patterns(units: int) -> np.ndarray:
    """All ways to fill `units` with one to three different lengths in units, as a matrix of counts by length."""
    out = []
    for a in range(1, units + 1):
        for i in range(1, units // a + 1):
            left = units - i * a
            if left == 0:
                out.append({a: i})
            for b in range(1, min(a, left + 1)):
                for j in range(1, left // b + 1):
                    rest = left - j * b
                    if rest == 0:
                        out.append({a: i, b: j})
                    out.extend({a: i, b: j, c: rest // c} for c in range(1, min(b, rest + 1)) if rest % c == 0)
    matrix = np.zeros((units + 1, len(out)))
    for k, pattern in enumerate(out):
        for length, n in pattern.items():
            matrix[length, k] = n
    return matrix[1:]


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that minimizes |a x - b|, by an active set."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        k = int(np.argmax(gradient))
        if gradient[k] <= 1e-8 * max(1.0, np.abs(b).max()):
            break
        active[k] = True
        while True:
            on = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[on] = s
                break
            low = s <= 0
            step = np.min(x[on][low] / np.maximum(x[on][low] - s[low], 1e-300))
            x[on] += step * (s - x[on])
            active[on[x[on] <= 1e-12]] = False
            x[~active] = 0
    return x


def plan(histogram: dict[int, int], capacity: int, units: int = UNITS) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Ranges (length, first rank, first container, count) and groups of containers (first container, count, used tokens).
    histogram: the number of pieces of each length from 1 to capacity."""
    left = {n: c for n, c in histogram.items() if 0 < n <= capacity and c > 0}
    used, ranges, groups, containers = dict.fromkeys(left, 0), [], [[] for _ in range(capacity + 1)], 0

    def take(length: int, count: int, container: int) -> None:
        ranges.append((length, used[length], container, count))
        used[length] += count
        left[length] -= count

    if left.get(capacity):
        groups[0].append((0, left[capacity]))
        containers = left[capacity]
        take(capacity, left[capacity], 0)
    unit = -(-capacity // units)
    if unit > 1 and left:
        slack, held = sum(left.values()) * unit / 2, dict.fromkeys(left, 0)
        for n in sorted(left):
            held[n] = min(left[n], max(0, int(slack // n)))
            slack -= held[n] * n
        bins: dict[int, list[int]] = {}
        for n in sorted(left, reverse=True):
            bins.setdefault(-(-n // unit), []).append(n)
        whole = capacity // unit
        wanted = np.array([sum(left[n] - held[n] for n in bins.get(k, [])) for k in range(1, whole + 1)], float)
        matrix = patterns(whole)
        useful = ~((matrix > 0) & (wanted == 0)[:, None]).any(0)
        matrix = matrix[:, useful]
        repeats = nonnegative_least_squares(matrix, wanted) if matrix.shape[1] else np.zeros(0)
        free = {k: sum(left[n] - held[n] for n in of) for k, of in bins.items()}
        for p in np.argsort(-repeats, kind="stable"):
            need = {int(k) + 1: int(matrix[k, p]) for k in np.flatnonzero(matrix[:, p])}
            times = int(min(repeats[p], *(free[k] // n for k, n in need.items())))
            if times < 1:
                continue
            room = [(0, times, capacity)]  # (offset, count, room) of the containers of this pattern
            for k, n in need.items():
                free[k] -= n * times
                for _ in range(n):
                    at, cuts = 0, []
                    for length in bins[k]:
                        here = min(left[length] - held[length], times - at)
                        if here > 0:
                            take(length, here, containers + at)
                            cuts.append((at, here, length))
                            at += here
                    room = [(max(o, s), min(o + c, s + d) - max(o, s), r - length) for o, c, r in room for s, d, length in cuts if min(o + c, s + d) > max(o, s)]
            for offset, count, r in room:
                groups[r].append((containers + offset, count))
            containers += times
    rooms = sorted(r for r in range(capacity + 1) if groups[r])
    for length in sorted(left, reverse=True):
        while left[length]:
            at = bisect_left(rooms, length)
            while at < len(rooms) and not groups[rooms[at]]:
                rooms.pop(at)
            if at == len(rooms):
                new = -(-left[length] // (capacity // length))
                groups[capacity].append((containers, new))
                containers += new
                rooms.append(capacity)
            room = rooms[at]
            start, count = groups[room].pop()
            k = min(count, left[length])
            take(length, k, start)
            if count > k:
                groups[room].append((start + k, count - k))
            if not groups[room - length]:
                spot = bisect_left(rooms, room - length)
                if spot == len(rooms) or rooms[spot] != room - length:
                    rooms.insert(spot, room - length)
            groups[room - length].append((start, k))
    return ranges, sorted((start, count, capacity - r) for r in range(capacity + 1) for start, count in groups[r])


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces with `rank`, from 0, among those of the same length. Counts per part of a length give each part's first rank."""
    total = pieces.count()
    parts = max(1, -(-total // PART))
    parted = pieces.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(parts)))
    counts = parted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    local = parted.withColumn("local", F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "piece")) - 1)
    return local.join(shuffled(first), ["length", "part"]).select("id", "piece", "length", (F.col("first") + F.col("local")).alias("rank"))


def pack(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container_id, doc_id, piece, start_token, n_tokens, fill): each text, or each piece of a text longer than a container, with
    its container and the share of that container that is used."""
    sized = cut(with_tokens(records, id_col, text_col, [], tokenizer))
    pieces = sized.where("tokens > 0").select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"cast(floor((tokens - 1) / {capacity}) as bigint)"))).alias("piece"), "tokens")
    pieces = pieces.select("id", "piece", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece") * capacity).alias("length"))
    # at most `capacity` rows
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges, groups = plan(histogram, capacity)
    ranges.sort()
    spark = records.sparkSession
    table = tuple(np.array(c, np.int64) for c in zip(*ranges, strict=True)) if ranges else (np.zeros(0, np.int64),) * 4
    ends = tuple(np.array(c, np.int64) for c in zip(*groups, strict=True)) if groups else (np.zeros(0, np.int64),) * 3
    # both tables are bounded by the lengths and patterns, not by the number of texts
    shared = spark.sparkContext.broadcast((table, ends))

    @F.pandas_udf("container long, used long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        (lengths, ranks, containers, _), (starts, _, used) = shared.value
        span = np.int64(1) << 44  # more than the rank of any text of one length
        at = np.searchsorted(lengths * span + ranks, length.to_numpy() * span + rank.to_numpy(), side="right") - 1
        container = containers[at] + rank.to_numpy() - ranks[at]
        return pd.DataFrame({"container": container, "used": used[np.searchsorted(starts, container, side="right") - 1]})

    placed = ranked(pieces).withColumn("p", place("length", "rank")).select(
        F.col("p.container").alias("container_id"), F.col("id").alias("doc_id"), "piece", (F.col("piece") * capacity).alias("start_token"), F.col("length").alias("n_tokens"), (F.col("p.used") / capacity).alias("fill")
    )
    nothing = sized.where("tokens = 0").select(F.lit(None).cast("long").alias("container_id"), F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start_token"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("fill"))
    return placed.union(nothing)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, pieces, tokens, fill, least_fill): the whole packing in one row; the fills come from the rows themselves."""
    each = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    return each.agg(F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * capacity)).alias("fill"), (F.min("used") / capacity).alias("least_fill"))
