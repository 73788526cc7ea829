"""Problem 8: records drawn so that every source gets its target share of all tokens.

The mixture is as large as the sources allow: the source that is shortest of tokens for its share, with all its records at
their highest number of repeats, sets the total. The total is divided into equal blocks of tokens, which are allotted to
the sources by Sainte-Lague's highest quotients, and those of a source to its shards in the same way by the tokens that a
shard holds. So every shard knows its integer quota before anything is drawn, and draws alone: every record as often as the
quota goes into the shard's tokens, then, in a seeded order, records as long as they fit, then the longest one that fits
the gap.

Defined results: records of unlisted or null sources, without tokens, or with a null id are not drawn; a target share that is
null or not positive draws nothing; a listed source without tokens has an actual share of zero and does not bound the others;
repeated targets of a source add up, with the smallest number of repeats; null repeats count as one; repeated rows with one
id count once; an empty table gives no draws; further columns are ignored.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm.tokens import TOKENIZER, with_tokens
from tessellum.session import cut, shuffled

#: Blocks into which the mixture is divided.
BLOCKS = 10_000
#: Records of a shard, about.
SHARD = 100_000
SEED = 42


def sainte_lague(weights: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients weight / 1, 3, 5, ...; ties go to the earlier weight.

    The quotients above a bar d are floor(weight / d + 1/2) for each weight. The bar is halved in until the seats given are at
    most `seats` and few are left; only these, about one for each weight, are given one by one."""
    w = np.maximum(np.array(weights, float), 0.0)
    given = np.zeros(len(w), np.int64)
    if seats <= 0 or not (w > 0).any():
        return given.tolist()
    above = lambda bar: np.floor(w / bar + 0.5 - 1e-9).astype(np.int64)
    low, high = w.sum() / (seats + len(w)) / 2, 4 * w.sum()
    for _ in range(80):
        bar = (low + high) / 2
        if above(bar).sum() <= seats:
            high = bar
        else:
            low = bar
    given = np.maximum(above(high) - 1, 0)
    heap = [(-w[k] / (2 * int(given[k]) + 1), k) for k in np.flatnonzero(w > 0).tolist()]
    heapq.heapify(heap)
    for _ in range(seats - int(given.sum())):
        _, k = heap[0]
        given[k] += 1
        heapq.heapreplace(heap, (-w[k] / (2 * int(given[k]) + 1), k))
    return given.tolist()


def quotas(supply: dict[tuple[str, int], int], targets: dict[str, tuple[float, int]], blocks: int = BLOCKS) -> dict[tuple[str, int], int]:
    """Tokens to draw from each (source, shard). supply: the tokens it holds; targets: share and most repeats of each source."""
    held: dict[str, int] = {}
    for (source, _), tokens in supply.items():
        held[source] = held.get(source, 0) + tokens
    able = [s for s, (share, repeats) in targets.items() if share > 0 and repeats > 0 and held.get(s, 0) > 0]
    if not able:
        return {}
    whole = sum(Fraction(targets[s][0]) for s in able)
    total = min(Fraction(held[s] * targets[s][1]) * whole / Fraction(targets[s][0]) for s in able)
    given = sainte_lague([float(targets[s][0]) for s in able], blocks)
    out = {}
    for source, n in zip(able, given, strict=True):
        shards = sorted(k for k in supply if k[0] == source and supply[k] > 0)
        most = held[source] * targets[source][1]
        tokens = min(int(total * n / blocks), most)
        # the blocks of a source go to its shards; what a block is in tokens follows from the source's own quota
        seats = sainte_lague([float(supply[k]) for k in shards], max(n, 1) * len(shards))
        for k, seat in zip(shards, seats, strict=True):
            out[k] = min(tokens * seat // max(1, max(n, 1) * len(shards)), supply[k] * targets[source][1])
    return out


def draws(records: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, draws): how often each record is drawn, for those that are."""
    spark = records.sparkSession
    # targets: a table of sources, a few rows
    wanted = {
        r.source: (float(r.share), int(r.repeats))
        for r in targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("repeats")).where("share > 0").collect()
    }
    sized = cut(with_tokens(records, id_col, text_col, [source_col], tokenizer).where(F.col("tokens") > 0).where(F.col(source_col).isin(list(wanted))).select("id", F.col(source_col).alias("source"), "tokens"))
    shards = {r.source: max(1, -(-r.n // SHARD)) for r in sized.groupBy("source").agg(F.count("*").alias("n")).collect()}
    many = F.create_map(*[x for s, n in shards.items() for x in (F.lit(s), F.lit(n))]) if shards else F.create_map(F.lit(""), F.lit(1))
    sharded = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id"), many[F.col("source")]))
    # one row per SHARD records
    supply = {(r.source, r.shard): r.tokens for r in sharded.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")).collect()}
    quota = quotas(supply, wanted)
    rows = [(s, int(k), int(q), int(supply[s, k]), wanted[s][1]) for (s, k), q in quota.items()]
    table = spark.createDataFrame(rows, "source string, shard long, quota long, held long, most long")
    each = sharded.join(shuffled(table), ["source", "shard"]).withColumn("base", F.expr("quota div held")).withColumn("rest", F.expr("quota % held"))
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id")
    shard = Window.partitionBy("source", "shard")
    run = each.withColumn("sum", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("once", F.col("sum") <= F.col("rest"))
    gap = run.withColumn("gap", F.col("rest") - F.coalesce(F.max(F.when(F.col("once"), F.col("sum"))).over(shard), F.lit(0)))
    once = gap.withColumn("draws", F.col("base") + F.col("once").cast("long"))
    # the longest record that fits the gap and may be drawn again, as often as both allow
    fits = (F.col("tokens") <= F.col("gap")) & (F.col("draws") < F.col("most"))
    last = once.withColumn("fills", F.max(F.when(fits, F.struct("tokens", "id"))).over(shard))
    more = F.when(F.col("fills.id") == F.col("id"), F.least(F.expr("gap div tokens"), F.col("most") - F.col("draws"))).otherwise(0)
    drawn = last.withColumn("draws", F.col("draws") + more)
    return drawn.where("draws > 0").select(F.col("id").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), F.col("draws").cast("long").alias("draws"))


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, records, most_draws) for every listed source."""
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("draws")).alias("tokens"), F.count("*").alias("records"), F.max("draws").alias("most_draws"))
    rows = wanted.join(got, "source", "left").na.fill(0, ["tokens", "records", "most_draws"])
    # one row per source
    return rows.withColumn("actual_share", F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0)))
