"""Problem 6: records that differ only in layout, letter case, punctuation or the order of their fields.

Canonical records are range-partitioned and sorted externally on (key, id), so that a key that holds a third of all
rows is spread over several neighbouring partitions. Each partition is scanned once for runs of equal adjacent keys,
compared in full; runs that go on across partition borders are joined afterwards through a table with two rows per
partition. No group is ever collected.

Defined results: null texts are in no group; texts without any letter or digit, the empty one included, form one
group; repeated rows with the same id count once; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.text import letters_digits
from tessellum.session import cut, shuffled

#: A field: perhaps a comment sign or list mark, a name of one or two words, a colon or equals sign, a value.
FIELD = r"^[^\p{L}\p{N}]*\p{L}[\p{L}\p{N}_.-]{0,40}( [\p{L}\p{N}_.-]{1,40})?\s*[:=].*[\p{L}\p{N}]"
#: Fewest fields of a text whose fields may have any order.
FIELDS = 3


def field_key(text: Column) -> Column:
    """Canonical form of a text that consists only of fields: its canonical fields in sorted order; else null."""
    parts = F.filter(F.split(text, r"[\r\n;]+"), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    only_fields = (F.size(parts) >= FIELDS) & F.forall(parts, lambda p: p.rlike(FIELD))
    return F.when(only_fields, F.concat(F.lit("\u0001"), F.array_join(F.array_sort(F.transform(parts, letters_digits)), "\u0001")))


RUNS = "id long, part int, run_start long, first_run boolean, last_run boolean, border string, border_key string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk over the sorted rows of one partition. run_start is the first id of a row's run within the partition; the
    first row and the last row carry the key, to be compared with the neighbouring partitions."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    key = start = held = None
    first_run = True

    def flush(ids: pa.Array, starts: pa.Array, firsts: pa.Array, border: list, border_keys: list) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([part] * n, pa.int32()), starts, firsts, pa.array([False] * n), pa.array(border, pa.string()), pa.array(border_keys, pa.string())],
            ["id", "part", "run_start", "first_run", "last_run", "border", "border_key"],
        )

    any_rows = False
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, ids = batch.column("key").cast(pa.large_string()), batch.column("id")
        changed = [True] if n == 1 else [True, *pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_pylist()]
        changed[0] = key is None or keys[0].as_py() != key
        border, border_keys = [None] * n, [None] * n
        if not any_rows:
            border[0], border_keys[0] = "first", keys[0].as_py()
        starts, firsts = [0] * n, [False] * n
        values = ids.to_pylist()
        for i in range(n):
            if changed[i]:
                if any_rows or i:
                    first_run = False
                start = values[i]
            starts[i], firsts[i] = start, first_run
        any_rows, key = True, keys[n - 1].as_py()
        held = (values[-1], start, first_run)
        yield flush(ids, pa.array(starts, pa.int64()), pa.array(firsts), border, border_keys)
    if held:  # a row of its own for the end of the partition: no document, only its last run
        yield flush(pa.array([None], pa.int64()), pa.array([held[1]], pa.int64()), pa.array([held[2]]), ["last"], [key])


def runs_of_equal_keys(keyed: DataFrame) -> DataFrame:
    """(id, keep) for rows (id, key): keep is the smallest id of the rows with the same key."""
    rows = keyed.select(F.col("id").cast("long").alias("id"), "key").where("key is not null and id is not null")
    sorted_rows = rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    scanned = cut(sorted_rows.mapInArrow(_scan, RUNS))
    # Borders: two rows per partition, in partition order. A first run continues the run before it if the keys agree;
    # partitions that hold one single run pass its start on.
    ends = scanned.where("border = 'last'").select("part", F.col("border_key").alias("last_key"), F.col("run_start").alias("last_start"), F.col("first_run").alias("single"))
    begins = scanned.where("border = 'first'").select("part", F.col("border_key").alias("first_key"), F.col("run_start").alias("first_start"))
    order = Window.orderBy("part")
    borders = (
        begins.join(ends, "part")
        .withColumn("goes_on", F.coalesce(F.lag("last_key").over(order) == F.col("first_key"), F.lit(False)))
        .withColumn("before_start", F.lag("last_start").over(order))
        .withColumn("before_single", F.coalesce(F.lag("single").over(order), F.lit(False)))
        # a chain: a maximal sequence of partitions through which one run passes
        .withColumn("chain_step", F.when(F.col("goes_on") & F.col("before_single"), 0).otherwise(1))
        .withColumn("chain", F.sum("chain_step").over(order))
    )
    head = Window.partitionBy("chain").orderBy("part")
    borders = borders.withColumn("carried", F.first(F.when(F.col("goes_on"), F.col("before_start")).otherwise(F.col("first_start"))).over(head))
    fixed = borders.where("goes_on").select("part", F.lit(True).alias("first_run"), F.col("carried"))
    documents = scanned.where("id is not null").select("id", "part", "run_start", "first_run")
    # one row per partition of the sort: bounded by the number of partitions
    return documents.join(F.broadcast(fixed), ["part", "first_run"], "left").select("id", F.coalesce("carried", "run_start").alias("keep"))


def layout_groups(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, keep): keep is the smallest id among the rows whose text is the same up to layout.

    Two relations make texts the same: equal canonical text, and equal sorted fields. Both are merged by alternating
    between them until no id changes; the second round is needed only for texts that are in a field group."""
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    keyed = base.select("id", letters_digits(F.col("text")).alias("plain"), field_key(F.col("text")).alias("fields"))
    first = runs_of_equal_keys(keyed.select("id", F.coalesce("fields", "plain").alias("key")).distinct())
    # Texts with the fields of a field group but another layout, which is no field text, meet it by the plain key.
    plain_of_fields = keyed.where("fields is not null").select("id", "plain").distinct()
    if plain_of_fields.isEmpty():
        return first
    bridge = (
        keyed.select("id", "plain").join(shuffled(plain_of_fields.select("plain").distinct()), "plain", "left_semi").distinct()
        .join(shuffled(first), "id").groupBy("plain").agg(F.min("keep").alias("low"), F.max("keep").alias("high")).where("low <> high")
    )
    bridge = cut(bridge)
    if bridge.isEmpty():
        return first
    return _merge(first, keyed.select("id", "plain").join(shuffled(bridge.select("plain")), "plain", "left_semi"))


def _merge(first: DataFrame, members: DataFrame) -> DataFrame:
    """Join groups of `first` that share a value of `plain`; min-label propagation until nothing changes."""
    edges = cut(members.join(shuffled(first), "id").select("plain", F.col("keep").alias("node")).distinct())
    labels = cut(edges.select("node", F.col("node").alias("label")).distinct())
    while True:
        lowest = edges.join(shuffled(labels), "node").groupBy("plain").agg(F.min("label").alias("low"))
        moved = edges.join(shuffled(lowest), "plain").groupBy("node").agg(F.min("low").alias("low"))
        new = cut(labels.join(shuffled(moved), "node").select("node", F.least("label", "low").alias("label"), (F.col("low") < F.col("label")).alias("moved")))
        if new.where("moved").isEmpty():
            break
        labels = new.select("node", "label")
    return first.join(shuffled(labels.withColumnRenamed("node", "keep")), "keep", "left").select("id", F.coalesce("label", "keep").alias("keep"))


def found(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(keep_id, copy_id): each row that is a copy, with the smallest id of its group."""
    groups = layout_groups(rows, id_col, text_col)
    return groups.where("id <> keep").select(F.col("keep").alias("keep_id"), F.col("id").alias("copy_id")).distinct()


def collapsed(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(keep_id, copies): one row per group with the exact number of its rows."""
    return layout_groups(rows, id_col, text_col).groupBy(F.col("keep").alias("keep_id")).agg(F.count("*").alias("copies"))
