"""Connected components of a link table, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.session import cut, shuffled


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for undirected links (a, b); component is the smallest node of the component.

    Every round each node takes the smallest label among its own and its neighbours', then follows that label once
    more (pointer jumping), so that long chains need a logarithmic number of rounds. Nulls are no nodes; repeated and
    reflexive links change nothing; no links give no rows."""
    both = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    edges = cut(both.union(both.select("b", "a")).toDF("node", "other").distinct())
    labels = edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label"))
    while True:
        near = edges.join(shuffled(labels.select(F.col("node").alias("other"), "label")), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(shuffled(near), "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("jump"))
        after = cut(step.join(shuffled(jump), "new", "left").select("node", F.least("new", F.coalesce("jump", "new")).alias("next"), "label"))
        changed = not after.where("next <> label").isEmpty()
        labels = after.select("node", F.col("next").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
