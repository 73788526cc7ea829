"""Places in a global order without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.session import cut


def global_rank(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place from 1 in `order`, which should be total. Rows are range-partitioned; a row's place is the number
    of rows in the partitions before its own plus its place there. The table of partition sizes has one row per partition."""
    parted = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return parted.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_before", "_at")
