"""Joins on overlapping ranges of lines, spread over bins of lines so that a file with very many ranges is no hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.session import shuffled

#: Lines of a bin.
WIDTH = 64


def _bin(line: Column) -> Column:
    return F.floor(line / WIDTH).cast("int")


def overlaps(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], margin: int = 0) -> DataFrame:
    """left and right rows with the same key whose ranges a and b share a line, or are at most `margin` lines apart. Each pair
    comes once, from the bin in which the later of both begins. Rows with a null key or bound, and empty ranges, meet nothing."""
    x = left.where(F.col(a[0]) <= F.col(a[1])).withColumn("_from", F.col(a[0]) - margin).withColumn("_to", F.col(a[1]) + margin)
    x = x.withColumn("_bin", F.explode(F.sequence(_bin(F.col("_from")), _bin(F.col("_to")))))
    y = right.where(F.col(b[0]) <= F.col(b[1])).withColumn("_bin", F.explode(F.sequence(_bin(F.col(b[0])), _bin(F.col(b[1])))))
    met = x.join(shuffled(y), [key, "_bin"]).where((F.col("_from") <= F.col(b[1])) & (F.col("_to") >= F.col(b[0])))
    return met.where(F.col("_bin") == _bin(F.greatest("_from", F.col(b[0])))).drop("_bin", "_from", "_to")


def inside(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], how: str) -> DataFrame:
    """left_semi or left_anti: left rows whose range a lies, or does not lie, wholly in a range b of a right row with the same key."""
    x = left.withColumn("_bin", _bin(F.col(a[0])))
    y = right.where(F.col(b[0]) <= F.col(b[1])).select(F.col(key).alias("_key"), F.col(b[0]).alias("_s"), F.col(b[1]).alias("_e"), F.explode(F.sequence(_bin(F.col(b[0])), _bin(F.col(b[1])))).alias("_of"))
    same = (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_of")) & (F.col("_s") <= F.col(a[0])) & (F.col("_e") >= F.col(a[1]))
    return x.join(shuffled(y), same, how).drop("_bin")
