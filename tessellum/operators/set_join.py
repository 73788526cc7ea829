"""Set-similarity join by rare prefixes."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.session import bounded_broadcast, cut, shuffled


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast if the rows are few enough by count, else shuffled."""
    hinted = bounded_broadcast(df)
    return hinted if hinted is not df else shuffled(df)


def prefix_join(left: DataFrame, right: DataFrame, threshold: Fraction) -> DataFrame:
    """(l, r, similarity): all pairs of rows (l, tokens) and (r, tokens) with a Jaccard similarity of at least `threshold`.

    A set of n tokens in the order of rarity has at least one of its first n - ceil(t * n) + 1 in common with any partner.
    The position filter drops a pair if even with all tokens after the shared one the overlap would be too small."""
    t_num, t_den = threshold.numerator, threshold.denominator

    def long(df: DataFrame, key: str) -> DataFrame:
        once = df.select(F.col(key), F.array_distinct("tokens").alias("tokens")).withColumn("n", F.size("tokens"))  # before the explode, not once per row
        return once.select(F.col(key), F.explode("tokens").alias("token"), "n")

    a, b = long(left, "l"), long(right, "r")
    ranks = _sized(cut(a.select("token").union(b.select("token")).groupBy("token").agg(F.count("*").alias("df"))))

    def prefixed(df: DataFrame, key: str) -> DataFrame:
        ranked = df.join(ranks, "token").withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("df", "token")))
        return ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * t_num / t_den) + 1)

    x = prefixed(a, "l").select("l", "token", F.col("n").alias("n_l"), F.col("at").alias("at_l"))
    y = _sized(cut(prefixed(b, "r").select("r", "token", F.col("n").alias("n_r"), F.col("at").alias("at_r"))))
    needed = (F.col("n_l") + F.col("n_r")) * t_num / (t_num + t_den)
    by_length = (F.least("n_l", "n_r") * t_den >= F.greatest("n_l", "n_r") * t_num)
    by_position = F.lit(1) + F.least(F.col("n_l") - F.col("at_l"), F.col("n_r") - F.col("at_r"))
    # the first shared token of a pair is the one with the smallest positions: only there is the bound valid
    met = x.join(y, "token").where(by_length).groupBy("l", "r", "n_l", "n_r").agg(F.max(by_position).alias("bound")).where(F.col("bound") >= needed - 1e-9)
    sets_l, sets_r = left.select("l", F.array_distinct("tokens").alias("of_l")), right.select("r", F.array_distinct("tokens").alias("of_r"))
    overlap = F.size(F.array_intersect("of_l", "of_r"))
    union = F.size("of_l") + F.size("of_r") - overlap
    checked = met.select("l", "r").join(shuffled(sets_l), "l").join(shuffled(sets_r), "r").withColumn("overlap", overlap).withColumn("union", union)
    return checked.where(F.col("overlap") * t_den >= F.col("union") * t_num).select("l", "r", (F.col("overlap") / F.col("union")).alias("similarity"))
