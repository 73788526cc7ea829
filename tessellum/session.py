"""Session-level helpers: where intermediate results are kept and how broadcasts are bounded."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table may be broadcast. A table is counted before it is broadcast, never guessed.
BROADCAST_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessellum-checkpoint-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there, so that no later stage recomputes them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the table has at most `rows` rows; otherwise the planner chooses a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int, by: list[str], how: str = "inner") -> DataFrame:
    """Equi join with a left side whose keys may be very uneven: left rows are spread over `salts` parts by a hash
    of the columns `by`, the right side is repeated once per part. Right keys are expected to be unique or few. Both sides
    may grow, so both are shuffled and merged: the planner's size of a checkpointed or Python side is a guess."""
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    many = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return spread.join(shuffled(many), [*on, "_salt"], how).drop("_salt")


def shuffled(df: DataFrame) -> DataFrame:
    """Mark the side of a join that grows with the data: it is shuffled and merged, never broadcast on an estimate."""
    return df.hint("merge")
