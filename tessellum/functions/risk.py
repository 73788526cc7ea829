"""Risk arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimated_risk(risk: Column, match: Column) -> Column:
    """The risk of a text that resembles a pattern of this risk to the given degree: the pattern's risk and the highest one, 9,
    mixed by the degree and rounded; at least 5 as long as the degree is below 0.9."""
    mixed = F.floor(risk * match + 9 * (1 - match) + F.lit(0.5)).cast("int")
    return F.when((match < 0.9) & (mixed <= 4), F.lit(5)).otherwise(mixed)


def percent(value: Column) -> Column:
    """A degree in percent with one decimal, as shown beside a match."""
    return F.floor(value * 1000 + F.lit(0.5)) / F.lit(10.0)


def clamp_priority(priority: Column) -> Column:
    """The priority of an import: 1 to 10, 5 if there is none."""
    return F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(priority, F.lit(5))))
