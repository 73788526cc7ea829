"""The phrase matcher's functions for SQL text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessellum.operators import phrase_match


def register(spark: SparkSession) -> None:
    """pattern_tokens(pattern) and pattern_in_text(pattern, text); both are null for null."""

    @F.pandas_udf("array<string>")
    def tokens(pattern: pd.Series) -> pd.Series:
        return pattern.map(phrase_match.pattern_tokens, na_action="ignore")

    @F.pandas_udf("boolean")
    def in_text(pattern: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or x is None else phrase_match.pattern_in_text(p, x) for p, x in zip(pattern, text, strict=True)], dtype="object")

    spark.udf.register("pattern_tokens", tokens)
    spark.udf.register("pattern_in_text", in_text)
