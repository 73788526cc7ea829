"""Exports as files, written in parallel by the tasks that hold the rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def write_json_lines(rows: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """One JSON object a line; with an order, the parts follow each other in it."""
    (rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows).write.mode("overwrite").json(path)


def write_labelled(rows: DataFrame, path: str, label: str = "label", text: str = "text") -> None:
    """Texts in a folder per label, one JSON string a line, so that line ends within texts stay."""
    rows.select(label, F.to_json(F.struct(F.col(text))).alias("value")).write.mode("overwrite").partitionBy(label).text(path)


def write_text(rows: DataFrame, path: str, line: str, order: list[Column]) -> None:
    """Compressed text whose parts, in the order of their names, are the rows in `order`."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(line).write.mode("overwrite").option("compression", "gzip").text(path)


def stream(rows: DataFrame, order: list[Column]) -> Iterator[Row]:
    """The rows in order, one partition at a time on the driver while the next one is made: a cursor over results of any size."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).toLocalIterator(prefetchPartitions=True)
