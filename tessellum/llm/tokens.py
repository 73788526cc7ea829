"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary file. It is a parameter everywhere and read where the executors run.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters of texts that are tokenized together; bounds the memory of a step.
TOGETHER = 2_000_000

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        _loaded[path] = t
    return _loaded[path]


def with_tokens(records: DataFrame, id_col: str, text_col: str, extra: list[str], path: str = TOKENIZER) -> DataFrame:
    """(id, *extra, tokens); null texts have no tokens. Rows without an id are left out, repeated rows count once."""
    kept = records.select(F.col(id_col).cast("long").alias("id"), *extra, F.col(text_col).alias("_text")).where("id is not null")
    schema = ", ".join(f"{name} {kind}" for name, kind in kept.drop("_text").dtypes) + ", tokens long"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for batch in batches:
            texts, sizes = [x if isinstance(x, str) else "" for x in batch["_text"]], []
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= TOGETHER):
                    held += len(texts[end])
                    end += 1
                sizes += [len(e.ids) for e in t.encode_batch(texts[at:end], add_special_tokens=False)]
                at = end
            yield batch.drop(columns="_text").assign(tokens=pd.Series(sizes, index=batch.index, dtype="int64"))

    return kept.mapInPandas(count, schema).dropDuplicates(["id"])
