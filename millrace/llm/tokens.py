"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.encoding import VOCABULARY, vocabulary

def encoder(path: str):
    """The byte-level BPE encoder of a vocabulary file, read once per worker."""
    return vocabulary(path)


def encode(text: str, path: str = VOCABULARY) -> list[int]:
    """Token ids of a whole text; the strings of special tokens are ordinary text."""
    return encoder(path).encode_ordinary(text)


def token_counts(docs: DataFrame, keep: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens`` for every row; NULL and empty texts have 0 tokens."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in b["_text"]]
            yield b.drop(columns="_text").assign(tokens=sizes)

    return docs.select(*keep, F.col(text).alias("_text")).mapInPandas(run, schema)
