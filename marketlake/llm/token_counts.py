"""Token counts by rank-synchronous array merging (see `bpe`).

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows
give a row each; an empty table gives no row; texts of any length are read whole.
Ids never leave the JVM, and other columns are not read, so their names cannot
clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import text_or_empty, text_udf


def token_counter(path: str | None = None):
    """A column function: the number of tokens of a text."""

    def make():
        encoder = bpe.load(path or bpe.default_path())
        return lambda texts: [len(x) // 4 for x in encoder.encode_bytes(texts)]

    return text_udf(make, "long", pa.int64())


def count_tokens(df: DataFrame, path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text, as the library for the vocabulary file gives them."""
    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
        token_counter(path)(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
