"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary of the digests, merged over partitions, names candidates
for frequent digests; their true counts are taken (one aggregate with map-side
combine) and the winners, at most `capacity` rows, are broadcast. Copies of a
winner are settled where they are read and never shuffled; all other digests,
none of which has more than about 1/capacity of the rows, are shuffled.

Texts are equal when identical after each run of space and U+0009 to U+000D is
one space; a null text equals the empty one. Of equal texts the row with the
least id stays, null ids last; of rows that repeat that id, one stays. An empty
table gives no row; other columns keep their values whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, frozen, text_or_empty


def normalised(text_col: str):
    return F.regexp_replace(text_or_empty(text_col), SPACE, " ")


def misra_gries(rows: DataFrame, key: str, capacity: int) -> DataFrame:
    """At most `capacity` (key, n) per partition, mergeable: n is short of the true count by at most rows / (capacity + 1)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype="int64")
        for frame in frames:
            held = held.add(frame[key].value_counts(), fill_value=0).astype("int64")
            if len(held) > capacity:
                counts = held.to_numpy()
                held = held[counts > np.partition(counts, -capacity - 1)[-capacity - 1]] - np.partition(counts,
                    -capacity - 1)[-capacity - 1]
        yield pd.DataFrame({key: list(held.index), "n": held.to_numpy(dtype="int64")})

    return rows.select(key).mapInPandas(run, f"{key} binary, n long")


def heavy_digests(slim: DataFrame, capacity: int) -> DataFrame:
    """(digest, h_keep, h_size) of the digests that hold more than 1/capacity of the rows; at most `capacity` rows.

    h_keep is the first of the digest's ids with their row keys, as a struct.
    """
    total = slim.count()
    candidates = misra_gries(slim, "__digest", capacity).groupBy("__digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"),
        "__digest").limit(capacity)
    own = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__key").alias("key"))
    exact = slim.join(F.broadcast(candidates.select("__digest")), "__digest").groupBy("__digest").agg(F.min(own).alias("h_keep"),
        F.count("*").alias("h_size"))
    return exact.filter(F.col("h_size") > max(1, total // capacity))


def exact_groups(df: DataFrame, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, keep_id, group_size, kept and digest, dropped rows too."""
    slim = frozen(df.select(F.col(id_col).cast("long").alias("__id"),
        F.unhex(F.sha2(normalised(text_col), 256)).alias("__digest")).withColumn("__key", F.monotonically_increasing_id()))
    marked = slim.join(F.broadcast(heavy_digests(slim, capacity)), "__digest", "left")
    winners = marked.filter("h_size IS NOT NULL").select("__id", F.col("h_keep.id").alias("h_keep"), "h_size",
        (F.col("__key") == F.col("h_keep.key")).alias("kept"), "__digest")
    w = Window.partitionBy("__digest")
    rank = F.row_number().over(w.orderBy(F.col("__id").asc_nulls_last(), "__key"))
    rest = marked.filter("h_size IS NULL").select("__id", F.min("__id").over(w).alias("h_keep"), F.count("*").over(w).alias("h_size"),
        (rank == 1).alias("kept"), "__digest")
    return winners.union(rest).select(F.col("__id").alias("doc_id"), F.col("h_keep").alias("keep_id"), F.col("h_size").alias("group_size"),
        "kept", F.lower(F.hex("__digest")).alias("text_sha256"))


def drop_exact_copies(df: DataFrame, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, which stand in a struct on the way so that no name clashes."""
    rows = df.select(F.struct("*").alias("__row"), F.col(id_col).cast("long").alias("__id"),
        F.unhex(F.sha2(normalised(text_col), 256)).alias("__digest"))
    heavy = frozen(heavy_digests(frozen(rows.select("__id", "__digest", F.monotonically_increasing_id().alias("__key"))),
        capacity).select("__digest", F.col("h_keep.id").alias("h_keep"), "h_size"))
    marked = rows.join(F.broadcast(heavy), "__digest", "left")
    # winners with the least id, repeated and null ones too, meet in an aggregate with map-side combine
    least = marked.filter("h_size IS NOT NULL AND __id <=> h_keep").groupBy("__digest").agg(F.first("__row").alias("__row"))
    w = Window.partitionBy("__digest").orderBy(F.col("__id").asc_nulls_last())
    rest = marked.filter("h_size IS NULL").withColumn("__rank", F.row_number().over(w)).filter("__rank = 1")
    return least.select("__row.*").union(rest.select("__row.*"))
