"""Minimax contiguous partition into shards, with DataFrame functions only.

Equal texts share a digest and stay together. The first bits of the digest
order all texts into 65,536 atomic groups, whatever the number of rows; only
their sizes (at most that many numbers) reach the driver. The smallest capacity
for which a greedy walk over the ordered sizes needs no more shards than asked
is found by binary search; the cuts then lie, within that capacity, as near to
even shares as the greedy walks from both ends allow. Rows get their shard by
comparing the group with the cuts, and gapless slots from counts per cell (a
group, split by id where it is large) plus a rank inside the cell.

Defined results: a null text counts as empty (no bytes); repeated rows take a
slot each; an empty table gives no row; null ids are dealt among cells by row;
texts of any length are read whole, in the JVM; other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen, text_or_empty

GROUPS = 65_536


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity for which a greedy walk over the ordered sizes needs at most so many shards."""
    before = [0, *accumulate(sizes)]

    def needed(capacity: int) -> int:
        at, n = 0, 0
        while at < len(sizes):
            at = bisect_right(before, before[at] + capacity) - 1
            n += 1
            if n > shards:
                break
        return n

    low, high = max(max(sizes, default=0), -(-before[-1] // shards)), before[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(mid) <= shards else (mid + 1, high)
    return low


def cuts(sizes: list[int], shards: int) -> list[int]:
    """Where each shard but the first begins: no shard is above the smallest capacity, each is near an even share of what is left."""
    capacity = smallest_capacity(sizes, shards)
    before = [0, *accumulate(sizes)]
    earliest = [0] * (shards + 1)  # walking back from the end, the first start that still lets the rest fit
    earliest[shards] = len(sizes)
    for k in range(shards - 1, 0, -1):
        earliest[k] = bisect_left(before, before[earliest[k + 1]] - capacity)
    out, at = [], 0
    for k in range(1, shards):
        share = before[at] + (before[-1] - before[at]) / (shards - k + 1)
        to = bisect_left(before, share)
        if to and to <= len(sizes) and share - before[to - 1] < before[to] - share:
            to -= 1
        at = min(max(to, earliest[k], at), bisect_right(before, before[at] + capacity) - 1)
        out.append(at)
    return out


def shard(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; sizes of shards are near equal."""
    text = text_or_empty(text_col)
    rows = frozen(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int").alias("__group"),
            F.monotonically_increasing_id().alias("__row"),
        )
    )
    groups = frozen(rows.groupBy("__group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    sizes = [0] * GROUPS
    for r in groups.select("__group", "bytes").collect():  # at most GROUPS rows
        sizes[r[0]] = r[1]
    at = cuts(sizes, shards)
    # a group with many rows is split by id into cells of about cell_rows, or four times the mean group
    cell = F.greatest(F.lit(cell_rows), 4 * F.lit(groups.agg(F.sum("n")).first()[0] or 0) / GROUPS)
    split = groups.select("__group", F.ceil(F.col("n") / cell).cast("int").alias("__cells"))
    dealt = rows.join(F.broadcast(split), "__group").withColumn("__cell",
        F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("__row"))), F.col("__cells")))
    dealt = dealt.withColumn("shard", sum((F.col("__group") >= c).cast("int") for c in at) if at else F.lit(0))
    counts = dealt.groupBy("shard", "__group", "__cell").agg(F.count("*").alias("__n"))
    order = Window.partitionBy("shard").orderBy("__group", "__cell").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__group", "__cell", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__base"))
    rank = Window.partitionBy("__group", "__cell").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size", "__row")
    return dealt.withColumn("__rank", F.row_number().over(rank)).join(base, ["__group", "__cell"]).select("doc_id", "size", "text_crc32",
        F.col("shard").cast("int").alias("shard"), (F.col("__base") + F.col("__rank") - 1).cast("long").alias("slot"))
