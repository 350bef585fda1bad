"""Mergeable sketches a day, for counts and percentiles over any range of days without reading its rows again.

A day's row of a group holds a HyperLogLog sketch of a key and a KLL sketch of a
value; rows of days are merged, never recomputed. Exact forms are
`snapshots.distinct_items` and `reads.route_timings`; these are for tables whose
days are stored once and asked for in many ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import epoch_day

#: Relative standard error of the counts is 1.04 / sqrt(2 ** LG_K); the rank error of percentiles is about 2.3 / K ** 0.9.
LG_K, K = 12, 400


def daily_sketches(log: DataFrame, by: str, key: str, value: str, ts: str = "ts") -> DataFrame:
    """(by, day, n, keys, values): the sketches of each group and day; null keys and values are not counted in them."""
    return log.groupBy(by, epoch_day(ts).alias("day")).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(key).cast("string"), F.lit(LG_K)).alias("keys"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("values"))


def over_days(sketches: DataFrame, by: str, first: int | None = None, last: int | None = None, ranks: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """(by, n, distinct, p<percent>...) over a range of days, from their rows alone."""
    own = sketches if first is None else sketches.filter(F.col("day") >= first)
    own = own if last is None else own.filter(F.col("day") <= last)
    merged = own.groupBy(by).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("distinct"),
        F.kll_merge_agg_double("values").alias("__v"))
    return merged.select(by, "n", "distinct", *[F.kll_sketch_get_quantile_double("__v", F.lit(r)).alias(f"p{round(r * 100)}") for r in ranks])
