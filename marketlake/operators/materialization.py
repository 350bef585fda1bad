"""Durable bucket rollups: runs over the buckets that are due, a state table, and the repair of failed buckets.

A run computes all its buckets in one job. If that fails, the buckets are halved
by time and each half is tried again, so that k bad buckets among n cost about
k log n jobs, the good ones are kept and the bad ones are known. Rollups and
anomaly segments are written first, each attempt into a part folder of its own;
the run's state rows, written last, name the part that counts for each bucket.
They are the commit: what a stopped or failed attempt left behind has no state
row and is never read, and a run that is repeated replaces its own state.

Tables below the folder: rollups/part=..., segments/part=..., state/run=...
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import DAY_MS, epoch_day
from ..sources.files import read_or_empty
from . import rollups as R

STATE = ("granularity string, bucket_start long, bucket_end long, source_day long, finalized boolean, failed boolean, raw_rows long, "
    "rollup_rows long, anomaly_rows long, part string")
#: What a market's buckets are computed by: ticks and parameters to rollups, and to anomaly segments.
Compute = tuple[Callable[[DataFrame, R.RollupParams], DataFrame], Callable[[DataFrame, R.RollupParams], DataFrame]]
QUOTES: Compute = (R.bucket_rollup_quotes, R.quote_segments)
LISTINGS: Compute = (R.bucket_rollup_listings, R.listing_segments)


def state_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every state row ever written, with its run."""
    return read_or_empty(spark, f"{folder}/state", f"{STATE}, run long")


def current_state(log: DataFrame) -> DataFrame:
    """The newest row of each bucket."""
    rest = [c for c in log.columns if c not in ("granularity", "bucket_start", "run")]
    return log.groupBy("granularity", "bucket_start").agg(F.max_by(F.struct(*rest), "run").alias("__s"), F.max("run").alias("run")).select(
        "granularity", "bucket_start", "__s.*", "run")


def due_and_failed(state: DataFrame, ticks: DataFrame, now_ms: int, p: R.RollupParams, watermark_ms: int = 30_000, most: int = 128) -> DataFrame:
    """Bucket starts of a run: closed ones behind the last finalized bucket, and those that failed before."""
    own = state.filter(F.col("granularity") == p.granularity)
    return R.due_buckets(own, ticks, now_ms, p, watermark_ms, most).union(own.filter("failed").select("bucket_start")).distinct()


def _inside(ticks: DataFrame, buckets: list[int], p: R.RollupParams) -> DataFrame:
    """Rows of the buckets; the range of times reaches the scan, and day partitions where the table has them."""
    lo, hi = min(buckets), max(buckets) + p.width
    own = ticks.filter((F.col("snapshot_ts") >= lo) & (F.col("snapshot_ts") < hi))
    if "day" in ticks.columns:
        own = own.filter(F.col("day").between(lo // DAY_MS, (hi - 1) // DAY_MS)).drop("day")
    if len(buckets) == (hi - lo) // p.width:
        return own
    wanted = ticks.sparkSession.createDataFrame([(b,) for b in buckets], "__b long")  # one number a bucket
    start = F.floor(F.col("snapshot_ts") / p.width) * p.width
    return own.join(F.broadcast(wanted), start == F.col("__b"), "left_semi")


def _attempt(ticks: DataFrame, buckets: list[int], folder: str, p: R.RollupParams, compute: Compute) -> dict[int, tuple]:
    """Bucket to (part, raw, rollup and anomaly rows), None for those that failed."""
    part = uuid.uuid4().hex
    own = _inside(ticks, buckets, p)
    try:
        written = []
        for name, fn in zip(("rollups", "segments"), compute):
            to = f"{folder}/{name}/part={part}"
            fn(own, p).write.parquet(to)
            written.append(ticks.sparkSession.read.parquet(to))
        counts = [{r[0]: r[1] for r in x.groupBy("bucket_start").count().collect()} for x in (R.with_bucket(own, p), *written)]
    except (PySparkException, Py4JJavaError):
        if len(buckets) == 1:
            return {buckets[0]: None}
        half = len(buckets) // 2
        return _attempt(ticks, buckets[:half], folder, p, compute) | _attempt(ticks, buckets[half:], folder, p, compute)
    return {b: (part, *(c.get(b, 0) for c in counts)) for b in buckets}


def run(ticks: DataFrame, folder: str, run_id: int, now_ms: int, p: R.RollupParams, compute: Compute = QUOTES, watermark_ms: int = 30_000,
    most: int = 128) -> None:
    """One run: computes the buckets that are due or failed before, and writes their state.

    The driver holds bucket starts and counts, a few numbers a bucket; at most `most` new buckets are taken, as the rest is
    due in the next run.
    """
    spark = ticks.sparkSession
    state = current_state(state_log(spark, folder).filter(F.col("run") < run_id))
    buckets = sorted(r[0] for r in due_and_failed(state, ticks, now_ms, p, watermark_ms, most).collect())
    done = _attempt(ticks, buckets, folder, p, compute) if buckets else {}
    rows = []
    for b in buckets:
        part, raw, rolled, odd = done[b] or (None, 0, 0, 0)
        rows.append((p.granularity, b, b + p.width, b // DAY_MS, done[b] is not None, done[b] is None, raw, rolled, odd, part))
    spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/run={run_id}")


def finalized(spark: SparkSession, folder: str, name: str = "rollups", upto: int | None = None) -> DataFrame | None:
    """The rows of all finalized buckets (as of run `upto`), each from the part that its newest state names; None where no bucket is."""
    log = state_log(spark, folder)
    log = log if upto is None else log.filter(F.col("run") <= upto)
    state = current_state(log).filter("finalized").select("bucket_start", "part")
    if state.isEmpty():
        return None
    return spark.read.parquet(f"{folder}/{name}").join(state, ["bucket_start", "part"], "left_semi").drop("part")


def gate(state: DataFrame, ticks: DataFrame, rollups: DataFrame, widths: dict[str, int], least: float = 0.90) -> DataFrame:
    """(day, complete, covered): no bucket of the day has failed and all of each granularity are finalized; rollup rows of enough of its items."""
    whole = None
    for granularity, width in widths.items():
        own = state.filter(F.col("granularity") == granularity).groupBy(F.col("source_day").alias("day")).agg(
            ((F.count_if("failed") == 0) & (F.count_if("finalized") >= DAY_MS // width)).alias("ok"))
        whole = own if whole is None else whole.unionByName(own)
    s = whole.groupBy("day").agg((F.bool_and("ok") & (F.count("*") == len(widths))).alias("complete"))
    items = ticks.groupBy(epoch_day("snapshot_ts").alias("day")).agg(F.countDistinct("product_id").alias("items"))
    made = rollups.groupBy(epoch_day("bucket_start").alias("day")).agg(F.countDistinct("product_id").alias("rolled"))
    j = items.join(s, "day", "left").join(made, "day", "left")
    return j.select("day", F.coalesce("complete", F.lit(False)).alias("complete"),
        (F.coalesce("rolled", F.lit(0)) / F.col("items") >= least).alias("covered"))
