"""Structured Streaming forms of feeds, buckets, features and segments."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.exprs import epoch_day
from ..operators import materialization as MZ
from ..operators.rollups import RollupParams, with_bucket
from ..sources.files import read_or_empty, stored


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
    batch: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Runs a stream over all that is available; each micro-batch, perhaps changed by `batch`, replaces its own partition, so that a repeated batch writes nothing twice."""

    def write(df: DataFrame, batch_id: int) -> None:
        out = batch(df, batch_id) if batch else df
        out.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode",
            "dynamic").partitionBy("batch_id").parquet(path)

    with state_store(stream.sparkSession):
        stream.writeStream.outputMode(mode).option("checkpointLocation",
            checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


CLOCK = "clock long, rows long, late long"


def materialize(ticks: DataFrame, folder: str, checkpoint: str, p: RollupParams = RollupParams(), compute=MZ.QUOTES, watermark_ms: int = 30_000,
    most: int = 1_000_000, close: bool = False) -> None:
    """Robust rollups of a stream of ticks (snapshot_ts, ...), over all that is available.

    Medians and deviations need all samples of a bucket, so a micro-batch lands its rows first; when the clock, the greatest
    snapshot seen, has passed a bucket's end by the watermark, the bucket is computed from what has landed and its state is
    written (`operators.materialization`), from which the next batch, or the next start, goes on. Rows of a finalized bucket
    are late and land apart. All folders are named by the batch and overwritten: a batch that is repeated after a stop reads
    the state of the batches before it and writes the same again. With `close` the stream has ended, and what is open closes.

    Tables below the folder: raw/batch=.../day=..., late/batch=..., clock/batch=..., and those of the materialization.
    """

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        state = MZ.current_state(MZ.state_log(spark, folder).filter(F.col("run") < batch)).filter(F.col("granularity") == p.granularity)
        done = state.filter("finalized").select("bucket_start")
        rows = with_bucket(df, p)
        for name, kept in (("raw", rows.join(done, "bucket_start", "left_anti")), ("late", rows.join(done, "bucket_start", "left_semi"))):
            kept.drop("bucket_start").withColumn("day", epoch_day("snapshot_ts")).write.mode("overwrite").partitionBy("day").parquet(
                f"{folder}/{name}/batch={batch}")
        seen = {n: read_or_empty(spark, f"{folder}/{n}/batch={batch}", df.schema).agg(F.max("snapshot_ts"), F.count("*")).first()
            for n in ("raw", "late")}
        before = read_or_empty(spark, f"{folder}/clock", f"{CLOCK}, batch long").filter(F.col("batch") < batch).agg(F.max("clock")).first()[0]
        clock = max((x for x in (before, seen["raw"][0], seen["late"][0]) if x is not None), default=None)
        spark.createDataFrame([(clock, seen["raw"][1], seen["late"][1])], CLOCK).coalesce(1).write.mode("overwrite").parquet(
            f"{folder}/clock/batch={batch}")
        if clock is not None:
            MZ.run(landed_rows(spark, folder, df.schema, batch), folder, batch, clock, p, compute, watermark_ms, most)

    query = ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    if close:
        spark = ticks.sparkSession
        last = read_or_empty(spark, f"{folder}/clock", f"{CLOCK}, batch long").agg(F.max("clock"), F.max("batch")).first()
        if last[0] is not None:
            MZ.run(landed_rows(spark, folder, ticks.schema, last[1]), folder, last[1] + 1, last[0] + p.width + watermark_ms + 1, p, compute,
                watermark_ms, most)


def landed_rows(spark: SparkSession, folder: str, schema: StructType, upto: int, name: str = "raw") -> DataFrame:
    """Rows of a landing table up to a batch, with their day."""
    whole = StructType([*schema.fields, StructField("day", LongType()), StructField("batch", LongType())])
    return read_or_empty(spark, f"{folder}/{name}", whole).filter(F.col("batch") <= upto).drop("batch")


def closed_buckets(ticks: DataFrame, width: str = "1 day", watermark: str = "30 seconds") -> DataFrame:
    """Plain aggregates of tumbling buckets, each put out once when the watermark has passed its end. ticks: ts timestamp."""
    g = ticks.withWatermark("ts", watermark).groupBy(F.window("ts", width), "product_id").agg(F.count("*").alias("n"),
        F.avg("buy_price").alias("avg_buy"), F.min("buy_price").alias("min_buy"), F.max("buy_price").alias("max_buy"))
    return g.select(F.unix_millis("window.start").alias("bucket_start"), "product_id", "n", "avg_buy", "min_buy", "max_buy")


def micro_features(ticks: DataFrame, width: str = "60 seconds", slide: str = "5 seconds", watermark: str = "30 seconds",
    cap: float = 0.20) -> DataFrame:
    """Points and population deviation of capped log returns in sliding windows of each product; windows are short, so their points fit an array."""
    mid = ((F.col("buy_price") + F.col("sell_price")) / 2.0).alias("m")
    g = ticks.filter("buy_price > 0 AND sell_price > 0").select("ts", "product_id", mid).withWatermark("ts",
        watermark).groupBy(F.window("ts", width, slide), "product_id").agg(F.array_sort(F.collect_list(F.struct("ts", "m"))).alias("p"))
    m = F.transform("p", lambda x: x["m"])
    r = F.transform(F.arrays_zip(F.slice(m, F.lit(2), F.size(m) - 1).alias("b"), F.slice(m, F.lit(1), F.size(m) - 1).alias("a")),
        lambda x: F.least(F.greatest(F.log(x["b"] / x["a"]), F.lit(-cap)), F.lit(cap)))
    g = g.filter(F.size("p") > 2).withColumn("r", r)
    mean = F.aggregate("r", F.lit(0.0), lambda a, x: a + x) / F.size("r")
    g = g.withColumn("mean", mean)
    var = F.aggregate("r", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("r")
    return g.select(F.unix_millis("window.start").alias("window_start"), "product_id", F.size("p").alias("points"),
        F.sqrt(var).alias("micro_volatility"))


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Keyed state in RocksDB, which the operators below need, while a query starts and runs; the session's setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Keyed(StatefulProcessor):
    """State of one value a key, which goes when the key has been idle for `ttl_ms` of event time.

    A subclass says how a key's rows, in order, change the value: step(key, rows, value) gives the output and the new value.
    Rows of a key come in frames without order; a micro-batch of a key is bounded by the source's files per trigger.
    """

    state = order = columns = ""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.state)

    def step(self, key: tuple, rows: pd.DataFrame, value: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(rows).sort_values(self.order, kind="stable")
        value = tuple(self.value.get()) if self.value.exists() else None
        ts, cuts = frame[self.order[0]].to_numpy(), [0, len(frame)]
        if self.ttl_ms is not None:  # the timer frees the state; what is idle is told by the rows' own times, whenever it fires
            if value is not None and any(t < ts[0] for t in self.handle.listTimers()):
                value = None
            cuts = [0, *(np.flatnonzero(np.diff(ts) > self.ttl_ms) + 1).tolist(), len(frame)]
        for i, j in zip(cuts, cuts[1:]):
            out, value = self.step(key, frame.iloc[i:j], None if i else value)
            yield out[list(self.columns)]
        if value is not None:
            self._keep(value, int(ts[-1]))
        elif self.value.exists():
            self.value.clear()

    def _keep(self, value: tuple, at: int) -> None:
        self.value.update(value)
        if self.ttl_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at + self.ttl_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.value.clear()
        yield pd.DataFrame(columns=list(self.columns))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        first = initialState.iloc[0]
        self._keep(tuple(x.item() if hasattr(x, "item") else x for x in (first[c.split()[0]] for c in self.state.split(", "))), int(first["at"]))

    def close(self) -> None:
        pass


def _apply(stream: DataFrame, key: str, ts: str, processor: Keyed, schema: str, mode: str, initial: DataFrame | None,
    watermark: str = "30 seconds") -> DataFrame:
    """The initial state is stored first: the plan of a micro-batch, which is not adaptive, reads it and holds none of its joins."""
    timed = stream.withColumn("__ts", F.timestamp_millis(ts)).withWatermark("__ts", watermark)
    return timed.groupBy(key).transformWithStateInPandas(processor, schema, mode, "eventTime",
        initialState=None if initial is None else stored(initial).groupBy(key))


class _Changes(Keyed):
    state, order, columns = "hash string", ["last_updated", "payload_id"], ("feed", "last_updated", "hash", "payload_id")

    def step(self, key, rows, value):
        before = rows["hash"].shift()
        if value is not None:
            before.iloc[0] = value[0]
        fresh = (rows["hash"] != before) & ~(rows["hash"].isna() & before.isna())
        if value is None:
            fresh.iloc[0] = True
        last = rows["hash"].iloc[-1]
        return rows[fresh].assign(feed=key[0]), (None if pd.isna(last) else str(last),)


def changed_updates(updates: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Updates (feed, last_updated, hash, payload_id) whose hash is not that of the feed's update before; a feed idle for ttl_ms begins anew."""
    return _apply(updates, "feed", "last_updated", _Changes(ttl_ms), "feed string, last_updated long, hash string, payload_id long", "Append", None)


PAIR = "market string, ts long, trigger string, payload_a long, payload_b long"


class _Pairs(Keyed):
    state, order, columns = "a long, b long, ta long, tb long", ["ts", "payload"], ("market", "ts", "trigger", "payload_a", "payload_b")

    def step(self, key, rows, value):
        a, b, seen_a, seen_b = value or (-1, -1, -1, -1)
        first = (rows["feed"] == "quotes").to_numpy()
        ts, payload = rows["ts"].to_numpy(), rows["payload"].to_numpy()
        keep = ts >= np.where(first, seen_a, seen_b)  # a feed's own watermark never goes back
        first, ts, payload = first[keep], ts[keep], payload[keep]
        newest = []
        for own, start in ((first, a), (~first, b)):  # the newest payload of each feed at every row
            at = np.maximum.accumulate(np.where(own, np.arange(len(own)), -1))
            newest.append(np.where(at >= 0, payload[at], start) if len(own) else payload)
        both = (newest[0] >= 0) & (newest[1] >= 0)
        out = pd.DataFrame({"market": key[0], "ts": ts[both], "trigger": np.where(first[both], "a", "b"), "payload_a": newest[0][both],
            "payload_b": newest[1][both]})
        if not len(ts):
            return out, value
        last = lambda own, was: int(ts[own].max()) if own.any() else was
        return out, (int(newest[0][-1]), int(newest[1][-1]), last(first, seen_a), last(~first, seen_b))


def pair_feeds(updates: DataFrame, initial: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Each update with the newest payload of the other feed of its market. updates: market, feed, ts, payload.

    State is one payload a feed; initial (market, a, b, ta, tb, at) is what is known before, and a market idle for ttl_ms is forgotten.
    """
    return _apply(updates, "market", "ts", _Pairs(ttl_ms), PAIR, "Append", initial)


SEGMENT = "flip_key string, valid_from long, valid_to long, points int, profit long"


class _Segments(Keyed):
    state = "vf long, vt long, n long, p long, r double, l double, k double, partial boolean"
    order, columns = ["snapshot_ts"], ("flip_key", "valid_from", "valid_to", "points", "profit")

    def __init__(self, ttl_ms: int | None, rel: float, points: float):
        super().__init__(ttl_ms)
        self.rel, self.points = rel, points

    def _stretch(self, x: list[np.ndarray], i: int, base: tuple) -> int:
        """The first row from i on that is not like the base; looked for in stretches that double."""
        size = 16
        while i < len(x[0]):
            p, r, liquidity, k, partial = (c[i : i + size] for c in x)
            like = (partial == base[4]) & (np.abs(p - base[0]) <= self.rel * abs(base[0])) & (np.abs(r - base[1]) <= self.rel * abs(base[1])) & (
                np.abs(liquidity - base[2]) <= self.points) & (np.abs(k - base[3]) <= self.points)
            if not like.all():
                return i + int(like.argmin())
            i, size = i + size, size * 2
        return len(x[0])

    def step(self, key, rows, value):
        if value is not None:
            rows = rows[rows["snapshot_ts"] > value[1]]
        ts = rows["snapshot_ts"].to_numpy()
        x = [rows[c].to_numpy() for c in ("profit", "roi_per_hour", "liquidity_score", "risk_score", "partial")]
        out, i = [], 0
        if value is not None and len(ts):
            i = self._stretch(x, 0, value[3:])
            if i:
                value = (value[0], int(ts[i - 1]), int(value[2]) + i, *value[3:])
                out.append(value)
        while i < len(ts):
            base = (int(x[0][i]), *(float(c[i]) for c in x[1:4]), bool(x[4][i]))
            j = self._stretch(x, i + 1, base)
            value = (int(ts[i]), int(ts[j - 1]), j - i, *base)
            out.append(value)
            i = j
        frame = pd.DataFrame([(key[0], v[0], v[1], v[2], v[3]) for v in out], columns=list(self.columns))
        return frame, value


def trend_segments(history: DataFrame, initial: DataFrame | None = None, rel: float = 0.05, points: float = 3.0,
    ttl_ms: int | None = None) -> DataFrame:
    """Segments as they grow (update mode): the newest row of (flip_key, valid_from) counts.

    State is the open segment's first values; initial (flip_key, vf, vt, n, p, r, l, k, partial, at) holds the stored table's
    open segments, from which the stream goes on. A key idle for ttl_ms begins a new segment when it comes back.
    """
    return _apply(history, "flip_key", "snapshot_ts", _Segments(ttl_ms, rel, points), SEGMENT, "Update", initial)


def latest_only(batch: DataFrame, batch_id: int) -> DataFrame:
    """Of a micro-batch, the rows of its greatest snapshot: what a queue that keeps the latest hands on."""
    top = batch.agg(F.max("snapshot_ts").alias("__t"))
    return batch.join(F.broadcast(top), F.col("snapshot_ts") == F.col("__t"), "left_semi")


GENERATED = "snapshot_ts long, run string, batch long"


def regenerate(path: str, run: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink keyed by snapshot: one that has been generated already is left as it is, another is written.

    Rows are written first, then the log of the batch's snapshots, which is what counts: a batch that stopped between them is
    cleared and written again. run names the query, as each begins to count its batches anew. Tables: rows, generated.
    """

    def write(df: DataFrame, batch: int) -> None:
        log = read_or_empty(df.sparkSession, f"{path}/generated", GENERATED)
        done = log.filter(~((F.col("run") == run) & (F.col("batch") == batch))).select("snapshot_ts").distinct()
        df.join(done, "snapshot_ts", "left_anti").write.mode("overwrite").parquet(f"{path}/rows/run={run}/batch={batch}")
        fresh = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows/run={run}/batch={batch}")
        fresh.select("snapshot_ts").distinct().coalesce(1).write.mode("overwrite").parquet(f"{path}/generated/run={run}/batch={batch}")

    return write


def generated(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all generated snapshots."""
    whole = StructType([*schema.fields, StructField("run", StringType()), StructField("batch", LongType())])
    log = read_or_empty(spark, f"{path}/generated", GENERATED)
    return read_or_empty(spark, f"{path}/rows", whole).join(log, ["snapshot_ts", "run", "batch"], "left_semi").select(*schema.names)
