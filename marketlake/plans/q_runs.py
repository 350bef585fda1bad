"""Queries of durable runs: bucket state, repair, the gate, streamed rollups and compaction, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.exprs import DAY_MS
from ..operators import materialization as MZ
from ..operators import rollups as R
from ..sources import adapters as A
from ..sources.files import write_snapshots
from ..streaming import streams as ST
from .inputs_sql import sql
from .q_series import QUOTE, QUOTE_ROLLUP, P, T
from .q_streams import landed
from .q_tables import shared_folder

QUERIES: dict = {}
ORACLES: dict = {}
#: When the runs take place, and the days whose rows cannot be read the first time.
NOW = 1_705_700_000_000
DAMAGED = (T + 2 * DAY_MS, T + 5 * DAY_MS)


def q(name: str, fn, inputs: str, body: str) -> None:
    QUERIES[name] = fn
    ORACLES[name] = sql(inputs, body)


def damaged(ticks: DataFrame) -> DataFrame:
    """Ticks whose prices of two days raise an error when they are read."""
    day = F.floor(F.col("snapshot_ts") / DAY_MS) * DAY_MS
    return ticks.withColumn("buy_price", F.when(day.isin(*DAMAGED), F.raise_error(F.lit("damaged partition")).cast("double")).otherwise(
        F.col("buy_price")))


def ticks_by_day(s: SparkSession, d: str) -> DataFrame:
    """Ticks as a table partitioned by day: a run reads its input again for each attempt, and a half of the buckets reads its own days alone."""
    to, ticks = shared_folder(s), A.quote_ticks(s, d)
    write_snapshots(ticks, to)
    return s.read.schema(StructType([*ticks.schema.fields, StructField("day", LongType())])).parquet(to)


def two_runs(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    """(folder, ticks) after a run in which two days cannot be read, and one that repairs them."""
    folder, ticks = shared_folder(s), A.quote_ticks(s, d)
    MZ.run(damaged(ticks), folder, 1, NOW, P)
    MZ.run(ticks, folder, 2, NOW, P)
    return folder, ticks


def o153(s, d):
    """Due after the first run: the failed days, and the last closed one, which failed too; a day later the next as well."""
    folder, ticks = shared_folder(s), ticks_by_day(s, d)
    MZ.run(damaged(ticks), folder, 1, NOW, P)
    state = MZ.current_state(MZ.state_log(s, folder))
    parts = [MZ.due_and_failed(state, ticks, at, P).withColumn("now", F.lit(at)) for at in (NOW, NOW + DAY_MS)]
    return parts[0].unionByName(parts[1])


def o154(s, d):
    folder, _ = two_runs(s, d)
    return MZ.state_log(s, folder).drop("part", "bucket_end", "source_day")


def o161(s, d):
    folder, ticks = two_runs(s, d)
    log = MZ.state_log(s, folder)
    parts = []
    for k in (1, 2):
        rolled = MZ.finalized(s, folder, upto=k)
        rolled = rolled if rolled is not None else s.createDataFrame([], "bucket_start long, product_id string")
        parts.append(MZ.gate(MZ.current_state(log.filter(F.col("run") <= k)), ticks, rolled, {"1d": DAY_MS}).withColumn("run", F.lit(k)))
    return parts[0].unionByName(parts[1])


_LAST = NOW // DAY_MS * DAY_MS - DAY_MS
_BAD = f"({DAMAGED[0]}, {DAMAGED[1]})"
_DAYS = f"b AS (SELECT unnest(generate_series((SELECT min(snapshot_ts) // {DAY_MS} * {DAY_MS} FROM quote_ticks), least({_LAST}, (SELECT max(snapshot_ts) // {DAY_MS} * {DAY_MS} FROM quote_ticks)), {DAY_MS})) AS bucket_start)"
_COUNTS = f"""raw AS (SELECT snapshot_ts // {DAY_MS} * {DAY_MS} AS bucket_start, count(*) AS n FROM quote_ticks GROUP BY 1), rolled AS (SELECT bucket_start, count(DISTINCT product_id) AS n FROM kept GROUP BY 1), odd AS (SELECT bucket_start, count(DISTINCT product_id) AS n FROM bad GROUP BY 1)"""
q("o153_due_buckets", o153, "quote_ticks",
    f"WITH {_DAYS} SELECT bucket_start, {NOW} AS now FROM b WHERE bucket_start IN {_BAD} OR bucket_start > (SELECT max(bucket_start) FROM b WHERE bucket_start NOT IN {_BAD}) "
    f"UNION ALL SELECT bucket_start, {NOW + DAY_MS} FROM (SELECT bucket_start FROM b UNION SELECT max(bucket_start) + {DAY_MS} FROM b WHERE (SELECT max(snapshot_ts) FROM quote_ticks) >= {_LAST + DAY_MS}) "
    f"WHERE bucket_start IN {_BAD} OR bucket_start > (SELECT max(bucket_start) FROM b WHERE bucket_start NOT IN {_BAD})")
q("o154_bucket_state", o154, "quote_ticks",
    QUOTE + f""", {_DAYS}, {_COUNTS}, r AS (SELECT 1 AS run, *, bucket_start IN {_BAD} AS failed FROM b UNION ALL SELECT 2, *, false FROM b WHERE bucket_start IN {_BAD})
  SELECT run::BIGINT AS run, '1d' AS granularity, r.bucket_start, NOT failed AS finalized, failed, CASE WHEN failed THEN 0 ELSE coalesce(raw.n, 0) END AS raw_rows,
    CASE WHEN failed THEN 0 ELSE coalesce(rolled.n, 0) END AS rollup_rows, CASE WHEN failed THEN 0 ELSE coalesce(odd.n, 0) END AS anomaly_rows
  FROM r LEFT JOIN raw USING (bucket_start) LEFT JOIN rolled USING (bucket_start) LEFT JOIN odd USING (bucket_start)""")
q("o161_materialization_gate", o161, "quote_ticks",
    QUOTE + f""", {_DAYS}, {_COUNTS}, i AS (SELECT snapshot_ts // {DAY_MS} * {DAY_MS} AS bucket_start, count(DISTINCT product_id) AS items FROM quote_ticks GROUP BY 1),
  ok AS (SELECT run, bucket_start FROM b, (SELECT unnest([1, 2]) AS run) WHERE run = 2 OR bucket_start NOT IN {_BAD})
  SELECT i.bucket_start // {DAY_MS} AS day, runs.run::INT AS run, ok.run IS NOT NULL AS complete, CASE WHEN ok.run IS NULL THEN 0 ELSE coalesce(rolled.n, 0) END / items >= 0.9 AS covered
  FROM i CROSS JOIN (SELECT unnest([1, 2]) AS run) runs LEFT JOIN ok ON ok.run = runs.run AND ok.bucket_start = i.bucket_start LEFT JOIN rolled ON rolled.bucket_start = i.bucket_start""")


def _late(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ticks in time, ticks that come when their day has long closed)."""
    late = (F.col("k") % 10 == 0) & (F.col("snapshot_ts") < T)
    return df.filter(~late), df.filter(late)


def streamed(s: SparkSession, d: str) -> str:
    """The tables after a stream of ticks in order of time, its second start with late ones, and its end."""
    folder, checkpoint = shared_folder(s), shared_folder(s)
    in_time, late = _late(A.quote_ticks(s, d))
    to = shared_folder(s)
    for rows, close in ((in_time, False), (late, True)):
        stream = landed(s, rows, to=to)
        ST.materialize(stream, folder, checkpoint, P, close=close)
    return folder


def o065_stream(s, d):
    rows = MZ.finalized(s, streamed(s, d))
    return R.bucket_rollup_quotes(A.quote_ticks(s, d), P).limit(0) if rows is None else rows


def o155_stream(s, d):
    ticks = A.quote_ticks(s, d)
    return ST.landed_rows(s, streamed(s, d), ticks.schema, 2**31, "late").groupBy("day").agg(F.count("*").alias("n"))


_IN_TIME = "FROM quote_ticks WHERE (NOT (k % 10 = 0 AND snapshot_ts < {}) OR k IS NULL) AND buy_price > 0".format(T)
q("o065_bucket_rollup_stream", o065_stream, "quote_ticks", QUOTE_ROLLUP.replace("FROM quote_ticks WHERE buy_price > 0", _IN_TIME, 1))
q("o155_late_rows_stream", o155_stream, "quote_ticks",
    f"SELECT snapshot_ts // {DAY_MS} AS day, count(*) AS n FROM quote_ticks WHERE k % 10 = 0 AND snapshot_ts < {T} GROUP BY 1")
