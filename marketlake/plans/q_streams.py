"""Queries that run a stream over the event table, with the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.exprs import DAY_MS
from ..operators import maintenance as M
from ..sources import adapters as A
from ..sources.files import read_or_empty, stored
from ..streaming import streams as ST
from .inputs_sql import sql
from .q_reads import ORACLES as READS
from .q_series import T
from .q_tables import _H, shared_folder

QUERIES: dict = {}
ORACLES: dict = {}


def landed(s: SparkSession, df: DataFrame, steps: int = 4, to: str | None = None) -> DataFrame:
    """df as a stream: landed in so many steps ordered by time, one read per micro-batch. A step has a file for every 250,000 of its rows."""
    to = to or shared_folder(s)
    order = next(c for c in ("snapshot_ts", "last_updated", "ts") if c in df.columns)
    lo, hi, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
    each = max(1, n // (250_000 * steps))
    if lo is None:
        df.write.mode("append").parquet(to)
    else:
        width = (hi - lo) // steps + 1
        for k in range(steps):
            df.filter((F.col(order) >= lo + k * width) & (F.col(order) < lo + (k + 1) * width)).repartition(each).write.mode(
                "append").parquet(to)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(to)


def collected(s: SparkSession, stream: DataFrame, mode: str = "append", batch=None) -> DataFrame:
    to = shared_folder(s)
    ST.run_to_table(stream, to, shared_folder(s), mode, batch)
    return read_or_empty(s, to, StructType([*stream.schema.fields, StructField("batch_id", IntegerType())]))


def _ticks(s, d):
    return A.quote_ticks(s, d).withColumn("ts", F.timestamp_millis("snapshot_ts"))


def o152(s, d):
    return collected(s, ST.closed_buckets(landed(s, _ticks(s, d)))).drop("batch_id")


def o157(s, d):
    return collected(s, ST.micro_features(landed(s, _ticks(s, d)), "6 hours", "3 hours")).drop("batch_id").withColumn("micro_volatility",
        F.round("micro_volatility", 9))


def o157_market(s, d):
    """The operator's own windows, 60 s sliding by 5 s, over the ticks of all products as one market, which are dense enough for them."""
    t = _ticks(s, d).withColumn("product_id", F.lit("ALL"))
    return collected(s, ST.micro_features(landed(s, t))).drop("batch_id").withColumn("micro_volatility", F.round("micro_volatility", 9))


def o149(s, d):
    """Two users, one of each feed, are a market, so that markets grow with the data."""
    u = A.table(s, d, "events").select(
        F.concat(F.lit("m"), F.floor(F.col("user_id") / 2)).alias("market"),
            F.when(F.col("user_id") % 2 == 0, "quotes").otherwise("listings").alias("feed"),
        A.ms("ts").alias("ts"), F.col("event_id").alias("payload"),
    )
    return collected(s, ST.pair_feeds(landed(s, u))).drop("batch_id")


def o156(s, d):
    """The history up to T as a stored table, from whose open segments the stream of the rest goes on."""
    h = stored(A.opportunity_history(s, d))
    old = stored(M.trend_segments(h.filter(F.col("snapshot_ts") <= T)))
    newest = M.first_per_key(old, ["flip_key"], [F.desc("valid_from")])
    base = h.select("flip_key", F.col("snapshot_ts").alias("valid_from"), "roi_per_hour", "liquidity_score", "risk_score", "partial")
    opened = newest.join(base, ["flip_key", "valid_from"]).select("flip_key", F.col("valid_from").alias("vf"), F.col("valid_to").alias("vt"),
        F.col("points").cast("long").alias("n"), F.col("profit").alias("p"), F.col("roi_per_hour").alias("r"), F.col("liquidity_score").alias("l"),
        F.col("risk_score").alias("k"), "partial", F.col("valid_to").alias("at"))
    rows = collected(s, ST.trend_segments(landed(s, h.filter(F.col("snapshot_ts") > T)), opened), "update").drop("batch_id")
    return M.first_per_key(old.unionByName(rows), ["flip_key", "valid_from"], [F.desc("valid_to")])


def o151(s, d):
    return collected(s, ST.changed_updates(landed(s, A.payload_updates(s, d)))).drop("batch_id")


def o150(s, d):
    """Row counts of the snapshots that micro-batches of one file each hand on."""
    return collected(s, landed(s, A.quote_grid(s, d)), batch=ST.latest_only).groupBy("snapshot_ts").agg(F.count("*").alias("n"))


def o158(s, d):
    """The same snapshots twice through the sink, the second time at other prices: the first generation stays."""
    to = shared_folder(s)
    g = A.quote_grid(s, d).select("snapshot_ts", "product_id", "buy_price")
    for run, rows in (("first", g), ("again", g.withColumn("buy_price", F.col("buy_price") * 2))):
        landed(s, rows).writeStream.option("checkpointLocation",
            shared_folder(s)).foreachBatch(ST.regenerate(to, run)).trigger(availableNow=True).start().awaitTermination()
    return ST.generated(s, to, g.schema)


QUERIES = {"o149_pair_feeds_stream": o149, "o150_latest_only": o150, "o151_changed_updates_stream": o151, "o152_closed_buckets": o152, "o156_trend_segments_stream": o156,
    "o157_micro_features_stream": o157, "o157_market_features_stream": o157_market, "o158_regenerate": o158}
_MAX = "(SELECT max(snapshot_ts) FROM quote_ticks) - 30000"
ORACLES["o152_closed_buckets"] = sql("quote_ticks",
    f"SELECT snapshot_ts // {DAY_MS} * {DAY_MS} AS bucket_start, product_id, count(*) AS n, avg(buy_price) AS avg_buy, min(buy_price) AS "
    f"min_buy, max(buy_price) AS max_buy FROM quote_ticks GROUP BY ALL").replace("SELECT snapshot_ts //",
        "SELECT * FROM (SELECT snapshot_ts //") + f") WHERE bucket_start + {DAY_MS} <= {_MAX}"
ORACLES["o149_pair_feeds_stream"] = sql("",
    """WITH u AS (SELECT 'm' || (user_id // 2) AS market, epoch_us(ts) // 1000 AS ts, CASE WHEN user_id % 2 = 0 THEN event_id END AS a, CASE WHEN user_id % 2 <> 0 THEN event_id END AS b FROM events),
  w AS (SELECT *, last_value(a IGNORE NULLS) OVER o AS payload_a, last_value(b IGNORE NULLS) OVER o AS payload_b FROM u WINDOW o AS (PARTITION BY market ORDER BY ts, coalesce(a, b) ROWS UNBOUNDED PRECEDING))
  SELECT market, ts, CASE WHEN a IS NOT NULL THEN 'a' ELSE 'b' END AS trigger, payload_a, payload_b FROM w WHERE payload_a IS NOT NULL AND payload_b IS NOT NULL""")
ORACLES["o156_trend_segments_stream"] = sql("opportunity_history", _H.replace("WITH RECURSIVE", "WITH", 1)).replace("WITH ",
    "WITH RECURSIVE ", 1)
ORACLES["o157_micro_features_stream"] = sql("quote_ticks",
    f"""WITH m AS (SELECT snapshot_ts, product_id, (buy_price + sell_price) / 2 AS m FROM quote_ticks WHERE buy_price > 0 AND sell_price > 0),
  w AS (SELECT *, snapshot_ts // 10800000 * 10800000 - o * 10800000 AS window_start FROM m, (SELECT unnest([0, 1]) AS o)),
  r AS (SELECT *, least(0.2, greatest(-0.2, ln(m / lag(m) OVER p))) AS r, lag(m) OVER p AS prev FROM w WINDOW p AS (PARTITION BY window_start, product_id ORDER BY snapshot_ts))
  SELECT window_start, product_id, count(*)::INT AS points, round(stddev_pop(r) FILTER (prev IS NOT NULL), 9) AS micro_volatility FROM r GROUP BY ALL HAVING count(*) > 2 AND window_start + 21600000 <= {_MAX}""")
ORACLES["o157_market_features_stream"] = sql("quote_ticks",
    f"""WITH m AS (SELECT snapshot_ts, (buy_price + sell_price) / 2 AS m FROM quote_ticks WHERE buy_price > 0 AND sell_price > 0),
  w AS (SELECT *, snapshot_ts // 5000 * 5000 - o * 5000 AS window_start FROM m, (SELECT unnest(range(12)) AS o)),
  r AS (SELECT *, least(0.2, greatest(-0.2, ln(m / lag(m) OVER p))) AS r, lag(m) OVER p AS prev FROM w WINDOW p AS (PARTITION BY window_start ORDER BY snapshot_ts, m))
  SELECT window_start, 'ALL' AS product_id, count(*)::INT AS points, round(stddev_pop(r) FILTER (prev IS NOT NULL), 9) AS micro_volatility FROM r GROUP BY ALL HAVING count(*) > 2 AND window_start + 60000 <= {_MAX}""")
ORACLES["o151_changed_updates_stream"] = READS["o151_changed_updates"]
ORACLES["o158_regenerate"] = sql("quote_grid", "SELECT snapshot_ts, product_id, buy_price FROM quote_grid")
ORACLES["o150_latest_only"] = sql("quote_grid",
    """WITH e AS (SELECT min(snapshot_ts) AS lo, (max(snapshot_ts) - min(snapshot_ts)) // 4 + 1 AS width FROM quote_grid),
  t AS (SELECT snapshot_ts, (snapshot_ts - lo) // width AS step FROM quote_grid, e)
  SELECT snapshot_ts, count(*) AS n FROM t WHERE (step, snapshot_ts) IN (SELECT (step, max(snapshot_ts)) FROM t GROUP BY step) GROUP BY 1""")
