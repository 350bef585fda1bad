"""Queries of rollups, anomalies, features and history, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import DAY_MS
from ..operators import features as X
from ..operators import keys as K
from ..operators import reads as D
from ..operators import rollups as R
from ..sources import adapters as A
from ..sources.files import stored
from .inputs_sql import sql

QUERIES: dict = {}
ORACLES: dict = {}
#: The driver's quotes are sparse: about 17 a product and day.
P = R.RollupParams(granularity="1d", cadence_ms=3_600_000, merge_gap_ms=21_600_000, z=3.0)
T = 1_705_104_000_000  # 2024-01-13


def q(name: str, fn, inputs: str, body: str | None) -> None:
    QUERIES[name] = fn
    if body is not None:
        ORACLES[name] = sql(inputs, body)


def _centers(metrics: list[str], key: str) -> str:
    med = ", ".join(f"coalesce(median({m}), 0) AS {m}_med, coalesce(mad({m}), 0) AS {m}_mad" for m in metrics)
    return f"centers AS (SELECT bucket_start, {key}, {med} FROM samples GROUP BY ALL)"


def _tail(key: str) -> str:
    return f""", scored AS (SELECT *, list_max(list_transform(hits, lambda h: h.score)) AS score, CASE WHEN len(list_distinct(list_transform(hits, lambda h: h.reason))) > 1 THEN 'MULTI_SIGNAL' ELSE hits[1].reason END AS reason FROM
    (SELECT *, list_filter(raw_hits, lambda h: h.ok) AS hits FROM signals)),
  isl AS (SELECT *, sum(new) OVER (PARTITION BY bucket_start, {key} ORDER BY snapshot_ts) AS island FROM
    (SELECT *, CASE WHEN snapshot_ts - lag(snapshot_ts) OVER (PARTITION BY bucket_start, {key} ORDER BY snapshot_ts) <= 21600000 THEN 0 ELSE 1 END AS new FROM scored WHERE reason IS NOT NULL)),
  valid AS (SELECT bucket_start, {key}, count(*) AS valid_count FROM samples GROUP BY ALL),
  bad AS (SELECT i.* FROM (SELECT *, count(*) OVER w AS n, max(snapshot_ts) OVER w - min(snapshot_ts) OVER w AS dur FROM isl WINDOW w AS (PARTITION BY bucket_start, {key}, island)) i JOIN valid USING (bucket_start, {key}) WHERE n >= 2 OR dur >= 10000 OR n >= 0.2 * valid_count),
  marked AS (SELECT s.*, b.snapshot_ts IS NOT NULL AS is_bad, count(*) OVER w AS valid_count, count_if(b.snapshot_ts IS NULL) OVER w AS good FROM samples s LEFT JOIN bad b ON b.bucket_start = s.bucket_start AND b.{key} = s.{key} AND b.snapshot_ts = s.snapshot_ts WINDOW w AS (PARTITION BY s.bucket_start, s.{key})),
  kept AS (SELECT *, good = 0 AS all_anomalous FROM marked WHERE valid_count >= 2 AND (NOT is_bad OR good = 0))"""


def _z(m: str) -> str:
    return f"(0.6745 * ({m} - {m}_med) / greatest(1e-9, {m}_mad))"


QUOTE = f"""WITH samples AS (SELECT *, (snapshot_ts // {DAY_MS}) * {DAY_MS} AS bucket_start, (buy_price + sell_price) / 2 AS mid, abs(buy_price - sell_price) / ((buy_price + sell_price) / 2) AS spread, least(buy_volume, sell_volume)::DOUBLE AS liquidity,
    ln((buy_price + sell_price) / 2) AS log_mid, ln(1 + least(buy_volume, sell_volume)::DOUBLE) AS log_liquidity FROM quote_ticks WHERE buy_price > 0 AND sell_price > 0),
  {_centers(R.QUOTE_METRICS, 'product_id')},
  signals AS (SELECT *, [{{score: abs({_z('log_mid')}), reason: 'PRICE_SPIKE', ok: abs({_z('log_mid')}) >= 3 AND abs(exp(log_mid - log_mid_med) - 1) >= 0.08}},
    {{score: {_z('spread')}, reason: 'SPREAD_BLOWOUT', ok: {_z('spread')} >= 3 AND spread >= 2 * spread_med}},
    {{score: -{_z('log_liquidity')}, reason: 'LIQUIDITY_COLLAPSE', ok: -{_z('log_liquidity')} >= 3 AND liquidity <= 0.25 * (exp(log_liquidity_med) - 1)}}] AS raw_hits FROM samples JOIN centers USING (bucket_start, product_id))""" + _tail("product_id")
LISTING = f"""WITH samples AS (SELECT *, (snapshot_ts // {DAY_MS}) * {DAY_MS} AS bucket_start, ln(anchor) AS log_anchor, ln(p50) AS log_p50, ln(1 + bin_count) AS log_count FROM
    (SELECT *, coalesce(CASE WHEN bin_lowest5_mean > 0 THEN bin_lowest5_mean END, CASE WHEN bin_p50 > 0 THEN bin_p50 END)::DOUBLE AS anchor, coalesce(CASE WHEN bin_p50 > 0 THEN bin_p50 END, CASE WHEN bin_lowest5_mean > 0 THEN bin_lowest5_mean END)::DOUBLE AS p50 FROM listing_points) WHERE anchor IS NOT NULL),
  {_centers(R.LISTING_METRICS, 'item_key')},
  signals AS (SELECT *, [{{score: abs({_z('log_anchor')}), reason: 'PRICE_SPIKE', ok: abs({_z('log_anchor')}) >= 3 AND abs(exp(log_anchor - log_anchor_med) - 1) >= 0.10}},
    {{score: abs({_z('log_p50')}), reason: 'PRICE_SPIKE', ok: abs({_z('log_p50')}) >= 3 AND abs(exp(log_p50 - log_p50_med) - 1) >= 0.10}},
    {{score: -{_z('log_count')}, reason: 'INVENTORY_COLLAPSE', ok: -{_z('log_count')} >= 3 AND bin_count <= 0.30 * (exp(log_count_med) - 1)}}] AS raw_hits FROM samples JOIN centers USING (bucket_start, item_key))""" + _tail("item_key")


def _roll(value: str, key: str, medians: str, more: str = "") -> str:
    return f""", g AS (SELECT bucket_start, {key}, quantile_cont({value}, 0.1) AS p10, quantile_cont({value}, 0.25) AS p25, quantile_cont({value}, 0.75) AS p75, quantile_cont({value}, 0.9) AS p90, min({value}) AS min, max({value}) AS max, {medians}{more},
    any_value(valid_count) AS valid_count, any_value(valid_count) < 2 OR any_value(valid_count) / 24e0 < 0.35 OR any_value(all_anomalous) AS partial, count(*) AS used_count FROM kept GROUP BY ALL)
  SELECT g.*, w.winsorized FROM g JOIN (SELECT k.bucket_start, k.{key}, avg(least(greatest(k.{value}, g.p10), g.p90)) AS winsorized FROM kept k JOIN g ON g.bucket_start = k.bucket_start AND g.{key} = k.{key} GROUP BY ALL) w USING (bucket_start, {key})"""


def _segments(key: str, metrics: list[str], medians: str) -> str:
    med = ", ".join(f"median({m}) AS {m}_m, mad({m}) AS {m}_d" for m in metrics)
    dist = " + ".join(f"abs({m} - {m}_m) / greatest(1e-9, {m}_d)" for m in metrics)
    return f""", c2 AS (SELECT bucket_start, {key}, {med} FROM bad GROUP BY ALL), rep AS (SELECT bucket_start, {key}, arg_min(snapshot_ts, {{d: round({dist}, 9), t: snapshot_ts}}) AS representative_ts FROM bad JOIN c2 USING (bucket_start, {key}) GROUP BY ALL)
  SELECT s.*, representative_ts FROM (SELECT bucket_start, {key}, min(snapshot_ts) AS segment_start, max(snapshot_ts) AS segment_end, arg_max(snapshot_ts, {{s: score, t: -snapshot_ts}}) AS peak_ts, max(score) AS score,
    CASE WHEN count(DISTINCT island) > 1 THEN 'MULTI_ANOMALY_CLUSTER' ELSE arg_max(reason, {{s: score, t: -snapshot_ts}}) END AS reason, count(DISTINCT island) > 1 AS fragmented, count(*) AS sample_count, {medians} FROM bad GROUP BY ALL) s JOIN rep USING (bucket_start, {key})"""


_QM = "median(mid) AS median_mid, median(buy_price) AS median_buy, median(sell_price) AS median_sell, median(spread) AS median_spread, median(buy_volume) AS median_buy_volume, median(sell_volume) AS median_sell_volume, min(liquidity) AS liquidity_min, max(liquidity) AS liquidity_max"
_LM = "median(p50) AS median_p50, median(anchor) AS median_anchor, median(bin_lowest) AS median_lowest, median(bin_p95) AS median_p95, median(bin_count) AS median_count, median(ending_soon_count) AS median_ending"
QUOTE_ROLLUP = QUOTE + _roll("mid", "product_id", _QM)
q("o065_bucket_rollup_quotes", lambda s, d: R.bucket_rollup_quotes(A.quote_ticks(s, d), P), "quote_ticks", QUOTE_ROLLUP)
q("o066_bucket_rollup_listings", lambda s, d: R.bucket_rollup_listings(A.listing_points(s, d), P), "listing_points",
    LISTING + _roll("p50", "item_key", _LM))
q("o067_partial", lambda s, d: R.bucket_rollup_quotes(A.quote_ticks(s, d), P).groupBy("partial").agg(F.count("*").alias("n")),
    "quote_ticks", QUOTE + " SELECT partial, count(*) AS n FROM (SELECT any_value(valid_count) / 24e0 < 0.35 OR any_value(all_anomalous) "
    "AS partial FROM kept GROUP BY bucket_start, product_id) GROUP BY 1")
q("o081_metric_centers", lambda s, d: R.metric_centers(R.with_bucket(R.valid_quote_samples(A.quote_ticks(s, d)), P),
    ["bucket_start", "product_id"], R.QUOTE_METRICS), "quote_ticks", QUOTE + " SELECT * FROM centers")
_sig = lambda s, d: R.quote_samples(A.quote_ticks(s, d), P)
q("o082_robust_z", lambda s, d: _sig(s, d)[0].select("snapshot_ts", "product_id",
    R.robust_z(F.col("log_mid"), F.col("log_mid_med"), F.col("log_mid_mad")).alias("z")).filter("abs(z) < 1000"), "quote_ticks",
    QUOTE + f" SELECT snapshot_ts, product_id, {_z('log_mid')} AS z FROM signals WHERE abs(z) < 1000")
q("o083_quote_signals", lambda s, d: _sig(s, d)[0].filter("reason IS NOT NULL").select("snapshot_ts", "product_id", "reason", "score"),
    "quote_ticks", QUOTE + " SELECT snapshot_ts, product_id, reason, score FROM scored WHERE reason IS NOT NULL")
q("o084_listing_signals",
    lambda s, d: R.listing_samples(A.listing_points(s, d), P)[0].filter("reason IS NOT NULL").select("snapshot_ts", "item_key", "reason",
    "score"), "listing_points", LISTING + " SELECT snapshot_ts, item_key, reason, score FROM scored WHERE reason IS NOT NULL")
q("o085_merge_islands", lambda s, d: R.merge_islands(A.quote_ticks(s, d), ["product_id"], 3_600_000).select("product_id", "snapshot_ts",
    F.col("island").cast("long").alias("island")), "quote_ticks",
    "SELECT product_id, snapshot_ts, (sum(CASE WHEN g <= 3600000 THEN 0 ELSE 1 END) OVER (PARTITION BY product_id ORDER BY "
    "snapshot_ts))::BIGINT AS island FROM (SELECT *, snapshot_ts - lag(snapshot_ts) OVER (PARTITION BY product_id ORDER BY snapshot_ts) "
        "AS g FROM quote_ticks)")
q("o086_qualify_groups", lambda s, d: _sig(s, d)[1].select("bucket_start", "product_id", "snapshot_ts",
    F.col("island").cast("long").alias("island")), "quote_ticks",
    QUOTE + " SELECT bucket_start, product_id, snapshot_ts, island::BIGINT AS island FROM bad")
q("o087_quote_segments", lambda s, d: R.quote_segments(A.quote_ticks(s, d), P), "quote_ticks",
    QUOTE + _segments("product_id", R.QUOTE_METRICS,
    "median(mid) AS median_mid, median(spread) AS median_spread, median(liquidity) AS median_liquidity"))
q("o087_listing_segments", lambda s, d: R.listing_segments(A.listing_points(s, d), P), "listing_points",
    LISTING + _segments("item_key", R.LISTING_METRICS,
    "median(anchor) AS median_anchor, median(p50) AS median_p50, median(bin_count) AS median_count"))
q("o088_representative_ts", lambda s, d: R.representative_ts(_sig(s, d)[1], ["bucket_start", "product_id"], R.QUOTE_METRICS), "quote_ticks",
    QUOTE + _segments("product_id", R.QUOTE_METRICS, "count(*) AS n").replace("SELECT s.*, representative_ts",
    "SELECT s.bucket_start, s.product_id, representative_ts"))


def _kept(s, d):
    samples, _, by = _sig(s, d)
    return R.kept_samples(samples, by).select("bucket_start", "product_id", "snapshot_ts", "all_anomalous")


q("o089_exclude_anomalies", _kept, "quote_ticks", QUOTE + " SELECT bucket_start, product_id, snapshot_ts, all_anomalous FROM kept")
# a six-hour grid, with a day as the micro window
W = 86_400_000
_MIC = f"""WITH m AS (SELECT *, (buy_price + sell_price) / 2 AS mid FROM quote_grid WHERE buy_price > 0 AND sell_price > 0), w AS (SELECT * FROM m WHERE snapshot_ts >= {T - W} AND snapshot_ts <= {T}),
  r AS (SELECT *, ln(mid / lag(mid) OVER (PARTITION BY product_id ORDER BY snapshot_ts)) AS r FROM w),
  mv AS (SELECT product_id, count(*) AS micro_points, count(r) AS micro_returns, CASE WHEN count(r) >= 2 THEN stddev_pop(CASE WHEN r IS NOT NULL THEN least(greatest(r, -0.2), 0.2) END) END AS micro_volatility FROM r GROUP BY 1),
  mr AS (SELECT product_id, CASE WHEN nt < lt THEN ln(lm / nm) END AS micro_return FROM (SELECT product_id, max(snapshot_ts) AS lt, arg_max(mid, snapshot_ts) AS lm, arg_min(snapshot_ts, {{d: abs(snapshot_ts - {T - W}), t: snapshot_ts}}) AS nt, arg_min(mid, {{d: abs(snapshot_ts - {T - W}), t: snapshot_ts}}) AS nm FROM w GROUP BY 1)),
  a AS (SELECT *, snapshot_ts // {DAY_MS} AS day, abs(buy_price - sell_price) / mid AS spread, least(CASE WHEN buy_moving_week > 0 THEN buy_moving_week ELSE buy_volume END, CASE WHEN sell_moving_week > 0 THEN sell_moving_week ELSE sell_volume END) / 168e0 AS turnover FROM m
    WHERE snapshot_ts IN (SELECT min(snapshot_ts) FROM quote_grid WHERE snapshot_ts >= {(T // DAY_MS - 32) * DAY_MS} AND snapshot_ts <= {T} GROUP BY snapshot_ts // {DAY_MS})),
  ds AS (SELECT product_id, day, mid, spread, turnover, CASE WHEN day - lag(day) OVER o = 1 THEN ln(mid / lag(mid) OVER o) END AS ret FROM a WINDOW o AS (PARTITION BY product_id ORDER BY day)),
  mav AS (SELECT product_id, count(*) AS macro_returns, CASE WHEN count(*) >= 2 THEN stddev_pop(ret) END AS macro_volatility FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY day DESC) AS rn FROM ds WHERE ret IS NOT NULL) WHERE rn <= 30 GROUP BY 1),
  mar AS (SELECT product_id, coalesce(max(ret) FILTER (day = {T // DAY_MS}), last(ret ORDER BY day)) AS macro_return, count(*) AS macro_days FROM ds GROUP BY 1),
  nw AS (SELECT product_id, abs(buy_price - sell_price) / ((buy_price + sell_price) / 2) >= 0.05 AS wide, least(CASE WHEN buy_moving_week > 0 THEN buy_moving_week ELSE buy_volume END, CASE WHEN sell_moving_week > 0 THEN sell_moving_week ELSE sell_volume END) / 168e0 <= 10 AS thin
    FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY snapshot_ts DESC) AS rn FROM quote_grid WHERE snapshot_ts <= {T}) WHERE rn = 1),
  d7 AS (SELECT product_id, count(*) AS n, median(spread) AS s, median(turnover) AS v FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY day DESC) AS rn FROM ds) WHERE rn <= 7 GROUP BY 1),
  il AS (SELECT product_id, (wide AND thin) OR coalesce(n >= 3 AND (s >= 0.05 OR v <= 10), false) AS illiquid FROM nw LEFT JOIN d7 USING (product_id))"""
q("o090_micro_volatility", lambda s, d: X.micro_volatility(A.quote_grid(s, d), T, W), "quote_grid", _MIC + " SELECT * FROM mv")
q("o091_micro_return", lambda s, d: X.micro_return(A.quote_grid(s, d), T, W), "quote_grid", _MIC + " SELECT * FROM mr")
q("o092_daily_series", lambda s, d: X.daily_series(A.quote_grid(s, d), T), "quote_grid", _MIC + " SELECT * FROM ds")
q("o093_macro_volatility", lambda s, d: X.macro_volatility(X.daily_series(A.quote_grid(s, d), T)), "quote_grid",
    _MIC + " SELECT * FROM mav")
q("o094_macro_return", lambda s, d: X.macro_return(X.daily_series(A.quote_grid(s, d), T), T), "quote_grid", _MIC + " SELECT * FROM mar")
_FEAT = """ SELECT product_id, micro_volatility, micro_return, CASE WHEN coalesce(micro_points, 0) >= 10 AND micro_volatility IS NOT NULL AND micro_return IS NOT NULL THEN 'HIGH' WHEN coalesce(micro_points, 0) >= 6 AND coalesce(micro_volatility, micro_return) IS NOT NULL THEN 'MED' ELSE 'LOW' END AS micro_confidence,
  macro_volatility, macro_return, CASE WHEN coalesce(macro_returns, 0) >= 7 AND coalesce(macro_volatility, macro_return) IS NOT NULL THEN 'HIGH' WHEN coalesce(macro_returns, 0) >= 3 AND coalesce(macro_volatility, macro_return) IS NOT NULL THEN 'MED' ELSE 'LOW' END AS macro_confidence, illiquid
  FROM nw LEFT JOIN mv USING (product_id) LEFT JOIN mr USING (product_id) LEFT JOIN mav USING (product_id) LEFT JOIN mar USING (product_id) LEFT JOIN il USING (product_id)"""
q("o095_confidence", lambda s, d: X.timescale_features(A.quote_grid(s, d), T, W).groupBy("micro_confidence",
    "macro_confidence").agg(F.count("*").alias("n")), "quote_grid",
    _MIC + ", f AS (" + _FEAT + ") SELECT micro_confidence, macro_confidence, count(*) AS n FROM f GROUP BY ALL")
q("o096_structurally_illiquid",
    lambda s, d: X.structurally_illiquid(X.latest(A.quote_grid(s, d).filter(F.col("snapshot_ts") <= T)),
    X.daily_series(A.quote_grid(s, d), T)), "quote_grid",
    _MIC + f" SELECT il.* FROM il WHERE product_id IN (SELECT product_id FROM quote_grid WHERE snapshot_ts = (SELECT max(snapshot_ts) "
    f"FROM quote_grid WHERE snapshot_ts <= {T}))")
q("o097_timescale_features", lambda s, d: X.timescale_features(A.quote_grid(s, d), T, W), "quote_grid", _MIC + _FEAT)


def history(s, d, range_name: str):
    return X.price_history(A.quote_grid(s, d), T, range_name, A.auction_snapshots(s, d), K.aliases(A.items(s, d)))


def histories(s, d):
    """The histories of 24 hours, 7 and 30 days, over stored feeds that are read more than once."""
    grid, auctions = stored(A.quote_grid(s, d)), stored(A.auction_snapshots(s, d))
    return X.price_histories(grid, T, ["24h", "7d", "30d"], auctions, K.aliases(A.items(s, d)))


def _hist(range_name: str, name: str) -> str:
    """CTEs that end in the history of a range under a name."""
    back, width = X.HISTORY_RANGES[range_name]
    when, n = f"snapshot_ts >= {T - back} AND snapshot_ts <= {T}", name
    return f"""{n}_last AS (SELECT snapshot_ts // {width} * {width} AS bucket, max(snapshot_ts) AS snapshot_ts FROM (SELECT snapshot_ts FROM quote_grid UNION ALL SELECT snapshot_ts FROM auction_snapshots) WHERE {when} GROUP BY 1),
  {n}_q AS (SELECT product_id AS item_id, bucket, floor(buy_price + 0.5)::BIGINT AS buy_price, floor(sell_price + 0.5)::BIGINT AS sell_price, buy_volume AS volume FROM quote_grid JOIN {n}_last USING (snapshot_ts)),
  {n}_n AS (SELECT bucket, item_name, min(starting_bid) AS low, sum(CASE WHEN highest_bid > 0 THEN highest_bid ELSE starting_bid END)::BIGINT AS s, count(*) AS n FROM auction_snapshots JOIN {n}_last USING (snapshot_ts) GROUP BY ALL),
  {n}_a AS (SELECT item_id, bucket, min(low)::BIGINT AS buy_price, sum(s)::BIGINT // sum(n)::BIGINT AS sell_price, sum(n)::BIGINT AS volume FROM {n}_n JOIN named USING (item_name) GROUP BY ALL),
  {n} AS (SELECT * FROM {n}_q UNION ALL SELECT * FROM {n}_a WHERE (item_id, bucket) NOT IN (SELECT (item_id, bucket) FROM {n}_q))"""


_NAMED = "named AS (SELECT DISTINCT item_name, item_id FROM (SELECT item_name, upper(trim(item_name)) AS u FROM (SELECT DISTINCT item_name FROM auction_snapshots)) JOIN item_aliases ON contains(u, alias) OR contains(regexp_replace(u, '[_ ]', '', 'g'), alias))"
_FEEDS = "quote_grid auction_snapshots items item_aliases"
q("o098_price_history", lambda s, d: history(s, d, "7d"), _FEEDS, f"WITH {_NAMED}, {_hist('7d', 'h')} SELECT * FROM h")
q("o099_score_history", lambda s, d: X.score_history(history(s, d, "30d")), _FEEDS,
    f"WITH {_NAMED}, {_hist('30d', 'h')}" + """, v AS (SELECT *, coalesce(least(100, greatest(0, volume * 100e0 / nullif(max(CASE WHEN volume > 0 THEN volume END) OVER (PARTITION BY item_id), 0))), 0) AS liq, lag(sell_price) OVER (PARTITION BY item_id ORDER BY bucket) AS b,
  CASE WHEN buy_price > 0 THEN abs(buy_price - sell_price) * 100e0 / buy_price ELSE 0e0 END AS sp FROM h), w AS (SELECT *, CASE WHEN b > 0 THEN abs(sell_price - b) * 100e0 / b ELSE sp END AS vol FROM v)
  SELECT item_id, bucket, floor(liq * 100 + 0.5) / 100 AS liquidity, floor(vol * 100 + 0.5) / 100 AS volatility, floor(least(100, greatest(0, 2 * sp + 3 * vol)) * 100 + 0.5) / 100 AS risk FROM w""")
q("o100_quick_stats", lambda s, d: X.quick_stats_of(histories(s, d)), _FEEDS,
    f"WITH {_NAMED}, {_hist('24h', 'd')}, {_hist('7d', 'w')}, {_hist('30d', 'm')}" + """, l AS (SELECT item_id, unnest(arg_max({'buy_price': buy_price, 'sell_price': sell_price, 'volume': volume}, bucket)) FROM m GROUP BY 1),
  c AS (SELECT item_id, count(*) AS n, arg_min(buy_price, bucket) AS b0, arg_max(buy_price, bucket) AS b1, arg_min(sell_price, bucket) AS s0, arg_max(sell_price, bucket) AS s1 FROM d GROUP BY 1),
  o AS (SELECT item_id, floor(avg(volume) + 0.5)::BIGINT AS avg_volume_7d, max(buy_price) FILTER (buy_price > 0) AS high_7d, min(sell_price) FILTER (sell_price > 0) AS low_7d FROM w GROUP BY 1)
  SELECT item_id, buy_price, sell_price, volume, CASE WHEN n >= 2 AND b0 > 0 THEN floor((b1 - b0) * 100e0 / b0 * 100 + 0.5) / 100 END AS buy_change_24h, CASE WHEN n >= 2 AND s0 > 0 THEN floor((s1 - s0) * 100e0 / s0 * 100 + 0.5) / 100 END AS sell_change_24h,
    avg_volume_7d, high_7d, low_7d, buy_price - sell_price AS spread, CASE WHEN buy_price > 0 THEN floor((buy_price - sell_price) * 100e0 / buy_price * 100 + 0.5) / 100 END AS spread_pct FROM l LEFT JOIN c USING (item_id) LEFT JOIN o USING (item_id)""")
_W7 = f"WHERE snapshot_ts >= {T - 7 * DAY_MS} AND snapshot_ts <= {T}"
q("o101_market_overview", lambda s, d: X.market_overview(A.quote_grid(s, d), A.opportunities(s, d), T), "quote_grid opportunities",
    f"""WITH n AS (SELECT product_id, snapshot_ts, buy_price AS buy, sell_price AS sell, buy_volume AS volume FROM quote_grid WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM quote_grid {_W7})),
  g AS (SELECT product_id, avg(coalesce(buy_price, 0)) AS ab, avg(coalesce(sell_price, 0)) AS asl, max(coalesce(buy_price, 0)) AS high, min(coalesce(sell_price, 0)) AS low, avg(coalesce(buy_volume, 0)) AS avg_volume FROM quote_grid {_W7} GROUP BY 1)
  SELECT product_id, snapshot_ts, buy, CASE WHEN ab <> 0 THEN (buy - ab) * 100 / ab END AS buy_change, sell, CASE WHEN asl <> 0 THEN (sell - asl) * 100 / asl END AS sell_change, buy - sell AS spread, CASE WHEN buy > 0 THEN (buy - sell) * 100 / buy END AS spread_percent,
    high, low, volume, avg_volume, (SELECT count(*) FROM opportunities) AS active, (SELECT max(expected_profit) FROM opportunities) AS best_profit FROM n JOIN g USING (product_id)""")
_ENDS = f"""w AS (SELECT *, buy_volume AS volume FROM quote_grid WHERE snapshot_ts >= {T - DAY_MS} AND snapshot_ts <= {T}), e AS (SELECT min(snapshot_ts) AS lo, max(snapshot_ts) AS hi FROM w)"""
q("o044_first_and_last", lambda s, d: X.first_and_last(A.quote_grid(s, d), T), "quote_grid",
    f"""WITH {_ENDS}
  SELECT a.product_id, a.buy_price AS buy_price_lo, b.buy_price AS buy_price_hi, a.volume AS volume_lo, b.volume AS volume_hi FROM w a JOIN w b USING (product_id), e WHERE a.snapshot_ts = lo AND b.snapshot_ts = hi AND lo < hi""")


def trending(s, d):
    """Items that end in 5 are not in the catalogue."""
    items = A.items(s, d).filter("item_id NOT LIKE '%5'")
    return X.trending(A.quote_grid(s, d), T, items, D.marketplaces(items, A.quote_grid(s, d), A.auction_snapshots(s, d), A.opportunities(s, d)))


q("o102_trending", trending, "quote_grid auction_snapshots items item_aliases opportunities",
    f"""WITH {_ENDS},
  j AS (SELECT a.product_id, a.buy_price AS p0, b.buy_price AS p1, a.volume AS v0, b.volume AS v1 FROM w a JOIN w b USING (product_id), e WHERE a.snapshot_ts = lo AND b.snapshot_ts = hi AND lo < hi AND a.buy_price > 0 AND a.volume > 0),
  hs AS (SELECT upper(trim(item_name)) AS k FROM auction_snapshots UNION SELECT regexp_replace(upper(trim(item_name)), '[_ ]', '', 'g') FROM auction_snapshots UNION SELECT upper(trim(result_item_id)) FROM opportunities WHERE flip_type = 'AUCTION'),
  m AS (SELECT item_id, bool_or(alias IN (SELECT product_id FROM quote_grid)) AS b, bool_or(alias IN (SELECT k FROM hs)) AS a FROM item_aliases WHERE item_id NOT LIKE '%5' GROUP BY 1)
  SELECT product_id, floor((p1 - p0) * 100e0 / p0 * 100 + 0.5) / 100 AS price_change, floor((v1 - v0) * 100e0 / v0 * 100 + 0.5) / 100 AS volume_change, floor(p1 + 0.5)::BIGINT AS buy_price, coalesce(display_name, product_id) AS display_name,
    CASE WHEN m.item_id IS NULL THEN 'BAZAAR' WHEN a AND b THEN 'BOTH' WHEN b THEN 'BAZAAR' WHEN a THEN 'AUCTION_HOUSE' ELSE 'NONE' END AS marketplace
  FROM j LEFT JOIN m ON m.item_id = product_id LEFT JOIN items ON items.item_id = m.item_id ORDER BY abs(price_change) DESC, product_id LIMIT 10""")
_TREND = "SELECT avg_spread, CASE WHEN n = 0 THEN 'UNKNOWN' WHEN avg_spread >= 0.04 THEN 'BULLISH' WHEN avg_spread <= 0.01 THEN 'BEARISH' ELSE 'SIDEWAYS' END AS trend FROM (SELECT coalesce(avg((buy_price - sell_price) / buy_price), 0) AS avg_spread, count(*) AS n FROM quote_grid WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM quote_grid))"
q("o072_market_trend", lambda s, d: X.market_trend(A.quote_grid(s, d)), "quote_grid", _TREND)
q("o103_dashboard_overview", lambda s, d: X.dashboard_overview(A.items(s, d), A.quote_grid(s, d), A.opportunities(s, d)),
    "quote_grid items opportunities",
    f"SELECT (SELECT count(*) FROM items) AS item_count, (SELECT count(DISTINCT snapshot_ts) FROM quote_grid) AS snapshot_count, "
    f"arg_max(stable_id, {{p: coalesce(expected_profit, -9e18), s: "
        f"stable_id}}) AS top_opportunity, max(expected_profit) AS top_profit, count(*) AS opportunity_count, (SELECT "
            f"trend FROM ({_TREND})) AS trend FROM opportunities")
