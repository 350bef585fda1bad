"""Queries of ranked reads, filters and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keys as K
from ..operators import reads as D
from ..operators import sketches as SK
from ..operators import snapshots as S
from ..sources import adapters as A
from . import q_value as QV
from .inputs_sql import sql

QUERIES: dict = {}
ORACLES: dict = {}
TYPES = ("AUCTION", "BAZAAR", "CRAFTING", "FORGE", "FUSION", "KATGRADE")


def q(name: str, fn, inputs: str, body: str | None) -> None:
    QUERIES[name] = fn
    if body is not None:
        ORACLES[name] = sql(inputs, body)


_O = "opportunities"
_B = ["stable_id", "expected_profit", "liquidity_score", "risk_score"]
_b = ", ".join(_B)
q("o033_filter_opportunities",
    lambda s, d: D.filter_opportunities(A.opportunities(s, d), min_liquidity=20, max_risk=70, min_profit=50_000, min_roi=0.01,
    max_capital=900_000, partial=False).select(*_B), _O,
    f"SELECT {_b} FROM opportunities WHERE liquidity_score >= 20 AND risk_score <= 70 AND expected_profit >= 50000 AND roi >= 0.01 AND "
    f"required_capital <= 900000 AND NOT partial")
q("o132_sort_opportunities", lambda s, d: D.sort_opportunities(A.opportunities(s, d), "liquidity_score", "asc").select(*_B), _O,
    f"SELECT {_b} FROM opportunities ORDER BY liquidity_score ASC NULLS LAST, stable_id")
q("o133_top_opportunities", lambda s, d: D.top_opportunities(A.opportunities(s, d), 50, min_liquidity=10).select(*_B), _O,
    f"SELECT {_b} FROM opportunities WHERE liquidity_score >= 10 ORDER BY expected_profit DESC NULLS LAST, stable_id LIMIT 50")
q("o134_top_by", lambda s, d: D.top_by(A.opportunities(s, d), "risk_score", 10, 20).select(*_B), _O,
    f"SELECT {_b} FROM opportunities WHERE risk_score IS NOT NULL ORDER BY risk_score, stable_id LIMIT 20 OFFSET 10")
_CONF = """least(100, greatest(0, 100 - CASE WHEN partial THEN 15 ELSE 0 END - coalesce(list_sum(list_transform(partial_reasons, lambda r: CASE WHEN r LIKE 'MISSING_INPUT_PRICE%' THEN 60 WHEN r LIKE 'INSUFFICIENT_OUTPUT_DEPTH%' THEN 30 WHEN r = 'MISSING_ELECTION_DATA' THEN 5 ELSE 10 END)), 0)
  + (coalesce(liquidity_score, 0) - 50) * 0.2e0 - CASE WHEN coalesce(risk_score, 0) > 60 THEN (risk_score - 60) * 0.3e0 ELSE 0 END - CASE WHEN greatest(0, coalesce(roi_per_hour, 0)) > 50 AND (partial OR coalesce(liquidity_score, 0) < 40) THEN 20 ELSE 0 END
  - CASE WHEN fees > 0 AND greatest(0, coalesce(expected_profit, 0)) > fees * 100 THEN 10 ELSE 0 END))"""
_V = "greatest(0, coalesce(roi_per_hour, 0))"
_RATE = f"CASE WHEN {_V} <= 0 THEN 0 WHEN {_V} <= 1 THEN 100 * (1 - exp(-{_V})) ELSE least(100, 100 * (1 - exp(-1)) + (100 - 100 * (1 - exp(-1))) * ln(greatest({_V}, 1)) / ln(100)) END"
_GOOD = f"floor(least(100, greatest(0, 0.35e0 * ({_RATE}) + 0.25e0 * least(100, log10(greatest(0, coalesce(expected_profit, 0)) + 1e0) * 10) + 0.25e0 * coalesce(liquidity_score, 0) + 0.15e0 * (100 - coalesce(risk_score, 100)) - CASE WHEN partial AND partial_reasons <> ['MISSING_ELECTION_DATA'] THEN 10 ELSE 0 END)) * 100 + 0.5) / 100"
q("o125_confidence_score", lambda s, d: A.opportunities(s, d).select("stable_id", D.confidence_score().alias("confidence")), _O,
    f"SELECT stable_id, {_CONF}::DOUBLE AS confidence FROM opportunities")
q("o124_actionable", lambda s, d: D.actionable(A.opportunities(s, d), gates=True).select("stable_id"), _O,
    f"SELECT stable_id FROM opportunities WHERE len(list_filter(partial_reasons, lambda r: r LIKE 'MISSING_INPUT_PRICE%')) = 0 AND "
    f"expected_profit > 0 AND liquidity_score >= 15 AND {_CONF} >= 25")
q("o126_goodness", lambda s, d: A.opportunities(s, d).select("stable_id", D.goodness(1).alias("goodness")), _O,
    f"SELECT stable_id, {_GOOD} AS goodness FROM opportunities")
q("o135_best_opportunities", lambda s, d: D.best_opportunities(A.opportunities(s, d), 1).select("stable_id", "goodness", "total"), _O,
    f"SELECT stable_id, {_GOOD} AS goodness, (SELECT count(*) FROM opportunities) AS total FROM opportunities ORDER BY goodness DESC, expected_profit DESC NULLS LAST, stable_id LIMIT "
    f"10 OFFSET 10")
q("o136_page", lambda s, d: D.page(A.opportunities(s, d).orderBy("stable_id"), 100, 25).select(*_B), _O,
    f"SELECT {_b} FROM opportunities ORDER BY stable_id LIMIT 25 OFFSET 100")


def _seek(s, d):
    """The fifth page: the cursor is the last row of the fourth."""
    o = A.opportunities(s, d)
    last = D.sort_opportunities(o, "liquidity_score").limit(100).select("liquidity_score", "stable_id").tail(1)  # what a client sends back
    return D.seek_page(o, "liquidity_score", after=tuple(last[0]) if last else None).select("stable_id", "liquidity_score", "total")


q("o136_seek_page", _seek, _O, "SELECT stable_id, liquidity_score, (SELECT count(*) FROM opportunities) AS total FROM opportunities "
    "ORDER BY liquidity_score DESC NULLS LAST, stable_id LIMIT 25 OFFSET 100")
q("o039_hydrate", lambda s, d: D.hydrate(A.opportunities(s, d).orderBy(F.col("expected_profit").desc_nulls_last(),
    "stable_id").limit(20).select("stable_id", F.col("expected_profit").alias("rank")),
    A.opportunities(s, d).filter("NOT partial").select("stable_id", "roi"), "stable_id"), _O,
    "SELECT r.stable_id, rank, f.roi FROM (SELECT stable_id, expected_profit AS rank FROM opportunities ORDER BY expected_profit DESC "
    "NULLS LAST, stable_id LIMIT 20) r LEFT JOIN (SELECT stable_id, roi FROM opportunities WHERE NOT partial) f USING (stable_id)")
q("o038_with_definition",
    lambda s, d: D.with_definition(A.opportunities(s, d).select("flip_key", "expected_profit"),
    A.opportunities(s, d).select("flip_key", "flip_type", "result_item_id"), "FORGE"), _O,
    "SELECT flip_key, expected_profit, flip_type, result_item_id FROM opportunities WHERE flip_type = 'FORGE'")
q("o040_orphans", lambda s, d: D.orphans(A.opportunities(s, d), A.opportunities(s, d).filter("partial"),
    A.opportunities(s, d).filter("fees % 3 = 0")).select("stable_id", "snapshot_ts"), _O,
    "SELECT stable_id, snapshot_ts FROM opportunities WHERE snapshot_ts NOT IN (SELECT snapshot_ts FROM opportunities WHERE partial OR "
    "fees % 3 = 0)")
q("o068_summary_stats", lambda s, d: D.summary_stats(A.opportunities(s, d)), _O,
    "SELECT count(*) AS n, floor(avg(expected_profit) FILTER (expected_profit > 0) + 0.5)::BIGINT AS avg_profit, floor(avg(roi) * 100 + "
    "0.5) / 100 AS avg_roi, greatest(0, max(expected_profit)) AS best_profit FROM opportunities")
q("o069_counts_by_type", lambda s, d: D.counts_by_type(A.opportunities(s, d).filter("partial"), TYPES), _O,
    f"SELECT t.flip_type, count(o.stable_id) AS n FROM "
    f"(SELECT unnest({list(TYPES)}) AS flip_type) t LEFT JOIN opportunities o ON o.flip_type = t.flip_type AND partial GROUP BY 1")
q("o070_coverage", lambda s, d: D.coverage(A.opportunities(s, d).filter("flip_type <> 'FORGE'")), _O,
    f"SELECT t.flip_type, count(o.stable_id) AS n, count(o.stable_id) > 0 AS covered FROM "
    f"(SELECT unnest({list(D.COVERED)}) AS flip_type) t LEFT JOIN opportunities o ON o.flip_type = t.flip_type AND o.flip_type <> 'FORGE' "
        f"GROUP BY 1")
q("o071_current_summary", lambda s, d: D.current_summary(A.opportunities(s, d)), _O,
    "SELECT count(*) AS n, max(expected_profit) AS max_profit, max(snapshot_ts) AS last_ts FROM opportunities")
_L = """WITH l AS (SELECT *, (length(item_name) - length(replace(item_name, '✪', '')))::INT AS star_count, CASE WHEN highest_bid > 0 THEN highest_bid ELSE starting_bid END AS estimated_value,
  CASE WHEN item_lore LIKE '%modifier: sharp' THEN 'Sharp' ELSE 'None' END AS reforge FROM listings)"""
q("o073_listing_breakdown", lambda s, d: D.listing_breakdown(A.listings(s, d)), "listings",
    _L + """, g AS (SELECT star_count::VARCHAR AS stars, CASE WHEN bin THEN 'BIN' ELSE 'AUCTION' END AS sale, reforge, CASE WHEN estimated_value > 0 THEN estimated_value END AS price, CASE WHEN bin THEN starting_bid END AS bp FROM l),
  a AS (SELECT 'stars' AS kind, stars AS value, price, bp FROM g UNION ALL SELECT 'sale', sale, price, bp FROM g UNION ALL SELECT 'reforge', reforge, price, bp FROM g UNION ALL SELECT 'all', 'all', price, bp FROM g),
  r AS (SELECT kind, value, count(*) AS n, floor(avg(price) + 0.5)::BIGINT AS avg_price, min(bp) AS lowest_bin FROM a GROUP BY ALL)
  SELECT * FROM r UNION ALL SELECT 'stars', v::VARCHAR, 0, NULL, NULL FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS v) WHERE v::VARCHAR NOT IN (SELECT value FROM r WHERE kind = 'stars')""")
q("o138_list_listings", lambda s, d: D.list_listings(K.to_listing(A.listings(s, d)), True, 1, 5, "none").select("auction_uuid",
    "estimated_value"), "listings",
    _L + " SELECT auction_uuid, estimated_value FROM l WHERE bin AND star_count BETWEEN 1 AND 5 AND reforge = 'None' ORDER BY "
    "estimated_value DESC, auction_uuid LIMIT 50")
q("o139_recent_sales", lambda s, d: D.recent_sales(A.listings(s, d), K.aliases(A.items(s, d).filter("item_id = 'P91'"))), "listings items item_aliases",
    _L + """, n AS (SELECT DISTINCT item_name FROM (SELECT item_name, upper(trim(item_name)) AS u FROM (SELECT DISTINCT item_name FROM listings)) JOIN item_aliases ON item_id = 'P91' AND (contains(u, alias) OR contains(regexp_replace(u, '[_ ]', '', 'g'), alias)))
  SELECT auction_uuid, estimated_value AS value, star_count, reforge, end_ts, bin FROM l WHERE claimed AND item_name IN (FROM n) ORDER BY end_ts DESC, auction_uuid LIMIT 20""")
q("o137_quick_spreads", lambda s, d: D.quick_spreads(S.latest(A.quote_grid(s, d))), "quote_grid",
    "WITH r AS (SELECT product_id, floor(buy_price + 0.5)::BIGINT AS buy, floor(sell_price + 0.5)::BIGINT AS sell, least(buy_volume, sell_volume) AS volume FROM quote_grid WHERE snapshot_ts = (SELECT "
    "max(snapshot_ts) FROM quote_grid)) SELECT *, greatest(0, buy - sell) AS spread, CASE WHEN buy <= 0 THEN 0 ELSE floor(greatest(0, buy - sell) * 100e0 / buy * 100 + 0.5) / 100 END AS spread_pct FROM r "
    "WHERE spread_pct >= 1 ORDER BY spread_pct DESC, product_id LIMIT 10")
q("o141_product_detail", lambda s, d: D.product_detail(A.part_quotes(s, d), "P7"), "part_quotes",
    "SELECT product_id, floor(buy_price + 0.5)::BIGINT AS buy_price, floor(sell_price + 0.5)::BIGINT AS sell_price, buy_volume, "
    "sell_volume FROM part_quotes WHERE product_id = 'P7'")
q("o049_with_display_name",
    lambda s, d: D.with_display_name(A.part_quotes(s, d).select("product_id"), A.items(s, d).filter("item_id LIKE '%5'")),
    "part_quotes items", "SELECT product_id, coalesce(CASE WHEN item_id LIKE '%5' THEN display_name END, product_id) AS display_name FROM "
    "part_quotes LEFT JOIN items ON item_id = product_id")
q("o032_search_items", lambda s, d: D.search_items(A.items(s, d), "ring", "economy").select("item_id", "display_name"), "items",
    "SELECT item_id, display_name FROM items WHERE (contains(lower(item_id), 'ring') OR contains(lower(display_name), 'ring') OR "
    "contains(lower(minecraft_id), 'ring')) AND lower(category) = 'economy'")
_ALL = "unnest([upper(item_id), display_name, upper(minecraft_id), regexp_replace(upper(item_id), '[_ ]', '', 'g'), regexp_replace(display_name, '[_ ]', '', 'g'), regexp_replace(upper(minecraft_id), '[_ ]', '', 'g')])"
q("o043_marketplaces", lambda s, d: D.marketplaces(A.items(s, d), A.part_quotes(s, d).filter("product_id LIKE '%3'"),
    A.listings(s, d).filter("bin AND tier = 'T1'"), A.opportunities(s, d)), "items part_quotes listings opportunities",
    f"""WITH k AS (SELECT item_id, {_ALL} AS k FROM items), h AS (SELECT upper(trim(item_name)) AS k FROM listings WHERE bin AND tier = 'T1' UNION SELECT regexp_replace(upper(trim(item_name)), '[_ ]', '', 'g') FROM listings WHERE bin AND tier = 'T1' UNION SELECT upper(result_item_id) FROM opportunities WHERE flip_type = 'AUCTION'),
  m AS (SELECT item_id, bool_or(k IN (SELECT product_id FROM part_quotes WHERE product_id LIKE '%3')) AS b, bool_or(k IN (SELECT k FROM h)) AS a FROM k GROUP BY 1) SELECT item_id, CASE WHEN a AND b THEN 'BOTH' WHEN b THEN 'BAZAAR' WHEN a THEN 'AUCTION_HOUSE' ELSE 'NONE' END AS marketplace FROM m""")
q("o050_opportunities_for_item",
    lambda s, d: D.opportunities_for_item(QV.legs(s, d).select("opp_id", "flip_type").distinct(), QV.V.item_stacks(QV.legs(s, d)),
    K.aliases(A.items(s, d).filter("item_id = 'P91'"))), QV.IN + " items",
    QV.LEGS + " SELECT DISTINCT opp_id, flip_type FROM all_legs WHERE leg_type IN ('BUY', 'SELL') AND item_id IN (SELECT unnest(['P91', "
    "display_name, upper(minecraft_id)]) FROM items WHERE item_id = 'P91')")
q("o142_list_snapshots", lambda s, d: A.quote_grid(s,
    d).groupBy("snapshot_ts").agg(F.count("*").alias("n")).orderBy(F.desc("snapshot_ts")).limit(20), "quote_grid",
    "SELECT snapshot_ts, count(*) AS n FROM quote_grid GROUP BY 1 ORDER BY 1 DESC LIMIT 20")
q("o143_list_recipes", lambda s, d: D.page(A.recipes(s, d).filter("process_type = 'FORGE'").orderBy("recipe_id"), 5, 20), "recipes",
    "SELECT * FROM recipes WHERE process_type = 'FORGE' ORDER BY recipe_id LIMIT 20 OFFSET 5")
q("o143_list_items", lambda s, d: D.page(D.search_items(A.items(s, d)).orderBy("item_id"), 20, 30).select("item_id", "display_name",
    "rarity"), "items", "SELECT item_id, display_name, rarity FROM items ORDER BY item_id LIMIT 30 OFFSET 20")
q("o144_list_opportunities",
    lambda s, d: D.page(D.sort_opportunities(D.filter_opportunities(A.opportunities(s, d), flip_type="CRAFTING", min_profit=1), "roi"), 10,
    25).select(*_B), _O,
  f"SELECT {_b} FROM opportunities WHERE flip_type = 'CRAFTING' AND expected_profit >= 1 ORDER BY roi DESC NULLS LAST, stable_id LIMIT 25 "
      f"OFFSET 10")
q("o144_get_opportunity", lambda s, d: A.opportunities(s, d).filter("stable_id = 'o77'").select(*_B), _O,
    f"SELECT {_b} FROM opportunities WHERE stable_id = 'o77'")
q("o074_route_timings", lambda s, d: D.route_timings(A.request_log(s, d)), "request_log",
    """SELECT route, avg(duration_ms) AS mean_ms, max(duration_ms) AS max_ms, quantile_cont(duration_ms, 0.95) AS p95_ms, quantile_cont(duration_ms, 0.99) AS p99_ms, count(*) AS requests, string_agg(DISTINCT method, ',' ORDER BY method) AS methods,
  string_agg(DISTINCT status, ',' ORDER BY status) AS statuss, string_agg(DISTINCT outcome, ',' ORDER BY outcome) AS outcomes, p95_ms > 250 AS over_threshold FROM request_log GROUP BY 1""")


def _sketched(s, d):
    """From daily sketches: requests, and whether distinct durations and the 95th percentile lie within their bounds of the exact ones."""
    log = A.request_log(s, d)
    near = SK.over_days(SK.daily_sketches(log, "route", "duration_ms", "duration_ms"), "route")
    j = log.join(near, "route").groupBy("route", "n", "distinct", "p95").agg(F.countDistinct("duration_ms").alias("exact"),
        F.avg((F.col("duration_ms") < F.col("p95")).cast("int")).alias("below"), F.avg((F.col("duration_ms") <= F.col("p95")).cast("int")).alias("upto"))
    return j.select("route", F.col("n").alias("requests"), (F.abs(F.col("distinct") - F.col("exact")) <= 0.05 * F.col("exact") + 1).alias("distinct_near"),
        ((F.col("below") <= 0.97) & (F.col("upto") >= 0.93)).alias("p95_near"))


q("o074_route_sketches", _sketched, "request_log", "SELECT route, count(*) AS requests, true AS distinct_near, true AS p95_near FROM request_log GROUP BY 1")
q("o075_top_stacks", lambda s, d: D.top_stacks(A.table(s, d, "events").select(F.col("event_type").alias("class"),
    F.concat(F.lit("s"), F.col("user_id")).alias("stack"), F.round(F.col("value") * 100).cast("long").alias("duration"))), "",
    "SELECT class, stack, total, events, rank::INT AS rank, round(total / sum_t, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION "
    "BY class ORDER BY total DESC, stack) AS rank, sum(total) OVER (PARTITION BY class) AS sum_t FROM (SELECT event_type AS class, 's' || "
        "user_id AS stack, sum(round(value * 100)::BIGINT)::BIGINT AS total, count(*) AS events FROM events GROUP BY ALL)) WHERE "
            "rank <= 10")
q("o080_source_cadence", lambda s, d: D.source_cadence(A.payload_updates(s, d)), "payload_updates",
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY last_updated DESC) AS rn FROM (SELECT DISTINCT feed, last_updated FROM payload_updates) QUALIFY rn <= 8),
  l AS (SELECT *, last_updated - lag(last_updated) OVER (PARTITION BY feed ORDER BY last_updated) AS d FROM t),
  g AS (SELECT feed, last_updated, least(greatest(d, 1000), 600000)::DOUBLE AS gap FROM l WHERE d IS NOT NULL),
  h AS (SELECT feed, median(gap) AS m, list(gap ORDER BY last_updated) AS gaps FROM g GROUP BY 1)
  SELECT feed, floor((m + list_reduce(gaps, lambda a, x: a * 0.7e0 + x * 0.3e0)) / 2 + 0.5)::BIGINT AS estimate_ms,
    CASE WHEN len(gaps) < 3 THEN 0e0 ELSE list_aggregate(list_transform(gaps, lambda x: abs(x - m)), 'median') END AS jitter_ms FROM h""")
q("o151_changed_updates", lambda s, d: D.changed_updates(A.payload_updates(s, d)), "payload_updates",
    "SELECT feed, last_updated, hash, payload_id FROM (SELECT *, lag(hash) OVER (PARTITION BY feed ORDER BY last_updated, payload_id) AS "
    "p FROM payload_updates) WHERE p IS NULL OR p <> hash")
