"""Queries of keys, attributes, snapshots, statistics and table upkeep, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.exprs import DAY_MS, epoch_day, mid, norm_product_id, rel_spread
from ..operators import keys as K
from ..operators import snapshots as S
from ..sources import adapters as A
from .inputs_sql import sql

QUERIES: dict = {}
ORACLES: dict = {}
T0, T1 = 1_704_499_200_000, 1_705_104_000_000  # 2024-01-06 and 2024-01-13
PARTS = r"""parts AS (SELECT *, trim(coalesce(item_name, '')) AS nm, coalesce(nullif(upper(replace(trim(replace(regexp_extract(replace(extra, '\"', '"'), '(?i)"(?:internalname|id|item_id|itemId)"\s*:\s*"([^"]+)"', 1), '\', '')), ' ', '_')), ''),
    nullif(upper(replace(trim(replace(regexp_extract(extra, '(?i)"(?:internalname|id|item_id|itemId)"\s*:\s*"([^"]+)"', 1), '\', '')), ' ', '_')), '')) AS xid FROM listings),
keyed AS (SELECT *, coalesce(xid, upper(replace(nm, ' ', '_'))) AS base_id, upper(tier) AS key_tier, upper(replace(category, ' ', '_')) AS key_category, '-' AS pet_level,
    (length(item_name) - length(replace(item_name, '✪', '')) + coalesce(length(item_lore) - length(replace(item_lore, '✪', '')), 0))::INT AS stars,
    coalesce(contains(lower(item_lore), 'rarity upgraded'), false) OR coalesce(contains(lower(extra), 'recombobulated'), false) AS recombobulated FROM parts),
full_keys AS (SELECT *, base_id || '|T:' || key_tier || '|C:' || key_category || '|P:' || pet_level AS agg_key,
    stars > 0 OR recombobulated OR regexp_matches(upper(regexp_replace(coalesce(item_lore, ''), '§.', ' ', 'g')), '\b[A-Z][A-Z''\- ]{2,}\s+[IVXLCDM]{1,6}\b')
    OR coalesce(trim(extra) <> '' AND NOT (regexp_matches(replace(extra, '\"', '"'), '(?i)^\s*\{\s*"(?:internalname|id|item_id|itemId)"\s*:\s*"[^"]+"\s*\}\s*$') AND regexp_matches(extra, '(?i)^\s*\{\s*"(?:internalname|id|item_id|itemId)"\s*:\s*"[^"]+"\s*\}\s*$')), false) AS has_additionals FROM keyed)"""


def q(name: str, fn, inputs: str, body: str) -> None:
    QUERIES[name] = fn
    ORACLES[name] = sql(inputs, body)


q("o004_to_snapshot", lambda s, d: S.to_snapshot(A.listings(s, d), A.quotes(s, d)), "quotes listings",
  "SELECT greatest((SELECT max(snapshot_ts) FROM listings), (SELECT max(snapshot_ts) FROM quotes)) AS snapshot_ts, (SELECT count(*) FROM "
      "listings) AS listing_count, (SELECT count(*) FROM quotes) AS quote_count")
q("o007_append_new", lambda s, d: S.append_new(A.quote_grid(s, d).select("snapshot_ts", "product_id", "buy_price"),
    A.quote_grid(s, d).filter(F.col("snapshot_ts") < T0), ["snapshot_ts", "product_id"]), "quote_grid",
  f"SELECT snapshot_ts, product_id, buy_price FROM quote_grid WHERE snapshot_ts >= {T0}")
q("o008_scan_range", lambda s, d: S.scan_range(A.quote_ticks(s, d), T0, T1).select("snapshot_ts", "product_id", "buy_price"), "quote_ticks",
  f"SELECT snapshot_ts, product_id, buy_price FROM quote_ticks WHERE snapshot_ts >= {T0} AND snapshot_ts < {T1}")
q("o010_upsert", lambda s, d: S.upsert(S.daily_rollup_quotes(A.quote_ticks(s, d).filter(F.col("snapshot_ts") >= T0)).select("day",
    "product_id", "sample_count"),
    S.daily_rollup_quotes(A.quote_ticks(s, d).filter(F.col("snapshot_ts") < T1)).select("day", "product_id", "sample_count"),
    ["day", "product_id"]), "quote_ticks",
  f"SELECT snapshot_ts // {DAY_MS} AS day, product_id, count(*) AS sample_count FROM quote_ticks GROUP BY ALL")
q("o012_scan", lambda s, d: S.scan(A.quote_grid(s, d), keys=A.quote_ticks(s, d).filter("k > 97"),
    between=("P1", "P5")).select("snapshot_ts", "product_id", "k"), "quote_grid",
  "SELECT snapshot_ts, product_id, k FROM quote_grid WHERE product_id BETWEEN 'P1' AND 'P5' AND product_id IN (SELECT product_id FROM "
      "quote_ticks WHERE k > 97)")
q("o014_norm_product_id",
    lambda s, d: A.table(s, d,
    "part").select(norm_product_id(F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name"))).alias("product_id"),
    "p_partkey"), "",
  "SELECT CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE upper(trim(p_name)) END AS product_id, p_partkey FROM part")
_keys = ["auction_uuid", "base_id", "key_tier", "key_category", "pet_level", "stars", "recombobulated"]
q("o015_listing_key_parts", lambda s, d: K.key_parts(A.listings(s, d)).select(*_keys), "listings",
    f"WITH {PARTS} SELECT {', '.join(_keys)} FROM keyed")
q("o016_listing_key", lambda s, d: K.listing_keys(A.listings(s, d)).groupBy("listing_key").count(), "listings",
    f"WITH {PARTS} SELECT agg_key || '|S:' || stars || '|R:' || recombobulated::INT AS listing_key, count(*) AS count FROM full_keys "
    f"GROUP BY 1")
q("o017_listing_agg_key", lambda s, d: K.listing_keys(A.listings(s, d)).groupBy("agg_key").count(), "listings",
    f"WITH {PARTS} SELECT agg_key, count(*) AS count FROM full_keys GROUP BY 1")
q("o018_has_additionals", lambda s, d: K.listing_keys(A.listings(s, d)).groupBy("has_additionals", "item_lore", "extra").count(),
    "listings", f"WITH {PARTS} SELECT has_additionals, item_lore, extra, count(*) AS count FROM full_keys GROUP BY ALL")
q("o019_comparable_key", lambda s, d: K.comparable(A.listings(s, d)).groupBy(*S.COMPARABLE).count(), "listings",
    f"WITH {PARTS} SELECT base_id, key_tier, key_category, pet_level, stars, recombobulated, xid IS NULL AS low_confidence, count(*) AS "
    f"count FROM keyed GROUP BY ALL")
q("o020_unique_output_key", lambda s, d: K.unique_output_keys(K.key_parts(A.listings(s, d)).select(*_keys[1:]).distinct()), "listings",
    f"""WITH {PARTS}, a AS (SELECT DISTINCT {', '.join(_keys[1:])} FROM keyed),
  b AS (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY key_tier, key_category, pet_level, stars, recombobulated) AS n FROM a),
  c AS (SELECT *, row_number() OVER (PARTITION BY base_id, key_tier, key_category, n = 1 ORDER BY key_tier, key_category, pet_level, stars, recombobulated) AS m FROM b)
  SELECT * EXCLUDE (n, m), CASE WHEN n = 1 THEN base_id ELSE base_id || ' [' || key_tier || '/' || key_category || ']' || CASE WHEN m > 1 THEN ' #' || m ELSE '' END END AS output_key FROM c""")
q("o021_sanitize_quotes",
    lambda s, d: S.sanitize_quotes(A.quote_ticks(s,
    d).withColumns({"buy_price": F.when(F.col("k") % 5 == 0, float("nan")).otherwise(F.col("buy_price")),
    "sell_volume": F.col("sell_volume") - 1000})), "quote_ticks",
  "SELECT snapshot_ts, product_id, CASE WHEN k % 5 <> 0 THEN buy_price END AS buy_price, sell_price, buy_volume, CASE WHEN sell_volume >= "
      "1000 THEN sell_volume - 1000 END AS sell_volume FROM quote_ticks")
_star = "CASE WHEN l_linenumber % 4 = 0 THEN p_name || ' ✪✪✪✪✪✪' WHEN l_linenumber % 4 = 1 THEN p_name || ' 3-Star' WHEN l_linenumber % 4 = 2 THEN 'Sharp ' || p_name || ' 9 star' ELSE p_name || ' (odd), Ruby Slot' END"
_names = lambda s, d: A.table(s, d, "lineitem").join(A.table(s, d, "part"),
    F.col("l_partkey") == F.col("p_partkey")).select(F.expr(_star).alias("nm"),
    F.expr("CASE WHEN l_linenumber % 3 = 0 THEN '§aModifier: giant-odd' WHEN l_linenumber % 3 = 1 THEN 'Universal slot, opal "
    "gemstone' END").alias("lore"))  # noqa: E731
_texts = lambda s, d, *by: _names(s, d).groupBy(*by).count()  # noqa: E731  (the text rules read each text once)
_NAMES = f"WITH n AS (SELECT {_star} AS nm, CASE WHEN l_linenumber % 3 = 0 THEN '§aModifier: giant-odd' WHEN l_linenumber % 3 = 1 THEN 'Universal slot, opal gemstone' END AS lore FROM lineitem JOIN part ON l_partkey = p_partkey)"
q("o022_stars", lambda s, d: _texts(s, d, "nm").select("nm", K.star_count("nm").alias("stars"), "count"), "items",
    _NAMES + " SELECT nm, least(5, CASE WHEN contains(nm, '✪') THEN length(nm) - length(replace(nm, '✪', '')) ELSE "
    "coalesce(try_cast(regexp_extract(nm, '(?i)(\\d+)\\s*-?\\s*STAR', 1) AS INT), 0) END)::INT AS stars, count(*) AS count FROM n "
        "GROUP BY ALL")
q("o023_reforge", lambda s, d: _texts(s, d, "nm", "lore").select("nm", "lore", K.reforge("nm", "lore").alias("reforge"), "count"), "items",
    _NAMES + " SELECT nm, lore, CASE WHEN lore LIKE '%Modifier%' THEN 'Giant-Odd' WHEN nm LIKE 'Sharp %' THEN 'Sharp' WHEN nm LIKE "
    "'%(odd)%' THEN 'Odd' ELSE 'None' END AS reforge, count(*) AS count FROM n GROUP BY ALL")
q("o024_gem_slots", lambda s, d: _texts(s, d, "nm", "lore").select("nm", "lore", F.array_join(K.gem_slots("nm", "lore"), ",").alias("slots"), "count"),
    "items", _NAMES + " SELECT nm, lore, CASE WHEN lore LIKE 'Univ%' THEN 'Universal,Opal' WHEN nm LIKE '%Ruby Slot' THEN 'Ruby' ELSE '' "
    "END AS slots, count(*) AS count FROM n GROUP BY ALL")
q("o025_to_listing", lambda s, d: K.to_listing(A.listings(s, d)).select("auction_uuid", "star_count", "estimated_value", "bin"), "listings",
    "SELECT auction_uuid, (length(item_name) - length(replace(item_name, '✪', '')))::INT AS star_count, CASE WHEN highest_bid > 0 THEN "
    "highest_bid ELSE starting_bid END AS estimated_value, bin FROM listings")
ALIAS = "alias AS (SELECT DISTINCT item_id, unnest([upper(item_id), display_name, upper(minecraft_id), regexp_replace(upper(item_id), '[_ ]', '', 'g'), regexp_replace(display_name, '[_ ]', '', 'g'), regexp_replace(upper(minecraft_id), '[_ ]', '', 'g')]) AS alias FROM items)"
q("o030_item_aliases", lambda s, d: K.aliases(A.items(s, d)), "items", f"WITH {ALIAS} SELECT * FROM alias")
_q34 = ["snapshot_ts", "product_id", "mid", "spread", "liquidity", "log_mid", "log_liquidity"]
q("o034_valid_quote_samples", lambda s, d: S.valid_quote_samples(A.quote_ticks(s, d)).select(*_q34), "quote_ticks",
    "SELECT snapshot_ts, product_id, (buy_price + sell_price) / 2 AS mid, abs(buy_price - sell_price) / ((buy_price + sell_price) / 2) AS "
    "spread, least(buy_volume, sell_volume)::DOUBLE AS liquidity, ln((buy_price + sell_price) / 2) AS log_mid, ln(1 + least(buy_volume, "
        "sell_volume)) AS log_liquidity FROM quote_ticks WHERE buy_price > 0 AND sell_price > 0")
q("o034_valid_listing_samples",
    lambda s, d: S.valid_listing_samples(A.listing_points(s, d)).select("snapshot_ts", "item_key", "anchor", "p50"), "listing_points",
    "SELECT snapshot_ts, item_key, coalesce(CASE WHEN bin_lowest5_mean > 0 THEN bin_lowest5_mean END, CASE WHEN bin_p50 > 0 THEN bin_p50 "
    "END)::DOUBLE AS anchor, coalesce(CASE WHEN bin_p50 > 0 THEN bin_p50 END, CASE WHEN bin_lowest5_mean > 0 THEN bin_lowest5_mean "
        "END)::DOUBLE AS p50 FROM listing_points WHERE bin_lowest5_mean > 0 OR bin_p50 > 0")
q("o035_mid_spread", lambda s, d: A.quote_ticks(s, d).select("snapshot_ts", "product_id", mid("buy_price", "sell_price").alias("mid"),
    rel_spread("buy_price", F.when(F.col("k") % 9 != 0, F.col("sell_price"))).alias("rel_spread")), "quote_ticks",
  "SELECT snapshot_ts, product_id, (buy_price + sell_price) / 2 AS mid, CASE WHEN k % 9 <> 0 THEN abs(buy_price - sell_price) / "
      "((buy_price + sell_price) / 2) ELSE 1e0 END AS rel_spread FROM quote_ticks")
q("o036_as_of", lambda s, d: S.as_of(A.quote_grid(s, d), T0 + 1000).select("snapshot_ts", "product_id", "buy_price"), "quote_grid",
    f"SELECT snapshot_ts, product_id, buy_price FROM quote_grid WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM quote_grid WHERE "
    f"snapshot_ts <= {T0 + 1000})")
q("o036_as_of_join", lambda s, d: S.as_of_join(A.quote_ticks(s, d).select("product_id", "snapshot_ts", "k"),
    A.quote_grid(s, d).select("product_id", "snapshot_ts", "buy_price"), ["product_id"]), "quote_grid",
  "SELECT t.product_id, t.snapshot_ts, t.k, g.snapshot_ts AS right_snapshot_ts, g.buy_price AS right_buy_price FROM quote_ticks t ASOF "
      "LEFT JOIN quote_grid g ON t.product_id = g.product_id AND t.snapshot_ts >= g.snapshot_ts")


def _two_tables(s, d):
    """(raw, retained): the grid of two thirds of its slots, and of the other two thirds at a price of its own; a third is in both."""
    g, slot = A.quote_grid(s, d).select("product_id", "snapshot_ts", "buy_price"), F.col("snapshot_ts") / 21_600_000 % 3
    return g.filter(slot != 0), g.filter(slot != 1).withColumn("buy_price", -F.col("buy_price"))


def _as_of_both(s, d):
    raw, retained = _two_tables(s, d)
    return S.as_of_join(A.quote_ticks(s, d).select("product_id", "snapshot_ts", "k"), raw, ["product_id"], retained=retained)


q("o036_as_of_raw_and_retained", _as_of_both, "quote_grid",
    "WITH g AS (SELECT product_id, snapshot_ts, CASE WHEN snapshot_ts // 21600000 % 3 = 0 THEN -buy_price ELSE buy_price END AS buy_price FROM quote_grid) "
    "SELECT t.product_id, t.snapshot_ts, t.k, g.snapshot_ts AS right_snapshot_ts, g.buy_price AS right_buy_price FROM quote_ticks t ASOF "
    "LEFT JOIN g ON t.product_id = g.product_id AND t.snapshot_ts >= g.snapshot_ts")
q("o037_latest", lambda s, d: S.latest(A.quote_grid(s, d)).select("snapshot_ts", "product_id", "buy_price"), "quote_grid",
    "SELECT snapshot_ts, product_id, buy_price FROM quote_grid WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM quote_grid)")
q("o041_match_items", lambda s, d: K.match_items(A.listings(s, d), K.aliases(A.items(s, d))), "listings items",
  f"WITH {ALIAS}, n AS (SELECT DISTINCT item_name, upper(trim(item_name)) AS u, regexp_replace(upper(trim(item_name)), '[_ ]', '', 'g') "
      f"AS c FROM listings) SELECT DISTINCT item_name, item_id FROM n JOIN alias ON contains(u, alias) OR contains(c, alias)")
_cmp = ["flip_type", "expected_profit", "roi", "partial"]


def _right(s, d):
    o, k = A.opportunities(s, d), F.substring("stable_id", 2, 20).cast("long")
    return o.filter(k % 7 != 0).withColumns({"roi": F.when(k % 11 == 0, F.col("roi") + 1e-6).otherwise(F.col("roi") + 1e-12),
        "expected_profit": F.when(k % 10 == 0, None).otherwise(F.col("expected_profit"))})


q("o045_parity", lambda s, d: S.parity(A.opportunities(s, d).filter("stable_id NOT LIKE '%3'"), _right(s, d), "stable_id",
    _cmp).withColumn("mismatches", F.array_join("mismatches", ",")), "opportunities",
    """WITH l AS (SELECT * FROM opportunities WHERE stable_id NOT LIKE '%3'),
  r AS (SELECT *, substr(stable_id, 2)::BIGINT AS k FROM opportunities WHERE substr(stable_id, 2)::BIGINT % 7 <> 0)
  SELECT coalesce(l.stable_id, r.stable_id) AS stable_id, CASE WHEN r.stable_id IS NULL THEN 'only_left' WHEN l.stable_id IS NULL THEN 'only_right' ELSE 'shared' END AS side,
  CASE WHEN l.stable_id IS NOT NULL AND r.stable_id IS NOT NULL THEN concat_ws(',', CASE WHEN k % 10 = 0 AND l.expected_profit IS NOT NULL THEN 'expected_profit' END, CASE WHEN k % 11 = 0 AND l.roi IS NOT NULL THEN 'roi' END) END AS mismatches
  FROM l FULL JOIN r USING (stable_id)""")
_PAR = """WITH l AS (SELECT * FROM opportunities WHERE stable_id NOT LIKE '%3'),
  r AS (SELECT *, substr(stable_id, 2)::BIGINT AS k FROM opportunities WHERE substr(stable_id, 2)::BIGINT % 7 <> 0),
  m AS (SELECT stable_id, concat_ws(',', CASE WHEN k % 10 = 0 AND l.expected_profit IS NOT NULL THEN 'expected_profit' END, CASE WHEN k % 11 = 0 AND l.roi IS NOT NULL THEN 'roi' END) AS f FROM l JOIN r USING (stable_id)),
  c AS (SELECT (SELECT count(*) FROM l) AS nl, (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM m) AS ns, (SELECT count(*) FROM m WHERE f <> '') AS nm, ((SELECT max(snapshot_ts) FROM l) = (SELECT max(snapshot_ts) FROM r))::BIGINT AS al)
  SELECT 'count' AS kind, unnest(['left', 'right', 'shared', 'only_left', 'only_right', 'mismatched', 'aligned', 'ok']) AS name, unnest([nl, nr, ns, nl - ns, nr - ns, nm, al, CASE WHEN al = 1 AND nl = ns AND nr = ns AND nm = 0 THEN 1 ELSE 0 END]) AS n FROM c
  UNION ALL SELECT 'left_type', flip_type, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'right_type', flip_type, count(*) FROM r GROUP BY 2
  UNION ALL (SELECT 'sample_only_left', stable_id, 1 FROM l WHERE stable_id NOT IN (SELECT stable_id FROM r) ORDER BY 2 LIMIT 20)
  UNION ALL (SELECT 'sample_only_right', stable_id, 1 FROM r WHERE stable_id NOT IN (SELECT stable_id FROM l) ORDER BY 2 LIMIT 20)
  UNION ALL (SELECT 'sample_mismatch', stable_id || ':' || f, 1 FROM m WHERE f <> '' ORDER BY stable_id LIMIT 20)"""
q("o045_parity_report", lambda s, d: S.parity_report(A.opportunities(s, d).filter("stable_id NOT LIKE '%3'"), _right(s, d), "stable_id", _cmp),
    "opportunities", _PAR)
q("o047_daily_anchors", lambda s, d: S.daily_anchors(A.quote_grid(s, d), T0, T1).select("snapshot_ts", "product_id", "buy_price"),
    "quote_grid", f"SELECT snapshot_ts, product_id, buy_price FROM quote_grid WHERE snapshot_ts IN (SELECT min(snapshot_ts) FROM "
    f"quote_grid WHERE snapshot_ts >= {T0} AND snapshot_ts < {T1} GROUP BY snapshot_ts // {DAY_MS})")
q("o048_nearest", lambda s, d: S.nearest(A.quote_ticks(s, d), "product_id", T0).select("snapshot_ts", "product_id", "buy_price"),
    "quote_ticks", f"SELECT snapshot_ts, product_id, buy_price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY "
    f"abs(snapshot_ts - {T0}), snapshot_ts) AS rn FROM quote_ticks) WHERE rn = 1")
_feed = lambda s, d, f: A.payload_updates(s, d).filter(F.col("feed") == f).select(F.col("last_updated").alias("ts"),
    F.col("payload_id").alias("payload"))
q("o051_pair_feeds", lambda s, d: S.pair_feeds(_feed(s, d, "quotes"), _feed(s, d, "listings")), "payload_updates",
    """WITH u AS (SELECT last_updated AS ts, CASE WHEN feed = 'quotes' THEN payload_id END AS a, CASE WHEN feed <> 'quotes' THEN payload_id END AS b FROM payload_updates),
  w AS (SELECT *, last_value(a IGNORE NULLS) OVER o AS payload_a, last_value(b IGNORE NULLS) OVER o AS payload_b FROM u WINDOW o AS (ORDER BY ts, coalesce(a, b) ROWS UNBOUNDED PRECEDING))
  SELECT ts, CASE WHEN a IS NOT NULL THEN 'a' ELSE 'b' END AS trigger, payload_a, payload_b FROM w WHERE payload_a IS NOT NULL AND payload_b IS NOT NULL""")
_by = ["product_id", "day"]
_days = lambda s, d: A.quote_ticks(s, d).withColumn("day", epoch_day("snapshot_ts"))
_DAYS = f"WITH t AS (SELECT *, snapshot_ts // {DAY_MS} AS day FROM quote_ticks) "
q("o052_median", lambda s, d: _days(s, d).groupBy(*_by).agg(stats.median("buy_price").alias("m")), "quote_ticks",
    _DAYS + "SELECT product_id, day, median(buy_price) AS m FROM t GROUP BY ALL")
q("o053_percentile", lambda s, d: _days(s, d).groupBy(*_by).agg(stats.percentile("buy_price", 0.1).alias("p10"),
    stats.percentile("buy_price", 0.75).alias("p75")), "quote_ticks",
    _DAYS + "SELECT product_id, day, quantile_cont(buy_price, 0.1) AS p10, quantile_cont(buy_price, 0.75) AS p75 FROM t GROUP BY ALL")


def _floor(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy(*_by)
    t = _days(s, d).withColumns({"rn": F.row_number().over(w.orderBy("buy_price")), "n": F.count("*").over(w)})
    return t.groupBy(*_by).agg(stats.floor_percentiles("buy_price", "rn", "n", 0.95).alias("p95"))


q("o054_percentile_floor", _floor, "quote_ticks",
    _DAYS + "SELECT product_id, day, list_sort(list(buy_price))[floor(0.95e0 * (count(*) - 1))::INT + 1] AS p95 FROM t GROUP BY ALL")
q("o055_mad", lambda s, d: stats.medians_and_mads(_days(s, d), _by, ["buy_price"]).select(*_by, "buy_price_mad"), "quote_ticks",
    _DAYS + "SELECT product_id, day, mad(buy_price) AS buy_price_mad FROM t GROUP BY ALL")
q("o056_winsorized_mean", lambda s, d: stats.winsorized_mean(_days(s, d), _by, "buy_price"), "quote_ticks",
    _DAYS + ", c AS (SELECT product_id, day, quantile_cont(buy_price, 0.1) AS lo, quantile_cont(buy_price, 0.9) AS hi FROM t GROUP BY "
    "ALL) SELECT product_id, day, avg(least(greatest(buy_price, lo), hi)) AS buy_price_wins FROM t JOIN c USING (product_id, day) "
        "GROUP BY ALL")
q("o057_finite_range", lambda s, d: _days(s, d).withColumn("buy_price",
    F.when(F.col("k") % 5 == 0, float("inf")).otherwise(F.col("buy_price"))).groupBy(*_by).agg(*stats.finite_range("buy_price")),
    "quote_ticks", _DAYS + "SELECT product_id, day, min(buy_price) FILTER (k % 5 <> 0) AS buy_price_min, max(buy_price) FILTER (k % 5 <> "
    "0) AS buy_price_max FROM t GROUP BY ALL")
_AGG = f"""WITH {PARTS}, v AS (SELECT agg_key AS item_key, snapshot_ts, CASE WHEN bin AND NOT has_additionals AND starting_bid > 0 THEN starting_bid END AS b, CASE WHEN NOT bin AND NOT has_additionals AND highest_bid > 0 THEN highest_bid END AS x,
  bin AND starting_bid > 0 AS c, end_ts BETWEEN snapshot_ts AND snapshot_ts + 600000 AS e FROM full_keys WHERE NOT claimed),
  g AS (SELECT snapshot_ts, item_key, list_sort(list(b) FILTER (b IS NOT NULL)) AS l, list_sort(list(x) FILTER (x IS NOT NULL)) AS x, count_if(c)::INT AS bin_count, count_if(e)::INT AS ending_soon_count FROM v GROUP BY ALL)"""
q("o059_aggregate_listings", lambda s, d: S.aggregate_listings(A.listings(s, d)), "listings",
    _AGG + """ SELECT snapshot_ts, item_key, l[1] AS bin_lowest, floor(list_avg(l[1:5]) + 0.5)::BIGINT AS bin_lowest5_mean, l[floor(0.5e0 * (len(l) - 1))::INT + 1] AS bin_p50, l[floor(0.95e0 * (len(l) - 1))::INT + 1] AS bin_p95,
  x[floor(0.5e0 * (len(x) - 1))::INT + 1] AS bid_p50, bin_count, ending_soon_count FROM g WHERE len(l) > 0""")
q("o058_lowest_k_mean", lambda s, d: S.aggregate_listings(A.listings(s, d)).select("item_key", "bin_lowest5_mean"), "listings",
    _AGG + " SELECT item_key, floor(list_avg(l[1:5]) + 0.5)::BIGINT AS bin_lowest5_mean FROM g WHERE len(l) > 0")
q("o060_aggregate_quotes", lambda s, d: S.aggregate_quotes(A.quote_ticks(s, d)), "quote_ticks",
    "SELECT snapshot_ts, product_id, buy_price, sell_price, buy_volume, sell_volume FROM quote_ticks")
_LQ = "min(starting_bid) AS lowest, coalesce(list_sort(list(starting_bid))[2], min(starting_bid)) AS second_lowest, max(starting_bid) AS highest, avg(starting_bid) AS average, (list_sort(list(starting_bid))[floor(0.5e0 * (count(*) - 1))::INT + 1])::DOUBLE AS median, (list_sort(list(starting_bid))[floor(0.25e0 * (count(*) - 1))::INT + 1])::DOUBLE AS p25, count(*)::INT AS sample_size"
q("o061_listing_quotes", lambda s, d: S.listing_quotes(A.listings(s, d)), "listings",
    f"WITH {PARTS} SELECT base_id, key_tier, key_category, pet_level, stars, recombobulated, xid IS NULL AS "
    f"low_confidence, {_LQ} FROM keyed WHERE bin AND starting_bid > 0 GROUP BY ALL")
q("o062_listing_quotes_by_name", lambda s, d: S.listing_quotes(A.listings(s, d), ["name_key"]), "listings",
    f"SELECT upper(trim(item_name)) AS name_key, {_LQ} FROM listings WHERE bin AND starting_bid > 0 GROUP BY ALL")
q("o063_daily_rollup_quotes", lambda s, d: S.daily_rollup_quotes(A.quote_ticks(s, d)), "quote_ticks",
    f"SELECT snapshot_ts // {DAY_MS} AS day, product_id, avg(buy_price) AS avg_buy_price, avg(sell_price) AS avg_sell_price, "
    f"avg(abs(buy_price - sell_price)) AS avg_spread, avg(buy_volume) AS avg_buy_volume, avg(sell_volume) AS avg_sell_volume, count(*) AS "
        f"sample_count, min(snapshot_ts) AS first_ts, max(snapshot_ts) AS last_ts FROM quote_ticks GROUP BY ALL")
q("o064_daily_rollup_listings", lambda s, d: S.daily_rollup_listings(A.listing_points(s, d)), "listing_points",
    f"SELECT snapshot_ts // {DAY_MS} AS day, item_key, avg(bin_lowest) AS avg_bin_lowest, avg(bin_lowest5_mean) AS avg_bin_lowest5_mean, "
    f"avg(bin_p50) AS avg_bin_p50, avg(bin_p95) AS avg_bin_p95, avg(bid_p50) AS avg_bid_p50, avg(bin_count) AS avg_bin_count, "
        f"avg(ending_soon_count) AS avg_ending_soon_count, count(*) AS sample_count, min(snapshot_ts) AS first_ts, max(snapshot_ts) AS "
            f"last_ts FROM listing_points GROUP BY ALL")
q("o076_distinct_items", lambda s, d: S.scan_range(A.quote_ticks(s, d), T0, T1).agg(F.countDistinct("product_id").alias("n")),
    "quote_ticks", f"SELECT count(DISTINCT product_id) AS n FROM quote_ticks WHERE snapshot_ts >= {T0} AND snapshot_ts < {T1}")
q("o077_ts_bounds", lambda s, d: A.quote_ticks(s, d).agg(F.min("snapshot_ts").alias("first_ts"), F.max("snapshot_ts").alias("last_ts")),
    "quote_ticks", "SELECT min(snapshot_ts) AS first_ts, max(snapshot_ts) AS last_ts FROM quote_ticks")
q("o078_first_ts_per_day", lambda s, d: S.first_ts_per_day(A.quote_ticks(s, d)), "quote_ticks",
    f"SELECT snapshot_ts // {DAY_MS} AS day, min(snapshot_ts) AS first_ts FROM quote_ticks GROUP BY 1")
q("o145_combined_history",
    lambda s, d: S.combined_history(A.quote_grid(s, d).filter(F.col("snapshot_ts") >= T0).select("snapshot_ts", "product_id"),
    A.quote_grid(s, d).filter(F.col("snapshot_ts") < T1).select("snapshot_ts", "product_id")), "quote_grid",
    "SELECT snapshot_ts, product_id FROM quote_grid")
q("o147_key_difference", lambda s, d: S.key_difference(A.items(s, d).filter("item_id LIKE '%1%'"),
    A.items(s, d).filter("item_id LIKE '%2%'"), "item_id"), "items",
    "SELECT item_id, CASE WHEN item_id NOT LIKE '%2%' THEN 'only_left' WHEN item_id NOT LIKE '%1%' THEN 'only_right' ELSE 'both' END AS "
    "side FROM items WHERE item_id LIKE '%1%' OR item_id LIKE '%2%'")
q("o148_first_per_key", lambda s, d: S.first_per_key(A.quote_ticks(s, d), ["product_id"], ["snapshot_ts"]).select("product_id",
    "snapshot_ts", "k"), "quote_ticks",
    "SELECT product_id, min(snapshot_ts) AS snapshot_ts, arg_min(k, snapshot_ts) AS k FROM quote_ticks GROUP BY 1")
