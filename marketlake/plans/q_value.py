"""Queries of opportunities: generation, pricing, valuation and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import keys as K
from ..operators import valuation as V
from ..sources import adapters as A
from ..sources.files import stored
from .inputs_sql import sql
from .q_series import _FEAT, _MIC, T, W

QUERIES: dict = {}
ORACLES: dict = {}
IN = "part_quotes item_listing_quotes recipes ingredients"


def q(name: str, fn, inputs: str, body: str | None) -> None:
    QUERIES[name] = fn
    if body is not None:
        ORACLES[name] = sql(inputs, body)


def legs(s, d, quotes=None, lq=None):
    quotes = A.part_quotes(s, d) if quotes is None else quotes
    lq = A.item_listing_quotes(s, d) if lq is None else lq
    return V.market_opportunities(quotes, lq).unionByName(V.conversion_opportunities(A.recipes(s, d), A.ingredients(s, d)))


def feeds(s, d):
    """(quotes, listing quotes) as stored tables: both the legs and their prices read them."""
    return stored(A.part_quotes(s, d)), stored(A.item_listing_quotes(s, d))


def valued(s, d):
    quotes, lq = feeds(s, d)
    own = stored(legs(s, d, quotes, lq))
    return V.value_opportunities(own, quotes, lq, constraints=V.constraints_of(own))


def resolved(s, d):
    quotes, lq = feeds(s, d)
    return V.resolve_leg_prices(V.with_implicit_sells(legs(s, d, quotes, lq)), quotes, lq)


CAREFUL = "coalesce(CASE WHEN p25 > 0 AND second_lowest > 0 THEN least(p25, second_lowest) END, CASE WHEN p25 > 0 THEN p25 END, CASE WHEN second_lowest > 0 THEN second_lowest END, median * 0.97e0)"
LEGS = f"""WITH bz AS (SELECT 'BZ:' || product_id AS opp_id, 'BAZAAR' AS flip_type, product_id AS r FROM part_quotes WHERE buy_price > 0 AND sell_price / buy_price >= 1.015),
  ah AS (SELECT 'AH:' || item_id AS opp_id, 'AUCTION' AS flip_type, item_id AS r FROM item_listing_quotes WHERE lowest > 0 AND sample_size >= 10 AND {CAREFUL} / lowest >= 1.10),
  rc AS (SELECT recipe_id, 'RC:' || recipe_id AS opp_id, CASE process_type WHEN 'CRAFT' THEN 'CRAFTING' ELSE process_type END AS flip_type, output_item_id AS r, process_type, process_duration_seconds AS ds FROM recipes),
  legs AS (
    SELECT opp_id, flip_type, r AS result_item_id, n AS leg_no, ['BUY', 'SELL'][n + 1] AS leg_type, 30::BIGINT AS base_duration_seconds, r AS item_id, 1 AS amount, 'BAZAAR' AS market, NULL::INT AS duration_hours FROM bz, (SELECT unnest([0, 1])::INT AS n)
    UNION ALL SELECT opp_id, flip_type, r, n, ['BUY', 'SELL'][n + 1], [30, 43200][n + 1]::BIGINT, r, 1, 'AUCTION', CASE n WHEN 1 THEN 12 END FROM ah, (SELECT unnest([0, 1])::INT AS n)
    UNION ALL SELECT opp_id, flip_type, r, (row_number() OVER (PARTITION BY recipe_id ORDER BY item_id, amount) - 1)::INT, 'BUY', 30, item_id, amount, NULL, NULL FROM rc JOIN ingredients USING (recipe_id)
    UNION ALL SELECT opp_id, flip_type, r, (SELECT count(*) FROM ingredients i WHERE i.recipe_id = rc.recipe_id)::INT, CASE process_type WHEN 'FORGE' THEN 'FORGE' WHEN 'KATGRADE' THEN 'WAIT' ELSE 'CRAFT' END, ds, NULL, NULL, NULL, NULL FROM rc),
  all_legs AS (SELECT *, false AS implicit FROM legs UNION ALL SELECT opp_id, any_value(flip_type), max(result_item_id), max(leg_no) + 1, 'SELL', NULL, max(result_item_id), 1, NULL, NULL, true FROM legs GROUP BY opp_id HAVING NOT bool_or(leg_type = 'SELL')),
  j AS (SELECT l.*, b.* EXCLUDE (product_id), a.* EXCLUDE (item_id), CASE leg_type WHEN 'BUY' THEN coalesce(buy_price > 0, false) ELSE coalesce(sell_price > 0, false) END AS hq,
    CASE leg_type WHEN 'BUY' THEN coalesce(lowest > 0, false) ELSE coalesce({CAREFUL} > 0, false) END AS hl, {CAREFUL} AS careful FROM all_legs l LEFT JOIN part_quotes b ON b.product_id = l.item_id LEFT JOIN item_listing_quotes a ON a.item_id = l.item_id),
  res AS (SELECT *, CASE source WHEN 'BAZAAR' THEN CASE leg_type WHEN 'BUY' THEN buy_price ELSE sell_price END WHEN 'AUCTION' THEN CASE leg_type WHEN 'BUY' THEN lowest::DOUBLE ELSE careful END END AS unit_price,
    list_filter([CASE WHEN leg_type IN ('BUY', 'SELL') AND source IS NULL THEN 'MISSING_' || CASE leg_type WHEN 'BUY' THEN 'INPUT' ELSE 'OUTPUT' END || '_PRICE' || coalesce('_' || market, '') || ':' || item_id END,
      CASE WHEN leg_type = 'BUY' AND market IS NULL AND hq AND hl THEN 'AMBIGUOUS_INPUT_MARKET_SOURCE:' || item_id END,
      CASE WHEN source = 'BAZAAR' AND amount > CASE leg_type WHEN 'BUY' THEN sell_volume ELSE buy_volume END THEN 'INSUFFICIENT_' || CASE leg_type WHEN 'BUY' THEN 'INPUT' ELSE 'OUTPUT' END || '_DEPTH:' || item_id END,
      CASE WHEN source = 'BAZAAR' AND CASE leg_type WHEN 'BUY' THEN sell_volume ELSE buy_volume END <= 0 THEN 'ZERO_TURNOVER:' || item_id END], lambda x: x IS NOT NULL) AS reasons
    FROM (SELECT *, CASE WHEN leg_type NOT IN ('BUY', 'SELL') THEN NULL WHEN market = 'BAZAAR' THEN CASE WHEN hq THEN 'BAZAAR' END WHEN market = 'AUCTION' THEN CASE WHEN hl THEN 'AUCTION' END WHEN hq THEN 'BAZAAR' WHEN hl THEN 'AUCTION' END AS source FROM j)),
  p1 AS (SELECT *, CASE WHEN source = 'BAZAAR' THEN unit_price * (1 + CASE leg_type WHEN 'BUY' THEN 1 ELSE -1 END * 0.35e0 * CASE WHEN depth <= 0 THEN 1e0 WHEN amount > depth THEN 1e0 - depth::DOUBLE / amount ELSE 0e0 END) ELSE unit_price END AS unit_at
    FROM (SELECT *, CASE leg_type WHEN 'BUY' THEN sell_volume ELSE buy_volume END AS depth, CASE leg_type WHEN 'BUY' THEN sell_moving_week ELSE buy_moving_week END AS week FROM res)),
  p2 AS (SELECT *, CASE WHEN leg_type = 'BUY' AND source IS NOT NULL THEN ceil(unit_at * amount)::BIGINT ELSE 0 END AS leg_cost, CASE WHEN leg_type = 'SELL' AND source IS NOT NULL THEN floor(unit_at * amount)::BIGINT ELSE 0 END AS gross,
    CASE WHEN source = 'BAZAAR' THEN abs(buy_price - sell_price) / ((buy_price + sell_price) / 2) WHEN source = 'AUCTION' THEN (second_lowest - lowest)::DOUBLE / lowest END AS spread,
    CASE WHEN source = 'BAZAAR' THEN CASE WHEN week > 0 THEN least(24e0, amount / (week / 168e0)) WHEN depth > 0 THEN least(24e0, amount / (depth / 168e0)) ELSE 24e0 END WHEN source = 'AUCTION' AND leg_type = 'SELL' THEN coalesce(duration_hours, 12)::DOUBLE WHEN source = 'AUCTION' THEN base_duration_seconds / 3600e0 END AS fill_hours FROM p1),
  p3 AS (SELECT *, CASE WHEN leg_type = 'SELL' AND source = 'AUCTION' THEN ceil(gross * CASE WHEN gross < 10000000 THEN 0.01e0 WHEN gross < 100000000 THEN 0.02e0 ELSE 0.025e0 END)::BIGINT + 100 ELSE 0 END AS upfront FROM p2),
  priced AS (SELECT *, CASE WHEN leg_type = 'SELL' AND source = 'BAZAAR' THEN ceil(gross * 0.0125e0)::BIGINT WHEN leg_type = 'SELL' AND source = 'AUCTION' THEN upfront + CASE WHEN gross > 1000000 THEN least(ceil(gross * 0.01e0)::BIGINT, gross - 1000000) ELSE 0 END ELSE 0 END AS fees,
    CASE source WHEN 'BAZAAR' THEN least(100, greatest(0, 100e0 / (1 + fill_hours) / (1 + spread / 0.02e0))) WHEN 'AUCTION' THEN least(100, greatest(0, (1 - exp(-sample_size / 12e0)) / (1 + spread / 0.05e0) * 100)) END AS liquidity,
    CASE source WHEN 'BAZAAR' THEN 50 * least(1e0, spread / 0.05e0) + 50 * least(1e0, fill_hours / 6e0) WHEN 'AUCTION' THEN 60 * exp(-sample_size / 12e0) + 40 * least(1e0, spread / 0.2e0) END AS risk,
    CASE WHEN fill_hours > 0 THEN ceil(fill_hours * 3600e0)::BIGINT ELSE coalesce(base_duration_seconds, 0) END AS seconds FROM p3)"""
_LEGCOLS = ["opp_id", "flip_type", "result_item_id", "leg_no", "leg_type", "base_duration_seconds", "item_id", "amount", "market",
    "duration_hours"]
q("o042_resolve_leg_prices",
    lambda s, d: resolved(s, d).select("opp_id", "leg_no", "source", "unit_price", F.array_join("reasons", ",").alias("reasons")), IN,
    LEGS + " SELECT opp_id, leg_no, source, unit_price, array_to_string(reasons, ',') AS reasons FROM res")
q("o120_market_opportunities", lambda s, d: V.market_opportunities(A.part_quotes(s, d), A.item_listing_quotes(s, d)).select(*_LEGCOLS), IN,
    LEGS + f" SELECT {', '.join(_LEGCOLS)} FROM legs WHERE opp_id NOT LIKE 'RC:%'")
q("o121_conversion_opportunities", lambda s, d: V.conversion_opportunities(A.recipes(s, d), A.ingredients(s, d)).select(*_LEGCOLS), IN,
    LEGS + f" SELECT {', '.join(_LEGCOLS)} FROM legs WHERE opp_id LIKE 'RC:%'")
q("o146_all_opportunities",
    lambda s, d: legs(s, d).groupBy("flip_type").agg(F.countDistinct("opp_id").alias("n"), F.count("*").alias("legs")), IN,
    LEGS + " SELECT flip_type, count(DISTINCT opp_id) AS n, count(*) AS legs FROM legs GROUP BY 1")
q("o119_eligible_listings", lambda s, d: V.eligible_listings(A.item_listing_quotes(s, d)).select("item_id", "reason"), IN,
    f"SELECT item_id, CASE WHEN sample_size < 10 THEN "
    f"'THIN_SAMPLE' WHEN {CAREFUL} / lowest < 1.10 THEN 'NO_EDGE' ELSE 'OK' END AS reason FROM item_listing_quotes")
q("o119_eligible_quotes", lambda s, d: V.eligible_quotes(A.part_quotes(s, d)).select("product_id"), IN,
    "SELECT product_id FROM part_quotes WHERE sell_price / buy_price >= 1.015")
q("o112_conservative_sell", lambda s, d: A.item_listing_quotes(s, d).select("item_id", V.conservative_sell().alias("price")), IN,
    f"SELECT item_id, {CAREFUL} AS price FROM item_listing_quotes")
_priced = lambda s, d: V.price_legs(resolved(s, d))
q("o108_quote_fee", lambda s, d: _priced(s, d).filter("leg_type = 'SELL' AND source = 'BAZAAR'").select("opp_id", "gross", "fees"), IN,
    LEGS + " SELECT opp_id, gross, fees FROM priced WHERE leg_type = 'SELL' AND source = 'BAZAAR'")
q("o109_listing_fees", lambda s, d: A.table(s, d, "orders").select("o_orderkey",
    *[c.alias(n) for c, n in zip(V.listing_fees(F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 7 + 1) * 100),
    F.element_at(F.array(*map(F.lit, (1, 6, 12, 24, 48, 3))), (F.col("o_orderkey") % 6 + 1).cast("int")), 4.0),
    ("listing", "duration", "claim"))]), "",
    """SELECT o_orderkey, ceil(ceil(g * CASE WHEN g < 10000000 THEN 0.01e0 WHEN g < 100000000 THEN 0.02e0 ELSE 0.025e0 END) * 4)::BIGINT AS listing, [20, 45, 100, 350, 1200, 100][o_orderkey % 6 + 1]::BIGINT AS duration,
  CASE WHEN g > 1000000 THEN least(ceil(ceil(g * 0.01e0) * 4)::BIGINT, g - 1000000) ELSE 0 END AS claim FROM (SELECT o_orderkey, floor(o_totalprice * (o_orderkey % 7 + 1) * 100)::BIGINT AS g FROM orders)""")
q("o111_depth_price", lambda s, d: _priced(s, d).filter("leg_type = 'BUY'").select("opp_id", "leg_no", "leg_cost"), IN,
    LEGS + " SELECT opp_id, leg_no, leg_cost FROM priced WHERE leg_type = 'BUY'")
q("o113_fill_hours", lambda s, d: _priced(s, d).filter("source IS NOT NULL").select("opp_id", "leg_no", "fill_hours", "seconds"), IN,
    LEGS + " SELECT opp_id, leg_no, fill_hours, seconds FROM priced WHERE source IS NOT NULL")
q("o114_quote_leg_scores", lambda s, d: _priced(s, d).filter("source = 'BAZAAR'").select("opp_id", "leg_no", "liquidity", "risk"), IN,
    LEGS + " SELECT opp_id, leg_no, liquidity, risk FROM priced WHERE source = 'BAZAAR'")
q("o115_listing_leg_scores", lambda s, d: _priced(s, d).filter("source = 'AUCTION'").select("opp_id", "leg_no", "liquidity", "risk"), IN,
    LEGS + " SELECT opp_id, leg_no, liquidity, risk FROM priced WHERE source = 'AUCTION'")
q("o116_bottleneck_scores",
    lambda s, d: _priced(s, d).groupBy("opp_id").agg(F.min("liquidity").alias("liquidity"), F.max("risk").alias("risk")), IN,
    LEGS + " SELECT opp_id, min(liquidity) AS liquidity, max(risk) AS risk FROM priced GROUP BY 1")
q("o106_exposure", lambda s, d: V.exposure(_priced(s, d)), IN,
    LEGS + " SELECT opp_id, sum(leg_cost + upfront)::BIGINT AS peak_exposure FROM priced GROUP BY 1")
VALUED = LEGS + """, v0 AS (SELECT opp_id, any_value(flip_type) AS flip_type, any_value(result_item_id) AS result_item_id, sum(leg_cost)::BIGINT AS input_cost, sum(gross)::BIGINT AS gross, sum(fees)::BIGINT AS fees, sum(seconds)::BIGINT AS duration_seconds, min(liquidity) AS liquidity_score,
    max(risk) AS xr, coalesce(sum(fill_hours) FILTER (leg_type IN ('BUY', 'SELL')), 0) + coalesce(sum(base_duration_seconds / 3600e0) FILTER (leg_type NOT IN ('BUY', 'SELL')), 0) AS xh, sum(leg_cost + upfront)::BIGINT AS peak,
    array_to_string(list_concat(['MISSING_ELECTION_DATA'], list_filter(flatten(list(reasons ORDER BY leg_no)), lambda x, i: list_position(flatten(list(reasons ORDER BY leg_no)), x) = i)), ',') AS partial_reasons FROM priced GROUP BY opp_id),
  valued AS (SELECT opp_id, flip_type, result_item_id, fees, duration_seconds, liquidity_score, partial_reasons, true AS partial, greatest(input_cost, peak) AS required_capital, gross - input_cost - fees AS expected_profit,
    CASE WHEN greatest(input_cost, peak) > 0 THEN (gross - input_cost - fees) / greatest(input_cost, peak)::DOUBLE END AS roi, least(100, 0.7 * xr + 30 * least(1e0, xh / 6)) AS risk_score FROM v0)"""
VALUED = VALUED.replace(
    "list_filter(flatten(list(reasons ORDER BY leg_no)), lambda x, i: list_position(flatten(list(reasons ORDER BY leg_no)), x) = i)",
    "list_filter(rs, lambda x, i: list_position(rs, x) = i)").replace("FROM priced GROUP BY opp_id),\n  valued",
    "FROM (SELECT *, flatten(list(reasons ORDER BY leg_no) OVER (PARTITION BY opp_id)) AS rs FROM priced) GROUP BY opp_id, rs),\n "
    " valued").replace("list(reasons ORDER BY leg_no) OVER (PARTITION BY opp_id)",
        "list(reasons) OVER (PARTITION BY opp_id ORDER BY leg_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
q("o122_value_opportunities", lambda s, d: valued(s, d).withColumn("partial_reasons", F.array_join("partial_reasons", ",")), IN,
    VALUED + " SELECT *, CASE WHEN duration_seconds > 0 THEN roi * (3600e0 / duration_seconds) END AS roi_per_hour FROM valued")
_ROWS = " SELECT *, CASE WHEN duration_seconds > 0 THEN roi * (3600e0 / duration_seconds) END AS roi_per_hour FROM valued"
_election = lambda s, d: A.table(s, d, "nation").select(F.when(F.col("n_nationkey") == 4, "Derpy").otherwise("Paul").alias("mayor"),
    (F.col("n_regionkey") == 4).alias("active"))


def valued_with_features(s, d):
    """Valuation with the micro and macro features of the quotes and the taxes of the election."""
    features = stored(X.timescale_features(stored(A.quote_grid(s, d)), T, W))
    quotes, lq = feeds(s, d)
    own = stored(legs(s, d, quotes, lq))
    return V.value_opportunities(own, quotes, lq, features, V.constraints_of(own), V.tax_context(_election(s, d)))


def _vr(v: str, r: str, vc: float, rc: float) -> str:
    a, b = f"100 * least(1e0, greatest(0, {v} / {vc}e0))", f"100 * least(1e0, abs({r}) / {rc}e0)"
    return f"CASE WHEN {v} IS NOT NULL AND {r} IS NOT NULL THEN 0.7e0 * {a} + 0.3e0 * {b} WHEN {v} IS NOT NULL THEN {a} WHEN {r} IS NOT NULL THEN {b} END"


_WEIGHT = "CASE {c} WHEN 'HIGH' THEN 1e0 WHEN 'MED' THEN 0.5e0 ELSE 0e0 END"
_RISKS = f"""rk AS (SELECT opp_id, max(mi) AS micro, coalesce(min(mic) FILTER (mi IS NOT NULL), 0) AS mc, max(ma) AS macro, coalesce(min(mac) FILTER (ma IS NOT NULL), 0) AS ac FROM (SELECT DISTINCT opp_id, item_id FROM priced WHERE source = 'BAZAAR')
    JOIN (SELECT product_id AS item_id, {_vr('micro_volatility', 'micro_return', 0.03, 0.05)} AS mi, {_WEIGHT.format(c='micro_confidence')} AS mic, {_vr('macro_volatility', 'macro_return', 0.12, 0.2)} AS ma, {_WEIGHT.format(c='macro_confidence')} AS mac FROM feat) USING (item_id) GROUP BY 1),
  valued AS"""
_SCORE = """least(100, greatest(0, (1 - 0.35e0 * coalesce(mc, 0) - 0.2e0 * coalesce(ac, 0)) * c + 0.35e0 * coalesce(mc, 0) * coalesce(micro, c) + 0.2e0 * coalesce(ac, 0) * coalesce(macro, c))) AS risk_score
    FROM (SELECT *, least(100, 0.7 * xr + 30 * least(1e0, xh / 6)) AS c FROM v0) LEFT JOIN rk USING (opp_id))"""
_RATES = "CASE WHEN gross < 10000000 THEN 0.01e0 WHEN gross < 100000000 THEN 0.02e0 ELSE 0.025e0 END"
WITH_FEATURES = "WITH " + _MIC[
    4:] + ", feat AS (" + _FEAT + "), ctx AS (SELECT CASE WHEN bool_or(n_nationkey = 4 AND n_regionkey = 4) THEN 4e0 ELSE 1e0 END AS m FROM nation)," + VALUED[4:]
for _a, _b in (
    (f"ceil(gross * {_RATES})::BIGINT + 100", f"ceil(ceil(gross * {_RATES}) * (SELECT m FROM ctx))::BIGINT + 100"),
    ("least(ceil(gross * 0.01e0)::BIGINT, gross - 1000000)",
        "least(ceil(ceil(gross * 0.01e0) * (SELECT m FROM ctx))::BIGINT, gross - 1000000)"),
    ("100e0 / (1 + fill_hours) / (1 + spread / 0.02e0)))",
        "100e0 / (1 + fill_hours) / (1 + spread / 0.02e0) - CASE WHEN item_id IN (SELECT product_id FROM feat WHERE illiquid) THEN 10 "
        "ELSE 0 END))"),
    ("list_concat(['MISSING_ELECTION_DATA'], ", "list_concat([]::VARCHAR[], "),
    ("true AS partial,", "partial_reasons <> '' AS partial,"),
    ("valued AS", _RISKS),
    ("least(100, 0.7 * xr + 30 * least(1e0, xh / 6)) AS risk_score FROM v0)", _SCORE),
):
    assert _a in WITH_FEATURES, _a
    WITH_FEATURES = WITH_FEATURES.replace(_a, _b)
FEATURED = IN + " quote_grid"
q("o122_value_with_features", lambda s, d: valued_with_features(s, d).withColumn("partial_reasons", F.array_join("partial_reasons", ",")),
    FEATURED, WITH_FEATURES + _ROWS)
q("o118_total_risk_with_features", lambda s, d: valued_with_features(s, d).select("opp_id", "risk_score"), FEATURED,
    WITH_FEATURES + " SELECT opp_id, risk_score FROM valued")
_THEN = "product_id, buy_price, sell_price, buy_volume, sell_volume, buy_moving_week, sell_moving_week"
q("o144_opportunities_as_of",
    lambda s, d: V.opportunities_as_of(A.quote_grid(s, d), T + 1000, A.item_listing_quotes(s, d), A.recipes(s, d),
    A.ingredients(s, d)).withColumn("partial_reasons", F.array_join("partial_reasons", ",")),
    "quote_grid item_listing_quotes recipes ingredients",
  f"WITH part_quotes AS (SELECT {_THEN} FROM quote_grid WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM quote_grid WHERE "
      f"snapshot_ts <= {T + 1000}))," + VALUED[4:] + _ROWS)
q("o110_economics", lambda s, d: valued(s, d).select("opp_id", "required_capital", "expected_profit", "roi"), IN,
    VALUED + " SELECT opp_id, required_capital, expected_profit, roi FROM valued")
q("o118_total_risk", lambda s, d: valued(s, d).select("opp_id", "risk_score"), IN, VALUED + " SELECT opp_id, risk_score FROM valued")
q("o123_partial_reasons",
    lambda s, d: valued(s, d).select(F.explode("partial_reasons").alias("r")).select(F.split("r",
    ":")[0].alias("code")).groupBy("code").count(), IN,
    VALUED + " SELECT split_part(r, ':', 1) AS code, count(*) AS count FROM (SELECT unnest(string_split(partial_reasons, ',')) AS r FROM "
    "valued) GROUP BY 1")
q("o117_vol_return_risk",
    lambda s, d: A.quote_ticks(s, d).select("snapshot_ts", "product_id",
    V.vol_return_risk(F.when(F.col("k") % 3 != 0, F.col("k") / 2000.0), F.when(F.col("k") % 4 != 0, F.col("k") / -1000.0), 0.03,
    0.05).alias("risk")), "quote_ticks",
    """SELECT snapshot_ts, product_id, CASE WHEN k % 3 <> 0 AND k % 4 <> 0 THEN 70 * least(1e0, k / 2000e0 / 0.03e0) + 30 * least(1e0, k / 1000e0 / 0.05e0)
  WHEN k % 3 <> 0 THEN 100 * least(1e0, k / 2000e0 / 0.03e0) WHEN k % 4 <> 0 THEN 100 * least(1e0, k / 1000e0 / 0.05e0) END AS risk FROM quote_ticks""")
q("o128_durations", lambda s, d: V.durations(legs(s, d)), IN,
    LEGS + " SELECT opp_id, sum(base_duration_seconds)::BIGINT AS total, (sum(base_duration_seconds) FILTER (leg_type NOT IN ('FORGE', "
    "'WAIT')))::BIGINT AS active, coalesce(sum(base_duration_seconds) FILTER (leg_type IN ('FORGE', 'WAIT')), 0)::BIGINT AS passive, "
        "bool_or(leg_type = 'FORGE') AS needs_forge_slot FROM legs GROUP BY 1")
q("o079_item_stacks", lambda s, d: V.item_stacks(legs(s, d)), IN,
    LEGS + " SELECT opp_id, CASE leg_type WHEN 'BUY' THEN 'input' ELSE 'output' END AS side, item_id, sum(amount)::BIGINT AS amount FROM "
    "all_legs WHERE leg_type IN ('BUY', 'SELL') GROUP BY ALL")
q("o129_conversion_cost",
    lambda s, d: V.conversion_cost(A.recipes(s, d), A.ingredients(s, d), A.part_quotes(s, d).filter("product_id NOT LIKE '%3'"), A.listings(s, d),
    K.aliases(A.items(s, d))), IN + " listings items item_aliases",
    """WITH n AS (SELECT item_name, min(starting_bid) AS low, sum(CASE WHEN highest_bid > 0 THEN highest_bid ELSE starting_bid END)::BIGINT AS s, count(*) AS n FROM listings GROUP BY 1),
  mt AS (SELECT DISTINCT item_name, item_id FROM (SELECT item_name, upper(trim(item_name)) AS u FROM n) JOIN item_aliases ON contains(u, alias) OR contains(regexp_replace(u, '[_ ]', '', 'g'), alias)),
  l AS (SELECT item_id, min(low) AS lowest, sum(s)::BIGINT // sum(n)::BIGINT AS average FROM n JOIN mt USING (item_name) GROUP BY 1),
  p AS (SELECT coalesce(q.product_id, l.item_id) AS item_id, coalesce(floor(buy_price + 0.5)::BIGINT, lowest) AS b, coalesce(floor(sell_price + 0.5)::BIGINT, average) AS v FROM (SELECT * FROM part_quotes WHERE product_id NOT LIKE '%3') q FULL JOIN l ON q.product_id = l.item_id),
  c AS (SELECT recipe_id, CASE WHEN count(b) = count(*) THEN sum(b * amount)::BIGINT END AS cost, count(*) - count(b) AS missing FROM ingredients LEFT JOIN p USING (item_id) GROUP BY 1)
  SELECT r.recipe_id, output_item_id AS item_id, cost, missing, v AS sell_unit, v - cost AS profit, CASE WHEN cost > 0 THEN floor((v - cost) * 10000e0 / cost + 0.5) / 100 END AS profit_pct FROM recipes r LEFT JOIN c USING (recipe_id) LEFT JOIN p ON p.item_id = output_item_id""")
_IDENTITY = """, st AS (SELECT opp_id, any_value(flip_type) AS type, any_value(result_item_id) AS result, string_agg('{' || concat_ws(',', '"amount":' || amount, '"duration":' || base_duration_seconds, '"item":"' || item_id || '"',
    '"market":"' || market || '"', '"type":"' || leg_type || '"') || '}', ',' ORDER BY leg_no) AS steps FROM legs GROUP BY 1),
  js AS (SELECT opp_id, '{"constraints":[' || CASE WHEN opp_id LIKE 'RC:%' THEN CASE WHEN type = 'FORGE' THEN '"MIN_FORGE_SLOTS:1",' ELSE '' END || '"RECIPE_UNLOCKED"' ELSE '' END
    || '],"result":"' || result || '","steps":[' || steps || '],"type":"' || type || '","version":1}' AS j FROM st)
  SELECT opp_id, 'v1_' || sha256(j) AS flip_key, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-3' || substr(m, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(m, 17, 1)) - 1) % 4 + 1, 1)
    || substr(m, 18, 3) || '-' || substr(m, 21, 12) AS stable_id FROM (SELECT *, md5(j) AS m FROM js)"""
q("o127_stable_identity", lambda s, d: V.stable_identity(legs(s, d), V.constraints_of(legs(s, d))), IN, LEGS + _IDENTITY)
q("o131_min_capital", lambda s, d: V.min_capital(A.table(s, d, "orders").select((F.col("o_custkey") % 97).alias("opp_id"),
    F.when(F.col("o_orderkey") % 2 == 0, "MIN_CAPITAL").otherwise("RECIPE_UNLOCKED").alias("kind"),
    (F.floor("o_totalprice") - 1000).alias("long_value"))), "",
    "SELECT o_custkey % 97 AS opp_id, max(floor(o_totalprice)::BIGINT - 1000) AS min_capital FROM orders WHERE o_orderkey % 2 = 0 AND "
    "floor(o_totalprice) > 1000 GROUP BY 1")
q("o130_tax_context", lambda s, d: V.tax_context(A.table(s, d,
    "nation").select(F.when(F.col("n_nationkey") == 3, "Derpy").otherwise("Paul").alias("mayor"),
    (F.col("n_regionkey") == 3).alias("active"))), "",
    "SELECT 0.0125e0 AS quote_tax, CASE WHEN (SELECT n_regionkey FROM nation WHERE n_nationkey = 3) = 3 THEN 4e0 ELSE 1e0 END AS "
    "listing_multiplier, false AS election_missing")
_JSON = """CASE e.event_id % 4 WHEN 0 THEN '{"itemId":" A' || user_id || ' ","amount":' || (event_id % 5) || ',"market":"bazaar_buy"}' WHEN 1 THEN '{"itemId":"","amount":"x","source":"Auction"}' WHEN 2 THEN '{"itemId":"B","amount":"7","market":"npc","price":' || (event_id % 3) || ',"cost":2.5}' ELSE 'oops' END"""
q("o031_parse_leg_params",
    lambda s, d: V.parse_leg_params(A.table(s, d, "events").alias("e").select("event_id",
    F.expr(_JSON).alias("params_json"))).drop("params_json"), "",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'A' || user_id WHEN 2 THEN 'B' END AS item_id, CASE event_id % 4 WHEN 0 THEN greatest(1, event_id % 5) WHEN 2 THEN 7 ELSE 1 END::INT AS amount,
  CASE event_id % 4 WHEN 0 THEN 'BAZAAR' WHEN 1 THEN 'AUCTION' WHEN 2 THEN 'NPC' ELSE 'ANY' END AS market, CASE WHEN event_id % 4 = 2 THEN CASE WHEN event_id % 3 > 0 THEN (event_id % 3)::DOUBLE ELSE 2.5e0 END END AS npc_unit_price FROM events""")
