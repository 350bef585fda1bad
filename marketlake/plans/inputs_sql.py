"""The adapters of `sources.adapters` as DuckDB SQL, for the oracles."""

from __future__ import annotations

INPUTS = {
    "quote_ticks": r"""SELECT (epoch_us(ts) // 1000) AS snapshot_ts, 'P' || (user_id % 20) AS product_id, value + 1e0 AS buy_price, (value + 1e0) * (0.9e0 + (k % 20) / 100e0) AS sell_price,
        (k * 100)::BIGINT AS buy_volume, ((event_id % 97) * 50)::BIGINT AS sell_volume, k FROM (SELECT *, json_extract(props, '$.k')::INT AS k FROM events)""",
    "quotes": r"""SELECT *, buy_volume * 168 AS buy_moving_week, sell_volume * 168 AS sell_moving_week, k % 10 AS buy_orders, k % 10 AS sell_orders FROM quote_ticks""",
    "quote_grid": r"""SELECT slot AS snapshot_ts, * EXCLUDE (slot, snapshot_ts, rn) FROM (SELECT *, row_number() OVER (PARTITION BY slot, product_id ORDER BY snapshot_ts DESC) AS rn
        FROM (SELECT *, (snapshot_ts // 21600000) * 21600000 AS slot FROM quotes)) WHERE rn = 1""",
    "listings": r"""SELECT 896659200000::BIGINT AS snapshot_ts, md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice * 100)::BIGINT)) AS auction_uuid,
        p_name || CASE WHEN l_linenumber % 7 = 0 THEN ' ✪✪' ELSE '' END AS item_name, p_type AS category, 'T' || (p_size % 3) AS tier, floor(l_extendedprice)::BIGINT AS starting_bid,
        CASE WHEN l_returnflag = 'A' THEN floor(l_extendedprice * (1 - l_discount))::BIGINT ELSE 0 END AS highest_bid, (896659200000 - 86400000)::BIGINT AS start_ts, (epoch_us(l_shipdate) // 1000) AS end_ts,
        l_linestatus = 'F' AS claimed, l_returnflag <> 'A' AS bin,
        CASE l_linenumber % 5 WHEN 1 THEN '§7Plain item' WHEN 2 THEN '§6RARITY UPGRADED ✪' WHEN 3 THEN '§9Sharpness V' || chr(10) || 'modifier: sharp' WHEN 4 THEN 'Combat Slot and RUBY Gemstone' END AS item_lore,
        CASE l_linenumber % 4 WHEN 1 THEN '{"id":"' || tag || '"}' WHEN 2 THEN '{\"id\":\"' || tag || '\"}' WHEN 3 THEN '{"id":"' || tag || '","modifier":"odd"}' END AS extra
        FROM (SELECT *, upper(replace(p_name, ' ', '_')) AS tag FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "listing_points": r"""SELECT snapshot_ts, product_id AS item_key, floor(buy_price)::BIGINT AS bin_lowest, CASE WHEN k % 11 <> 0 THEN floor(buy_price * 1.05e0)::BIGINT END AS bin_lowest5_mean,
        CASE WHEN k % 7 <> 0 THEN floor(buy_price * 1.1e0)::BIGINT END AS bin_p50, floor(buy_price * 1.5e0)::BIGINT AS bin_p95, CASE WHEN k % 3 <> 0 THEN floor(buy_price * 0.8e0)::BIGINT END AS bid_p50,
        k + 1 AS bin_count, k % 4 AS ending_soon_count FROM quote_ticks""",
    "auction_snapshots": r"""SELECT (epoch_us(ts) // 1000) // 21600000 * 21600000 AS snapshot_ts, 'a' || event_id AS auction_uuid, p_name || CASE WHEN k % 7 = 0 THEN ' ✪✪' ELSE '' END AS item_name,
        floor(value * 10)::BIGINT + 1 AS starting_bid, CASE WHEN k % 2 = 1 THEN floor(value * 12)::BIGINT + 1 ELSE 0 END AS highest_bid
        FROM (SELECT *, json_extract(props, '$.k')::INT AS k FROM events) JOIN part ON p_partkey = event_id % (SELECT count(*) FROM part)""",
    "item_aliases": r"""SELECT item_id, alias FROM (SELECT item_id, unnest(list_distinct([upper(item_id), upper(display_name), upper(minecraft_id), regexp_replace(upper(item_id), '[_ ]', '', 'g'),
        regexp_replace(upper(display_name), '[_ ]', '', 'g'), regexp_replace(upper(minecraft_id), '[_ ]', '', 'g')])) AS alias FROM items) WHERE alias <> ''""",
    "items": r"""SELECT 'P' || p_partkey AS item_id, upper(p_name) AS display_name, 'mc:' || replace(p_name, ' ', '_') AS minecraft_id, p_brand AS rarity, p_type AS category FROM part""",
    "recipes": r"""SELECT 'R' || p_partkey AS recipe_id, 'P' || p_partkey AS output_item_id, CASE p_size % 3 WHEN 0 THEN 'CRAFT' WHEN 1 THEN 'FORGE' ELSE 'KATGRADE' END AS process_type,
        (p_size * 60)::BIGINT AS process_duration_seconds FROM part""",
    "ingredients": r"""SELECT 'R' || p_partkey AS recipe_id, 'P' || ((p_partkey * 7 + i * 13) % n_parts) AS item_id, (1 + (p_size + i) % 4)::INT AS amount
        FROM part, (SELECT count(*) AS n_parts FROM part), (SELECT unnest([0, 1, 2]) AS i)""",
    "part_quotes": r"""SELECT 'P' || l_partkey AS product_id, buy_price, buy_price * (0.95e0 + (l_partkey % 10) / 50e0) AS sell_price, buy_volume, sell_volume, buy_volume * 168 AS buy_moving_week, sell_volume * 168 AS sell_moving_week
        FROM (SELECT l_partkey, quantile_cont(l_extendedprice / l_quantity, 0.5) AS buy_price, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0)::BIGINT AS buy_volume,
        coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0)::BIGINT AS sell_volume FROM lineitem GROUP BY 1)""",
    "item_listing_quotes": r"""SELECT item_id, min(b) AS lowest, coalesce(list_sort(list(b))[2], min(b)) AS second_lowest, max(b) AS highest, avg(b) AS average, (list_sort(list(b))[floor(0.5e0 * (count(*) - 1))::INT + 1])::DOUBLE AS median,
        (list_sort(list(b))[floor(0.25e0 * (count(*) - 1))::INT + 1])::DOUBLE AS p25, count(*)::INT AS sample_size FROM (SELECT 'P' || l_partkey AS item_id, floor(l_extendedprice)::BIGINT AS b FROM lineitem WHERE l_returnflag <> 'A') GROUP BY 1""",
    "opportunities": r"""SELECT 'o' || k AS stable_id, 'k' || k AS flip_key, ['AUCTION', 'BAZAAR', 'CRAFTING', 'FORGE', 'FUSION', 'KATGRADE'][k % 5 + 1] AS flip_type, (epoch_us(o_orderdate) // 1000) AS snapshot_ts, 'P' || (k % 500) AS result_item_id,
        CASE WHEN k % 13 <> 0 THEN o_custkey * 1000 + 1000 END AS required_capital, CASE WHEN k % 17 <> 0 THEN profit END AS expected_profit,
        CASE WHEN k % 19 <> 0 THEN profit / (o_custkey * 1000e0 + 1000e0) END AS roi, CASE WHEN k % 19 <> 0 THEN profit / (o_custkey * 1000e0 + 1000e0) / (1 + k % 24) END AS roi_per_hour,
        (1 + k % 24) * 3600 AS duration_seconds, floor(o_totalprice * 0.0125e0)::BIGINT AS fees, CASE WHEN k % 23 <> 0 THEN (k % 101)::DOUBLE END AS liquidity_score,
        CASE WHEN k % 29 <> 0 THEN ((k * 7) % 101)::DOUBLE END AS risk_score, k % 4 = 0 AS partial,
        CASE WHEN k % 4 <> 0 THEN []::VARCHAR[] WHEN k % 8 = 0 THEN ['MISSING_ELECTION_DATA'] WHEN k % 12 = 0 THEN ['MISSING_INPUT_PRICE:P1', 'ZERO_TURNOVER'] ELSE ['INSUFFICIENT_OUTPUT_DEPTH'] END AS partial_reasons
        FROM (SELECT *, o_orderkey AS k, floor(o_totalprice)::BIGINT - 100000 AS profit FROM orders)""",
    "opportunity_history": r"""SELECT 'U' || user_id AS flip_key, day * 86400000 AS snapshot_ts, profit, profit / 1000e0 AS roi_per_hour, s AS liquidity_score, s AS risk_score, n % 2 = 0 AS partial
        FROM (SELECT user_id, (epoch_us(ts) // 1000) // 86400000 AS day, (sum(round(value * 100)::BIGINT) // 100)::BIGINT AS profit, avg(json_extract(props, '$.k')::INT) AS s, count(*) AS n FROM events GROUP BY 1, 2)""",
    "request_log": r"""SELECT (epoch_us(ts) // 1000) AS ts, event_type AS route, CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, CASE WHEN k % 5 = 0 THEN '500' ELSE '200' END AS status,
        CASE WHEN k % 5 = 0 THEN 'ERROR' ELSE 'OK' END AS outcome, value AS duration_ms FROM (SELECT *, json_extract(props, '$.k')::INT AS k FROM events)""",
    "payload_updates": r"""SELECT CASE WHEN user_id % 2 = 0 THEN 'quotes' ELSE 'listings' END AS feed, (epoch_us(ts) // 1000) AS last_updated, md5(props) AS hash, event_id AS payload_id FROM events""",
}
NEEDS = {"quotes": ("quote_ticks",), "quote_grid": ("quote_ticks", "quotes"), "listing_points": ("quote_ticks",), "item_aliases": ("items",)}


def sql(inputs: str, body: str) -> str:
    """The body, a list of further CTEs ending in a SELECT, over the named inputs."""
    names: list[str] = []
    for x in inputs.split():
        names += [n for n in (*NEEDS.get(x, ()), x) if n not in names]
    if not names:
        return body.strip()
    head = ",\n".join(f"{n} AS (\n{INPUTS[n]}\n)" for n in names)
    body = body.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {head},\n{body[4:]}"
    return f"WITH {head}\n{body}"
