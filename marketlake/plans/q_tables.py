"""Queries of sources, sinks, trend segments and retention, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import DAY_MS
from ..operators import compaction as C
from ..operators import features as X
from ..operators import maintenance as M
from ..operators import rollups as R
from ..sources import adapters as A
from ..sources import files as S
from ..sources.files import shared_folder
from . import q_value as QV
from .inputs_sql import sql
from .q_series import ORACLES as SERIES_SQL
from .q_series import QUOTE_ROLLUP as ROLLUP
from .q_series import P, T

QUERIES: dict = {}
ORACLES: dict = {}
ROLLUP_SQL = SERIES_SQL["o065_bucket_rollup_quotes"]


def q(name: str, fn, inputs: str, body: str | None) -> None:
    QUERIES[name] = fn
    if body is not None:
        ORACLES[name] = sql(inputs, body)


# sources, from JSON that Spark makes of the tables
def pages(s: SparkSession, d: str) -> DataFrame:
    """Pages of about 500 listings, each one JSON text; of the second update the last page is missing."""
    li = A.listings(s, d)
    total = max(1, li.count() // 500)
    li = li.withColumn("page", F.pmod(F.conv(F.substring("auction_uuid", 1, 8), 16, 10).cast("long"), F.lit(total)).cast("int"))
    a = F.struct(F.col("auction_uuid").alias("uuid"), "item_name", "category", "tier", "starting_bid",
        F.col("highest_bid").alias("highest_bid_amount"), F.col("start_ts").alias("start"), F.col("end_ts").alias("end"), "claimed", "bin",
        "item_lore", "extra")
    g = li.groupBy("page").agg(F.collect_list(a).alias("auctions"))
    one = g.select(F.explode(F.array(F.lit(5).cast("long"), F.lit(6).cast("long"))).alias("lastUpdated"), "page",
        "auctions").filter(f"NOT (lastUpdated = 6 AND page = {total - 1})")
    return one.select(F.to_json(F.struct(F.lit(True).alias("success"), "page", F.lit(total).alias("totalPages"), "lastUpdated",
        "auctions")).alias("value"))


def _pages_source(s, d):
    to = S.shared_folder(s)
    S.write_lines(pages(s, d), to)
    return S.read_listing_pages(s, to).groupBy("snapshot_ts", "bin").agg(F.count("*").alias("n"),
        F.sum("starting_bid").alias("bids"), F.count("item_lore").alias("lores"))


q("o001_read_listing_pages", _pages_source, "listings",
    "SELECT 5::BIGINT AS snapshot_ts, bin, count(*) AS n, sum(starting_bid)::BIGINT AS bids, count(item_lore) AS lores FROM listings "
    "GROUP BY bin")


def payload(s: SparkSession, d: str) -> DataFrame:
    g = A.quote_grid(s, d)
    status = F.struct(F.when(F.col("k") % 2 == 0, " ").otherwise(F.col("product_id")).alias("productId"),
        F.col("buy_price").alias("buyPrice"), F.col("sell_price").alias("sellPrice"), F.col("buy_volume").alias("buyVolume"),
        F.col("sell_volume").alias("sellVolume"))
    level = F.transform(F.sequence(F.lit(1), F.lit(5)),
        lambda i: F.struct((i * 10).cast("long").alias("amount"), (F.col("buy_price") + i).alias("pricePerUnit"), i.alias("orders")))
    v = F.struct(F.when(F.col("k") % 5 != 0, status).alias("quick_status"), level.alias("buy_summary"), level.alias("sell_summary"))
    m = g.groupBy("snapshot_ts").agg(F.map_from_entries(F.collect_list(F.struct("product_id", v.alias("v")))).alias("products"))
    return m.select(F.to_json(F.struct(F.lit(True).alias("success"), F.col("snapshot_ts").alias("lastUpdated"), "products")).alias("value"))


q("o002_read_quote_payload",
    lambda s, d: S.parse_quote_payload(payload(s, d)).select("snapshot_ts", "product_id", "buy_price", "sell_price", "buy_volume"),
    "quote_grid", "SELECT snapshot_ts, product_id, buy_price, sell_price, buy_volume FROM quote_grid WHERE k % 5 <> 0")
q("o140_order_book", lambda s, d: S.order_book(S.parse_quote_payload(payload(s, d)), "P3", 3).groupBy("side",
    "level").agg(F.round(F.sum("price"), 4).alias("price"), F.sum("amount").alias("amount")), "quote_grid",
    "SELECT side, level, round(sum(buy_price + level + 1), 4) AS price, (sum(10 * (level + 1)))::BIGINT AS amount FROM quote_grid, "
    "(SELECT unnest(['buy', 'sell']) AS side), (SELECT unnest([0, 1, 2]) AS level) WHERE product_id = 'P3' AND k % 5 <> 0 GROUP BY ALL")


def catalog(s: SparkSession, d: str) -> DataFrame:
    p, k = A.table(s, d, "part"), F.col("p_partkey")
    item = F.concat(F.lit("part_"), k)
    forge = '{"type":"forge","inputs":"[\\"RUBY:2\\",\\"JADE\\"]","duration":"%s"}'
    rows = p.select(F.when(k % 11 == 0, F.lit("{broken")).otherwise(F.concat(
        F.lit('{"internalname":" '), item, F.lit(' ","displayname":"'), F.col("p_name"),
            F.lit('","info":["https://a","b"],"lore":["x","y"]'),
        F.when(k % 3 == 0, F.concat(F.lit(',"recipe":{"A1":"WOOD:2","B2":"WOOD","C3":"P'), (k % 7).cast("string"),
            F.lit(':4"}'))).otherwise(""),
        F.when(k % 4 == 0, F.concat(F.lit(',"recipes":['), F.format_string(forge, F.col("p_size").cast("string")),
            F.when(k % 8 == 0, F.concat(F.lit(',{"type":"katgrade","time":'), (F.col("p_size") * 10).cast("string"),
            F.lit(',"input":"PET","output":"BETTER_PET:1","items":"[\\"LURE:2\\"]"}'))).otherwise(""),
            F.lit(',{"type":"npc_shop","result":"GEM:2","cost":"[\\"SKYBLOCK_COIN:'), F.col("p_size").cast("string"),
            F.lit('\\",\\"X:1\\"]"}]'))).otherwise(""), F.lit("}"),
    )).alias("value"))
    return S.parse_catalog(rows)


q("o003_read_catalog", lambda s, d: catalog(s, d).select(F.trim("internalname").alias("name"), "displayname"), "",
    "SELECT 'part_' || p_partkey AS name, p_name AS displayname FROM part WHERE p_partkey % 11 <> 0")
q("o027_catalog_items", lambda s, d: S.catalog_items(catalog(s, d)).select("item_id", "display_name", "lore",
    F.array_join("info_links", ",").alias("links")), "",
    "SELECT upper('part_' || p_partkey) AS item_id, p_name AS display_name, 'x' || chr(10) || 'y' AS lore, 'https://a' AS links FROM part "
    "WHERE p_partkey % 11 <> 0")
q("o026_useful_items", lambda s, d: S.useful_items(catalog(s, d)).select(F.trim("internalname").alias("name")), "",
    "SELECT 'part_' || p_partkey AS name FROM part WHERE p_partkey % 11 <> 0 AND (p_partkey % 3 = 0 OR p_partkey % 4 = 0)")
q("o143_list_npc_offers",
    lambda s, d: S.npc_offers(catalog(s, d)).filter("coin_cost IS NOT NULL").orderBy("item_id").offset(5).limit(20).select("item_id",
    "coin_cost"), "", "SELECT upper('part_' || p_partkey) AS item_id, p_size::BIGINT AS coin_cost FROM part WHERE p_partkey % 11 <> 0 AND "
    "p_partkey % 4 = 0 AND p_size <> 0 ORDER BY 1 LIMIT 20 OFFSET 5")
_C = "WITH c AS (SELECT *, upper('part_' || p_partkey) AS item FROM part WHERE p_partkey % 11 <> 0)"
q("o028_catalog_recipes", lambda s, d: S.catalog_recipes(catalog(s, d))[1], "",
    _C + """ SELECT item || ':CRAFT:0' AS recipe_id, 'WOOD' AS item_id, 3::BIGINT AS amount FROM c WHERE p_partkey % 3 = 0 UNION ALL SELECT item || ':CRAFT:0', 'P' || (p_partkey % 7), 4 FROM c WHERE p_partkey % 3 = 0
  UNION ALL SELECT item || ':FORGE:0', i, n FROM c, (SELECT unnest(['RUBY', 'JADE']) AS i, unnest([2, 1]) AS n) WHERE p_partkey % 4 = 0
  UNION ALL SELECT item || ':KATGRADE:0', i, n FROM c, (SELECT unnest(['PET', 'LURE']) AS i, unnest([1, 2]) AS n) WHERE p_partkey % 8 = 0""")
q("o028_catalog_recipe_heads", lambda s, d: S.catalog_recipes(catalog(s, d))[0], "",
    _C + """ SELECT item || ':CRAFT:0' AS recipe_id, item AS output_item_id, 'CRAFT' AS process_type, 0::BIGINT AS process_duration_seconds FROM c WHERE p_partkey % 3 = 0
  UNION ALL SELECT item || ':FORGE:0', item, 'FORGE', p_size FROM c WHERE p_partkey % 4 = 0 UNION ALL SELECT item || ':KATGRADE:0', 'BETTER_PET', 'KATGRADE', p_size * 10 FROM c WHERE p_partkey % 8 = 0""")
q("o029_npc_offers", lambda s, d: S.npc_offers(catalog(s, d)), "",
    _C + " SELECT item AS item_id, 'GEM' AS result_id, 2 AS amount, nullif(p_size, 0)::BIGINT AS coin_cost, p_size / 2e0 AS unit_cost "
    "FROM c WHERE p_partkey % 4 = 0")


def _snapshots(s, d):
    to = shared_folder(s)
    S.write_snapshots(A.quote_grid(s, d).select("snapshot_ts", "product_id", "buy_price"), to)
    return s.read.parquet(to)


q("o005_write_snapshots",
    lambda s, d: _snapshots(s, d).select("snapshot_ts", "product_id", "buy_price", F.col("day").cast("long").alias("day")), "quote_grid",
    f"SELECT snapshot_ts, product_id, buy_price, snapshot_ts // {DAY_MS} AS day FROM quote_grid")
q("o165_partition_inventory", lambda s, d: S.partition_inventory(_snapshots(s, d)).select(F.col("day").cast("long").alias("day"), "rows"),
    "quote_grid", f"SELECT snapshot_ts // {DAY_MS} AS day, count(*) AS rows FROM quote_grid GROUP BY 1")


def _rerun(s, d):
    """A rollup written twice, the second time with only the later days: the result is one rollup."""
    to = shared_folder(s)
    r = R.bucket_rollup_quotes(A.quote_ticks(s, d), P).select("bucket_start", "product_id", "median_mid", F.lit("1d").alias("granularity"))
    S.overwrite_buckets(r, to)
    S.overwrite_buckets(r.filter(F.col("bucket_start") >= T), to)
    return s.read.parquet(to).select("bucket_start", "product_id", "median_mid")


ORACLES["o009_overwrite_buckets"] = f"SELECT bucket_start, product_id, median_mid FROM ({ROLLUP_SQL})"
QUERIES["o009_overwrite_buckets"] = _rerun
q("o006_parse_snapshot_json",
    lambda s, d: S.parse_snapshot_json(A.quote_grid(s,
    d).groupBy("snapshot_ts").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("product_id",
    F.struct(F.col("buy_price").alias("buyPrice"), F.col("sell_price").alias("sellPrice")))))).alias("products_json"))), "quote_grid",
    "SELECT snapshot_ts, product_id, buy_price, sell_price FROM quote_grid")
q("o011_read_history", lambda s, d: S.read_history(A.request_log(s,
    d).select(F.when(F.col("ts") % 7 == 0, "oops").otherwise(F.to_json(F.struct("ts", "route", "duration_ms"))).alias("value")),
    "ts long, route string, duration_ms double", 100), "request_log",
    "SELECT ts, route, duration_ms FROM request_log WHERE ts % 7 <> 0 ORDER BY ts DESC, route, duration_ms LIMIT 100")


def _fingerprint(s, d):
    """Of a catalogue with one file a part."""
    return S.catalog_fingerprint(A.table(s, d, "part").select(F.concat(F.lit("part_"), "p_partkey").alias("name"),
        F.concat_ws("|", "p_name", "p_brand", "p_type", "p_size").alias("content")))


q("o013_catalog_fingerprint", _fingerprint, "",
    """WITH e AS (SELECT sha256('part_' || p_partkey || ':' || sha256(concat_ws('|', p_name, p_brand, p_type, p_size))) AS h FROM part),
  g AS (SELECT substr(h, 1, 3) AS g, sha256(string_agg(h, chr(10) ORDER BY h)) AS h, count(*) AS n FROM e GROUP BY 1)
  SELECT sha256(string_agg(g || ':' || h, chr(10) ORDER BY g)) AS fingerprint, sum(n)::BIGINT AS files FROM g""")
# trends and retention
_H = """WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY flip_key ORDER BY snapshot_ts) AS rn FROM opportunity_history),
  f AS (SELECT flip_key, rn, snapshot_ts AS vf, snapshot_ts AS vt, profit AS bp, roi_per_hour AS br, liquidity_score AS bl, risk_score AS bk, partial AS ba FROM h WHERE rn = 1
    UNION ALL SELECT flip_key, rn, CASE WHEN c THEN vf ELSE ts END, ts, CASE WHEN c THEN bp ELSE p END, CASE WHEN c THEN br ELSE r END, CASE WHEN c THEN bl ELSE l END, CASE WHEN c THEN bk ELSE k END, CASE WHEN c THEN ba ELSE a END
    FROM (SELECT f.*  EXCLUDE (rn), h.rn, h.snapshot_ts AS ts, h.profit AS p, h.roi_per_hour AS r, h.liquidity_score AS l, h.risk_score AS k, h.partial AS a,
      h.partial = ba AND abs(h.profit - bp) <= 0.05 * abs(bp) AND abs(h.roi_per_hour - br) <= 0.05 * abs(br) AND abs(h.liquidity_score - bl) <= 3 AND abs(h.risk_score - bk) <= 3 AS c FROM f JOIN h ON h.flip_key = f.flip_key AND h.rn = f.rn + 1))
  SELECT flip_key, vf AS valid_from, max(vt) AS valid_to, count(*)::INT AS points, any_value(bp) AS profit FROM f GROUP BY flip_key, vf"""
QUERIES["o104_trend_segments"] = lambda s, d: M.trend_segments(A.opportunity_history(s, d))
ORACLES["o104_trend_segments"] = sql("opportunity_history", _H.replace("WITH RECURSIVE", "WITH", 1)).replace("WITH ", "WITH RECURSIVE ", 1)
_old = lambda s, d: A.opportunity_history(s, d).filter(F.col("snapshot_ts") < T)
q("o105_monotonic_guard", lambda s, d: M.monotonic_guard(A.opportunity_history(s, d).select("flip_key", "snapshot_ts"), _old(s, d)),
    "opportunity_history", f"SELECT flip_key, snapshot_ts FROM opportunity_history h WHERE snapshot_ts > coalesce((SELECT "
    f"max(snapshot_ts) FROM opportunity_history o WHERE o.flip_key = h.flip_key AND o.snapshot_ts < {T}), -1)")
_points = lambda df: df.select("flip_key", F.struct(*M.POINT).alias("base"), F.col("snapshot_ts").alias("valid_to"),
    F.lit(1).alias("n"))


def _backfill(s, d):
    """The history up to T as stored segments, and every later day of it in one job."""
    h = A.opportunity_history(s, d)
    stored = M.segment_table(h.filter(F.col("snapshot_ts") <= T))
    return M.backfill_segments(h.filter(F.col("snapshot_ts") > T), stored).select("flip_key", F.col("base.snapshot_ts").alias("valid_from"),
        "valid_to", F.col("n").cast("int").alias("points"), F.col("base.profit").alias("profit"))


q("o166_backfill", _backfill, "", None)
ORACLES["o166_backfill"] = ORACLES["o104_trend_segments"]


def _stored(s, d):
    o = A.opportunities(s, d).withColumn("flip_key", F.col("result_item_id"))
    mid = 915_148_800_000
    cur = M.first_per_key(o.filter(F.col("snapshot_ts") < mid), ["flip_key"], [F.desc("snapshot_ts"), "stable_id"]).select("flip_key",
        "stable_id", "snapshot_ts", "expected_profit")
    seg = _points(cur.select("flip_key", "snapshot_ts", F.col("expected_profit").alias("profit"),
        *[F.lit(None).cast("double").alias(c) for c in ("roi_per_hour", "liquidity_score", "risk_score")], F.lit(False).alias("partial")))
    stored = M.store_opportunities(o.filter(F.col("snapshot_ts") >= mid), cur.select("flip_key"), cur, seg)
    none = F.lit(None).cast("string")
    rows = stored["current"].select(F.lit("current").alias("part"), "flip_key", "stable_id", "snapshot_ts",
        F.col("expected_profit").alias("value"))
    rows = rows.union(stored["definition"].select(F.lit("definition"), "flip_key", none, F.lit(None).cast("long"),
        F.lit(None).cast("long")))
    return rows.union(stored["segments"].select(F.lit("segment"), "flip_key", none, "valid_to", F.col("n").cast("long")))


q("o167_store_opportunities", _stored, "opportunities",
    """WITH o AS (SELECT * EXCLUDE (flip_key), result_item_id AS flip_key FROM opportunities), c AS (SELECT *, row_number() OVER (PARTITION BY flip_key ORDER BY snapshot_ts DESC, stable_id) AS rn FROM o WHERE snapshot_ts < 915148800000),
  n AS (SELECT *, row_number() OVER (PARTITION BY flip_key ORDER BY snapshot_ts, stable_id) AS rn FROM o WHERE snapshot_ts >= 915148800000),
  n1 AS (SELECT * FROM n WHERE rn = 1), c1 AS (SELECT * FROM c WHERE rn = 1),
  j AS (SELECT c1.flip_key AS ck, c1.snapshot_ts AS ct, n1.flip_key AS nk, n1.snapshot_ts AS nt, coalesce(NOT n1.partial AND n1.roi_per_hour IS NULL AND n1.liquidity_score IS NULL AND n1.risk_score IS NULL
    AND ((c1.expected_profit IS NULL AND n1.expected_profit IS NULL) OR coalesce(abs(c1.expected_profit - n1.expected_profit) <= 0.05 * abs(c1.expected_profit), false)), false) AS ok FROM c1 FULL JOIN n1 ON c1.flip_key = n1.flip_key)
  SELECT 'current' AS part, flip_key, stable_id, snapshot_ts, expected_profit AS value FROM n1 UNION ALL SELECT 'current', flip_key, stable_id, snapshot_ts, expected_profit FROM c1 WHERE flip_key NOT IN (SELECT flip_key FROM n)
  UNION ALL SELECT 'definition', coalesce(ck, nk), NULL, NULL, NULL FROM j
  UNION ALL SELECT 'segment', ck, NULL, CASE WHEN ok THEN nt ELSE ct END, CASE WHEN ok THEN 2 ELSE 1 END FROM j WHERE ck IS NOT NULL UNION ALL SELECT 'segment', nk, NULL, nt, 1 FROM j WHERE nk IS NOT NULL AND NOT ok""")
_snaps = lambda s, d: A.quote_ticks(s, d).select("snapshot_ts",
    F.concat_ws("-", "snapshot_ts", "product_id").alias("snapshot_id"))
_TIER = f"""WITH t AS (SELECT snapshot_ts, snapshot_ts || '-' || product_id AS snapshot_id, {T} - snapshot_ts AS age FROM quote_ticks),
  u AS (SELECT *, CASE WHEN age < 90000 THEN 0 WHEN age <= 1800000 THEN 1 WHEN age <= 43200000 THEN 2 ELSE 3 END AS tier FROM t),
  v AS (SELECT *, CASE tier WHEN 0 THEN snapshot_ts WHEN 1 THEN snapshot_ts // 60000 * 60000 WHEN 2 THEN snapshot_ts // 7200000 * 7200000 ELSE snapshot_ts // {DAY_MS} * {DAY_MS} END AS slot FROM u),
  k AS (SELECT *, tier = 0 OR row_number() OVER (PARTITION BY tier, slot ORDER BY snapshot_ts, snapshot_id) = 1 AS keep FROM v)"""
q("o107_retention_keepers", lambda s, d: M.retention_keepers(_snaps(s, d), T), "quote_ticks",
    _TIER + " SELECT snapshot_ts, snapshot_id, tier, slot, keep FROM k")


def _compacted(s, d):
    """Both tables after a compaction that stops before the switch, one that does not, a later one, and the removal of what no version names."""
    to, schema = shared_folder(s), "snapshot_ts long, snapshot_id string"
    snaps = _snaps(s, d)
    C.append(snaps.filter(F.col("snapshot_ts") >= T - DAY_MS), to)
    C.append(snaps.filter(F.col("snapshot_ts") < T - DAY_MS), to, "retained")
    C.compact(s, to, schema, T, switch=False)
    before = [C.read_table(s, to, t, schema).count() for t in C.TABLES]
    C.compact(s, to, schema, T)
    C.compact(s, to, schema, T)
    C.vacuum(s, to)
    tables = [C.read_table(s, to, t, schema).withColumns({"table": F.lit(t), "before": F.lit(n).cast("long")}) for t, n in zip(C.TABLES, before)]
    return tables[0].unionByName(tables[1])


q("o159_compact_snapshots", _compacted, "quote_ticks",
    _TIER + f""" SELECT snapshot_ts, snapshot_id, CASE WHEN tier = 0 THEN 'raw' ELSE 'retained' END AS "table",
    (CASE WHEN tier = 0 THEN (SELECT count(*) FROM t WHERE snapshot_ts >= {T - DAY_MS}) ELSE (SELECT count(*) FROM t WHERE snapshot_ts < {T - DAY_MS}) END) AS before FROM k WHERE keep""")
_day = T // DAY_MS
_parts = lambda s, d: A.quote_ticks(s, d).groupBy(F.lit("quotes").alias("table"),
    F.floor(F.col("snapshot_ts") / DAY_MS).alias("day")).agg(F.count("*").alias("rows"))
q("o160_retention_plan", lambda s, d: M.retention_plan(_parts(s, d),
    _parts(s, d).select("table", "day", (F.col("day") % 3 != 0).alias("archived")), _day + 10, 7), "quote_ticks",
    f"""SELECT 'quotes' AS "table", day, rows, CASE WHEN day < {_day + 4} AND day % 3 <> 0 THEN 'drop' ELSE 'keep' END AS action, CASE WHEN day >= {_day + 4} THEN 'WITHIN_RETENTION' WHEN day % 3 = 0 THEN 'NOT_ARCHIVED' ELSE 'OK' END AS reason
  FROM (SELECT snapshot_ts // {DAY_MS} AS day, count(*) AS rows FROM quote_ticks GROUP BY 1)""")


q("o162_archive_days", lambda s, d: M.archive_days(A.quote_grid(s, d)), "quote_grid",
    f"SELECT snapshot_ts // {DAY_MS} AS day, min(snapshot_ts) AS snapshot_ts, count(DISTINCT snapshot_ts) AS snapshots FROM quote_grid "
    f"GROUP BY 1")
q("o163_drop_older", lambda s, d: M.drop_older(A.quote_grid(s, d), T).select("snapshot_ts", "product_id"), "quote_grid",
    f"SELECT snapshot_ts, product_id FROM quote_grid WHERE snapshot_ts >= {T}")
q("o164_orphan_counts", lambda s, d: M.orphan_counts(QV.legs(s, d).filter("opp_id LIKE '%7'"), QV.legs(s, d),
    QV.V.constraints_of(QV.legs(s, d))), QV.IN,
    QV.LEGS + """, o AS (SELECT DISTINCT opp_id, flip_type FROM legs WHERE opp_id LIKE '%7') SELECT 'opportunities' AS what, count(*) AS n FROM o UNION ALL SELECT 'legs', count(*) FROM legs WHERE opp_id LIKE '%7'
  UNION ALL SELECT 'constraints', sum(CASE WHEN flip_type = 'FORGE' THEN 2 ELSE 1 END)::BIGINT FROM o WHERE opp_id LIKE 'RC:%'""")
q("o155_late_rows", lambda s, d: R.late_rows(A.quote_ticks(s, d),
    s.range(1).select(F.explode(F.array(F.lit(T), F.lit(T + DAY_MS))).alias("bucket_start"), F.lit(True).alias("finalized")),
    P).groupBy("bucket_start").count(), "quote_ticks",
    f"SELECT snapshot_ts // {DAY_MS} * {DAY_MS} AS bucket_start, count(*) AS count FROM quote_ticks WHERE "
    f"snapshot_ts >= {T} AND snapshot_ts < {T + 2 * DAY_MS} GROUP BY 1")
q("o046_micro_window", lambda s, d: X.scan_range(A.quote_ticks(s, d), T - 3_600_000, T + 1).select("snapshot_ts", "product_id"),
    "quote_ticks", f"SELECT snapshot_ts, product_id FROM quote_ticks WHERE snapshot_ts BETWEEN {T - 3_600_000} AND {T}")
