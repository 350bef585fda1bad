"""Market inputs derived from the driver's tables (FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import bucket_start, epoch_day

LISTING_TS = 896_659_200_000  # 1998-06-01
SLOT_MS = 21_600_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ms(col: str):
    """Epoch milliseconds of a time without zone, read as UTC."""
    return F.unix_millis(F.to_utc_timestamp(F.col(col).cast("timestamp"), F.current_timezone()))


def quote_ticks(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").select(ms("ts").alias("snapshot_ts"), F.concat(F.lit("P"), F.col("user_id") % 20).alias("product_id"),
        k.alias("k"), (F.col("value") + 1.0).alias("buy_price"), "event_id")
    return e.select("snapshot_ts", "product_id", "buy_price",
        (F.col("buy_price") * (F.lit(0.9) + (F.col("k") % 20) / F.lit(100.0))).alias("sell_price"),
        (F.col("k") * 100).cast("long").alias("buy_volume"), ((F.col("event_id") % 97) * 50).alias("sell_volume"), "k")


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Full quote records: ticks with moving weeks and order counts."""
    t = quote_ticks(spark, d)
    return t.withColumns({"buy_moving_week": F.col("buy_volume") * 168, "sell_moving_week": F.col("sell_volume") * 168,
        "buy_orders": F.col("k") % 10, "sell_orders": F.col("k") % 10})


def quote_grid(spark: SparkSession, d: str, slot_ms: int = SLOT_MS) -> DataFrame:
    """The last quote of each product in each slot, at the slot's start."""
    t = quotes(spark, d).withColumn("slot", bucket_start("snapshot_ts", slot_ms))
    rest = [c for c in t.columns if c not in ("slot", "product_id", "snapshot_ts")]
    g = t.groupBy("slot", "product_id").agg(F.max_by(F.struct(*rest), "snapshot_ts").alias("r"))
    return g.select(F.col("slot").alias("snapshot_ts"), "product_id", "r.*")


def listings(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    j = li.join(p, li.l_partkey == p.p_partkey)
    n = F.col("l_linenumber")
    uuid = F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") * 100)))
    lore = F.when(n % 5 == 1, "§7Plain item").when(n % 5 == 2, "§6RARITY UPGRADED ✪").when(n % 5 == 3,
        "§9Sharpness V\nmodifier: sharp").when(n % 5 == 4, "Combat Slot and RUBY Gemstone")
    tag = F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    extra = F.when(n % 4 == 1, F.concat(F.lit('{"id":"'), tag, F.lit('"}'))).when(n % 4 == 2,
        F.concat(F.lit('{\\"id\\":\\"'), tag, F.lit('\\"}'))).when(n % 4 == 3,
        F.concat(F.lit('{"id":"'), tag, F.lit('","modifier":"odd"}')))
    bin_ = F.col("l_returnflag") != "A"
    return j.select(
        F.lit(LISTING_TS).cast("long").alias("snapshot_ts"), uuid.alias("auction_uuid"),
            F.concat("p_name", F.when(n % 7 == 0, " ✪✪").otherwise("")).alias("item_name"),
        F.col("p_type").alias("category"), F.concat(F.lit("T"), F.col("p_size") % 3).alias("tier"),
            F.floor("l_extendedprice").alias("starting_bid"),
        F.when(~bin_, F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")))).otherwise(0).cast("long").alias("highest_bid"),
        F.lit(LISTING_TS - 86_400_000).cast("long").alias("start_ts"), ms("l_shipdate").alias("end_ts"),
            (F.col("l_linestatus") == "F").alias("claimed"), bin_.alias("bin"), lore.alias("item_lore"), extra.alias("extra"),
    )


def listing_points(spark: SparkSession, d: str) -> DataFrame:
    """Listing aggregates over time, from events: prices in bins by hour, as D8 rows."""
    v = F.col("buy_price")
    return quote_ticks(spark, d).select(
        "snapshot_ts", F.col("product_id").alias("item_key"), F.floor(v).alias("bin_lowest"),
            F.when(F.col("k") % 11 != 0, F.floor(v * 1.05)).alias("bin_lowest5_mean"),
        F.when(F.col("k") % 7 != 0, F.floor(v * 1.1)).alias("bin_p50"), F.floor(v * 1.5).alias("bin_p95"),
            F.when(F.col("k") % 3 != 0, F.floor(v * 0.8)).alias("bid_p50"),
        (F.col("k") + 1).alias("bin_count"), (F.col("k") % 4).alias("ending_soon_count"),
    )


def auction_snapshots(spark: SparkSession, d: str, slot_ms: int = SLOT_MS) -> DataFrame:
    """Auctions over time, one an event, at the snapshots of `quote_grid`; named as a part, on which nobody has bid where k is even."""
    p = table(spark, d, "part")
    n = p.agg(F.count("*").alias("n_parts"))
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").crossJoin(F.broadcast(n)).withColumns({"k": k, "part": F.col("event_id") % F.col("n_parts")})  # one row
    return e.join(p.hint("merge"), e.part == p.p_partkey).select(  # a broadcast takes many times the parts' bytes on disk
        bucket_start(ms("ts"), slot_ms).alias("snapshot_ts"), F.concat(F.lit("a"), "event_id").alias("auction_uuid"),
        F.concat("p_name", F.when(F.col("k") % 7 == 0, " ✪✪").otherwise("")).alias("item_name"), (F.floor(F.col("value") * 10) + 1).alias("starting_bid"),
        F.when(F.col("k") % 2 == 1, F.floor(F.col("value") * 12) + 1).otherwise(0).cast("long").alias("highest_bid"),
    )


def items(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("P"), "p_partkey").alias("item_id"), F.upper("p_name").alias("display_name"),
        F.concat(F.lit("mc:"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("minecraft_id"), F.col("p_brand").alias("rarity"),
        F.col("p_type").alias("category"))


def recipes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "CRAFT").when(F.col("p_size") % 3 == 1, "FORGE").otherwise("KATGRADE")
    return p.select(F.concat(F.lit("R"), "p_partkey").alias("recipe_id"), F.concat(F.lit("P"), "p_partkey").alias("output_item_id"),
        kind.alias("process_type"), (F.col("p_size") * 60).cast("long").alias("process_duration_seconds"))


def ingredients(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    n = p.agg(F.count("*").alias("n_parts"))
    e = p.crossJoin(F.broadcast(n)).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return e.select(F.concat(F.lit("R"), "p_partkey").alias("recipe_id"),
        F.concat(F.lit("P"), (F.col("p_partkey") * 7 + F.col("i") * 13) % F.col("n_parts")).alias("item_id"),
        (1 + (F.col("p_size") + F.col("i")) % 4).cast("int").alias("amount"))


def part_quotes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    q = lambda f: F.coalesce(F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))), F.lit(0.0)).cast("long")
    g = li.groupBy("l_partkey").agg(F.percentile(F.col("l_extendedprice") / F.col("l_quantity"), F.lit(0.5)).alias("buy_price"),
        q("A").alias("buy_volume"), q("N").alias("sell_volume"))
    return g.select(
        F.concat(F.lit("P"), "l_partkey").alias("product_id"), "buy_price",
            (F.col("buy_price") * (F.lit(0.95) + (F.col("l_partkey") % 10) / F.lit(50.0))).alias("sell_price"),
        "buy_volume", "sell_volume", (F.col("buy_volume") * 168).alias("buy_moving_week"),
            (F.col("sell_volume") * 168).alias("sell_moving_week"),
    )


def opportunities(spark: SparkSession, d: str) -> DataFrame:
    """Valued opportunities in the shape of A8, from orders."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("AUCTION", "BAZAAR", "CRAFTING", "FORGE", "FUSION", "KATGRADE"))), (k % 5 + 1).cast("int"))
    profit = F.floor("o_totalprice") - 100_000
    return o.select(
        F.concat(F.lit("o"), k).alias("stable_id"), F.concat(F.lit("k"), k).alias("flip_key"), kind.alias("flip_type"),
            ms("o_orderdate").alias("snapshot_ts"), F.concat(F.lit("P"), k % 500).alias("result_item_id"),
        F.when(k % 13 != 0, F.col("o_custkey") * 1000 + 1000).alias("required_capital"),
            F.when(k % 17 != 0, profit).alias("expected_profit"),
            F.when(k % 19 != 0, profit / (F.col("o_custkey") * 1000.0 + 1000.0)).alias("roi"),
        F.when(k % 19 != 0, profit / (F.col("o_custkey") * 1000.0 + 1000.0) / (1 + k % 24)).alias("roi_per_hour"),
            ((1 + k % 24) * 3600).alias("duration_seconds"), F.floor(F.col("o_totalprice") * 0.0125).alias("fees"),
        F.when(k % 23 != 0, (k % 101).cast("double")).alias("liquidity_score"),
            F.when(k % 29 != 0, ((k * 7) % 101).cast("double")).alias("risk_score"), (k % 4 == 0).alias("partial"),
        F.when(k % 4 != 0, F.array().cast("array<string>")).when(k % 8 == 0, F.array(F.lit("MISSING_ELECTION_DATA"))).when(k % 12 == 0,
            F.array(F.lit("MISSING_INPUT_PRICE:P1"),
            F.lit("ZERO_TURNOVER"))).otherwise(F.array(F.lit("INSUFFICIENT_OUTPUT_DEPTH"))).alias("partial_reasons"),
    )


def opportunity_history(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("day", epoch_day(ms("ts")))
    g = e.groupBy("user_id", "day").agg(F.floor(F.sum(F.round(F.col("value") * 100).cast("long")) / 100).alias("profit"),
        F.avg("k").alias("s"), F.count("*").alias("n"))
    return g.select(F.concat(F.lit("U"), "user_id").alias("flip_key"), (F.col("day") * 86_400_000).alias("snapshot_ts"), "profit",
        (F.col("profit") / 1000.0).alias("roi_per_hour"), F.col("s").alias("liquidity_score"), F.col("s").alias("risk_score"),
        (F.col("n") % 2 == 0).alias("partial"))


def request_log(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(ms("ts").alias("ts"), F.col("event_type").alias("route"),
        F.when(F.col("user_id") % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.when(k % 5 == 0, "500").otherwise("200").alias("status"), F.when(k % 5 == 0, "ERROR").otherwise("OK").alias("outcome"),
        F.col("value").alias("duration_ms"))


def payload_updates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.when(F.col("user_id") % 2 == 0, "quotes").otherwise("listings").alias("feed"), ms("ts").alias("last_updated"),
        F.md5("props").alias("hash"), F.col("event_id").alias("payload_id"))


def item_listing_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Listing quotes of all parts: the priced BIN listings of an item in one row."""
    from ..operators.snapshots import price_stats

    li = table(spark, d, "lineitem").filter("l_returnflag <> 'A'")
    return price_stats(li.select(F.concat(F.lit("P"), "l_partkey").alias("item_id"), F.floor("l_extendedprice").alias("starting_bid")),
        ["item_id"])
