"""Features of several time scales, price history and market overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import DAY_MS, bucket_start, clamp, epoch_day, finite, positive, rel_spread, round2, round_half_up
from .keys import match_items
from .snapshots import latest, nearest, scan_range

HISTORY_RANGES = {"24h": (DAY_MS, 3_600_000), "7d": (7 * DAY_MS, 21_600_000), "30d": (30 * DAY_MS, DAY_MS), "90d": (90 * DAY_MS, DAY_MS)}
CONFIDENCE = {"LOW": 0.0, "MED": 0.5, "HIGH": 1.0}


def _mids(df: DataFrame) -> DataFrame:
    buy, sell = positive("buy_price"), positive("sell_price")
    return df.withColumn("mid", (buy + sell) / 2.0).filter("mid IS NOT NULL")


def micro_volatility(ticks: DataFrame, t: int, window_ms: int = 60_000, cap: float = 0.20, by: str = "product_id") -> DataFrame:
    """(key, micro_points, micro_returns, micro_volatility): population deviation of capped log returns inside [t - window, t]."""
    own = _mids(scan_range(ticks, t - window_ms, t + 1))
    r = own.withColumn("r", clamp(F.log(F.col("mid") / F.lag("mid").over(Window.partitionBy(by).orderBy("snapshot_ts"))), -cap, cap))
    vol = F.when(F.count("r") >= 2, F.stddev_pop("r"))
    # clamp() ignores nulls, so the first row of a key is taken out by its missing predecessor
    r = r.withColumn("r", F.when(F.row_number().over(Window.partitionBy(by).orderBy("snapshot_ts")) > 1, F.col("r")))
    return r.groupBy(by).agg(F.count("*").alias("micro_points"), F.count("r").alias("micro_returns"), vol.alias("micro_volatility"))


def micro_return(ticks: DataFrame, t: int, window_ms: int = 60_000, by: str = "product_id") -> DataFrame:
    """ln(last mid / mid nearest to the window's start), where that point is earlier than the last."""
    own = _mids(scan_range(ticks, t - window_ms, t + 1)).select(by, "snapshot_ts", "mid")
    last = own.groupBy(by).agg(F.max("snapshot_ts").alias("last_ts"), F.max_by("mid", "snapshot_ts").alias("last_mid"))
    near = nearest(own, by, t - window_ms).withColumnRenamed("mid", "from_mid")
    return last.join(near, by).select(by,
        F.when(F.col("snapshot_ts") < F.col("last_ts"), F.log(F.col("last_mid") / F.col("from_mid"))).alias("micro_return"))


def daily_series(ticks: DataFrame, t: int, days: int = 32, by: str = "product_id") -> DataFrame:
    """(key, day, mid, spread, turnover, ret): rows at the first snapshot of each day; returns only between days next to each other."""
    own = scan_range(ticks, (t // DAY_MS - days) * DAY_MS, t + 1)
    firsts = own.groupBy(epoch_day("snapshot_ts").alias("day")).agg(F.min("snapshot_ts").alias("snapshot_ts"))
    a = _mids(own.join(F.broadcast(firsts), "snapshot_ts"))
    a = a.withColumns({"spread": rel_spread("buy_price", "sell_price"), "turnover": hourly_turnover()})
    w = Window.partitionBy(by).orderBy("day")
    ret = F.when(F.col("day") - F.lag("day").over(w) == 1, F.log(F.col("mid") / F.lag("mid").over(w)))
    return a.select(by, "day", "mid", "spread", "turnover").withColumn("ret", ret)


def macro_volatility(daily: DataFrame, n: int = 30, by: str = "product_id") -> DataFrame:
    r = daily.filter("ret IS NOT NULL").withColumn("rn",
        F.row_number().over(Window.partitionBy(by).orderBy(F.desc("day")))).filter(F.col("rn") <= n)
    return r.groupBy(by).agg(F.count("*").alias("macro_returns"), F.when(F.count("*") >= 2, F.stddev_pop("ret")).alias("macro_volatility"))


def macro_return(daily: DataFrame, t: int, by: str = "product_id") -> DataFrame:
    """The return that ends on the evaluation day, else that of the last pair where its days are adjacent."""
    return daily.groupBy(by).agg(F.coalesce(F.max(F.when(F.col("day") == t // DAY_MS, F.col("ret"))),
        F.max_by("ret", "day")).alias("macro_return"), F.count("*").alias("macro_days"))


def confidence(points: Column, signals: Column, high: int, medium: int, all_signals: int) -> Column:
    return F.when((points >= high) & (signals >= all_signals), "HIGH").when((points >= medium) & (signals >= 1), "MED").otherwise("LOW")


def hourly_turnover() -> Column:
    """The smaller side's weekly volume an hour, the moving week first."""
    side = lambda week, vol: F.coalesce(F.when(F.col(week) > 0, F.col(week)), F.col(vol), F.lit(0))
    return F.least(side("buy_moving_week", "buy_volume"), side("sell_moving_week", "sell_volume")) / 168.0


def structurally_illiquid(newest: DataFrame, daily: DataFrame, spread: float = 0.05, turnover: float = 10.0,
    by: str = "product_id") -> DataFrame:
    """Wide and thin now; else, with three days or more, wide or thin in the median of the last seven."""
    now = newest.select(by, (rel_spread("buy_price", "sell_price") >= spread).alias("wide"), (hourly_turnover() <= turnover).alias("thin"))
    last = daily.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("day")))).filter("rn <= 7")
    med = last.groupBy(by).agg(F.count("*").alias("n"), F.percentile("spread", F.lit(0.5)).alias("s"),
        F.percentile("turnover", F.lit(0.5)).alias("v"))
    past = (F.col("n") >= 3) & ((F.col("s") >= spread) | (F.col("v") <= turnover))
    return now.join(med, by, "left").select(by, ((F.col("wide") & F.col("thin")) | F.coalesce(past, F.lit(False))).alias("illiquid"))


def timescale_features(ticks: DataFrame, t: int, window_ms: int = 60_000, by: str = "product_id") -> DataFrame:
    """Micro and macro volatility, return and confidence, and the illiquid flag of every key known at t."""
    newest = ticks.filter(F.col("snapshot_ts") <= t).withColumn("rn",
        F.row_number().over(Window.partitionBy(by).orderBy(F.desc("snapshot_ts")))).filter("rn = 1").drop("rn")
    daily = daily_series(ticks, t, by=by)
    j = newest.select(by)
    for part in (micro_volatility(ticks, t, window_ms, by=by), micro_return(ticks, t, window_ms, by), macro_volatility(daily, by=by),
        macro_return(daily, t, by), structurally_illiquid(newest, daily, by=by)):
        j = j.join(part, by, "left")
    have = lambda *c: sum(F.col(x).isNotNull().cast("int") for x in c)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select(
        by, "micro_volatility", "micro_return",
            confidence(zero("micro_points"), have("micro_volatility", "micro_return"), 10, 6, 2).alias("micro_confidence"),
        "macro_volatility", "macro_return",
            confidence(zero("macro_returns"), have("macro_volatility", "macro_return"), 7, 3, 1).alias("macro_confidence"),
            F.coalesce("illiquid", F.lit(False)).alias("illiquid"),
    )


def price_history(quotes: DataFrame, t: int, range_name: str = "7d", auctions: DataFrame | None = None,
    aliases: DataFrame | None = None) -> DataFrame:
    """(item_id, bucket, buy_price, sell_price, volume) from the last snapshot of each bucket of the range that ends at t.

    An item with a quote in that snapshot has its rounded prices and buy volume. Without one, it has the auctions whose name
    contains one of its aliases: the least starting bid, the mean of the highest bids (the starting bid where there is none) in
    whole units, and their number. An item with neither has no point. Auctions are summed by name before names meet items.
    """
    return price_histories(quotes, t, [range_name], auctions, aliases).drop("range")


def price_histories(quotes: DataFrame, t: int, range_names: list[str], auctions: DataFrame | None = None,
    aliases: DataFrame | None = None) -> DataFrame:
    """The price histories of several ranges with the range's name, in one plan: feeds are read and names meet items once."""
    spans = [(r, t - HISTORY_RANGES[r][0], HISTORY_RANGES[r][1]) for r in range_names]
    since = min(start for _, start, _ in spans)
    own = scan_range(quotes, since, t + 1)
    seen = own.select("snapshot_ts")
    if auctions is not None:
        auctions = scan_range(auctions, since, t + 1)
        seen = seen.union(auctions.select("snapshot_ts"))
    buckets = F.array_compact(F.array(*[F.when(F.col("snapshot_ts") >= start, F.struct(F.lit(r).alias("range"),
        bucket_start("snapshot_ts", width).alias("bucket"))) for r, start, width in spans]))
    last = F.broadcast(seen.select("snapshot_ts", F.inline(buckets)).groupBy("range", "bucket").agg(
        F.max("snapshot_ts").alias("snapshot_ts")))  # at most 91 buckets a range
    price = lambda c: F.coalesce(round_half_up(finite(c)), F.when(F.col(c).isNotNull(), 0)).cast("long").alias(c)
    points = own.join(last, "snapshot_ts").select("range", F.upper(F.trim("product_id")).alias("item_id"), "bucket", price("buy_price"),
        price("sell_price"), F.col("buy_volume").cast("long").alias("volume"))
    if auctions is not None:
        value = F.when(F.col("highest_bid") > 0, F.col("highest_bid")).otherwise(F.col("starting_bid"))
        named = auctions.join(last, "snapshot_ts").groupBy("range", "bucket", "item_name").agg(F.min("starting_bid").alias("low"),
            F.sum(value).alias("sum"), F.count("*").alias("n"))
        # dealt by item before buckets multiply the pairs, so that these are summed where they arise; in as many parts as the rows need
        parts = int(quotes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        matched = match_items(named, aliases).select("item_name", F.upper(F.trim("item_id")).alias("item_id")).repartition(parts, "item_id")
        met = named.join(matched, "item_name").groupBy("range", "item_id", "bucket").agg(
            F.min("low").alias("low"), F.sum("sum").alias("sum"), F.sum("n").alias("n"))
        rest = met.join(points.select("range", "item_id", "bucket"), ["range", "item_id", "bucket"], "left_anti")
        points = points.unionByName(rest.select("range", "item_id", "bucket", F.col("low").alias("buy_price"), F.floor(F.col("sum") / F.col(
            "n")).cast("long").alias("sell_price"), F.col("n").alias("volume")))
    return points.filter("buy_price IS NOT NULL OR sell_price IS NOT NULL")


def score_history(history: DataFrame) -> DataFrame:
    """(item_id, bucket, liquidity, volatility, risk) of a history of 30 days.

    Liquidity against the item's largest volume; the spread over the buy price, 0 where one is missing; volatility against the
    sell price of the point before, else the spread; risk of twice the spread and three times the volatility.
    """
    w = Window.partitionBy("item_id")
    top = F.max(F.when(F.col("volume") > 0, F.col("volume"))).over(w)
    before = F.lag("sell_price").over(w.orderBy("bucket"))
    buy, sell = F.col("buy_price"), F.col("sell_price")
    spread = F.coalesce(F.when(buy > 0, F.abs(buy - sell) * 100.0 / buy), F.lit(0.0))
    h = history.withColumns({"liquidity": F.coalesce(clamp(F.col("volume") * 100.0 / top, 0, 100), F.lit(0.0)), "spread_pct": spread,
        "volatility": F.coalesce(F.when(before > 0, F.abs(sell - before) * 100.0 / before), spread)})
    return h.select("item_id", "bucket", round2("liquidity").alias("liquidity"), round2("volatility").alias("volatility"),
        round2(clamp(2 * F.col("spread_pct") + 3 * F.col("volatility"), 0, 100)).alias("risk"))


def quick_stats(day: DataFrame, week: DataFrame, month: DataFrame) -> DataFrame:
    """Of the histories of 24 hours, 7 and 30 days: the latest point with its spread, changes over a day, and the week's mean volume, high and low."""
    named = [h.withColumn("range", F.lit(r)) for h, r in ((day, "24h"), (week, "7d"), (month, "30d"))]
    return quick_stats_of(named[0].unionByName(named[1]).unionByName(named[2]))


def quick_stats_of(histories: DataFrame) -> DataFrame:
    """`quick_stats` of rows that name their range: each item of the month is one group of them all.

    The change is in percent from the first to the last point, for two points or more whose first price is above zero. Rows of a
    day or week without an item belong to none.
    """
    own = lambda r, c: F.when(F.col("range") == r, F.col(c))
    at = {r: own(r, "bucket") for r in ("24h", "30d")}
    positive_of = lambda c: F.when((F.col("range") == "7d") & (F.col(c) > 0), F.col(c))
    g = histories.filter("item_id IS NOT NULL OR range = '30d'").groupBy("item_id").agg(F.count(at["30d"]).alias("points"),
        *[F.max_by(c, at["30d"]).alias(c) for c in ("buy_price", "sell_price", "volume")], F.count(at["24h"]).alias("n"),
        *[f(c, at["24h"]).alias(f"{c}_{k}") for c in ("buy_price", "sell_price") for f, k in ((F.min_by, "a"), (F.max_by, "z"))],
        F.avg(F.when(F.col("volume") >= 0, own("7d", "volume"))).alias("avg_volume"), F.max(positive_of("buy_price")).alias("high_7d"),
        F.min(positive_of("sell_price")).alias("low_7d"))
    change = lambda c: F.when((F.col("n") >= 2) & (F.col(f"{c}_a") > 0), round2((F.col(f"{c}_z") - F.col(f"{c}_a")) * 100.0 / F.col(f"{c}_a")))
    spread = F.col("buy_price") - F.col("sell_price")
    return g.filter("points > 0").select("item_id", "buy_price", "sell_price", "volume", change("buy_price").alias("buy_change_24h"),
        change("sell_price").alias("sell_change_24h"), round_half_up("avg_volume").alias("avg_volume_7d"), "high_7d", "low_7d",
        spread.alias("spread"), F.when(F.col("buy_price") > 0, round2(spread * 100.0 / F.col("buy_price"))).alias("spread_pct"))


def market_overview(quotes: DataFrame, opportunities: DataFrame, t: int, by: str = "product_id") -> DataFrame:
    """Products of the latest snapshot up to t: prices and spread now, their distance in percent from the mean of the seven days before, high, low,
    volumes of the buy side, and how many opportunities there are and what the best of them earns."""
    own = scan_range(quotes, t - 7 * DAY_MS, t + 1)
    newest = own.agg(F.max("snapshot_ts").alias("__t"))
    now = own.join(F.broadcast(newest), F.col("snapshot_ts") == F.col("__t")).select(by, "snapshot_ts", F.col("buy_price").alias("buy"),
        F.col("sell_price").alias("sell"), F.col("buy_volume").alias("volume"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    h = own.groupBy(by).agg(F.avg(zero("buy_price")).alias("avg_buy"), F.avg(zero("sell_price")).alias("avg_sell"),
        F.max(zero("buy_price")).alias("high"), F.min(zero("sell_price")).alias("low"), F.avg(zero("buy_volume")).alias("avg_volume"))
    best = opportunities.agg(F.count("*").alias("active"), F.max("expected_profit").alias("best_profit"))
    delta = lambda x, base: F.when(F.col(base) != 0, (F.col(x) - F.col(base)) * 100.0 / F.col(base))
    j = now.join(h, by).crossJoin(F.broadcast(best))  # one row
    spread = F.col("buy") - F.col("sell")
    return j.select(by, "snapshot_ts", "buy", delta("buy", "avg_buy").alias("buy_change"), "sell", delta("sell", "avg_sell").alias("sell_change"),
        spread.alias("spread"), F.when(F.col("buy") > 0, spread * 100.0 / F.col("buy")).alias("spread_percent"), "high", "low", "volume",
        "avg_volume", "active", "best_profit")


def first_and_last(quotes: DataFrame, t: int, back_ms: int = DAY_MS, by: str = "product_id") -> DataFrame:
    """(key, buy_price_lo, buy_price_hi, volume_lo, volume_hi): products of both the first and the last snapshot of the range, in one pass over the two.
    Volumes are those of the buy side."""
    own = scan_range(quotes, t - back_ms, t + 1)
    ends = own.agg(F.min("snapshot_ts").alias("lo"), F.max("snapshot_ts").alias("hi"))
    e = own.join(F.broadcast(ends), (F.col("snapshot_ts") == F.col("lo")) | (F.col("snapshot_ts") == F.col("hi"))).filter("lo < hi")
    side = lambda c, at: F.max(F.when(F.col("snapshot_ts") == F.col(at), F.col(c))).alias(f"{c}_{at}")
    g = e.withColumn("volume", F.col("buy_volume")).groupBy(by).agg(*[side(c, at) for c in ("buy_price", "volume") for at in ("lo", "hi")])
    return g.filter("buy_price_lo IS NOT NULL AND buy_price_hi IS NOT NULL")


def trending(quotes: DataFrame, t: int, items: DataFrame, marketplaces: DataFrame, limit: int = 10, by: str = "product_id") -> DataFrame:
    """Changes from the first to the last snapshot of the last day, for products that had a price and a buy volume in the first; the largest first.

    With the item's display name, the id where the catalogue has none, and where it is traded (item_id, marketplace).
    """
    g = first_and_last(quotes, t, by=by).filter("buy_price_lo > 0 AND volume_lo > 0")
    pct = lambda c: round2((F.col(f"{c}_hi") - F.col(f"{c}_lo")) * 100.0 / F.col(f"{c}_lo"))
    top = g.select(by, pct("buy_price").alias("price_change"), pct("volume").alias("volume_change"),
        round_half_up("buy_price_hi").alias("buy_price")).orderBy(F.abs("price_change").desc(), by).limit(limit)
    known = items.join(marketplaces, "item_id").groupBy(F.upper("item_id").alias("__id")).agg(F.min("display_name").alias("__name"),
        F.min("marketplace").alias("__place"))
    return top.join(known, F.upper(by) == F.col("__id"), "left").select(*top.columns, F.coalesce("__name", by).alias("display_name"),
        F.coalesce("__place", F.lit("BAZAAR")).alias("marketplace"))


def market_trend(quotes: DataFrame) -> DataFrame:
    """BULLISH from 4 % mean relative spread, BEARISH to 1 %, SIDEWAYS between; rows without a valid one average 0; no rows, UNKNOWN."""
    s = latest(quotes).agg(F.coalesce(F.avg((F.col("buy_price") - F.col("sell_price")) / positive("buy_price")),
        F.lit(0.0)).alias("avg_spread"), F.count("*").alias("n"))
    return s.select("avg_spread",
        F.when(F.col("n") == 0, "UNKNOWN").when(F.col("avg_spread") >= 0.04, "BULLISH").when(F.col("avg_spread") <= 0.01,
        "BEARISH").otherwise("SIDEWAYS").alias("trend"))


def dashboard_overview(items: DataFrame, quotes: DataFrame, opportunities: DataFrame) -> DataFrame:
    best = opportunities.agg(F.max_by("stable_id", F.struct("expected_profit", "stable_id")).alias("top_opportunity"),
        F.max("expected_profit").alias("top_profit"), F.count("*").alias("opportunity_count"))
    parts = [items.agg(F.count("*").alias("item_count")), quotes.agg(F.countDistinct("snapshot_ts").alias("snapshot_count")), best,
        market_trend(quotes).select("trend")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out
