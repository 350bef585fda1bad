"""Ranked, filtered and summarised reads of items, listings, quotes and opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamp, round2, round_half_up
from .keys import match_items, reforge, star_count, to_listing

SORTS = ("expected_profit", "roi", "roi_per_hour", "required_capital", "fees", "duration_seconds", "liquidity_score", "risk_score")
COVERED = ("AUCTION", "BAZAAR", "CRAFTING", "FORGE")


def filter_opportunities(df: DataFrame, *, flip_type: str | None = None, min_liquidity: float | None = None, max_risk: float | None = None,
    min_profit: int | None = None, min_roi: float | None = None, min_roi_per_hour: float | None = None, max_capital: int | None = None,
    partial: bool | None = None) -> DataFrame:
    """Active bounds only; a null metric fails its bound."""
    low = {"liquidity_score": min_liquidity, "expected_profit": min_profit, "roi": min_roi, "roi_per_hour": min_roi_per_hour}
    high = {"risk_score": max_risk, "required_capital": max_capital}
    for c, v in low.items():
        df = df if v is None else df.filter(F.col(c) >= v)
    for c, v in high.items():
        df = df if v is None else df.filter(F.col(c) <= v)
    df = df if flip_type is None else df.filter(F.col("flip_type") == flip_type)
    return df if partial is None else df.filter(F.col("partial") == partial)


def sort_opportunities(df: DataFrame, by: str = "expected_profit", direction: str = "desc", key: str = "stable_id") -> DataFrame:
    """Nulls last both ways, ties by id."""
    if by not in SORTS:
        raise ValueError(f"cannot sort by {by}")
    c = F.col(by)
    return df.orderBy(c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last(), F.col(key))


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    return df.offset(offset).limit(limit)


def seek_page(df: DataFrame, by: str, direction: str = "desc", after: tuple | None = None, limit: int = 25, key: str = "stable_id") -> DataFrame:
    """The page behind a cursor (metric, id), with the total of all rows in every row of it.

    The cursor is a predicate on the metric and the id, which the scan can take, and no row before it is sorted: a deep page costs
    what the first one does. The order is that of `sort_opportunities`.
    """
    rows = df
    if after is not None:
        value, last = after
        c, later = F.col(by), F.col(key) > F.lit(last)
        if value is None:
            rows = df.filter(c.isNull() & later)
        else:
            beyond = c < F.lit(value) if direction == "desc" else c > F.lit(value)
            rows = df.filter(beyond | ((c == F.lit(value)) & later) | c.isNull())
    total = df.agg(F.count("*").alias("total"))
    return sort_opportunities(rows, by, direction, key).limit(limit).crossJoin(F.broadcast(total))  # one row


def top_opportunities(df: DataFrame, k: int = 10, **filters) -> DataFrame:
    return sort_opportunities(filter_opportunities(df, **filters)).limit(min(k, 10_000))


def top_by(df: DataFrame, metric: str, offset: int = 0, limit: int = 10) -> DataFrame:
    """The most liquid, or the least risky."""
    return page(sort_opportunities(df.filter(F.col(metric).isNotNull()), metric, "asc" if metric == "risk_score" else "desc"), offset,
        limit)


def confidence_score(outliers: bool = True) -> Column:
    """100 less for partial results, reasons, risk and outliers, with credit for liquidity; 0 to 100."""

    def cost(r: Column) -> Column:
        bad = r.startswith("MISSING_INPUT_PRICE") | r.startswith("INSUFFICIENT_INPUT_DEPTH")
        out = r.startswith("MISSING_OUTPUT_PRICE") | r.startswith("INSUFFICIENT_OUTPUT_DEPTH")
        return F.when(F.trim(r) == "", 0.0).when(bad, 60.0).when(out, 30.0).when(r.startswith("AMBIGUOUS_INPUT_MARKET_SOURCE"),
            25.0).when(r == "MISSING_ELECTION_DATA", 5.0).otherwise(10.0)

    liq = clamp(F.coalesce("liquidity_score", F.lit(0.0)), 0.0, 100.0)
    risk = clamp(F.coalesce("risk_score", F.lit(0.0)), 0.0, 100.0)
    score = 100.0 - F.when(F.col("partial"), 15.0).otherwise(0.0) - F.aggregate("partial_reasons", F.lit(0.0),
        lambda a, r: a + cost(r)) + (liq - 50.0) * 0.2 - F.when(risk > 60, (risk - 60.0) * 0.3).otherwise(0.0)
    if outliers:
        fast = F.greatest(F.lit(0.0), F.coalesce("roi_per_hour", F.lit(0.0))) > 50
        rich = (F.coalesce("fees", F.lit(0)) > 0) & (F.greatest(F.lit(0), F.coalesce("expected_profit", F.lit(0))) > F.coalesce("fees",
            F.lit(0)) * 100)
        score = score - F.when(fast & (F.col("partial") | (liq < 40)), 20.0).otherwise(0.0) - F.when(rich, 10.0).otherwise(0.0)
    return clamp(score, 0.0, 100.0)


def actionable(df: DataFrame, gates: bool = False, min_profit: int = 0, min_liquidity: float = 15.0,
    min_confidence: float = 25.0) -> DataFrame:
    """Rows whose inputs have a price and depth; with gates, also profit, liquidity and confidence enough."""
    df = df.filter(~F.exists("partial_reasons", lambda r: r.startswith("MISSING_INPUT_PRICE") | r.startswith("INSUFFICIENT_INPUT_DEPTH")))
    return df.filter(
        (F.col("expected_profit") > min_profit) & (F.col("liquidity_score") >= min_liquidity) & (
        confidence_score() >= min_confidence)) if gates else df


def goodness(version: int = 1) -> Column:
    """Weighted score of return an hour, profit, liquidity and low risk (version 2: with confidence), less 10 for partial results unless only election data are missing."""
    v = F.greatest(F.lit(0.0), F.coalesce("roi_per_hour", F.lit(0.0)))
    at_one = 100.0 * (1.0 - F.exp(F.lit(-1.0)))
    rate = F.when(v <= 0, 0.0).when(v <= 1,
        100.0 * (1.0 - F.exp(-v))).otherwise(clamp(at_one + (100.0 - at_one) * F.log(F.greatest(v, F.lit(1.0))) / F.log(F.lit(100.0)), 0.0,
        100.0))
    profit = F.least(F.lit(100.0), F.log10(F.greatest(F.lit(0), F.coalesce("expected_profit", F.lit(0))) + 1.0) * 10.0)
    liq = clamp(F.coalesce("liquidity_score", F.lit(0.0)), 0.0, 100.0)
    safe = 100.0 - clamp(F.coalesce("risk_score", F.lit(100.0)), 0.0, 100.0)
    hard = (F.size("partial_reasons") == 0) | F.exists("partial_reasons", lambda r: (F.trim(r) != "") & (r != "MISSING_ELECTION_DATA"))
    penalty = F.when(F.col("partial") & hard, 10.0).otherwise(0.0)
    mixed = 0.35 * rate + 0.25 * profit + 0.25 * liq + 0.15 * safe if version == 1 else 0.45 * rate + 0.25 * profit + 0.15 * liq + 0.15 * confidence_score()
    return round2(clamp(mixed - penalty, 0.0, 100.0))


def best_opportunities(df: DataFrame, number: int = 0, size: int = 10, version: int = 1) -> DataFrame:
    ranked = df.withColumn("goodness", goodness(version)).orderBy(F.desc("goodness"), F.col("expected_profit").desc_nulls_last(),
        "stable_id")
    total = df.agg(F.count("*").alias("total"))
    return page(ranked, number * size, size).crossJoin(F.broadcast(total))  # one row


def hydrate(ranked: DataFrame, full: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """Full rows of a ranked page in rank order, unmatched entries kept. A page of at most 10,000 rows is met where the full rows are read; a longer one by a shuffle."""
    found = full
    if ranked.count() <= 10_000:
        found = full.join(F.broadcast(ranked.select(key).distinct()), key, "left_semi")
    return ranked.join(found, key, "left").orderBy(rank)


def with_definition(current: DataFrame, definition: DataFrame, flip_type: str | None = None) -> DataFrame:
    j = current.join(definition, "flip_key")
    return j if flip_type is None else j.filter(F.col("flip_type") == flip_type)


def orphans(flips: DataFrame, snapshots: DataFrame, retained: DataFrame) -> DataFrame:
    """Opportunities whose snapshot is neither raw nor retained."""
    for known in (snapshots, retained):
        flips = flips.join(known.select("snapshot_ts").distinct(), "snapshot_ts", "left_anti")
    return flips


def summary_stats(df: DataFrame) -> DataFrame:
    ok = F.col("expected_profit") > 0
    finite = F.col("roi").isNotNull() & ~F.isnan("roi") & (F.abs("roi") < float("inf"))
    return df.agg(F.count("*").alias("n"),
        F.coalesce(round_half_up(F.avg(F.when(ok, F.col("expected_profit")))), F.lit(0)).alias("avg_profit"),
        F.coalesce(round2(F.avg(F.when(finite, F.col("roi")))), F.lit(0.0)).alias("avg_roi"),
        F.greatest(F.lit(0), F.max("expected_profit")).alias("best_profit"))


def counts_by_type(df: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """A row for every type, absent ones with 0."""
    names = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, types))).alias("flip_type"))
    n = df.groupBy("flip_type").agg(F.count("*").alias("n"))
    return names.join(n, "flip_type", "left").select("flip_type", F.coalesce("n", F.lit(0)).alias("n"))


def coverage(df: DataFrame) -> DataFrame:
    return counts_by_type(df, COVERED).withColumn("covered", F.col("n") > 0)


def current_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.max("expected_profit").alias("max_profit"), F.max("snapshot_ts").alias("last_ts"))


def listing_breakdown(listings: DataFrame) -> DataFrame:
    """(kind, value, n, avg_price, lowest_bin): stars 0 to 5, BIN or AUCTION, reforge, and the total, in one pass of grouping sets.

    Listings are summed by name and lore first, so that the text rules read each pair of them once.
    """
    value = F.when(F.col("highest_bid") > 0, F.col("highest_bid")).otherwise(F.col("starting_bid"))
    price = F.when(value > 0, value)
    texts = listings.groupBy("item_name", "item_lore", "bin").agg(F.count("*").alias("c"), F.sum(price).alias("price"), F.count(price).alias("priced"),
        F.min(F.when(F.col("bin"), F.col("starting_bid"))).alias("bin_price"))
    t = texts.select(star_count("item_name").cast("string").alias("stars"), F.when(F.col("bin"), "BIN").otherwise("AUCTION").alias("sale"),
        reforge("item_name", "item_lore").alias("reforge"), "c", "price", "priced", "bin_price")
    g = t.groupingSets([["stars"], ["sale"], ["reforge"], []], "stars", "sale", "reforge").agg(F.grouping_id().alias("gid"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), round_half_up(F.try_divide(F.sum("price"), F.sum("priced"))).alias("avg_price"),
        F.min("bin_price").alias("lowest_bin"))
    kind = F.when(F.col("gid") == 3, "stars").when(F.col("gid") == 5, "sale").when(F.col("gid") == 6, "reforge").otherwise("all")
    g = g.select(kind.alias("kind"), F.coalesce("stars", "sale", "reforge", F.lit("all")).alias("value"), "n", "avg_price", "lowest_bin")
    zero = listings.sparkSession.range(6).select(F.lit("stars").alias("kind"), F.col("id").cast("string").alias("value"))
    absent = zero.join(g, ["kind", "value"], "left_anti").select("kind", "value", F.lit(0).cast("long").alias("n"),
        F.lit(None).cast("long").alias("avg_price"), F.lit(None).cast("long").alias("lowest_bin"))
    return g.unionByName(absent)


def list_listings(listings: DataFrame, bin_only: bool | None = None, min_stars: int | None = None, max_stars: int | None = None,
    reforge: str | None = None, sort: str = "estimated_value", limit: int = 50) -> DataFrame:
    for c in [] if bin_only is None else [F.col("bin") == bin_only]:
        listings = listings.filter(c)
    listings = listings if min_stars is None else listings.filter(F.col("star_count") >= min_stars)
    listings = listings if max_stars is None else listings.filter(F.col("star_count") <= max_stars)
    listings = listings if reforge is None else listings.filter(F.lower(F.col("reforge")) == reforge.lower())
    order = {"ending": F.asc("end_ts"), "price": F.asc("starting_bid")}.get(sort, F.desc("estimated_value"))
    return listings.orderBy(order, "auction_uuid").limit(limit)


def recent_sales(listings: DataFrame, aliases: DataFrame, limit: int = 20) -> DataFrame:
    """(auction_uuid, value, star_count, reforge, end_ts, bin): the newest claimed listings whose name contains one of the aliases (item_id, alias)."""
    names = match_items(listings, aliases).select("item_name").distinct()
    own = listings.filter("claimed").join(names, "item_name", "left_semi").orderBy(F.desc("end_ts"), "auction_uuid").limit(limit)
    return to_listing(own).select("auction_uuid", F.col("estimated_value").alias("value"), "star_count", "reforge", "end_ts", "bin")


def quick_spreads(quotes: DataFrame, min_pct: float = 1.0, limit: int = 10) -> DataFrame:
    """The widest spreads, of rounded prices over the rounded buy price."""
    r = quotes.select("product_id", round_half_up("buy_price").alias("buy"), round_half_up("sell_price").alias("sell"),
        F.least("buy_volume", "sell_volume").alias("volume")).withColumn("spread", F.greatest(F.lit(0), F.col("buy") - F.col("sell")))
    t = r.withColumn("spread_pct", F.when(F.col("buy") <= 0, 0.0).otherwise(round2(F.col("spread") * 100.0 / F.col("buy"))))
    return t.filter(F.col("spread_pct") >= min_pct).orderBy(F.desc("spread_pct"), "product_id").limit(limit)


def product_detail(quotes: DataFrame, product_id: str) -> DataFrame:
    return quotes.filter(F.col("product_id") == product_id).select("product_id", round_half_up("buy_price").alias("buy_price"),
        round_half_up("sell_price").alias("sell_price"), "buy_volume", "sell_volume")


def with_display_name(df: DataFrame, items: DataFrame, key: str = "product_id") -> DataFrame:
    """Adds display_name, the id where the catalogue has none; ids compare in upper case, the first name wins."""
    names = items.groupBy(F.upper("item_id").alias("__id")).agg(F.min("display_name").alias("__name"))
    return df.join(names, F.upper(key) == F.col("__id"), "left").withColumn("display_name", F.coalesce("__name", key)).drop("__id",
        "__name")


def search_items(items: DataFrame, text: str | None = None, category: str | None = None, rarity: str | None = None) -> DataFrame:
    if text:
        t = F.lit(text.lower())
        items = items.filter(F.contains(F.lower("item_id"), t) | F.contains(F.lower("display_name"),
            t) | F.contains(F.lower("minecraft_id"), t))
    items = items if category is None else items.filter(F.lower("category") == category.lower())
    return items if rarity is None else items.filter(F.lower("rarity") == rarity.lower())


def marketplaces(items: DataFrame, quotes: DataFrame, listings: DataFrame, opportunities: DataFrame) -> DataFrame:
    """(item_id, marketplace): BOTH, BAZAAR, AUCTION_HOUSE or NONE by exact match of id, display name or minecraft id, as they are or compact."""
    norm = lambda c: F.upper(F.trim(c))
    compact = lambda c: F.regexp_replace(norm(c), "[_ ]", "")
    own = items.select("item_id",
        F.explode(F.array_distinct(F.array_compact(F.array(*[f(c) for c in ("item_id", "display_name", "minecraft_id") for f in (norm,
        compact)])))).alias("k"))
    book = quotes.select(norm("product_id").alias("k")).distinct().withColumn("b", F.lit(True))
    names = listings.select("item_name").distinct()
    house = names.select(norm("item_name").alias("k")).union(names.select(compact("item_name"))).union(
        opportunities.filter("flip_type = 'AUCTION'").select(norm("result_item_id"))).distinct().withColumn("a", F.lit(True))
    m = own.join(book, "k", "left").join(house, "k", "left").groupBy("item_id").agg(F.coalesce(F.bool_or("b"), F.lit(False)).alias("b"),
        F.coalesce(F.bool_or("a"), F.lit(False)).alias("a"))
    return m.select("item_id",
        F.when(F.col("a") & F.col("b"), "BOTH").when(F.col("b"), "BAZAAR").when(F.col("a"),
        "AUCTION_HOUSE").otherwise("NONE").alias("marketplace"))


def opportunities_for_item(opps: DataFrame, stacks: DataFrame, item_aliases: DataFrame) -> DataFrame:
    """Opportunities with an input or output that is one of the item's aliases."""
    hit = stacks.withColumn("alias", F.upper("item_id")).join(item_aliases.select("alias").distinct(), "alias", "left_semi")
    return opps.join(hit.select("opp_id").distinct(), "opp_id", "left_semi")


def route_timings(log: DataFrame, threshold_ms: float = 250.0) -> DataFrame:
    """Mean, greatest and exact percentiles of each route's durations; equal durations are one row with a count before they are ordered."""
    sets = [F.array_join(F.sort_array(F.collect_set(c)), ",").alias(f"{c}s") for c in ("method", "status", "outcome")]
    g = log.groupBy("route").agg(F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"),
        F.count("*").alias("requests"), *sets)
    w, value = Window.partitionBy("route"), F.col("duration_ms")
    counts = log.filter("duration_ms IS NOT NULL").groupBy("route", "duration_ms").agg(F.count("*").alias("c"))
    counts = counts.withColumns({"upto": F.sum("c").over(w.orderBy("duration_ms")), "n": F.sum("c").over(w)})

    def percentile(p: float) -> Column:
        place = F.lit(p) * (F.max("n") - 1)
        at = lambda i: F.min(F.when(F.col("upto") > i, value))
        spot = F.lit(p) * (F.col("n") - 1)
        low, high = at(F.floor(spot)), at(F.ceil(spot))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    g = g.join(counts.groupBy("route").agg(percentile(0.95).alias("p95_ms"), percentile(0.99).alias("p99_ms")), "route", "left")
    return g.withColumn("over_threshold", F.col("p95_ms") > threshold_ms).orderBy(F.desc("p95_ms"), F.desc("mean_ms"), F.desc("max_ms"),
        "route")


def top_stacks(events: DataFrame, n: int = 10) -> DataFrame:
    """The n stacks of each class with the longest total duration, and their share of the class."""
    g = events.groupBy("class", "stack").agg(F.sum("duration").alias("total"), F.count("*").alias("events"))
    w = Window.partitionBy("class")
    g = g.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("total"), "stack")),
        "share": F.round(F.col("total") / F.sum("total").over(w), 6)})
    return g.filter(F.col("rank") <= n)


def source_cadence(updates: DataFrame, low_ms: int = 1_000, high_ms: int = 600_000, keep: int = 7, alpha: float = 0.3) -> DataFrame:
    """(feed, estimate_ms, jitter_ms) from the clamped gaps of the last updates: the mean of their median and moving average, and their MAD."""
    w = Window.partitionBy("feed").orderBy("last_updated")
    newest = F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("last_updated")))
    # the newest updates alone reach the window of the gaps; each partition hands on no more than these
    u = updates.select("feed", "last_updated").distinct().withColumn("rn", newest).filter(F.col("rn") <= keep + 1)
    u = u.withColumn("gap", F.col("last_updated") - F.lag("last_updated").over(w)).filter("gap IS NOT NULL")
    u = u.withColumn("gap", F.least(F.greatest("gap", F.lit(low_ms)), F.lit(high_ms)).cast("double"))
    g = u.groupBy("feed").agg(F.percentile("gap", F.lit(0.5)).alias("m"),
        F.transform(F.array_sort(F.collect_list(F.struct("last_updated", "gap"))), lambda x: x["gap"]).alias("gaps"))
    ema = F.aggregate("gaps", F.lit(None).cast("double"), lambda a, x: F.coalesce(a * (1 - alpha) + x * alpha, x))
    g = g.withColumns({"ema": ema, "dev": F.array_sort(F.transform("gaps", lambda x: F.abs(x - F.col("m"))))})
    n = F.size("dev")
    mad = (F.element_at("dev", F.floor((n + 1) / 2).cast("int")) + F.element_at("dev", F.floor((n + 2) / 2).cast("int"))) / 2.0
    return g.select("feed", round_half_up((F.col("m") + F.col("ema")) / 2.0).alias("estimate_ms"),
        F.when(n < 3, 0.0).otherwise(mad).alias("jitter_ms"))


def changed_updates(updates: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """Updates whose payload hash is not that of the feed's update before.

    Updates are compared within hours; the last hash of the hour before is carried over on one row a feed and hour.
    """
    order = F.struct("last_updated", "payload_id")
    u = updates.withColumn("__b", F.floor(F.col("last_updated") / bucket_ms))
    hours = u.groupBy("feed", "__b").agg(F.max_by(F.struct("hash"), order).alias("__last"))
    before = Window.partitionBy("feed").orderBy("__b")
    carry = hours.select(F.col("feed").alias("__feed"), F.col("__b").alias("__c"), F.lag("__last").over(before).alias("__carry"))
    w = Window.partitionBy("feed", "__b").orderBy("last_updated", "payload_id")
    j = u.withColumn("__p", F.lag(F.struct("hash")).over(w)).join(carry,
        F.col("feed").eqNullSafe(F.col("__feed")) & (F.col("__b") == F.col("__c")))
    before_it = F.coalesce("__p", "__carry")
    return j.filter(before_it.isNull() | ~F.col("hash").eqNullSafe(before_it["hash"])).select(*updates.columns)
