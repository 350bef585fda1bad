"""Opportunities: generating them, pricing their legs, valuing and scoring them.

Everything runs on the long leg table (opp_id, leg_no, ...); only the exposure
fold, bounded by an opportunity's few legs, gathers a group into an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clamp, rel_spread
from .keys import match_items
from .snapshots import as_of

# Fixed values of fees and scores.
QUOTE_TAX = 0.0125
LISTING_HOURS_FEE = {1: 20, 6: 45, 12: 100, 24: 350, 48: 1200}
DEPTH_IMPACT = 0.35
MOST_HOURS = 24.0
DEFAULT_LISTING_HOURS = 12
STEP_SECONDS = 30


def quote_fee(gross: Column, rate: float | Column = QUOTE_TAX) -> Column:
    return F.ceil(gross * rate)


def listing_fees(gross: Column, hours: Column, multiplier: Column | float = 1.0) -> tuple[Column, Column, Column]:
    """(listing fee, duration fee, claim tax)."""
    m = multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier))
    rate = F.when(gross < 10_000_000, 0.01).when(gross < 100_000_000, 0.02).otherwise(0.025)
    duration = F.lit(LISTING_HOURS_FEE[12])
    for h, fee in LISTING_HOURS_FEE.items():
        duration = F.when(hours == h, fee).otherwise(duration)
    claim = F.when(gross > 1_000_000, F.least(F.ceil(F.ceil(gross * 0.01) * m), gross - 1_000_000)).otherwise(0)
    return F.ceil(F.ceil(gross * rate) * m), duration.cast("long"), claim.cast("long")


def depth_price(unit: Column, amount: Column, depth: Column, side: str) -> Column:
    """The unit price worsened by up to 35 % for the share of the amount that the other side's volume lacks."""
    short = F.when(depth <= 0, 1.0).when(amount > depth, 1.0 - depth / amount).otherwise(0.0)
    return unit * (1.0 + (1 if side == "BUY" else -1) * short * DEPTH_IMPACT)


def conservative_sell(p: str = "") -> Column:
    """From second lowest, p25, median, average and highest of a listing quote, in that order of care."""
    pos = lambda c: F.when(F.col(p + c) > 0, F.col(p + c).cast("double"))
    second, p25, med = pos("second_lowest"), pos("p25"), pos("median")
    both = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))
    return F.coalesce(both(p25, second), p25, both(second, med * 0.97), second, med * 0.97, pos("average") * 0.95, pos("highest"))


def fill_hours(amount: Column, week: Column, volume: Column) -> Column:
    """Hours to trade the amount at the side's weekly turnover, at most 24; 24 without turnover."""
    turnover = F.when(week > 0, week).otherwise(volume) / 168.0
    return F.when(turnover > 0, clamp(amount / turnover, 0.0, MOST_HOURS)).otherwise(MOST_HOURS)


def eligible_quotes(quotes: DataFrame, ratio: float = 1.015) -> DataFrame:
    return quotes.filter((F.col("buy_price") > 0) & (F.col("sell_price") / F.col("buy_price") >= ratio))


def eligible_listings(lq: DataFrame, least: int = 10, edge: float = 1.10) -> DataFrame:
    """Adds reason: OK, or why a listing quote makes no opportunity."""
    anchor = conservative_sell()
    reason = F.when(~(F.col("lowest") > 0), "NO_PRICE").when(F.col("sample_size") < least, "THIN_SAMPLE").when(anchor.isNull(),
        "NO_ANCHOR").when(anchor / F.col("lowest") < edge, "NO_EDGE").otherwise("OK")
    return lq.withColumn("reason", reason)


LEG = ["opp_id", "flip_type", "result_item_id", "leg_no", "leg_type", "base_duration_seconds", "item_id", "amount", "market",
    "npc_unit_price", "duration_hours"]


def _legs(df: DataFrame, legs: list[Column]) -> DataFrame:
    e = df.select("opp_id", "flip_type", "result_item_id", F.posexplode(F.array(*legs)).alias("leg_no", "leg"))
    return e.select("opp_id", "flip_type", "result_item_id", "leg_no", "leg.*").select(*LEG)


def _leg(kind: str, item: Column, seconds: int, market: str | None, hours: int | None = None) -> Column:
    return F.struct(F.lit(kind).alias("leg_type"), F.lit(seconds).cast("long").alias("base_duration_seconds"), item.alias("item_id"),
        F.lit(1).alias("amount"), F.lit(market).alias("market"), F.lit(None).cast("double").alias("npc_unit_price"),
        F.lit(hours).cast("int").alias("duration_hours"))


def market_opportunities(quotes: DataFrame, lq: DataFrame, item: str = "item_id") -> DataFrame:
    """Legs of buy-and-sell opportunities for eligible quotes and listing quotes."""
    b = eligible_quotes(quotes).select(F.concat(F.lit("BZ:"), "product_id").alias("opp_id"), F.lit("BAZAAR").alias("flip_type"),
        F.col("product_id").alias("result_item_id"))
    a = eligible_listings(lq).filter("reason = 'OK'").select(F.concat(F.lit("AH:"), item).alias("opp_id"),
        F.lit("AUCTION").alias("flip_type"), F.col(item).alias("result_item_id"))
    r = F.col("result_item_id")
    bz = _legs(b, [_leg("BUY", r, STEP_SECONDS, "BAZAAR"), _leg("SELL", r, STEP_SECONDS, "BAZAAR")])
    ah = _legs(a, [_leg("BUY", r, STEP_SECONDS, "AUCTION"),
        _leg("SELL", r, DEFAULT_LISTING_HOURS * 3600, "AUCTION", DEFAULT_LISTING_HOURS)])
    return bz.unionByName(ah)


def conversion_opportunities(recipes: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Legs of conversions: one BUY per ingredient in item order, then the process."""
    from pyspark.sql import Window

    kind = F.when(F.col("process_type") == "CRAFT", "CRAFTING").otherwise(F.col("process_type"))
    r = recipes.select("recipe_id", F.concat(F.lit("RC:"), "recipe_id").alias("opp_id"), kind.alias("flip_type"),
        F.col("output_item_id").alias("result_item_id"), "process_type", "process_duration_seconds")
    none = lambda t: F.lit(None).cast(t)
    b = r.join(ingredients, "recipe_id").withColumn("leg_no",
        F.row_number().over(Window.partitionBy("recipe_id").orderBy("item_id", "amount")) - 1)
    buys = b.select("opp_id", "flip_type", "result_item_id", "leg_no", F.lit("BUY").alias("leg_type"),
        F.lit(STEP_SECONDS).cast("long").alias("base_duration_seconds"), "item_id", "amount", none("string").alias("market"),
        none("double").alias("npc_unit_price"), none("int").alias("duration_hours"))
    n = ingredients.groupBy("recipe_id").agg(F.count("*").cast("int").alias("leg_no"))
    step = F.when(F.col("process_type") == "FORGE", "FORGE").when(F.col("process_type") == "KATGRADE", "WAIT").otherwise("CRAFT")
    process = r.join(n, "recipe_id", "left").select("opp_id", "flip_type", "result_item_id", F.coalesce("leg_no", F.lit(0)).alias("leg_no"),
        step.alias("leg_type"), F.col("process_duration_seconds").alias("base_duration_seconds"), none("string").alias("item_id"),
        none("int").alias("amount"), none("string").alias("market"), none("double").alias("npc_unit_price"),
        none("int").alias("duration_hours"))
    return buys.unionByName(process)


def constraints_of(legs: DataFrame) -> DataFrame:
    """(opp_id, kind, long_value): a recipe to unlock for conversions, forge slots for forging."""
    o = legs.filter("opp_id LIKE 'RC:%'").groupBy("opp_id").agg(F.bool_or(F.col("leg_type") == "FORGE").alias("forge"))
    kinds = F.array_compact(F.array(F.struct(F.lit("RECIPE_UNLOCKED").alias("kind"), F.lit(None).cast("long").alias("long_value")),
        F.when(F.col("forge"), F.struct(F.lit("MIN_FORGE_SLOTS").alias("kind"), F.lit(1).cast("long").alias("long_value")))))
    return o.select("opp_id", F.explode(kinds).alias("c")).select("opp_id", "c.*")


def min_capital(constraints: DataFrame) -> DataFrame:
    return constraints.filter("kind = 'MIN_CAPITAL' AND long_value > 0").groupBy("opp_id").agg(F.max("long_value").alias("min_capital"))


def parse_leg_params(df: DataFrame, params: str = "params_json") -> DataFrame:
    """Adds item_id, amount, market and npc_unit_price from a step's JSON."""
    j = lambda k: F.get_json_object(params, f"$.{k}")
    market = F.upper(F.coalesce(j("market"), j("source"), F.lit("")))
    npc = F.lit(None).cast("double")
    for k in ("npcUnitPrice", "npcPrice", "unitPrice", "price", "cost"):
        v = j(k).try_cast("double")
        npc = F.coalesce(npc, F.when(v > 0, v))
    return df.withColumns({
        "item_id": F.nullif(F.trim(j("itemId")), F.lit("")),
            "amount": F.greatest(F.lit(1), F.coalesce(j("amount").try_cast("int"), F.lit(1))),
        "market": F.when(market.startswith("BAZAAR"), "BAZAAR").when(market.startswith("AUCTION"), "AUCTION").when(market.startswith("NPC"),
            "NPC").otherwise("ANY"), "npc_unit_price": npc,
    })


def with_implicit_sells(legs: DataFrame) -> DataFrame:
    """Adds implicit: a last SELL of one result item where an opportunity has no SELL leg."""
    g = legs.groupBy("opp_id").agg(F.first("flip_type").alias("flip_type"), F.max("result_item_id").alias("result_item_id"),
        (F.max("leg_no") + 1).cast("int").alias("leg_no"), F.bool_or(F.col("leg_type") == "SELL").alias("sells"))
    e = g.filter("NOT sells AND trim(result_item_id) <> ''")
    none = lambda t: F.lit(None).cast(t)
    add = e.select("opp_id", "flip_type", "result_item_id", "leg_no", F.lit("SELL").alias("leg_type"),
        none("long").alias("base_duration_seconds"), F.col("result_item_id").alias("item_id"), F.lit(1).alias("amount"),
        none("string").alias("market"), none("double").alias("npc_unit_price"), none("int").alias("duration_hours"),
        F.lit(True).alias("implicit"))
    return legs.select(*LEG).withColumn("implicit", F.lit(False)).unionByName(add)


def resolve_leg_prices(legs: DataFrame, quotes: DataFrame, lq: DataFrame, item: str = "item_id") -> DataFrame:
    """Adds source, unit_price and reasons (array) to BUY and SELL legs, with the columns of both quotes."""
    qz = quotes.select(F.col("product_id").alias("__q"), "buy_price", "sell_price", "buy_volume", "sell_volume", "buy_moving_week",
        "sell_moving_week")
    lz = lq.select(F.col(item).alias("__l"), "lowest", "second_lowest", "highest", "average", "median", "p25", "sample_size")
    j = legs.join(qz, F.col("item_id") == F.col("__q"), "left").join(lz, F.col("item_id") == F.col("__l"), "left")
    buy, sell = F.col("leg_type") == "BUY", F.col("leg_type") == "SELL"
    market, careful = F.coalesce("market", F.lit("ANY")), conservative_sell()
    has_q = F.when(buy, F.coalesce(F.col("buy_price") > 0, F.lit(False))).otherwise(F.coalesce(F.col("sell_price") > 0, F.lit(False)))
    has_l = F.when(buy, F.coalesce(F.col("lowest") > 0, F.lit(False))).otherwise(careful.isNotNull())
    npc_ok = buy & (F.col("npc_unit_price") > 0)
    source = F.when(~(buy | sell), None).when(market == "NPC", F.when(npc_ok, "NPC")).when(market == "BAZAAR",
        F.when(has_q, "BAZAAR")).when(market == "AUCTION", F.when(has_l, "AUCTION")).when(has_q, "BAZAAR").when(has_l, "AUCTION")
    j = j.withColumn("source", source)
    price = F.when(F.col("source") == "NPC", F.col("npc_unit_price")).when(F.col("source") == "BAZAAR",
        F.when(buy, F.col("buy_price")).otherwise(F.col("sell_price"))).when(F.col("source") == "AUCTION",
        F.when(buy, F.col("lowest").cast("double")).otherwise(careful))
    depth = F.when(buy, F.col("sell_volume")).otherwise(F.col("buy_volume"))
    side = F.when(buy, "INPUT").otherwise("OUTPUT")
    code = lambda text: F.concat(text, F.lit(":"), F.col("item_id"))
    none_found = F.col("source").isNull() & (buy | sell)
    missing = F.when(none_found & (market == "NPC"),
        F.when(buy, code(F.lit("MISSING_NPC_PRICE"))).otherwise(code(F.lit("UNSUPPORTED_OUTPUT_MARKET_NPC")))).when(none_found,
        code(F.concat(F.lit("MISSING_"), side, F.lit("_PRICE"),
        F.when(market.isin("BAZAAR", "AUCTION"), F.concat(F.lit("_"), market)).otherwise(""))))
    ambiguous = F.when(buy & ~market.isin("NPC", "BAZAAR", "AUCTION") & has_q & has_l, code(F.lit("AMBIGUOUS_INPUT_MARKET_SOURCE")))
    short = F.when((F.col("source") == "BAZAAR") & (F.col("amount") > F.greatest(depth, F.lit(0))),
        code(F.concat(F.lit("INSUFFICIENT_"), side, F.lit("_DEPTH"))))
    still = F.when(F.col("source") == "BAZAAR",
        F.when(F.coalesce(F.when(buy,
        F.when(F.col("sell_moving_week") > 0,
        F.col("sell_moving_week")).otherwise(F.col("sell_volume"))).otherwise(F.when(F.col("buy_moving_week") > 0,
        F.col("buy_moving_week")).otherwise(F.col("buy_volume"))), F.lit(0)) <= 0, code(F.lit("ZERO_TURNOVER"))))
    return j.withColumns({"unit_price": price, "reasons": F.array_compact(F.array(missing, ambiguous, short, still))}).drop("__q", "__l")


def quote_leg_scores(spread: Column, hours: Column, illiquid: Column) -> tuple[Column, Column]:
    """(liquidity, risk) of a leg on the order book."""
    liq = 100.0 / (1.0 + hours) / (1.0 + spread / 0.02) - F.when(illiquid, 10.0).otherwise(0.0)
    return clamp(liq, 0.0, 100.0), 0.5 * clamp(spread / 0.05, 0.0, 1.0) * 100.0 + 0.5 * clamp(hours / 6.0, 0.0, 1.0) * 100.0


def listing_leg_scores(n: Column, spread: Column) -> tuple[Column, Column]:
    """(liquidity, risk) of a leg on listings."""
    sample = 1.0 - F.exp(-n / 12.0)
    return clamp(sample / (1.0 + spread / 0.05) * 100.0, 0.0,
        100.0), 0.6 * (1.0 - clamp(sample, 0.0, 1.0)) * 100.0 + 0.4 * clamp(spread / 0.2, 0.0, 1.0) * 100.0


def price_legs(resolved: DataFrame, features: DataFrame | None = None, tax: float | Column = QUOTE_TAX,
    multiplier: float | Column = 1.0) -> DataFrame:
    """Costs, revenue, fees, fill hours, seconds and scores of every leg."""
    buy, sell = F.col("leg_type") == "BUY", F.col("leg_type") == "SELL"
    on_book, on_list = F.col("source") == "BAZAAR", F.col("source") == "AUCTION"
    if features is not None:
        resolved = resolved.join(features.select(F.col("product_id").alias("__f"), "illiquid"), F.col("item_id") == F.col("__f"),
            "left").drop("__f")
    else:
        resolved = resolved.withColumn("illiquid", F.lit(False))
    amount = F.coalesce("amount", F.lit(1))
    at = F.when(on_book & buy, depth_price(F.col("unit_price"), amount, F.col("sell_volume"), "BUY")).when(on_book,
        depth_price(F.col("unit_price"), amount, F.col("buy_volume"), "SELL")).otherwise(F.col("unit_price"))
    df = resolved.withColumns({"leg_cost": F.when(buy & F.col("source").isNotNull(), F.ceil(at * amount)).otherwise(0).cast("long"),
        "gross": F.when(sell & F.col("source").isNotNull(), F.floor(at * amount)).otherwise(0).cast("long")})
    hours_listed = F.when(F.col("duration_hours") > 0, F.col("duration_hours")).otherwise(DEFAULT_LISTING_HOURS)
    fee, span, claim = listing_fees(F.col("gross"), hours_listed, multiplier)
    df = df.withColumns({"upfront": F.when(sell & on_list, fee + span).otherwise(0).cast("long"),
        "fees": F.when(sell & on_book, quote_fee(F.col("gross"), tax)).when(sell & on_list, fee + span + claim).otherwise(0).cast("long")})
    df = df.withColumn("proceeds", F.greatest(F.lit(0), F.col("gross") - F.col("fees")))
    on_side = F.when(buy, fill_hours(amount, F.col("sell_moving_week"), F.col("sell_volume"))).otherwise(fill_hours(amount,
        F.col("buy_moving_week"), F.col("buy_volume")))
    listed = F.when(sell, hours_listed.cast("double")).otherwise(F.when(F.col("base_duration_seconds") > 0,
        F.col("base_duration_seconds") / 3600.0))
    df = df.withColumn("fill_hours", F.when(on_book, on_side).when(on_list, F.when(listed > 0, F.least(listed, F.lit(MOST_HOURS)))))
    spread = F.when(on_book, rel_spread("buy_price",
        "sell_price")).otherwise(F.coalesce((F.greatest("second_lowest", "lowest") - F.col("lowest")) / F.when(F.col("lowest") > 0,
        F.col("lowest")), F.lit(1.0)))
    ql, qr = quote_leg_scores(spread, F.col("fill_hours"), F.coalesce("illiquid", F.lit(False)))
    ll, lr = listing_leg_scores(F.col("sample_size").cast("double"), spread)
    seconds = F.when(F.col("fill_hours") > 0,
        F.ceil(F.col("fill_hours") * 3600.0)).otherwise(F.greatest(F.lit(0), F.coalesce("base_duration_seconds", F.lit(0))))
    return df.withColumns({"liquidity": F.when(on_book, ql).when(on_list, ll), "risk": F.when(on_book, qr).when(on_list, lr),
        "seconds": seconds.cast("long")})


def exposure(priced: DataFrame) -> DataFrame:
    """(opp_id, peak_exposure): a fold over an opportunity's legs in order, floored at 0 after explicit proceeds."""
    return priced.groupBy("opp_id").agg(F.array_sort(F.collect_list(F.struct(*_FOLDED))).alias("l")).select("opp_id",
        peak_exposure("l").alias("peak_exposure"))


_FOLDED = ("leg_no", "leg_type", "leg_cost", "upfront", "proceeds", "implicit")


def peak_exposure(legs: str) -> Column:
    """The fold over an array of legs in order."""
    zero = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("peak"))

    def step(acc: Column, x: Column) -> Column:
        run = acc["run"] + x["leg_cost"] + x["upfront"]
        after = F.when((x["leg_type"] == "SELL") & ~x["implicit"], F.greatest(F.lit(0).cast("long"), run - x["proceeds"])).otherwise(run)
        return F.struct(after.alias("run"), F.greatest(acc["peak"], run).alias("peak"))

    return F.aggregate(legs, zero, step)["peak"]


def vol_return_risk(vol: Column, ret: Column, vol_cap: float, ret_cap: float) -> Column:
    v, r = clamp(vol / vol_cap, 0.0, 1.0) * 100.0, clamp(F.abs(ret) / ret_cap, 0.0, 1.0) * 100.0
    return F.when(vol.isNotNull() & ret.isNotNull(), 0.7 * v + 0.3 * r).when(vol.isNotNull(), v).when(ret.isNotNull(), r)


def total_risk(opps: DataFrame, signals: DataFrame, features: DataFrame | None) -> DataFrame:
    """opps: opp_id, execution_risk, exposure_hours; signals: (opp_id, item_id) of order-book legs. Gives (opp_id, risk_score)."""
    if features is None:
        s = opps.select("opp_id", *[F.lit(None).cast("double").alias(c) for c in ("micro", "macro")],
            *[F.lit(0.0).alias(c) for c in ("micro_c", "macro_c")])
    else:
        weight = lambda c: F.when(F.col(c) == "HIGH", 1.0).when(F.col(c) == "MED", 0.5).otherwise(0.0)
        f = features.select(F.col("product_id").alias("item_id"),
            vol_return_risk(F.col("micro_volatility"), F.col("micro_return"), 0.03, 0.05).alias("mi"),
            weight("micro_confidence").alias("mic"),
            vol_return_risk(F.col("macro_volatility"), F.col("macro_return"), 0.12, 0.20).alias("ma"),
            weight("macro_confidence").alias("mac"))
        g = signals.select("opp_id", "item_id").distinct().join(f, "item_id").groupBy("opp_id").agg(F.max("mi").alias("micro"),
            F.coalesce(F.min(F.when(F.col("mi").isNotNull(), F.col("mic"))), F.lit(0.0)).alias("micro_c"), F.max("ma").alias("macro"),
            F.coalesce(F.min(F.when(F.col("ma").isNotNull(), F.col("mac"))), F.lit(0.0)).alias("macro_c"))
        s = opps.select("opp_id").join(g, "opp_id", "left").na.fill(0.0, ["micro_c", "macro_c"])
    return opps.join(s, "opp_id").select("opp_id", blended_risk(*map(F.col, ("micro", "macro", "micro_c", "macro_c"))).alias("risk_score"))


def blended_risk(micro: Column, macro: Column, micro_c: Column, macro_c: Column) -> Column:
    """Execution and exposure, mixed with the micro and macro risk by how sure these are."""
    c = F.least(F.lit(100.0), 0.7 * F.col("execution_risk") + 0.3 * clamp(F.col("exposure_hours") / 6.0, 0.0, 1.0) * 100.0)
    wi, wa = 0.35 * micro_c, 0.20 * macro_c
    score = (1.0 - wi - wa) * c + wi * F.coalesce(micro, c) + wa * F.coalesce(macro, c)
    return F.when(F.col("execution_risk").isNotNull(), clamp(score, 0.0, 100.0))


def value_opportunities(legs: DataFrame, quotes: DataFrame, lq: DataFrame, features: DataFrame | None = None,
    constraints: DataFrame | None = None, context: DataFrame | None = None) -> DataFrame:
    """One valued row per opportunity. features: of `timescale_features`; context: the one row of `tax_context`, without which election data count as missing.

    The legs are priced once and folded in one aggregate: sums, exposure, reasons and the items whose features count.
    """
    resolved = resolve_leg_prices(with_implicit_sells(legs), quotes, lq)
    if context is None:
        resolved = resolved.withColumns({"quote_tax": F.lit(QUOTE_TAX), "listing_multiplier": F.lit(1.0), "election_missing": F.lit(True)})
    else:
        resolved = resolved.crossJoin(F.broadcast(context))  # one row
    p = price_legs(resolved, features, F.col("quote_tax"), F.col("listing_multiplier"))
    inp, out = F.col("leg_type") == "BUY", F.col("leg_type") == "SELL"
    hours = lambda c: F.coalesce(F.sum(F.when(c, F.col("fill_hours"))), F.lit(0.0))
    craft = F.coalesce(F.sum(F.when(~(inp | out), F.greatest(F.lit(0), F.coalesce("base_duration_seconds", F.lit(0))) / 3600.0)),
        F.lit(0.0))
    g = p.groupBy("opp_id").agg(
        F.first("flip_type").alias("flip_type"), F.first("result_item_id").alias("result_item_id"), F.sum("leg_cost").alias("input_cost"),
            F.sum("gross").alias("gross"), F.sum("fees").alias("fees"), F.sum("seconds").alias("duration_seconds"),
        F.min("liquidity").alias("liquidity_score"), F.max("risk").alias("execution_risk"),
            (hours(inp) + hours(out) + craft).alias("exposure_hours"),
        F.array_sort(F.collect_list(F.struct(*_FOLDED, "reasons"))).alias("__l"), F.bool_or("election_missing").alias("__missing"),
            F.collect_set(F.when(F.col("source") == "BAZAAR", F.col("item_id"))).alias("__items"),
    )
    election = F.when(F.col("__missing"), F.array(F.lit("MISSING_ELECTION_DATA"))).otherwise(F.array().cast("array<string>"))
    reasons = F.array_distinct(F.concat(election, F.flatten(F.transform("__l", lambda x: x["reasons"]))))
    g = g.withColumns({"partial_reasons": reasons, "peak_exposure": peak_exposure("__l")}).drop("__l", "__missing")
    if constraints is not None:
        g = g.join(min_capital(constraints), "opp_id", "left")
    else:
        g = g.withColumn("min_capital", F.lit(0).cast("long"))
    if features is None:
        g = g.withColumn("risk_score", blended_risk(*[F.lit(None).cast("double")] * 2, *[F.lit(0.0)] * 2))
    else:
        g = g.join(total_risk(g.select("opp_id", "execution_risk", "exposure_hours"),
            g.select("opp_id", F.explode("__items").alias("item_id")), features), "opp_id")
    return economics(g.withColumn("partial", F.size("partial_reasons") > 0)).drop("execution_risk", "exposure_hours", "min_capital",
        "peak_exposure", "input_cost", "gross", "__items")


def opportunities_as_of(quotes: DataFrame, t: int | None, lq: DataFrame, recipes: DataFrame, ingredients: DataFrame,
    **options) -> DataFrame:
    """Opportunities generated and valued again from the quotes of the snapshot at or before t, the newest without t."""
    then = as_of(quotes, t)
    legs = market_opportunities(then, lq).unionByName(conversion_opportunities(recipes, ingredients))
    return value_opportunities(legs, then, lq, constraints=constraints_of(legs), **options)


def economics(df: DataFrame) -> DataFrame:
    """Adds required_capital, expected_profit, roi and roi_per_hour from costs, revenue, fees, peak exposure and the capital constraint."""
    df = df.withColumns({"required_capital": F.greatest(F.coalesce("min_capital", F.lit(0)), "input_cost", "peak_exposure"),
        "expected_profit": F.col("gross") - F.col("input_cost") - F.col("fees")})
    df = df.withColumn("roi", F.when(F.col("required_capital") > 0, F.col("expected_profit") / F.col("required_capital").cast("double")))
    return df.withColumn("roi_per_hour", F.when(F.col("duration_seconds") > 0, F.col("roi") * (3600.0 / F.col("duration_seconds"))))


def durations(legs: DataFrame) -> DataFrame:
    s = F.greatest(F.lit(0), F.coalesce("base_duration_seconds", F.lit(0)))
    passive = F.col("leg_type").isin("FORGE", "WAIT")
    return legs.groupBy("opp_id").agg(F.sum(s).alias("total"), F.sum(F.when(~passive, s).otherwise(0)).alias("active"),
        F.sum(F.when(passive, s).otherwise(0)).alias("passive"), F.bool_or(F.col("leg_type") == "FORGE").alias("needs_forge_slot"))


def item_stacks(legs: DataFrame) -> DataFrame:
    """(opp_id, side, item_id, amount): sums over BUY and SELL legs, the result item with 1 where nothing sells it."""
    s = legs.filter("leg_type IN ('BUY', 'SELL') AND item_id IS NOT NULL").groupBy("opp_id",
        F.when(F.col("leg_type") == "BUY", "input").otherwise("output").alias("side"), "item_id").agg(F.sum("amount").alias("amount"))
    r = legs.filter("result_item_id IS NOT NULL").select("opp_id", F.lit("output").alias("side"),
        F.col("result_item_id").alias("item_id")).distinct()
    return s.unionByName(r.join(s, ["opp_id", "side", "item_id"], "left_anti").withColumn("amount", F.lit(1).cast("long")))


def stable_identity(legs: DataFrame, constraints: DataFrame) -> DataFrame:
    """(opp_id, flip_key, stable_id): sha256 and a name UUID of the canonical JSON of type, result, legs and sorted constraints."""
    leg = F.struct("leg_no", F.struct("amount", F.col("base_duration_seconds").alias("duration"), F.col("item_id").alias("item"), "market",
        F.col("leg_type").alias("type")).alias("s"))
    g = legs.groupBy("opp_id").agg(F.first("flip_type").alias("type"), F.first("result_item_id").alias("result"),
        F.transform(F.array_sort(F.collect_list(leg)), lambda x: x["s"]).alias("steps"))
    c = constraints.groupBy("opp_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind",
        F.col("long_value").cast("string")))).alias("constraints"))
    j = g.join(c, "opp_id", "left").withColumn("constraints", F.coalesce("constraints", F.array().cast("array<string>")))
    j = j.withColumn("json", F.to_json(F.struct("constraints", "result", "steps", "type", F.lit(1).alias("version")),
        {"ignoreNullFields": "true"}))
    m = F.md5(F.col("json"))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(m, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    uuid = F.concat(F.substring(m, 1, 8), F.lit("-"), F.substring(m, 9, 4), F.lit("-3"), F.substring(m, 14, 3), F.lit("-"), variant,
        F.substring(m, 18, 3), F.lit("-"), F.substring(m, 21, 12))
    return j.select("opp_id", F.concat(F.lit("v1_"), F.sha2("json", 256)).alias("flip_key"), uuid.alias("stable_id"))


def auction_prices(listings: DataFrame, aliases: DataFrame) -> DataFrame:
    """(item_id, lowest, avg_value): least starting bid, and mean of highest bids (starting bids where there is none) in whole units, of the listings
    whose name contains one of the item's aliases. Listings are summed by name before names meet items."""
    value = F.when(F.col("highest_bid") > 0, F.col("highest_bid")).otherwise(F.col("starting_bid"))
    named = listings.groupBy("item_name").agg(F.min("starting_bid").alias("lowest"), F.sum(value).alias("sum"), F.count("*").alias("n"))
    met = named.join(match_items(named, aliases), "item_name").groupBy("item_id").agg(F.min("lowest").alias("lowest"), F.sum("sum").alias("sum"),
        F.sum("n").alias("n"))
    return met.select("item_id", "lowest", F.floor(F.col("sum") / F.col("n")).alias("avg_value"))


def conversion_cost(recipes: DataFrame, ingredients: DataFrame, quotes: DataFrame, listings: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per recipe: what its ingredients cost and its output sells for, from quotes (rounded) else the listings under the item's aliases; null where a price is missing."""
    q = quotes.select(F.col("product_id").alias("item_id"), F.when(F.col("buy_price") > 0, F.floor(F.col("buy_price") + 0.5)).alias("qb"),
        F.when(F.col("sell_price") > 0, F.floor(F.col("sell_price") + 0.5)).alias("qs"))
    p = q.join(auction_prices(listings, aliases), "item_id", "full_outer")
    p = p.select("item_id", F.coalesce("qb", "lowest").alias("buy_unit"), F.coalesce("qs", "avg_value").alias("sell_unit"))
    c = ingredients.join(p, "item_id",
        "left").groupBy("recipe_id").agg(F.when(F.count("buy_unit") == F.count("*"),
        F.sum(F.col("buy_unit") * F.col("amount"))).alias("cost"), (F.count("*") - F.count("buy_unit")).alias("missing"))
    j = recipes.select("recipe_id", F.col("output_item_id").alias("item_id")).join(c, "recipe_id",
        "left").join(p.select("item_id", "sell_unit"), "item_id", "left")
    profit = F.col("sell_unit") - F.col("cost")
    return j.select("recipe_id", "item_id", "cost", "missing", "sell_unit", profit.alias("profit"),
        F.when(F.col("cost") > 0, F.floor(profit * 10000.0 / F.col("cost") + 0.5) / 100.0).alias("profit_pct"))


def tax_context(election: DataFrame, perk: str = "DERPY", standard: float = 1.0, raised: float = 4.0) -> DataFrame:
    """One row: the listing multiplier, and whether election data are missing. election: mayor, active."""
    a = election.agg(F.count("*").alias("n"), F.max(F.when(F.col("active") & (F.upper("mayor") == perk), 1).otherwise(0)).alias("hit"))
    return a.select(F.lit(QUOTE_TAX).alias("quote_tax"), F.when(F.col("hit") == 1, raised).otherwise(standard).alias("listing_multiplier"),
        (F.col("n") == 0).alias("election_missing"))
