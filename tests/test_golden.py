"""Hand-computed values and invariants of the market operators."""

from pyspark.sql import functions as F

from marketlake.functions import stats
from marketlake.functions.exprs import rel_spread, round_half_up
from marketlake.operators import rollups as R
from marketlake.operators import snapshots as S
from marketlake.operators import valuation as V
from marketlake.operators.maintenance import trend_segments


def one(df):
    return df.first().asDict()


def test_percentiles_and_mad(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4)], "g int, x double")
    r = one(df.groupBy("g").agg(stats.percentile("x", 0.25).alias("a"), stats.percentile("x", 0.75).alias("b"), stats.median("x").alias("m")))
    assert (r["a"], r["b"], r["m"]) == (1.75, 3.25, 2.5)
    df = spark.createDataFrame([(1, float(x)) for x in (10, 11, 12, 20)], "g int, x double")
    assert one(stats.medians_and_mads(df, ["g"], ["x"]))["x_mad"] == 1.0
    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 100)], "g int, x double")
    assert one(stats.winsorized_mean(df, ["g"], "x", 0.25, 0.75))["x_wins"] == 8.5


def test_half_up_and_spread(spark):
    r = one(spark.range(1).select(round_half_up(F.lit(-2.5)).alias("a"), round_half_up(F.lit(2.5)).alias("b"), rel_spread(F.lit(3.0), F.lit(1.0)).alias("s"), rel_spread(F.lit(3.0), F.lit(None).cast("double")).alias("n")))
    assert (r["a"], r["b"], r["s"], r["n"]) == (-2, 3, 1.0, 1.0)


def listing(name, price, bin_=True, bid=0, claimed=False, end=2000, lore=None, extra=None):
    return (1000, "u", name, "weapon", "epic", price, bid, 0, end, claimed, bin_, lore, extra)


LISTING = "snapshot_ts long, auction_uuid string, item_name string, category string, tier string, starting_bid long, highest_bid long, start_ts long, end_ts long, claimed boolean, bin boolean, item_lore string, extra string"


def test_listing_aggregate(spark):
    rows = [listing("Axe", p, end=2000 if p <= 400 else 9_000_000) for p in range(100, 700, 100)] + [listing("Axe", 1, False, b, end=9_000_000) for b in (150, 250)] + [listing("Axe", 5, claimed=True)]
    r = one(S.aggregate_listings(spark.createDataFrame(rows, LISTING)))
    assert r == {"snapshot_ts": 1000, "item_key": "AXE|T:EPIC|C:WEAPON|P:-", "bin_lowest": 100, "bin_lowest5_mean": 300, "bin_p50": 300, "bin_p95": 500, "bid_p50": 150, "bin_count": 6, "ending_soon_count": 4}
    assert S.aggregate_listings(spark.createDataFrame([listing("Bow", 0, False, 10)], LISTING)).count() == 0


def ticks(spark, buys, volumes=None):
    t0 = 1_773_482_400_000
    volumes = volumes or [1000] * len(buys)
    return spark.createDataFrame([(t0 + 5000 * i, "A", b, b - 1, v, v) for i, (b, v) in enumerate(zip(buys, volumes))], "snapshot_ts long, product_id string, buy_price double, sell_price double, buy_volume long, sell_volume long")


def test_spike_segment(spark):
    p = R.RollupParams(granularity="1m")
    t = ticks(spark, [100.0, 100.1, 100.2, 150.0, 151.0, 100.0, 100.1])
    s = R.quote_segments(t, p).collect()
    assert len(s) == 1 and s[0].sample_count == 2 and s[0].reason == "PRICE_SPIKE"
    assert one(R.bucket_rollup_quotes(t, p))["median_mid"] < 110
    assert R.quote_segments(ticks(spark, [100.0, 100.1, 100.2, 150.0, 100.2, 100.0, 100.1]), p).count() == 0
    low = R.quote_segments(ticks(spark, [100.0] * 6, [1000, 1020, 1010, 50, 45, 1000]), p).collect()
    assert [x.reason for x in low] == ["LIQUIDITY_COLLAPSE"]


def test_fees(spark):
    f = lambda g, h, m: tuple(spark.range(1).select(*V.listing_fees(F.lit(g).cast("long"), F.lit(h), m)).first())
    assert f(20_000_000, 12, 1.0) == (400_000, 100, 200_000)
    assert sum(f(20_000_000, 12, 4.0)) == 2_400_100
    assert f(1_000_100, 12, 1.0)[2] == 100
    assert spark.range(1).select(V.quote_fee(F.lit(999))).first()[0] == 13


def test_risk(spark):
    o = spark.createDataFrame([("a", 80.0, 6.0)], "opp_id string, execution_risk double, exposure_hours double")
    assert abs(V.total_risk(o, None, None).first().risk_score - 86.0) < 1e-9
    s = spark.createDataFrame([("a", "I")], "opp_id string, item_id string")
    feature = "product_id string, micro_volatility double, micro_return double, micro_confidence string, macro_volatility double, macro_return double, macro_confidence string"
    f = spark.createDataFrame([("I", 0.03, 0.05, "HIGH", 0.12, 0.20, "HIGH")], feature)
    o = spark.createDataFrame([("a", 20.0, 0.0)], o.schema)
    assert abs(V.total_risk(o, s, f).first().risk_score - 61.3) < 1e-9


def test_exposure_floors_at_zero(spark):
    legs = [("a", 0, "BUY", 100, 0, 0, False), ("a", 1, "SELL", 0, 5, 500, False), ("a", 2, "BUY", 90, 0, 0, False)]
    df = spark.createDataFrame(legs, "opp_id string, leg_no int, leg_type string, leg_cost long, upfront long, proceeds long, implicit boolean")
    assert V.exposure(df).first().peak_exposure == 105


def test_segments_compare_with_their_first_point(spark):
    rows = [("k", i, p, 1.0, 50.0, 50.0, False) for i, p in enumerate((100, 104, 108, 109))]
    df = spark.createDataFrame(rows, "flip_key string, snapshot_ts long, profit long, roi_per_hour double, liquidity_score double, risk_score double, partial boolean")
    s = trend_segments(df).orderBy("valid_from").collect()
    assert [(x.valid_from, x.valid_to, x.points) for x in s] == [(0, 1, 2), (2, 3, 2)]


def test_plans(spark, sf):
    from marketlake.operators import reads
    from marketlake.sources import adapters as A

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(reads.top_opportunities(A.opportunities(spark, sf), 10))
    p = plan(R.bucket_rollup_quotes(A.quote_ticks(spark, sf)))
    assert "CartesianProduct" not in p and "Python" not in p


def test_as_of_join_carries_over_days(spark):
    day = 86_400_000
    right = [("a", 5, 1.0), ("a", day + 7, 2.0), ("a", day + 7, 2.0), ("b", 3 * day, 9.0), (None, 10, 4.0)]
    left = [(k, t) for k in ("a", "b", "c", None) for t in (0, 5, 6, day + 6, day + 7, 9 * day)]
    got = S.as_of_join(spark.createDataFrame(left, "k string, snapshot_ts long"), spark.createDataFrame(right, "k string, snapshot_ts long, v double"), ["k"]).collect()

    def want(k, t):
        known = [(s, v) for x, s, v in right if x == k and s <= t]
        return max(known) if known else (None, None)

    assert len(got) == len(left)
    assert {(r.k, r.snapshot_ts): (r.right_snapshot_ts, r.right_v) for r in got} == {(k, t): want(k, t) for k, t in left}


def test_changed_updates_carry_over_hours(spark):
    from marketlake.operators import reads

    hour = 3_600_000
    rows = [("q", i * hour // 3, h, i) for i, h in enumerate(["x", "x", None, None, "x", "y", "y", "y", "y", "z", "y"])] + [("l", 40 * hour, "x", 99), ("l", 90 * hour, "x", 100)]
    got = reads.changed_updates(spark.createDataFrame(rows, "feed string, last_updated long, hash string, payload_id long"))
    assert sorted(r.payload_id for r in got.collect()) == [0, 2, 4, 5, 9, 10, 99] and got.columns == ["feed", "last_updated", "hash", "payload_id"]


def test_route_timings_are_exact(spark):
    import numpy as np

    from marketlake.operators import reads

    rng = np.random.default_rng(1)
    rows = [(r, float(x), "GET", "200", "OK") for r in "ab" for x in rng.integers(0, 40, 57)] + [("c", None, "GET", "200", "OK")]
    got = {r.route: r for r in reads.route_timings(spark.createDataFrame(rows, "route string, duration_ms double, method string, status string, outcome string")).collect()}
    for route in "ab":
        own = [x for r, x, *_ in rows if r == route]
        assert np.allclose([got[route].p95_ms, got[route].p99_ms, got[route].mean_ms], [*np.percentile(own, [95, 99]), np.mean(own)])
    assert got["c"].p95_ms is None and got["c"].requests == 1


def test_price_stats_count_duplicates(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(int(g), int(x)) for g in range(6) for x in rng.integers(1, 9, 1 + g * 7)]
    got = {r.g: r for r in S.price_stats(spark.createDataFrame(rows, "g int, starting_bid long"), ["g"]).collect()}
    for g, r in got.items():
        own = sorted(x for k, x in rows if k == g)
        at = lambda p: own[int(p * (len(own) - 1))]
        assert (r.lowest, r.second_lowest, r.highest, r.median, r.p25, r.sample_size) == (own[0], own[min(1, len(own) - 1)], own[-1], at(0.5), at(0.25), len(own))
        assert abs(r.average - np.mean(own)) < 1e-9


def test_segments_of_long_histories_and_nulls(spark):
    rows = [("k", i, 100 + i % 3, None, None, 50.0, None) for i in range(5000)] + [("n", 1, None, 1.0, 5.0, 5.0, True), ("n", 2, None, 1.0, 9.0, 5.0, True), ("n", 3, 7, 1.0, 9.0, 5.0, True)]
    df = spark.createDataFrame(rows, "flip_key string, snapshot_ts long, profit long, roi_per_hour double, liquidity_score double, risk_score double, partial boolean")
    got = sorted((r.flip_key, r.valid_from, r.valid_to, r.points) for r in trend_segments(df.repartition(5)).collect())
    assert got == [("k", 0, 4999, 5000), ("n", 1, 1, 1), ("n", 2, 2, 1), ("n", 3, 3, 1)]
    assert trend_segments(df.limit(0)).count() == 0


def test_fingerprint_of_files(spark, tmp_path):
    from marketlake.sources import files

    for n in ("a", "b", "c"):
        (tmp_path / n).write_text(f"text of {n}")
    first = one(files.catalog_fingerprint(files.catalog_files(spark, str(tmp_path))))
    same = spark.createDataFrame([(n, bytearray(f"text of {n}".encode())) for n in "cab"], "name string, content binary")
    assert first["files"] == 3 and one(files.catalog_fingerprint(same)) == first
    (tmp_path / "a").write_text("other")
    assert one(files.catalog_fingerprint(files.catalog_files(spark, str(tmp_path))))["fingerprint"] != first["fingerprint"]


def test_hydrated_pages_keep_unmatched_rows(spark):
    from marketlake.operators import reads

    ranked = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    got = reads.hydrate(ranked, spark.createDataFrame([("b", 7), ("c", 8)], "id string, x int"), "id").collect()
    assert [(r.id, r["rank"], r.x) for r in got] == [("a", 1, None), ("b", 2, 7)]


def test_tax_context_and_features_change_the_value(spark, sf):
    from marketlake.plans import q_value as Q

    plain = {r.opp_id: r for r in Q.valued(spark, sf).collect()}
    full = {r.opp_id: r for r in Q.valued_with_features(spark, sf).collect()}
    assert plain.keys() == full.keys()
    assert all("MISSING_ELECTION_DATA" in plain[k].partial_reasons and "MISSING_ELECTION_DATA" not in full[k].partial_reasons for k in plain)
    assert any(plain[k].fees < full[k].fees for k in plain) and any(plain[k].risk_score != full[k].risk_score for k in plain)


def test_no_window_takes_a_whole_log(spark, sf):
    from marketlake.operators import reads
    from marketlake.sources import adapters as A

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (reads.changed_updates(A.payload_updates(spark, sf)), S.as_of_join(A.quote_ticks(spark, sf).select("product_id", "snapshot_ts", "k"), A.quote_grid(spark, sf).select("product_id", "snapshot_ts", "buy_price"), ["product_id"])):
        windows = [x for x in plan(df).split("\n") if "Window [" in x]
        assert len(windows) == 2 and sum("__b" in x.split("windowspecdefinition(", 1)[1].split("ASC")[0].split("__t")[0] for x in windows) >= 1
        assert "Aggregate [" in plan(df)
