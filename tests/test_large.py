"""Cases that only larger tables have: quotes of one time, hot keys, long streams."""

import os

import duckdb
import pytest
from compare import rows_match
from pyspark.sql import functions as F

from marketlake.functions.exprs import DAY_MS
from marketlake.operators import features as X
from marketlake.operators import keys as K
from marketlake.operators import snapshots as S
from marketlake.plans import registry
from marketlake.sources import adapters as A
from marketlake.sources import files


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Tables whose events come in twos and threes at one time and product, and anomalous ones beside calm ones."""
    to, src = str(tmp_path_factory.mktemp("crowded")), "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"""COPY (SELECT event_id + 1000000 * i AS event_id, ts, user_id + 20 * i AS user_id, event_type, CASE WHEN i = 2 AND event_id % 4 = 0 THEN 5000 + event_id ELSE value + i END AS value,
      CASE WHEN i = 1 THEN '{{"k": 51}}' ELSE props END AS props FROM '{src}/events.parquet', (SELECT unnest([0, 1, 2]) AS i) WHERE i < 2 OR event_id % 2 = 0) TO '{to}/events.parquet'""")
    for t in os.listdir(src):
        if t != "events.parquet":
            os.symlink(f"{src}/{t}", f"{to}/{t}")
    return to


@pytest.mark.parametrize("name", ["o060_aggregate_quotes", "o065_bucket_rollup_quotes", "o066_bucket_rollup_listings", "o089_exclude_anomalies",
    "o065_bucket_rollup_stream", "o067_partial", "o086_qualify_groups"])
def test_quotes_of_one_time(spark, crowded, name):
    rows_match(spark, registry.QUERIES[name], registry.ORACLES[name], crowded)


def test_aggregate_keeps_rows_of_one_time(spark):
    q = spark.createDataFrame([(1, " a", 1.0, 1.0, 1, 1), (1, "A", 2.0, -1.0, 1, 1), (1, " ", 2.0, 1.0, 1, 1)],
        "snapshot_ts long, product_id string, buy_price double, sell_price double, buy_volume long, sell_volume long")
    assert sorted((r.product_id, r.buy_price) for r in S.aggregate_quotes(q).collect()) == [("A", 1.0), ("A", 2.0)]


def test_segments_from_joined_state(spark, sf):
    """The open segments come from a join by a shuffle, as on tables too large to broadcast."""
    key, name = "spark.sql.autoBroadcastJoinThreshold", "o156_trend_segments_stream"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        rows_match(spark, registry.QUERIES[name], registry.ORACLES[name], sf)
    finally:
        spark.conf.set(key, before)


def test_pages_meet_by_update_and_page(spark):
    """An update's pages do not come together in one task; of an update with a page missing none comes."""
    page = lambda u, p, n: '{"success":true,"page":%d,"totalPages":4,"lastUpdated":%d,"auctions":[{"uuid":"%s"}]}' % (p, u, n)
    rows = [page(u, p, f"{u}-{p}") for u in (5, 6) for p in range(4) if (u, p) != (6, 3)] + [page(5, 2, "5-2")]
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        out = files.parse_listing_pages(spark.createDataFrame([(r,) for r in rows], "value string"))
        assert sorted((r.snapshot_ts, r.auction_uuid) for r in out.collect()) == [(5, f"5-{p}") for p in range(4)]
        shuffles = exchanges_of(out)
    finally:
        spark.conf.set(key, before)
    assert not [e for e in shuffles if "auctions" in e[1] and "page" not in e[0]]


@pytest.mark.parametrize("most", ["-1", "10m"])
def test_pages_are_dealt_once(spark, tmp_path, most):
    """Pages are written and read as lines, go through one shuffle by update and page, and updates or pages without a number are told apart too."""
    page = lambda u, p, n, total=2: '{"success":true,"page":%s,"totalPages":%d,"lastUpdated":%s,"auctions":[{"uuid":"%s"}]}' % (p, total, u, n)
    rows = [page(5, 0, "a\\nb"), page(5, 1, "c"), page(5, 1, "c"), page(6, 0, "d"), page("null", 0, "e", 1), page("null", 0, "e", 1), page(7, 0, "f", 1),
        page(7, "null", "g", 1), page(7, "null", "g", 1), page(8, 0, "h", 1).replace("true", "false"), "{broken", "null"]
    key, to = "spark.sql.autoBroadcastJoinThreshold", f"{tmp_path}/pages"
    files.write_lines(spark.createDataFrame([(r,) for r in rows], "value string"), to)
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        out = files.read_listing_pages(spark, to)
        got = out.collect()
        dealt = [e for e in exchanges_of(out) if "auctions" in e[1]]
    finally:
        spark.conf.set(key, before)
    assert sorted((r.snapshot_ts or 0, r.auction_uuid) for r in got) == [(0, "e"), (5, "a\nb"), (5, "c"), (7, "f"), (7, "g")]
    assert len(dealt) == 1 and "page" in dealt[0][0]


def test_stored_pages_are_read_by_line(spark, sf):
    """A batch of a Parquet file would hold thousands of pages at once."""
    plan = registry.QUERIES["o001_read_listing_pages"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan json" in plan and "FileScan parquet" not in plan


def exchanges_of(df):
    """(partitioning, columns) of every shuffle of the first plan."""
    import re

    full = df._jdf.queryExecution().executedPlan()
    full = full.initialPlan() if full.nodeName() == "AdaptiveSparkPlan" else full
    found, todo = [], [full]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            found.append((node.outputPartitioning().toString(), re.sub(r"#\d+L?", "", node.output().toString())))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_gem_slots_share_letters(spark):
    df = spark.createDataFrame([("x", "Ruby SlotTopaz slot, jade gemstone"), ("OPAL GEMSTONE SLOT COMBAT GEMSTONE SLOT", None), ("ruby slotopaz slot", "combat gemstone")],
        "nm string, lore string")
    assert [r[0] for r in df.select(K.gem_slots("nm", "lore")).collect()] == [["Ruby", "Jade", "Topaz"], ["Combat", "Opal"], ["Ruby", "Topaz"]]


@pytest.mark.parametrize("name", ["o022_stars", "o023_reforge", "o024_gem_slots"])
def test_text_rules_read_texts_once(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Aggregate [nm#") and "_groupingexpression" not in plan.splitlines()[0], plan


@pytest.mark.parametrize("name, table, least", [("o122_value_with_features", "lineitem", 2), ("o100_quick_stats", "events", 2)])
def test_feeds_are_computed_once(spark, sf, name, table, least):
    """What several parts of the plan read is stored before: the plan that is left reads no table of the driver again."""
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{sf}/{table}.parquet") < least


def test_component_rounds_on_few_edges(spark, monkeypatch):
    """A round's rows lie in as many partitions as its edges need, not in the session's; edges of several tasks give the same."""
    from marketlake.llm import common

    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    edges = [(i, i + 1) for i in range(30)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001)]
    want = sorted([(n, 0) for n in range(31)] + [(1000 + i, 1000) for i in range(200)] + [(5000, 5000), (5001, 5000)])
    frozen, parts = common.frozen, []

    def counted(df):
        parts.append(df.rdd.getNumPartitions())
        return frozen(df)

    monkeypatch.setattr(common, "frozen", counted)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for size, most in ((65_536, 1), (100, 3)):
            monkeypatch.setattr(common, "EDGES_A_TASK", size, raising=False)
            parts.clear()
            got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
            assert sorted((r.node, r.component) for r in got) == want
            assert len(parts) > 2 and max(parts[1:]) <= most, parts  # the first holds the edges as they come
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_attempts_read_their_own_days(spark, sf, monkeypatch):
    """Each attempt of a run reads a table by day, of which the days of its buckets alone, and not the driver's events again."""
    from marketlake.operators import materialization as MZ

    inside, read = MZ._inside, []

    def noted(ticks, buckets, p):
        own = inside(ticks, buckets, p)
        read.append((len(buckets), own.inputFiles(), own._jdf.queryExecution().executedPlan().toString()))
        return own

    monkeypatch.setattr(MZ, "_inside", noted)
    registry.QUERIES["o153_due_buckets"](spark, sf)
    assert len(read) > 2 and not [f for _, files, _ in read for f in files if "events.parquet" in f]
    assert all("PartitionFilters: [isnotnull(day" in plan for _, _, plan in read), read[0][2]


def test_aliases_are_not_broadcast(spark, tmp_path):
    """Aliases grow with the items, and exploded rows look small to Spark: no join of names and aliases broadcasts what it reads."""
    spark.createDataFrame([("Large Ring ✪",), ("hot bolt",)], "item_name string").write.parquet(f"{tmp_path}/names")
    spark.createDataFrame([("P1", "large ring", "mc:large_ring"), ("P2", "bolt", "mc:b"), ("P3", "x", None)],
        "item_id string, display_name string, minecraft_id string").write.parquet(f"{tmp_path}/items")
    out = K.match_items(spark.read.parquet(f"{tmp_path}/names"), K.aliases(spark.read.parquet(f"{tmp_path}/items")))
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [("Large Ring ✪", "P1"), ("hot bolt", "P2")]


def test_auctions_do_not_broadcast_parts(spark, sf):
    plan = A.auction_snapshots(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_histories_in_one_plan(spark):
    """Several ranges at once are the histories of each; pairs of names and items lie by item before buckets multiply them."""
    t, h = 30 * DAY_MS, 3_600_000
    quotes = spark.createDataFrame([(t - 2 * h, "a", 10.0, 8.0, 5), (t - h, "a", 12.0, float("nan"), 6), (t - 3 * DAY_MS, "a", 4.0, None, None),
        (t - 20 * DAY_MS, " b ", 1.5, 2.0, 1), (t - h, None, 3.0, 2.0, 1), (t + 1, "late", 1.0, 1.0, 1)],
        "snapshot_ts long, product_id string, buy_price double, sell_price double, buy_volume long")
    auctions = spark.createDataFrame([(t - 2 * h, "Ring", 5, 0), (t - h, "Ring ✪", 7, 9), (t - h, "ring", 3, None), (t - 6 * DAY_MS, "Ring", 2, 4), (t - h, None, 1, 1)],
        "snapshot_ts long, item_name string, starting_bid long, highest_bid long")
    aliases = spark.createDataFrame([("R1", "RING"), ("R2", "RING"), ("a", "RING")], "item_id string, alias string")
    every = X.price_histories(quotes, t, ["24h", "7d", "30d"], auctions, aliases)
    rows, order = every.collect(), lambda some: sorted(map(str, some))
    assert order(x.asDict() for x in rows if x.range == "7d") == order({"range": "7d"} | x.asDict() for x in X.price_history(quotes, t, "7d", auctions,
        aliases).collect())
    stats = X.quick_stats_of(spark.createDataFrame(rows, every.schema))
    got = {r.item_id: tuple(r)[1:] for r in stats.collect()}
    assert got["A"] == (12, 0, 6, 20.0, -100.0, 4, 12, 4, 12, 100.0)  # of a bucket's snapshots the last; an auction six days before
    assert got["R1"] == (3, 6, 2, -40.0, 20.0, 2, 3, 4, -3, -100.0)
    assert got["B"] == (2, 2, 1, None, None, None, None, None, 0, 0.0)
    assert got[None] == (3, 2, 1, None, None, None, None, None, 1, 33.33)  # no item of the day or week
    assert not [e for e in exchanges_of(every) if "low" in e[1] and "item_id" in e[0] and "bucket" in e[0]]
