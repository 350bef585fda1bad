"""Durable runs, compaction, streams, segments and paging, by definition and across stops."""

import random

import pytest
from pyspark.sql import functions as F

from marketlake.operators import compaction as C
from marketlake.operators import keys as K
from marketlake.operators import maintenance as M
from marketlake.operators import materialization as MZ
from marketlake.operators import reads as D
from marketlake.operators import rollups as R
from marketlake.operators import snapshots as S
from marketlake.plans import q_streams
from marketlake.sources.files import children, read_or_empty
from marketlake.streaming import streams as ST

DAY = 86_400_000
POINT = "flip_key string, snapshot_ts long, profit long, roi_per_hour double, liquidity_score double, risk_score double, partial boolean"


def folds(rows, rel=0.05, points=3.0):
    """Segments point by point."""
    near = lambda a, b, limit: a is None and b is None or a is not None and b is not None and abs(a - b) <= limit
    out, base, key = [], None, None
    for k, *x in sorted(rows):
        same = base is not None and k == key and x[5] == base[5] and near(base[1], x[1], rel * abs(base[1] or 0)) and near(base[2], x[2], rel * abs(base[2] or 0))
        if same and near(base[3], x[3], points) and near(base[4], x[4], points):
            out[-1][2:4] = [x[0], out[-1][3] + 1]
        else:
            key, base = k, x
            out.append([k, x[0], x[0], 1, x[1]])
    return sorted(map(tuple, out))


def test_segments_point_by_point(spark):
    rng = random.Random(3)
    rows = []
    for key in range(12):
        walk, ts = [100.0 * (key - 4), 1.0, 50.0, 50.0], 0
        for _ in range(400 if key == 5 else 80):
            ts += rng.choice([1, DAY // 2, 40 * DAY])
            walk = [v + rng.choice([0, 0, s, -s]) for v, s in zip(walk, (2.5 if key % 3 else 40, 0.02, 1.5, 1.5))]
            gap = [None if key % 4 == 1 and rng.random() < 0.2 else v for v in walk]
            rows.append((f"k{key}", ts, None if gap[0] is None else int(gap[0]), gap[1], gap[2], gap[3], rng.random() < 0.05))
    frame = spark.createDataFrame(rows, POINT)
    want = folds(rows)
    assert sorted(tuple(r) for r in M.trend_segments(frame.repartition(5)).collect()) == want
    middle = sorted(r[1] for r in rows)[len(rows) // 2]
    stored = M.segment_table(frame.filter(F.col("snapshot_ts") <= middle), bucket_ms=DAY)
    got = M.backfill_segments(frame, stored)
    assert sorted((r.flip_key, r.base.snapshot_ts, r.valid_to, r.n, r.base.profit) for r in got.collect()) == want
    assert M.backfill_segments(frame.limit(0), stored).count() == stored.count()


def test_aliases_by_brute_force(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("ab_ C") for _ in range(rng.randrange(0, 9))) for _ in range(60)] + ["É ✪✪", "x"]
    aliases = [(f"i{k}", "".join(rng.choice("AB_ C") for _ in range(rng.randrange(0, 5)))) for k in range(60)] + [("e", "É"), ("none", "ZZZ")]
    got = K.match_items(spark.createDataFrame([(n,) for n in names], "item_name string"), spark.createDataFrame(aliases, "item_id string, alias string"))
    forms = lambda n: {n.strip(" ").upper(), n.strip(" ").upper().replace("_", "").replace(" ", "")}
    want = {(n, i) for n in names for i, a in aliases if a and any(a in f for f in forms(n))}
    assert {tuple(r) for r in got.collect()} == want


def ticks(spark, days, per_day=4):
    return spark.createDataFrame([(d * DAY + k * 3_600_000, "P1", 100.0 + k, 90.0, 10, 10) for d in days for k in range(per_day)],
        "snapshot_ts long, product_id string, buy_price double, sell_price double, buy_volume long, sell_volume long")


P = R.RollupParams(granularity="1d", cadence_ms=3_600_000)


def test_failed_buckets_are_known_and_repaired(spark, tmp_path):
    good, folder = ticks(spark, range(10, 18)), str(tmp_path)
    bad = good.withColumn("buy_price", F.when(F.col("snapshot_ts") >= 13 * DAY, F.when(F.col("snapshot_ts") < 14 * DAY,
        F.raise_error(F.lit("damaged")).cast("double")).otherwise(F.col("buy_price"))).otherwise(F.col("buy_price")))
    MZ.run(bad, folder, 1, 18 * DAY + 60_000, P)
    state = {r.bucket_start // DAY: (r.finalized, r.failed, r.raw_rows) for r in MZ.current_state(MZ.state_log(spark, folder)).collect()}
    assert state == {d: (d != 13, d == 13, 4 * (d != 13)) for d in range(10, 18)}
    assert MZ.finalized(spark, folder).count() == 7
    gate = lambda: {r.day: r.complete for r in MZ.gate(MZ.current_state(MZ.state_log(spark, folder)), good, MZ.finalized(spark, folder), {"1d": DAY}).collect()}
    assert gate() == {d: d != 13 for d in range(10, 18)}
    # a stopped attempt leaves a part without state, which nothing reads; a repeated run writes the same again
    R.bucket_rollup_quotes(good, P).write.parquet(f"{folder}/rollups/part=left")
    assert MZ.finalized(spark, folder).count() == 7
    for _ in range(2):
        MZ.run(good, folder, 2, 18 * DAY + 60_000, P)
        assert all(gate().values()) and MZ.finalized(spark, folder).count() == 8 and MZ.state_log(spark, folder).count() == 9
    assert MZ.due_and_failed(MZ.current_state(MZ.state_log(spark, folder)), good, 18 * DAY + 60_000, P).count() == 0
    MZ.run(good.limit(0), str(tmp_path / "none"), 1, DAY, P)
    assert MZ.finalized(spark, str(tmp_path / "none")) is None


def test_rollups_of_a_stream_go_on_after_a_stop(spark, tmp_path):
    folder, source, checkpoint = (str(tmp_path / x) for x in ("out", "in", "checkpoint"))
    schema = ticks(spark, [1]).schema
    for days, close in (((1, 2), False), ((3,), False), ((1, 4), True)):  # of day 1 the last rows come when it has closed
        ticks(spark, days).coalesce(1).write.mode("append").parquet(source)
        ST.materialize(spark.readStream.schema(schema).parquet(source), folder, checkpoint, P, close=close)
    want = sorted(map(tuple, R.bucket_rollup_quotes(ticks(spark, [1, 2, 3, 4]), P).collect()))
    got = MZ.finalized(spark, folder).select(*R.bucket_rollup_quotes(ticks(spark, [1]), P).columns)
    assert sorted(map(tuple, got.collect())) == want
    assert ST.landed_rows(spark, folder, schema, 99, "late").count() == 4


@pytest.mark.parametrize("name", sorted(q_streams.QUERIES))
def test_empty_streams(spark, tmp_path, name):
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert q_streams.QUERIES[name](spark, str(tmp_path)).count() == 0


def streamed(spark, tmp_path, batches, schema, apply, mode="append"):
    """Each batch is one file, and so one micro-batch."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(source)
    stream = apply(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    ST.run_to_table(stream, out, str(tmp_path / "checkpoint"), mode)
    return sorted(map(tuple, read_or_empty(spark, out, stream.schema).drop("batch_id").collect()))


def test_idle_feeds_begin_anew(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    rows = [[("a", 1000, "x", 1), ("a", 2000, "x", 2), ("b", 1500, None, 3)], [("b", 900_000, "y", 4)], [("a", 1_000_000, "x", 5), ("b", 1_000_000, "y", 6)]]
    got = streamed(spark, tmp_path, rows, "feed string, last_updated long, hash string, payload_id long", lambda s: ST.changed_updates(s, 200_000))
    assert [r[3] for r in sorted(got, key=lambda r: r[3])] == [1, 3, 4, 5]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_pairs_go_on_from_what_is_known(spark, tmp_path):
    known = spark.createDataFrame([("m", 7, 8, 100, 200, 200)], "market string, a long, b long, ta long, tb long, at long")
    rows = [[("m", "quotes", 50, 1), ("m", "listings", 250, 2), ("n", "quotes", 300, 3)], [("n", "listings", 400, 4), ("m", "quotes", 500, 5)]]
    got = streamed(spark, tmp_path, rows, "market string, feed string, ts long, payload long", lambda s: ST.pair_feeds(s, known))
    assert got == [("m", 250, "b", 7, 2), ("m", 500, "a", 5, 2), ("n", 400, "b", 3, 4)]


def test_compaction_survives_a_stop(spark, tmp_path):
    folder, schema, now = str(tmp_path), "snapshot_ts long, snapshot_id string", 20 * DAY
    snaps = spark.createDataFrame([(now - k * 7_000_000, f"s{k}") for k in range(-2, 150)], schema)
    C.append(snaps, folder)
    assert C.read_table(spark, folder, "raw", schema).count() == 152
    marked = M.retention_keepers(snaps, now)
    want = [{r.snapshot_id for r in marked.filter(c).collect()} for c in ("tier = 0", "tier > 0 AND keep")]
    read = lambda: [{r.snapshot_id for r in C.read_table(spark, folder, t, schema).collect()} for t in C.TABLES]
    C.compact(spark, folder, schema, now, switch=False)
    assert read() == [{r.snapshot_id for r in snaps.collect()}, set()]
    for _ in range(2):
        C.compact(spark, folder, schema, now)
        assert read() == want
    assert len(C.versions(spark, folder)) == 2  # nothing moved the second time
    C.vacuum(spark, folder, keep=1)
    assert read() == want and len(children(spark, f"{folder}/data")) <= 2
    C.append(spark.createDataFrame([(now + 1, "new")], schema), folder)
    assert read() == [want[0] | {"new"}, want[1]]


def test_seek_pages_are_offset_pages(spark):
    rows = [(f"s{k:02}", None if k % 5 == 0 else (k * 7) % 4, 1) for k in range(40)]
    df = spark.createDataFrame(rows, "stable_id string, liquidity_score long, x long")
    for direction in ("asc", "desc"):
        after, seen = None, []
        while page := D.seek_page(df, "liquidity_score", direction, after, 7).collect():
            assert {r.total for r in page} == {40}
            seen += [r.stable_id for r in page]
            after = (page[-1].liquidity_score, page[-1].stable_id)
        assert seen == [r.stable_id for r in D.sort_opportunities(df, "liquidity_score", direction).collect()]


def test_as_of_prefers_raw(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k string, snapshot_ts long, v string")
    got = S.as_of_join(frame([("a", t, "") for t in (5, 10, 15, 3 * DAY)]).drop("v"), frame([("a", 10, "raw")]), ["k"], retained=frame([("a", 4, "old"), ("a", 10, "kept"), ("a", 15, "kept later")]))
    assert [r.right_v for r in got.orderBy("snapshot_ts").collect()] == ["old", "raw", "kept later", "kept later"]
