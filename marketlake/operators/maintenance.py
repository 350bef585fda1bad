"""Trend segments, storage steps and retention of tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import DAY_MS, bucket_start, epoch_day
from .snapshots import first_per_key, upsert

TIERS = ((30 * 60_000, 60_000), (12 * 3_600_000, 7_200_000), (None, DAY_MS))
POINT = ("snapshot_ts", "profit", "roi_per_hour", "liquidity_score", "risk_score", "partial")


def _near(a: Column, b: Column, rel: float) -> Column:
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= rel * F.abs(a), F.lit(False))


def _within(a: Column, b: Column, points: float) -> Column:
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= points, F.lit(False))


def _continues(base: Column, x: Column, rel: float, points: float) -> Column:
    """Whether a point is like the first of the segment."""
    return base["partial"].eqNullSafe(x["partial"]) & _near(base["profit"], x["profit"], rel) & _near(base["roi_per_hour"],
        x["roi_per_hour"], rel) & _within(base["liquidity_score"], x["liquidity_score"], points) & _within(base["risk_score"],
        x["risk_score"], points)


def _apart(before: Column, x: Column, rel: float, points: float) -> Column:
    """Whether a point ends every segment that the point before it can belong to, whatever that began with; may be false for one that does."""

    def relative(c: str) -> Column:
        # a base that is like p lies between p / (1 + rel) and p / (1 - rel), and what is like that base a little further out
        p, v = before[c].cast("double"), x[c].cast("double")
        far = (1 + rel) / (1 - rel) * (1 + 1e-9)
        return (v < F.least(p * far, p / far)) | (v > F.greatest(p * far, p / far))

    fixed = lambda c: F.abs(before[c] - x[c]) > 2 * points * (1 + 1e-9)
    tests = [relative("profit"), relative("roi_per_hour"), fixed("liquidity_score"), fixed("risk_score")]
    gone = [before[c].isNull() != x[c].isNull() for c in ("profit", "roi_per_hour", "liquidity_score", "risk_score")]
    out = ~before["partial"].eqNullSafe(x["partial"])
    for t in (*gone, *[F.coalesce(t, F.lit(False)) for t in tests]):
        out = out | t
    return before.isNull() | out


def _islands(rows: DataFrame, rel: float, points: float, bucket_ms: int) -> DataFrame:
    """Adds __island, the time of the last point that begins a segment in any case. Points meet the one before them within buckets of time; the last
    point and the last island of a bucket are carried on, on one row a key and bucket."""
    point = F.struct(*POINT)
    rows = rows.withColumns({"__b": F.floor(F.col("snapshot_ts") / bucket_ms), "__x": point})
    past = Window.partitionBy("flip_key").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    same = ["flip_key", "__b"]
    last = rows.groupBy(*same).agg(F.max_by("__x", "snapshot_ts").alias("__last"))
    last = last.withColumn("__carry", F.lag("__last").over(Window.partitionBy("flip_key").orderBy("__b"))).drop("__last")
    own = Window.partitionBy(*same).orderBy("snapshot_ts")
    rows = rows.withColumn("__before", F.lag("__x").over(own)).join(last, same)
    head = F.when(_apart(F.coalesce("__before", "__carry"), F.col("__x"), rel, points), F.col("snapshot_ts"))
    rows = rows.withColumn("__head", head).drop("__before", "__carry", "__x")
    heads = rows.groupBy(*same).agg(F.max("__head").alias("__h"))
    heads = heads.withColumn("__carry", F.last("__h", ignorenulls=True).over(past)).drop("__h")
    here = F.last("__head", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__here", here).join(heads, same).withColumn("__island", F.coalesce("__here", "__carry")).drop("__b", "__head",
        "__here", "__carry")


def _heads(values: list[np.ndarray], first: np.ndarray, limits: tuple[float, float], base: np.ndarray | None) -> np.ndarray:
    """Which rows begin a segment. first: rows that do in any case; base: what the segment before the first row began with, if it may go on."""
    x = np.stack(values)  # profit, roi, liquidity, risk, partial
    heads, n = first.copy(), x.shape[1]
    edges = np.r_[np.flatnonzero(first), n]
    spans = [(0, int(edges[0]), base)] if base is not None and edges[0] > 0 else []
    spans += [(int(a) + 1, int(b), x[:, a]) for a, b in zip(edges[:-1], edges[1:]) if b - a > 1]
    for at, end, own in spans:
        size = 16
        while at < end:
            part = x[:, at : min(end, at + size)]
            tolerance = np.array([abs(own[0]) * limits[0], abs(own[1]) * limits[0], limits[1], limits[1], 0.0])[:, None]
            like = ((np.abs(part - own[:, None]) <= tolerance) | (np.isnan(part) & np.isnan(own)[:, None])).all(axis=0)
            if like.all():
                at, size = at + part.shape[1], size * 2
                continue
            at += int(like.argmin())
            heads[at] = True
            own, at, size = x[:, at], at + 1, 16
    return heads


def segment_table(history: DataFrame, stored: DataFrame | None = None, rel: float = 0.05, points: float = 3.0,
    bucket_ms: int = 30 * DAY_MS) -> DataFrame:
    """(flip_key, base, valid_to, n): the segments of each opportunity's history, going on from the newest stored one of its key.

    A point extends a segment while it is like the first of it, so where a segment ends depends on where it began. But a point
    that no segment of its predecessor can hold begins one in any case: histories are cut there, which plain columns find, and
    the pieces are read apart, a key's on many tasks. Only pieces of several points are looked at in Python, segment by segment
    on arrays, with the open segment as state.
    """
    rows = history.select("flip_key", *POINT).withColumns({"vf": F.col("snapshot_ts"), "w": F.lit(1).cast("long")})
    if stored is not None:  # the open segment is a point with the values it began with
        newest = first_per_key(stored, ["flip_key"], [F.desc("valid_to")])
        rows = rows.join(newest.select("flip_key", "valid_to"), "flip_key", "left").filter("valid_to IS NULL OR snapshot_ts > valid_to").drop("valid_to")
        rows = rows.unionByName(newest.select("flip_key", F.col("valid_to").alias("snapshot_ts"), *[F.col(f"base.{c}").alias(c) for c in POINT[1:]],
            F.col("base.snapshot_ts").alias("vf"), F.col("n").cast("long").alias("w")))
    cut = _islands(rows, rel, points, bucket_ms)
    order = ["flip_key", "__island", "snapshot_ts"]
    fields = ["flip_key", "vf", *POINT[1:], "snapshot_ts", "w", "__island"]
    profit = history.schema["profit"].dataType.simpleString()
    out = [("flip_key", pa.string()), ("vf", pa.int64()), ("profit", pa.float64() if profit == "double" else pa.int64()),
        *[(c, pa.float64()) for c in POINT[2:5]], ("partial", pa.bool_()), ("valid_to", pa.int64()), ("n", pa.int64())]
    schema = pa.schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, base = None, None, None  # the open segment's row, its (key, island), and its values as numbers
        for batch in batches:
            if not len(batch):
                continue
            column = dict(zip(fields, batch.columns))
            number = lambda c: column[c].cast(pa.float64()).to_numpy(zero_copy_only=False)
            values = [number(c) for c in POINT[1:5]] + [number_of_flag(column["partial"])]
            keys, islands = column["flip_key"].to_numpy(zero_copy_only=False), column["__island"].to_numpy()
            first = np.r_[group is None or (keys[0], islands[0]) != group, (keys[1:] != keys[:-1]) | (islands[1:] != islands[:-1])]
            at = np.flatnonzero(_heads(values, first, (rel, points), None if first[0] else base))
            to, upto = column["snapshot_ts"].to_numpy(), np.r_[0, np.cumsum(column["w"].to_numpy())]
            ends = np.r_[at[1:], len(batch)]
            grown = int(at[0]) if len(at) else len(batch)
            if held is not None and grown:
                held = {**held, "valid_to": int(to[grown - 1]), "n": held["n"] + int(upto[grown])}
            if not len(at):
                continue
            made = pa.RecordBatch.from_arrays([*[column[c].take(pa.array(at)) for c in fields[:7]], pa.array(to[ends - 1]), pa.array(upto[ends] - upto[at])],
                schema=schema)
            if held is not None:
                yield pa.RecordBatch.from_pylist([held], schema=schema)
            yield made.slice(0, len(at) - 1)
            held, group = made.slice(len(at) - 1).to_pylist()[0], (keys[-1], islands[-1])
            base = np.array([v[at[-1]] for v in values])
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], schema=schema)

    def number_of_flag(flags: pa.Array) -> np.ndarray:
        return flags.cast(pa.int8()).cast(pa.float64()).to_numpy(zero_copy_only=False)

    typed = cut.select("flip_key", F.col("vf").cast("long"), "profit", *[F.col(c).cast("double").alias(c) for c in POINT[2:5]], "partial", "snapshot_ts",
        "w", "__island")
    made = typed.repartition("flip_key", "__island").sortWithinPartitions(*order).mapInArrow(run,
        f"flip_key string, vf long, profit {profit}, roi_per_hour double, liquidity_score double, risk_score double, partial boolean, valid_to long, n long")
    return made.select("flip_key", F.struct(F.col("vf").alias("snapshot_ts"), *POINT[1:]).alias("base"), "valid_to", "n")


def trend_segments(history: DataFrame, rel: float = 0.05, points: float = 3.0) -> DataFrame:
    """(flip_key, valid_from, valid_to, points, profit): the segments of a history."""
    return segment_table(history, None, rel, points).select("flip_key", F.col("base.snapshot_ts").alias("valid_from"), "valid_to",
        F.col("n").cast("int").alias("points"), F.col("base.profit").alias("profit"))


def backfill_segments(history: DataFrame, stored: DataFrame, rel: float = 0.05, points: float = 3.0) -> DataFrame:
    """The stored segments (flip_key, base, valid_to, n) after any number of later snapshots, in one job: the newest of a key goes on, the others stay."""
    newest = first_per_key(stored, ["flip_key"], [F.desc("valid_to")])
    older = stored.join(newest.select("flip_key", "valid_to"), ["flip_key", "valid_to"], "left_anti")
    return older.select("flip_key", "base", "valid_to", F.col("n").cast("long").alias("n")).unionByName(segment_table(history, stored, rel, points))


def monotonic_guard(new: DataFrame, current: DataFrame) -> DataFrame:
    """Updates later than what is stored for their key."""
    known = current.groupBy("flip_key").agg(F.max("snapshot_ts").alias("__seen"))
    return new.join(known, "flip_key", "left").filter("__seen IS NULL OR snapshot_ts > __seen").drop("__seen")


def extend_segments(new: DataFrame, segments: DataFrame, rel: float = 0.05, points: float = 3.0) -> DataFrame:
    """The segments table after one snapshot: the newest segment of a key grows, or a new one begins. segments: flip_key, base (a point), valid_to, n."""
    newest = first_per_key(segments, ["flip_key"], [F.desc("valid_to")])
    j = new.select("flip_key", F.struct(*POINT).alias("x")).join(newest, "flip_key",
        "left").filter("valid_to IS NULL OR x.snapshot_ts > valid_to")
    ok = F.col("base").isNotNull() & _continues(F.col("base"), F.col("x"), rel, points)
    changed = j.select("flip_key", F.when(ok, F.col("base")).otherwise(F.col("x")).alias("base"), F.col("x.snapshot_ts").alias("valid_to"),
        F.when(ok, F.col("n") + 1).otherwise(1).alias("n"), ok.alias("__grew"), F.col("valid_to").alias("__old"))
    replaced = changed.filter("__grew").select("flip_key", F.col("__old").alias("valid_to"))
    return segments.join(replaced, ["flip_key", "valid_to"], "left_anti").unionByName(changed.drop("__grew", "__old"))


def store_opportunities(valued: DataFrame, definition: DataFrame, current: DataFrame, segments: DataFrame) -> dict[str, DataFrame]:
    """The three tables after storing a snapshot: definitions of new keys, the current row of each key, and its segments."""
    fresh = monotonic_guard(first_per_key(valued, ["flip_key"], ["snapshot_ts", "stable_id"]), current)
    defs = definition.unionByName(fresh.select(*definition.columns).join(definition.select("flip_key"), "flip_key", "left_anti"))
    return {"definition": defs, "current": upsert(fresh.select(*current.columns), current, ["flip_key"]),
        "segments": extend_segments(fresh.withColumn("profit", F.col("expected_profit")), segments)}


def retention_keepers(snaps: DataFrame, now: int, keep_ms: int = 90_000, tiers=TIERS) -> DataFrame:
    """Adds tier, slot and keep: rows newer than keep_ms stay; of each tier slot the earliest row stays."""
    age = F.lit(now) - F.col("snapshot_ts")
    tier, width = F.lit(len(tiers)), F.lit(tiers[-1][1])
    for i, (limit, step) in reversed(list(enumerate(tiers))):
        if limit is not None:
            tier, width = F.when(age <= limit, i + 1).otherwise(tier), F.when(age <= limit, step).otherwise(width)
    t = snaps.withColumn("tier", F.when(age < keep_ms, 0).otherwise(tier)).withColumn("slot",
        F.when(F.col("tier") == 0, F.col("snapshot_ts")).otherwise(F.floor(F.col("snapshot_ts") / width) * width))
    rn = F.row_number().over(Window.partitionBy("tier", "slot").orderBy("snapshot_ts", "snapshot_id"))
    return t.withColumn("keep", (F.col("tier") == 0) | (rn == 1))


def retention_plan(partitions: DataFrame, state: DataFrame, today: int, keep_days: int = 30) -> DataFrame:
    """(table, day, action, reason) of day partitions; finished days older than the window may be dropped."""
    j = partitions.join(state, ["table", "day"], "left")
    old = F.col("day") < today - (keep_days - 1)
    ready = F.coalesce("archived", F.lit(False))
    reason = F.when(~old, "WITHIN_RETENTION").when(~ready, "NOT_ARCHIVED").otherwise("OK")
    return j.select("table", "day", "rows", F.when(old & ready, "drop").otherwise("keep").alias("action"), reason.alias("reason"))


def archive_days(raw: DataFrame) -> DataFrame:
    """(day, snapshot_ts, snapshots): the earliest snapshot of each day, which is retained, and how many there were."""
    return raw.groupBy(epoch_day("snapshot_ts").alias("day")).agg(F.min("snapshot_ts").alias("snapshot_ts"),
        F.countDistinct("snapshot_ts").alias("snapshots"))


def drop_older(df: DataFrame, cutoff: int) -> DataFrame:
    return df.filter(F.col("snapshot_ts") >= cutoff)


def orphan_counts(orphan_opps: DataFrame, legs: DataFrame, constraints: DataFrame) -> DataFrame:
    """(what, n): opportunities, legs and constraints that go with them."""
    ids = orphan_opps.select("opp_id").distinct()
    parts = [(n, t) for n, t in (("opportunities", ids), ("legs", legs.join(ids, "opp_id", "left_semi")),
        ("constraints", constraints.join(ids, "opp_id", "left_semi")))]
    out = None
    for name, t in parts:
        row = t.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def slots(df: DataFrame, width_ms: int) -> DataFrame:
    return df.withColumn("slot", bucket_start("snapshot_ts", width_ms))
