"""Compaction of raw and retained snapshot tables as a staged job behind a manifest.

Partitions of a table are folders, one a day, and a version of the manifest is a
small table that names those that count. A compaction writes the days that
change to a folder of its own, then the next version of the manifest, which is
the switch: a stop before it leaves the tables as they were, and the next
compaction begins again. Days in which nothing moves keep their folders.

Tables below the folder: data/<id>/table=<raw|retained>/day=..., manifest/v=...
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import epoch_day
from ..sources.files import children, delete
from .maintenance import TIERS, retention_keepers

MANIFEST = "table string, day long, path string, rows long"
TABLES = ("raw", "retained")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions of the manifest."""
    found = [x for x in children(spark, f"{folder}/manifest") if x.rsplit("/", 1)[-1].startswith("v=")]
    return sorted(int(x.rsplit("=", 1)[-1]) for x in found if any(y.endswith("/_SUCCESS") for y in children(spark, x)))


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> list[tuple[str, int, str, int]]:
    """(table, day, path, rows) of a version, by default the newest: a few words a day."""
    known = versions(spark, folder)
    if not known:
        return []
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/v={known[-1] if version is None else version}")
    return sorted(tuple(r) for r in rows.collect())


def read_table(spark: SparkSession, folder: str, table: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a table; schema is that of its rows."""
    paths = [p for t, _, p, _ in manifest(spark, folder, version) if t == table]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _stage(df: DataFrame, folder: str) -> list[tuple[str, int, str, int]]:
    """Writes rows (table, day, ...) to a new folder; gives their manifest entries."""
    to = f"{folder}/data/{uuid.uuid4().hex}"
    df.repartition("table", "day").write.partitionBy("table", "day").parquet(to)
    written = df.sparkSession.read.schema(df.schema).parquet(to).groupBy("table", "day").agg(F.count("*").alias("n"))
    return [(r.table, r.day, f"{to}/table={r.table}/day={r.day}", r.n) for r in written.collect()]


def _publish(spark: SparkSession, folder: str, entries: list[tuple[str, int, str, int]]) -> None:
    version = max(versions(spark, folder), default=0) + 1
    spark.createDataFrame(sorted(entries), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/v={version}")


def append(df: DataFrame, folder: str, table: str = "raw") -> None:
    """Adds rows with a snapshot_ts to a table."""
    spark = df.sparkSession
    fresh = _stage(df.withColumns({"table": F.lit(table), "day": epoch_day("snapshot_ts")}), folder)
    _publish(spark, folder, manifest(spark, folder) + fresh)


def compact(spark: SparkSession, folder: str, schema: str, now: int, keep_ms: int = 90_000, tiers=TIERS, switch: bool = True) -> None:
    """Rows older than keep_ms leave the raw table; of each tier slot the earliest row stays, in the retained table.

    A snapshot that both tables have is the raw one. Slots lie within a UTC day, so days are decided one by one. Without
    `switch` the job stops before the manifest, as a lost driver would.
    """
    entries = manifest(spark, folder)
    rows = None
    for table in TABLES:
        own = read_table(spark, folder, table, schema).withColumn("__from", F.lit(table))
        rows = own if rows is None else rows.unionByName(own.join(rows.select("snapshot_ts").distinct(), "snapshot_ts", "left_anti"))
    marked = retention_keepers(rows, now, keep_ms, tiers).withColumn("day", epoch_day("snapshot_ts"))
    marked = marked.withColumn("table", F.when(F.col("tier") == 0, "raw").when(F.col("keep"), "retained"))
    stays = F.coalesce(F.col("table") == F.col("__from"), F.lit(False))
    kept = {(r["__from"], r.day): r.n for r in marked.filter(stays).groupBy("__from", "day").agg(F.count("*").alias("n")).collect()}
    held: dict[tuple[str, int], int] = {}
    for table, day, _, n in entries:
        held[table, day] = held.get((table, day), 0) + n
    changed = sorted({day for at, n in held.items() for day in [at[1]] if kept.get(at, 0) != n})
    if not changed:
        return
    days = spark.createDataFrame([(d,) for d in changed], "day long")
    moved = marked.filter("table IS NOT NULL").join(F.broadcast(days), "day", "left_semi")  # one number a day
    fresh = _stage(moved.select(*read_table(spark, folder, "raw", schema).columns, "table", "day"), folder)
    if switch:
        _publish(spark, folder, [e for e in entries if e[1] not in set(changed)] + fresh)


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Deletes the folders of data that none of the newest versions names, and older versions of the manifest."""
    known = versions(spark, folder)
    named = {p.split("/table=")[0] for v in known[-keep:] for _, _, p, _ in manifest(spark, folder, v)}
    for x in children(spark, f"{folder}/data"):
        if not any(x.endswith(n[len(folder) :]) for n in named):
            delete(spark, x)
    for v in known[:-keep]:
        delete(spark, f"{folder}/manifest/v={v}")
