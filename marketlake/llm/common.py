"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts name it: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a local folder only in local mode, where it is unset."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        spark.sparkContext.setCheckpointDir(named)
    elif spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def frozen(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder: lineage is cut and a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder, read again."""
    folder = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: A table is broadcast up to so many bytes.
BROADCAST_BYTES = 64_000_000


def bounded(df: DataFrame, size: int) -> DataFrame:
    """df marked for a broadcast where its counted size allows; else it is shuffled."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows while an eager step runs; bounds the memory of Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_udf(make: Callable[[], Callable[[list], object]], spark_type: str, arrow_type: pa.DataType, rows: int = 500):
    """A column function of whole texts; make() gives, once a task, the function from a list of texts to their values.

    Only texts go to Python and only values come back, so that ids and other
    columns never leave the JVM. Spark bounds a batch in bytes; within one, so
    many rows are Python objects at a time.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make()
        for batch in batches:
            parts = [pa.array(fn(batch.slice(at, rows).to_pylist()), type=arrow_type) for at in range(0, len(batch), rows)]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=arrow_type)

    return F.arrow_udf(run, spark_type)


#: A key is hot with more than 1/HOT of the rows; fewer than HOT keys can be.
HOT = 1024


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = 64) -> DataFrame:
    """left joined with right, whose key is unique. Hot keys' rows are dealt over salts, on each of which right's row stands; null keys too.

    left is read twice, once to count its keys, and should be frozen.
    """
    keyed = left.select(key).filter(F.col(key).isNotNull())
    bound = max(1, keyed.count() // HOT)
    hot = frozen(keyed.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > bound).select(key,
        F.lit(True).alias("__hot")))  # fewer than HOT rows
    at = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("__salt",
        F.when(F.col("__hot") | F.col(key).isNull(), at).otherwise(0)).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    known = right.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return dealt.join(known, [key, "__salt"], how).drop("__salt")


def _meet_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with m of least (u, m, n), n counting u among the rows; hubs meet it where they are read."""
    bound = max(1, total // HOT)
    hubs = F.broadcast(least.filter(F.col("n") > bound).select("u", "m"))  # fewer than HOT rows
    rest = rows.join(hubs.select("u"), "u", "left_anti").join(least.filter(F.col("n") <= bound).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(rest)


#: A task of a component round holds so many edges, of two longs each.
EDGES_A_TASK = 65_536


def _few(df: DataFrame, edges: int) -> DataFrame:
    """df in as many partitions as its edges need, where that is fewer than a shuffle makes: a round on few edges leaves few files and tasks."""
    parts = -(-edges // EDGES_A_TASK)
    return df.coalesce(max(1, parts)) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a long, b long) -> (node, component): component is the least node reachable.

    Large-star and small-star rounds in turn, each a group-by with map-side
    combine and a join, in which hubs, with more than 1/HOT of the edges, are
    not shuffled; rounds are checkpointed. Nodes without an edge are absent.
    A round's shuffles stay on disk until the driver collects its garbage, so
    that the edges, not the session, say how many tasks write them.
    """
    spark = edges.sparkSession
    now = frozen(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n = now.count()
    if not n:
        return spark.createDataFrame([], "node long, component long")
    seen = None
    for _ in range(rounds):
        both = _few(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * n)
        least = _few(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), 2 * n)
        large = _few(_meet_least(both, least, 2 * n), 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _few(large.distinct(), n)
        least = _few(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), n)
        small = _few(_meet_least(large, least, n), n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = frozen(_few(small.union(least.select("u", F.col("m").alias("v"))).distinct(), n))
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("s")).first()
        if seen == mark:
            break
        seen, n = mark, mark[0]
    else:
        raise RuntimeError("components did not settle")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.union(pairs.select(F.col("component").alias("node"), "component").distinct())
