"""Prefix trie of rebuilt conversations by whole-sequence collapse.

A conversation is rebuilt from the first turns of the one it was forked from and
its own later turns. A prefix is named by its depth and two sums of 64-bit
hashes, one for each (depth, SHA-256 of role and text) on it: sums that a window
adds up, run by run, so that no conversation has to fit one task. Identical
rebuilt conversations collapse into one sequence with a weight, its least
conversation and the list of its conversations; sequences that are proper
prefixes of others go by an anti-join, what stays are the leaves. The prefixes of
the distinct sequences, weighted, are aggregated into nodes; all aggregates
combine before the shuffle, so that the root and other prefixes that most
conversations share cost one row a task.

Sums over a subtree need no walk over ancestors. Members times code points add
up along each sequence: what it has from a node on, times its weight. Distinct
nodes are counted once by giving each to its least sequence: a sequence owns the
end of its path, from some depth on, and brings the code points it owns to all
nodes above.

Lists of conversations are put in order by range partitions that a list may
span, written as runs of text, and hashed run after run with bounded memory.

Defined results: null roles and texts are empty; turns without conversation are
left out; turns of equal number (null numbers are equal, and first) stand in
order of role, then of the text's first 128 code points, then of SHA-256, and
repeated rows are turns of their own; a conversation left without turns belongs
to the root alone; texts of any length are read whole, in the JVM; an empty table gives no row, no root either. Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen, join_hot

#: A prefix's name.
KEY = ["depth", "s1", "s2"]
_HASH = "decimal(38,0)"


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text") -> DataFrame:
    """(conv_id, place, digest, chars): turns with their place in the conversation, from 1 on.

    Turns are ranked inside ranges of (conversation, turn) that Spark cuts, and the counts of a conversation's earlier
    ranges are added: a conversation may span any number of ranges.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.substring(text, 1, 128).alias("head"), digest.alias("digest"),
        F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("head"), F.asc("digest"), F.asc("row")]
    rows = rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    inside = Window.partitionBy("range", "conv_id").orderBy(*order)
    rows = frozen(rows.withColumn("rank", F.row_number().over(inside)).select("conv_id", "range", "rank", "digest", "chars"))
    sizes = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    later = sizes.withColumn("before", before).filter("before > 0").select("conv_id", "range", "before")  # at most one a range
    return rows.join(F.broadcast(later), ["conv_id", "range"], "left").select("conv_id",
        (F.col("rank") + F.coalesce("before", F.lit(0))).cast("long").alias("place"), "digest", "chars")


def rebuilt(conversations: DataFrame, fork: int = 100, most: int = 6, **columns) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id), (turns: conv_id, depth, digest, chars) after each conversation c has been rebuilt.

    It begins with the first h turns of conversation c - c % fork, where h is the CRC-32 of its decimal number modulo `most`,
    and goes on with its own turns after the first h.
    """
    turns = numbered(conversations, **columns)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = frozen(turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % fork).alias("base"),
        head.alias("h")))
    start = turns.filter(F.col("place") < most)
    start = start.filter(F.col("conv_id") % fork == 0).select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    first = convs.join(start, "base").filter("place <= h")  # under `most` turns for each of at most 2 * fork conversations
    taken = start.groupBy("base").agg(F.count("*").alias("have"))
    shift = convs.join(taken, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("have", F.lit(0))).alias("taken"))
    own = join_hot(turns, shift, "conv_id").filter("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("taken"))
    both = [x.select("conv_id", F.col("place").alias("depth"), "digest", "chars") for x in (first, own)]
    return convs.select("conv_id"), both[0].unionByName(both[1])


def prefixes(turns: DataFrame, run: int = 4096) -> DataFrame:
    """(conv_id, depth, s1, s2, chars, before): each prefix of a conversation but the empty one; before: code points above its last turn."""
    hashed = lambda seed: F.xxhash64(F.lit(seed), "depth", "digest").cast(_HASH)
    rows = frozen(turns.select("conv_id", "depth", hashed(1).alias("h1"), hashed(2).alias("h2"), "chars",
        F.floor(F.col("depth") / run).alias("run")))
    w = Window.partitionBy("conv_id", "run").orderBy("depth")
    here = {c: F.sum(x).over(w).cast(_HASH) for c, x in (("s1", "h1"), ("s2", "h2"), ("upto", "chars"))}
    inside = rows.withColumns(here)
    sums = rows.groupBy("conv_id", "run").agg(*[F.sum(x).cast(_HASH).alias(f"r_{x}") for x in ("h1", "h2", "chars")])
    past = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "run", *[F.coalesce(F.sum(f"r_{x}").over(past), F.lit(0)).cast(_HASH).alias(f"r_{x}") for x in ("h1", "h2",
        "chars")])
    add = lambda a, b: (F.col(a) + F.col(b)).cast(_HASH)
    return inside.join(sums, ["conv_id", "run"]).select("conv_id", "depth", add("s1", "r_h1").alias("s1"), add("s2", "r_h2").alias("s2"),
        "h1", "h2", "chars", (add("upto", "r_chars") - F.col("chars")).cast("long").alias("before"))


def end_lists(ends: DataFrame, run_bytes: int = 1 << 14) -> DataFrame:
    """(depth, s1, s2, conv_id) to (depth, s1, s2, ends_sha256): SHA-256 of each prefix's conversations, ascending, joined by commas."""
    text = ends.select(F.concat_ws("/", *[F.col(c).cast("string") for c in KEY]).alias("name"), "conv_id")
    kept = pa.schema([("name", pa.string()), ("first", pa.int64()), ("ids", pa.binary())])

    def runs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, ids, size = None, None, [], 0
        out: list[tuple] = []
        for batch in rows:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != name or size >= run_bytes:
                    if ids:
                        out.append((name, first, ",".join(ids).encode()))
                    name, first, ids, size = key, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield _rows(out)
            out = []
        if ids:
            yield _rows([(name, first, ",".join(ids).encode())])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kept)], schema=kept)

    def digests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in rows:
            done: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                if key != name:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_buffer())
            yield _hex(done)
        if state is not None:
            yield _hex([(name, state.hexdigest())])

    def _hex(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [[]] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["name", "ends_sha256"])

    ranged = text.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    cut = ranged.mapInArrow(runs, "name string, first long, ids binary")
    one = cut.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digests, "name string, ends_sha256 string")
    part = F.split("name", "/")
    return one.select(part[0].cast("long").alias("depth"), part[1].cast(_HASH).alias("s1"), part[2].cast(_HASH).alias("s2"), "ends_sha256")


def trie(conversations: DataFrame, fork: int = 100, most: int = 6, run: int = 4096, **columns) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(conversations, fork, most, **columns)
    paths = frozen(prefixes(turns, run))
    zero = F.lit(0).cast(_HASH)
    # whole sequences: the deepest prefix of each conversation, none for one without turns
    last = paths.groupBy("conv_id").agg(F.max_by(F.struct(*KEY, (F.col("before") + F.col("chars")).alias("total")), "depth").alias("l"))
    none = F.struct(F.lit(0).cast("long").alias("depth"), zero.alias("s1"), zero.alias("s2"), F.lit(0).cast("long").alias("total"))
    whole = frozen(convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("l", none).alias("l")).select("conv_id", "l.*"))
    sequences = frozen(whole.groupBy(*KEY, "total").agg(F.count("*").alias("weight"), F.min("conv_id").alias("first")))
    # the prefixes of distinct sequences: those of each one's least conversation, and the root
    mine = sequences.select(F.col("first").alias("conv_id"), "weight", F.col("total"))
    own = join_hot(paths, mine, "conv_id")
    root = mine.select("conv_id", F.lit(0).cast("long").alias("depth"), zero.alias("s1"), zero.alias("s2"), zero.alias("h1"), zero.alias("h2"),
        F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("before"), "weight", "total")
    paths = frozen(own.select(*root.columns).unionByName(root))
    nodes = frozen(paths.groupBy(*KEY).agg(F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("chars").alias("chars"),
        F.first("before").alias("before"), F.first("h1").alias("h1"), F.first("h2").alias("h2")))
    # proper prefixes, each the parent of a node
    parents = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), (F.col("s1") - F.col("h1")).cast(_HASH).alias("s1"),
        (F.col("s2") - F.col("h2")).cast(_HASH).alias("s2"))
    proper = parents.groupBy(*KEY).agg(F.count("*").alias("n_children"))
    # leaves: sequences that are no proper prefix of another
    leaves = sequences.join(proper, KEY, "left_anti").select(F.col("first").alias("conv_id"), F.lit(1).alias("leaf"))
    # each node belongs to its least sequence, which so owns the end of its path from depth `since` on
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("since"), F.min_by("before", "depth").alias("not_owned"))
    facts = frozen(sequences.select(F.col("first").alias("conv_id")).join(leaves, "conv_id", "left").join(owned, "conv_id", "left").select("conv_id",
        F.coalesce("leaf", F.lit(0)).alias("leaf"), "since", "not_owned"))
    along = join_hot(paths, facts, "conv_id")
    distinct = F.when(F.col("since").isNull(), 0).otherwise(F.col("total") - F.when(F.col("depth") >= F.col("since"),
        F.col("before")).otherwise(F.col("not_owned")))
    below = along.groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"),
        (F.sum(F.col("weight") * (F.col("total") - F.col("before"))) - F.sum(distinct)).alias("saved_tokens"))
    named = nodes.select(F.struct(*KEY).alias("up"), F.col("conv_id").alias("parent_conv_id"))
    up = F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), (F.col("s1") - F.col("h1")).cast(_HASH).alias("s1"),
        (F.col("s2") - F.col("h2")).cast(_HASH).alias("s2")))
    rows = join_hot(frozen(nodes.select(*KEY, "n_convs", "conv_id", up.alias("up"))), named, "up", "left")
    out = rows.join(below, KEY).join(proper, KEY, "left").join(end_lists(whole), KEY, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", F.col("n_convs").cast("long").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
