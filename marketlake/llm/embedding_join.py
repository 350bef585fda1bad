"""Cosine self-join of vectors by epsilon grid order.

Unit vectors with cosine >= c lie within epsilon = sqrt(2 - 2c). Vectors are
rotated to principal axes (of the second moments, summed over all vectors) and
sorted by label and the grid cells, epsilon wide, of the leading axes. The
sequence is cut into blocks with their bounding boxes; intervals of blocks,
eight times as long from level to level, are joined from the longest down, and
a pair of intervals whose boxes are further apart than epsilon in the leading
axes, or that have no label in common, goes no further. Pairs of blocks that
are left are compared in double precision; a unit gives link counts and one
edge a vector, never its pairs. Equal vectors of a label are one row with a
weight until the end. Pruning is safe whatever the axes are.

Vectors link only within one label and one dimension. Null labels, null or zero
vectors and vectors with null or non-finite components link with nothing, equal
ones included. Rows that repeat a vec_id count as vectors of their own. Vectors
are scaled by a power of two before they are squared. Equality of vectors is
that of (label, components), the label's length first. Other columns, whatever
their names, are not read; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, connected_components, frozen, join_hot
from .ngram_join import _local_edges

FANOUT = 8


def _moments(dim_col: str, vec_col: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for dim, part in frame.groupby(dim_col):
                x = _unit(np.stack(part[vec_col].to_numpy()).astype(np.float64))
                sums[dim] = sums.get(dim, 0.0) + x.T @ x
        for dim, m in sums.items():
            i, j = np.triu_indices(dim)
            yield pd.DataFrame({"dim": dim, "i": i, "j": j, "v": m[i, j]})

    return run


def principal_axes(vectors: DataFrame, axes: int) -> dict[int, np.ndarray]:
    """By dimension, the leading axes of the second moments of the unit vectors, summed over all of them in Spark."""
    sums = vectors.mapInPandas(_moments("dim", "vec"), "dim int, i int, j int, v double").groupBy("dim", "i",
        "j").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():  # dim * (dim + 1) / 2 rows a dimension
        m = out.setdefault(r.dim, np.zeros((r.dim, r.dim)))
        m[r.i, r.j] = m[r.j, r.i] = r.v
    return {d: np.linalg.eigh(m)[1][:, ::-1][:, :axes].copy() for d, m in out.items()}


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two so that the largest component is about one: squares neither overflow nor vanish, and no bit is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def embedding_join(df: DataFrame, cosine: float = 0.93, axes: int = 6, block: int = 1024, id_col: str = "vec_id",
    vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (least vec_id reachable, itself included), kept."""
    spark = df.sparkSession
    eps = math.sqrt(2 - 2 * cosine) + 1e-9
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(
        F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0),
            F.lit(False)
    )
    rows = rows.withColumn("vec", F.when(sound, F.col("vec"))).withColumn("key",
        F.when(sound, F.unhex(F.md5(F.concat(F.length("label"), F.lit(":"), "label", F.lit(":"),
        F.array_join(F.transform("vec", lambda x: (x + 0.0).cast("string")), ","))))))
    named = frozen(rows.select("vec_id", "label", "key", "vec"))
    classes = frozen(named.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"),
        F.first("label").alias("label"), F.first("vec").alias("vec")).withColumn("dim", F.size("vec")))
    basis = principal_axes(classes, axes)
    if not basis:
        return named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.lit(True).alias("kept"))
    m = max(b.shape[1] for b in basis.values())
    cols = [f"p{k}" for k in range(m)]

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                p = np.zeros((len(part), m))
                own = _unit(np.stack(part["vec"].to_numpy()).astype(np.float64)) @ basis[dim]
                p[:, : own.shape[1]] = own
                yield part.assign(**{c: p[:, k] for k, c in enumerate(cols)})

    grouped = classes.mapInPandas(project, f"{classes._jdf.schema().toDDL()}, " + ", ".join(f"{c} double" for c in cols))
    cells = [F.floor(F.col(c) / eps) for c in cols]
    parts = max(1, min(10_000, -(-classes.count() // (8 * block))))
    order = ["label", "dim", *cells, "rep"]
    ordered = grouped.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, held = TaskContext.get().partitionId(), 0, None

        def packed(x: pd.DataFrame) -> dict:
            p = x[cols].to_numpy()
            own = {"part": part, "n": n, "label": x["label"].iloc[0], "dim": int(x["dim"].iloc[0]),
                "reps": x["rep"].to_numpy(dtype="int64").tobytes(), "weights": x["weight"].to_numpy(dtype="int64").tobytes(),
                "vecs": np.stack(x["vec"].to_numpy()).astype(np.float64).tobytes()}
            return own | {f"lo{k}": v for k, v in enumerate(p.min(axis=0))} | {f"hi{k}": v for k, v in enumerate(p.max(axis=0))}

        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            while len(held):
                first = (held["label"] == held["label"].iloc[0]) & (held["dim"] == held["dim"].iloc[0])
                run = int(first.to_numpy().argmin()) if not first.all() else len(held)
                if run == len(held) and run < block:
                    break
                yield pd.DataFrame([packed(held.iloc[: min(run, block)])])
                held, n = held.iloc[min(run, block) :].reset_index(drop=True), n + 1
        if held is not None and len(held):
            yield pd.DataFrame([packed(held)])

    box = ", ".join(f"lo{k} double, hi{k} double" for k in range(m))
    schema = f"part int, n int, label string, dim int, reps binary, weights binary, vecs binary, {box}"
    with arrow_rows(spark, 4096):
        blocks = frozen(ordered.mapInPandas(lambda f: (x[[c.strip().split(" ")[0] for c in schema.split(",")]] for x in cut(f)), schema))
    before, offset = {}, 0
    for r in blocks.groupBy("part").count().orderBy("part").collect():  # one row a partition
        before[r[0]], offset = offset, offset + r[1]
    first_of = F.create_map(*[F.lit(int(x)) for kv in before.items() for x in kv])[F.col("part")]
    blocks = blocks.withColumn("seq", (first_of + F.col("n")).cast("long"))
    pairs = _near_intervals(blocks, offset, m, eps)
    work = pairs.join(blocks.select(F.col("seq").alias("i"), F.struct("reps", "weights", "vecs", "dim").alias("a")),
        "i").join(blocks.select(F.col("seq").alias("j"), F.struct("reps", "weights", "vecs").alias("b")), "j")
    work = work.repartition(max(1, min(10_000, offset)), "i", "j").select("i", "j", "a.dim", F.col("a.reps").alias("ra"),
        F.col("a.weights").alias("wa"), F.col("a.vecs").alias("va"), F.col("b.reps").alias("rb"), F.col("b.weights").alias("wb"),
        F.col("b.vecs").alias("vb"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        longs = lambda x: np.frombuffer(x, dtype=np.int64)
        for frame in frames:
            for r in frame.itertuples():
                ra, wa, rb, wb = longs(r.ra), longs(r.wa), longs(r.rb), longs(r.wb)
                a, b = (np.frombuffer(v, dtype=np.float64).reshape(-1, r.dim) for v in (r.va, r.vb))
                a, b = _scaled(a), _scaled(b)
                near = _unit(a) @ _unit(b).T
                for x, y in np.argwhere(np.abs(near - cosine) < 1e-12):  # at the threshold, by the definition
                    near[x, y] = math.fsum(a[x] * b[y]) / math.sqrt(math.fsum(a[x] * a[x]) * math.fsum(b[y] * b[y]))
                ok = near >= cosine
                if r.i == r.j:
                    np.fill_diagonal(ok, False)
                links_a, links_b = ok @ wb, wa @ ok
                p, q = np.nonzero(ok)
                reps = np.r_[ra, rb]
                root = _local_edges(len(reps), (p, q + len(ra)), reps)
                if r.i == r.j:
                    out = pd.DataFrame({"rep": ra, "root": np.minimum(root[: len(ra)], root[len(ra) :]), "links": links_a})
                else:
                    out = pd.DataFrame({"rep": reps, "root": root, "links": np.r_[links_a, links_b]})
                yield out[out["links"] > 0].astype("int64")

    with arrow_rows(spark, 16):
        found = frozen(work.mapInPandas(compare, "rep long, root long, links long"))
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    settled = classes.select("key", "rep", "weight").join(links, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep",
        "left")
    settled = settled.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    out = join_hot(named.select("vec_id", "key"), settled, "key", "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"),
        F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"))


def _near_intervals(blocks: DataFrame, n: int, m: int, eps: float) -> DataFrame:
    """(i, j), i <= j, of blocks that may hold a pair: intervals are joined level by level, from the longest down."""
    boxes = blocks.select("seq", F.col("label").alias("l0"), F.col("label").alias("l1"), F.col("dim").alias("d0"), F.col("dim").alias("d1"),
        *[f"{s}{k}" for k in range(m) for s in ("lo", "hi")])
    levels = [frozen(boxes)]
    while n > FANOUT * FANOUT:
        n = -(-n // FANOUT)
        agg = [F.min("l0").alias("l0"), F.max("l1").alias("l1"), F.min("d0").alias("d0"), F.max("d1").alias("d1")]
        agg += [f(f"{s}{k}").alias(f"{s}{k}") for k in range(m) for s, f in (("lo", F.min), ("hi", F.max))]
        levels.append(levels[-1].withColumn("seq", F.floor(F.col("seq") / FANOUT)).groupBy("seq").agg(*agg))

    def near(pairs: DataFrame, level: DataFrame) -> DataFrame:
        left = level.select(*[F.col(c).alias(f"a_{c}") for c in level.columns])
        right = level.select(*[F.col(c).alias(f"b_{c}") for c in level.columns])
        gap = sum(F.pow(F.greatest(F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}"), F.lit(0.0)),
            2) for k in range(m))
        meet = (F.col("a_l0") <= F.col("b_l1")) & (F.col("b_l0") <= F.col("a_l1")) & (F.col("a_d0") <= F.col("b_d1")) & (
            F.col("b_d0") <= F.col("a_d1"))
        both = pairs.join(left, F.col("i") == F.col("a_seq")).join(right, F.col("j") == F.col("b_seq"))
        return both.filter(meet & (gap <= eps * eps + 1e-9)).select("i", "j")

    # at the top, at most FANOUT * FANOUT intervals
    ids = levels[-1].select(F.col("seq").alias("i"))
    pairs = near(ids.select("i", F.explode(F.sequence("i", F.lit(n - 1).cast("long"))).alias("j")), levels[-1])
    for level in reversed(levels[:-1]):
        child = F.sequence(F.col("i") * FANOUT, F.col("i") * FANOUT + FANOUT - 1)
        other = F.sequence(F.col("j") * FANOUT, F.col("j") * FANOUT + FANOUT - 1)
        pairs = near(pairs.select(F.explode(child).alias("i"), "j", other.alias("o")).select("i",
            F.explode("o").alias("j")).filter("i <= j"), level)
    return pairs
