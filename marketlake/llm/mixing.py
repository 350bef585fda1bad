"""Mixing sources to target weights by subset-sum budget fitting.

1. Sizes are word counts. Sources, ordered by code point with null last, weigh
   5, 2, 1 in turn and share `share` times all words; a target stops at `most`
   times its source's size, and the excess is shared again by weight until no
   target is above: water filling, solved with windows over one row a source.
2. A source whose target holds its whole size k times takes every document k
   times. For what is left, documents are counted by exact length, every length
   gives the same share of its documents, rounded down, and the budget that
   remains is fitted by a bounded-knapsack dynamic program over the lengths:
   what is taken is the nearest sum that adding documents to the equal share has.
3. Of each length, so many documents are chosen by a seeded hash of their ids.
   A length with many documents in a source is split into cells by that hash,
   which are filled in order, so that no task ranks a large group alone.

Defined results: a null text counts as empty and is never taken more than 0
words; repeated rows are documents of their own, those equal in source, id and
size being interchangeable; rows without id draw their luck by their place in
the input, so that reruns agree on them while its partitions stay the same; texts
of any length are counted whole; an empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, frozen, text_or_empty

SEED = 20_240_229


def _reach(lengths: np.ndarray, spare: np.ndarray, rest: int) -> tuple[np.ndarray, int]:
    """How many more of each length to take, at most `spare`, with the sum nearest to rest, of two as near the lower; and that sum.

    A bounded knapsack: reachable sums are the bits of an integer, to as far above
    the rest as nothing at all is below it; each step is one length with a power
    of two of its documents, and of each sum the step that first reached it is kept.
    """
    more = np.zeros(len(lengths), dtype=np.int64)
    top = 2 * rest
    mask, reach = (1 << (top + 1)) - 1, 1
    first = np.full(top + 1, -1, dtype=np.int32)
    steps: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, left, n = int(lengths[i]), int(spare[i]), 1
        while size and left > 0 and min(n, left) * size <= top and not reach >> rest & 1:
            n = min(n, left)
            new = (reach << (n * size)) & mask & ~reach
            bits = np.unpackbits(np.frombuffer(new.to_bytes(top // 8 + 1, "little"), dtype=np.uint8), bitorder="little")
            first[np.flatnonzero(bits)] = len(steps)
            steps.append((i, n))
            reach |= new
            left -= n
            n *= 2
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    over = rest + 1 + (above & -above).bit_length() - 1 if above else 2 * top + 1
    at = total = below if rest - below <= over - rest else over
    while at:
        i, n = steps[first[at]]
        more[i] += n
        at -= n * int(lengths[i])
    return more, total


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = 16_384) -> np.ndarray:
    """How many of each length to take, at most `counts`, with the sum nearest to the budget, of two as near the lower.

    An equal share of every length first. Then the nearest sum that adding
    documents reaches, by the dynamic program over the last `window` words, to
    which one more of the longest lengths each leads. A sum as near to the rest
    as multiples of the lengths' common divisor come cannot be bettered; where
    the program finds none such, the window doubles, at last to all of the rest,
    so that the result is the nearest sum whatever the window.
    """
    if budget <= 0 or not int((lengths * counts).sum()):
        return np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts.tolist()], dtype=np.int64)
    rest = budget - int((take * lengths).sum())
    spare = counts - take
    step = math.gcd(*(int(x) for x, n in zip(lengths.tolist(), spare.tolist()) if x and n))
    best = min(rest % step, step - rest % step)
    while True:
        early, left = np.zeros(len(lengths), dtype=np.int64), rest
        for i in np.argsort(-lengths, kind="stable").tolist() if rest > window else []:
            more = min((left - window // 2) // max(1, int(lengths[i])), int(spare[i])) if lengths[i] and left > window else 0
            early[i] = max(0, more)
            left -= int(early[i]) * int(lengths[i])
        more, got = _reach(lengths, spare - early, left)
        if abs(left - got) == best or window >= rest:
            return take + early + more
        window *= 2


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("__w",
        F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double"))
    named = named.withColumn("__cap", F.col("source_size") * most)
    # sources reach their caps in order of cap / weight
    level = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    named = named.withColumn("__budget", F.sum("source_size").over(everything) * share)
    named = named.withColumn("__left", F.col("__budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
    named = named.withColumn("__weight", F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    named = named.withColumn("__rate", F.col("__left") / F.col("__weight"))
    # the first source that its cap does not bind fixes the rate of all after it
    free = F.when(F.col("__rate") * F.col("__w") <= F.col("__cap"), F.struct(F.col("__cap") / F.col("__w"), F.col("__rate")))
    rate = F.min(free).over(everything)["__rate"]
    return named.withColumn("target", F.least(F.coalesce(rate * F.col("__w"), F.col("__cap")), F.col("__cap"))).select("source",
        "source_size", "target")


def words(text_col: str):
    return F.coalesce(F.regexp_count(text_or_empty(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def mix(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = SEED, cell_rows: int = 256,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row, and copies, how often it is taken."""
    slim = frozen(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        words(text_col).alias("size"), F.monotonically_increasing_id().alias("__row")))
    lengths = frozen(slim.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = frozen(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most))

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", kind="stable")
        whole, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        times = int(target // whole) if whole else 0
        take = fit_budget(frame["size"].to_numpy(dtype=np.int64), frame["n"].to_numpy(dtype=np.int64), round(target - times * whole))
        return frame.assign(times=times, take=take)[["source", "size", "n", "source_size", "target", "times", "take"]]

    joined = lengths.withColumn("__s", F.col("source")).join(goal.withColumnRenamed("source", "__g"),
        F.col("__s").eqNullSafe(F.col("__g"))).drop("__s", "__g")
    planned = frozen(joined.groupBy("source").applyInPandas(plan,
        "source string, size long, n long, source_size long, target double, times int, take long"))

    luck = F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("__row")))  # null ids are spread by row
    cells = F.ceil(F.col("n") / cell_rows)
    rows = slim.alias("l").join(planned.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.size") == F.col("r.size")))
    rows = rows.select("doc_id", F.col("l.source").alias("source"), F.col("l.size").alias("size"), "n", "source_size", "target", "times",
        "take", luck.alias("__luck")).withColumn("__cell", F.pmod("__luck", cells))
    counts = rows.filter(F.col("n") > cell_rows).groupBy("source", "size", "__cell").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy("source", "size").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("__cell").alias("b_cell"),
        F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__base"))
    rank = Window.partitionBy("source", "size", "__cell").orderBy("__luck", F.col("doc_id").asc_nulls_last())
    ranked = rows.withColumn("__rank", F.row_number().over(rank)).join(base,
        F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("__cell") == F.col("b_cell")), "left")
    copies = F.col("times") + (F.col("__rank") + F.coalesce("__base", F.lit(0)) <= F.col("take")).cast("int")
    return ranked.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"),
        F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of df, each as often as the mix takes it, with df's columns; documents without words stay once.

    Rows equal in id, source and size get the copies of their equals in the mix, in some order.
    """
    plan = mix(df, id_col=id_col, text_col=text_col, source_col=source_col, **options).filter("size > 0")
    plan = plan.groupBy(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"),
        F.col("size").alias("p_size")).agg(F.min("copies").alias("least"), F.sum("copies").alias("all"), F.count("*").alias("n"))
    rows = df.select(F.struct("*").alias("__row"), F.col(id_col).cast("long").alias("__id"),
        F.col(source_col).cast("string").alias("__source"), words(text_col).alias("__size"))
    planned = rows.filter("__size > 0").join(plan,
        F.col("__id").eqNullSafe(F.col("p_id")) & F.col("__source").eqNullSafe(F.col("p_source")) & (F.col("__size") == F.col("p_size")))
    # a row alone in its key, as unique ids make it, needs no rank
    w = Window.partitionBy("__id", "__source", "__size").orderBy("least")
    single = planned.filter("n = 1").select("__row", F.col("least").alias("__copies"))
    several = planned.filter("n > 1").withColumn("__rank", F.row_number().over(w)).select("__row",
        (F.col("least") + (F.col("__rank") <= F.col("all") - F.col("least") * F.col("n")).cast("int")).alias("__copies"))
    copies = single.union(several).filter("__copies > 0").withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return copies.select("__row.*").union(rows.filter("__size = 0").select("__row.*"))
