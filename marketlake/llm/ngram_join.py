"""Jaccard self-join on word n-grams by MinHash banding, verified on full n-gram sets.

1. Equal texts form a class, known by its digest and numbered; its least id names it.
2. Every text gives one hash per band; `choose_bands` takes the cheapest band
   and row counts that miss a pair at the threshold with at most 1 - recall.
3. The band hashes are shuffled. Buckets with two or more classes stay, and of
   buckets with the same members one stays.
4. Members are dealt by hash into blocks of about `block_grams` n-grams and at
   most about `block` classes; each pair of blocks of a bucket is one unit of
   work, so that a bucket of any size is spread over tasks and a unit's memory
   is bounded. A unit compares full n-gram sets by counting shared n-grams, and
   a pair that shares several buckets is counted in the first. A unit returns
   link counts and one edge a class, never all its pairs.
5. Connected components of those edges give the class ids.

An n-gram is a run of five words (maximal runs without space or U+0009 to
U+000D); a text of one to four words has itself as its one n-gram. Texts
without words, null among them, link with nothing, equal ones included.
Repeated rows with one id are copies; different texts under one id are compared
and counted each by itself and share a class id. Null ids are kept apart by
text; a group whose ids are all null has a negative class id. Ids never leave
the JVM. A digest that many rows share is dealt over salts in every join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, arrow_rows, connected_components, frozen, join_hot, text_or_empty, text_udf
from .words import batches, mix, split_hashed


def choose_bands(threshold: float, recall: float, least_rows: int = 4, most_rows: int = 8) -> tuple[int, int]:
    """(bands, rows) that reach the recall at the threshold with the least work; fewer rows than least_rows let too many unlike pairs through.

    A band more costs a shuffled row per text, a row less more false candidates; the number of hashes decides.
    """
    options = [(int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**r))), r) for r in range(least_rows, most_rows + 1)]
    return min(options, key=lambda x: (x[0] * x[1] + x[0] * 4, x[0]))


@lru_cache(maxsize=4)
def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seed[:n] | np.uint64(1), seed[n:]


def grams_of(texts: list[bytes], n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, n-gram hashes, text of each) of runs of texts."""
    weights = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    for at, batch in batches(texts):
        _, _, _, words, owner = split_hashed(batch)
        if not len(words):
            continue
        count = np.bincount(owner, minlength=len(batch))
        own, grams = [], []
        if len(words) >= n:
            total = np.zeros(len(words) - n + 1, dtype=np.uint64)
            for k in range(n):
                total += words[k : len(words) - n + 1 + k] * weights[k]
            whole = owner[: len(words) - n + 1] == owner[n - 1 :]
            own.append(owner[: len(words) - n + 1][whole])
            grams.append(mix(total[whole]))
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):  # the whole text is the n-gram
            keep = np.isin(owner, short)
            start = np.flatnonzero(np.r_[True, owner[keep][1:] != owner[keep][:-1]])
            place = np.arange(keep.sum()) - np.repeat(start, np.diff(np.r_[start, keep.sum()]))
            own.append(short)
            grams.append(mix(np.add.reduceat(words[keep] * weights[place], start) + count[short].astype(np.uint64)))
        own, grams = np.concatenate(own), np.concatenate(grams)
        order = np.argsort(own, kind="stable")
        yield at, grams[order], own[order]


def signer(n: int, bands: int, rows: int):
    """A column function: a text's hash of each band and, last, the number of its n-grams; null for a text without words."""

    def make():
        a, b = _hash_family(bands * rows)
        weights = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).reshape(bands, rows) | np.uint64(1)

        def sign(texts: list[str]) -> list:
            signed: list = [None] * len(texts)
            for at, grams, owner in grams_of([t.encode("utf-8") for t in texts], n):
                start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                least = np.empty((bands * rows, len(start)), dtype=np.uint64)
                step = 32_768  # stays in the processor's cache, and whole texts stay together
                cut = [0, *(np.searchsorted(start, np.arange(step, start[-1] + 1, step)).tolist()), len(start)]
                for lo, hi in zip(cut, cut[1:]):
                    if lo < hi:
                        part = grams[start[lo] : start[hi] if hi < len(start) else None]
                        where = start[lo:hi] - start[lo]
                        for k in range(bands * rows):
                            least[k, lo:hi] = np.minimum.reduceat((part * a[k] + b[k]) >> np.uint64(32), where)
                keys = mix((least.reshape(bands, rows, -1) * weights[:, :, None]).sum(axis=1, dtype=np.uint64) + np.arange(bands,
                    dtype=np.uint64)[:, None]).astype(np.int64)
                keys = np.vstack([keys, np.diff(np.r_[start, len(grams)])])
                for j, i in enumerate(owner[start].tolist()):
                    signed[at + i] = keys[:, j]
            return signed

        return sign

    return text_udf(make, "array<long>", pa.list_(pa.int64()))


def _sets(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t.encode("utf-8") for t in frame["__text"].tolist()]
            out = [b""] * len(texts)
            for at, grams, owner in grams_of(texts, n):
                order = np.lexsort((grams, owner))
                grams, owner = grams[order], owner[order]
                first = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])]
                grams, owner = grams[first], owner[first]
                start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]).tolist()
                for i, lo, hi in zip(owner[start].tolist(), start, [*start[1:], len(grams)]):
                    out[at + i] = grams[lo:hi].tobytes()
            yield pd.DataFrame({"rep": frame["rep"], "grams": out})

    return run


def _shared(left: list[np.ndarray], right: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sorted sets, left by right: products of 0/1 matrices over n-grams that several sets have."""
    every = np.concatenate([*left, *right])
    known, times = np.unique(every, return_counts=True)
    known = known[times > 1]
    out = np.zeros((len(left), len(right)), dtype=np.float32)

    def coords(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(known, flat)
        at[at == len(known)] = 0
        hit = known[at] == flat
        row, at = row[hit], at[hit]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    if len(known):
        (lr, lc), (rr, rc) = coords(left), coords(right)
        for lo in range(0, len(known), step):
            a = np.zeros((len(left), step), dtype=np.float32)
            b = np.zeros((len(right), step), dtype=np.float32)
            i, j = np.searchsorted(lc, [lo, lo + step])
            a[lr[i:j], lc[i:j] - lo] = 1
            i, j = np.searchsorted(rc, [lo, lo + step])
            b[rr[i:j], rc[i:j] - lo] = 1
            out += a @ b.T
    return out


def _alike(both: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """shared / (a + b - shared) >= threshold, in integers scaled by 1e6."""
    both = both.astype(np.int64)
    return both * 1_000_000 >= round(threshold * 1_000_000) * (left[:, None] + right[None, :] - both)


def _local_edges(n: int, pairs: tuple[np.ndarray, np.ndarray], reps: np.ndarray) -> np.ndarray:
    """The least rep of each row's component within the unit."""
    root = reps.copy()
    a, b = pairs
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            return root
        root = new


def _verifier(threshold: float):
    def unit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("rep")
        reps, weight = part["rep"].to_numpy(), part["weight"].to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in part["grams"]]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        blocks = part["block"].to_numpy()
        bucket, lo, hi = part["bucket"].iloc[0], part["lo"].iloc[0], part["hi"].iloc[0]
        left, right = np.flatnonzero(blocks == lo), np.flatnonzero(blocks == hi)
        links = np.zeros(len(part), dtype=np.int64)
        ai = bi = np.zeros(0, dtype=np.int64)
        if len(left) and len(right):
            ok = _alike(_shared([sets[i] for i in left], [sets[i] for i in right]), sizes[left], sizes[right], threshold)
            if lo == hi:
                ok = np.triu(ok, 1)
            i, j = np.nonzero(ok)
            ai, bi = left[i], right[j]
            if len(ai):  # the first bucket that both are in counts the pair
                width = part["buckets"].map(len).max()
                own = np.full((len(part), width), np.iinfo(np.int64).max)
                for k, x in enumerate(part["buckets"]):
                    own[k, : len(x)] = x
                earlier = np.zeros(len(ai), dtype=bool)
                before = own < bucket
                for c in range(width):
                    has = before[ai, c]
                    if has.any():
                        earlier[has] |= ((own[bi[has]] == own[ai[has], c][:, None]) & before[bi[has]]).any(axis=1)
                ai, bi = ai[~earlier], bi[~earlier]
                np.add.at(links, ai, weight[bi])
                np.add.at(links, bi, weight[ai])
        root = _local_edges(len(part), (ai, bi), reps)
        some = links > 0
        return pd.DataFrame({"rep": reps[some], "root": root[some], "links": links[some]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the last unit seen, which may go on in the next batch
        for frame in frames:
            frame = pd.concat([*held, frame], ignore_index=True)
            key = frame[["bucket", "lo", "hi"]].to_numpy()
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            done = [unit(frame.iloc[a:b]) for a, b in zip(start, start[1:])]
            held = [frame.iloc[start[-1] :]]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held and len(held[0]):
            yield unit(held[0])

    return run


def ngram_join(df: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.99999, block: int = 512, block_grams: int = 1_000_000,
    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (least id reachable by links), n_links (other documents linked directly, copies counted), kept."""
    spark = df.sparkSession
    bands, rows_a_band = choose_bands(threshold, recall)
    base = df.select(F.col(id_col).cast("long").alias("__id"), text_or_empty(text_col).alias("__text")).withColumn("__class",
        F.unhex(F.md5("__text")))
    with arrow_rows(spark, 1000):
        signed = frozen(base.select("__id", "__class", signer(n, bands, rows_a_band)("__text").alias("__bands")))
        # numbered before the rows are written, so that the numbers stay
        classes = frozen(signed.groupBy("__class").agg(F.min("__id").alias("least"), F.count("*").alias("weight"),
            F.first("__bands").alias("__signed")).withColumn("rep",
            F.monotonically_increasing_id()).withColumns({"__bands": F.slice("__signed", 1, bands),
            "n_grams": F.element_at("__signed", -1)}).drop("__signed"))
        banded = classes.filter("__bands IS NOT NULL").select("rep", "weight", "n_grams",
            F.posexplode("__bands").alias("__p", "__h")).select("rep", "weight", "n_grams", F.xxhash64("__p", "__h").alias("bucket"))
        sizes = banded.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n_grams").alias("grams_in"),
            F.sum(F.xxhash64("rep").bitwiseAND(2**40 - 1)).alias("s1"),
            F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("s2")).filter("members > 1")
        kept = frozen(sizes.groupBy("members", "s1",
            "s2").agg(F.min_by(F.struct("bucket", "grams_in"), "bucket").alias("b")).select("members", "b.*"))
        members = frozen(banded.drop("n_grams").join(kept.select("bucket", "members", "grams_in"), "bucket"))
        own = members.groupBy("rep").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
        # a class's text is read from the rows of its least id, not from all its copies; classes of many rows are dealt over salts
        total = signed.count()
        many = F.col("weight") > max(1, total // HOT)
        wanted = classes.join(own.select("rep"), "rep").select("rep", "least", "weight", F.col("__class").alias("__of"))
        wanted = wanted.withColumn("__s", F.explode(F.when(many, F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))))
        hot = F.broadcast(classes.filter(many).select("__class", F.lit(True).alias("__hot")))  # fewer than HOT rows
        salted = base.join(hot, "__class", "left").withColumn("__salt",
            F.when(F.col("__hot"), F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int")).otherwise(0))
        texts = salted.join(wanted,
            (F.col("__class") == F.col("__of")) & (F.col("__salt") == F.col("__s")) & F.col("__id").eqNullSafe(F.col("least"))).select(
            "rep", "__text").dropDuplicates(["rep"])
        sets = texts.select("rep", "__text").mapInPandas(_sets(n), "rep long, grams binary").join(own, "rep")
        blocks = F.ceil(F.greatest(F.col("members") / block, F.col("grams_in") / block_grams)).cast("int")
        placed = members.withColumn("block", F.pmod(F.xxhash64("rep", "bucket"), blocks).cast("int")).withColumn("__other",
            F.explode(F.sequence(F.lit(0), blocks - 1)))
        units = placed.select("rep", "weight", "bucket", "block", F.least("block", "__other").alias("lo"),
            F.greatest("block", "__other").alias("hi"))
        work = units.join(sets, "rep").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
        found = frozen(work.mapInPandas(_verifier(threshold), "rep long, root long, links long"))
    # texts under one id are one document; those without words link with nothing
    worded = signed.filter("__id IS NOT NULL AND __bands IS NOT NULL").select("__id", "__class")
    several = worded.groupBy("__id").agg(F.min("__class").alias("c0"), F.max("__class").alias("c1")).filter("c0 <> c1").select("__id", "c0")
    texts_of_one = worded.join(several, "__id").filter("__class <> c0").select("__class", "c0").distinct()
    numbers = classes.select("__class", "rep")
    same_id = texts_of_one.join(numbers.withColumnRenamed("rep", "a"),
        "__class").join(numbers.select(F.col("__class").alias("c0"), F.col("rep").alias("b")), "c0").select("a", "b")
    component = frozen(connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(same_id)))
    # the least id of a component names it; where all are null, a negative stand-in does
    stand_in = -1 - F.abs(F.xxhash64("__class") % 2**61)
    names = component.join(classes.select("rep", "least", "__class"),
        F.col("node") == F.col("rep")).groupBy("component").agg(F.coalesce(F.min("least"), F.min(stand_in)).alias("name"))
    component = join_hot(component, names, "component").select(F.col("node").alias("rep"), "name")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    settled = classes.join(links, "rep", "left").join(component, "rep", "left")
    own_copies = F.when(F.col("__bands").isNotNull(), F.col("weight") - 1).otherwise(0)
    settled = settled.select("__class", F.coalesce("name", "least", stand_in).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + own_copies).alias("n_links"), F.col("__bands").isNull().alias("__alone"))
    out = join_hot(signed.select("__id", "__class"), settled, "__class")
    class_id = F.when(F.col("__alone"), F.coalesce("__id", "class_id")).otherwise(F.col("class_id"))
    return out.select(F.col("__id").alias("doc_id"), class_id.alias("class_id"), F.col("n_links").cast("long").alias("n_links"),
        F.coalesce(F.col("__id") == class_id, F.lit(False)).alias("kept"))


def keep_one_of_each_group(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of df whose id is the least of its group of linked documents; rows without an id stay."""
    gone = ngram_join(df, id_col=id_col,
        **options).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone")).distinct()
    rows = df.select(F.struct("*").alias("__row"), F.col(id_col).cast("long").alias("__id"))  # in a struct no name clashes
    return rows.join(gone, F.col("__id") == F.col("__gone"), "left_anti").select("__row.*")
