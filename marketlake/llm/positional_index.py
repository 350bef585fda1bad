"""Benchmark decontamination with a distributed positional inverted index.

The index is a written table. Documents are gathered into blocks of about
`block_words` words; in a block words are numbered through, with a gap between
documents, and each distinct word has a list of the numbers at which it stands.
Lists are stored in rows of (block, bucket), a bucket being a range of word
hashes, so that a look-up reads rows and not the millions of rare words. A
search looks up only the terms of the test texts: their frequencies over the whole corpus say which term
of a test window is rarest, and only blocks that hold that term see the window.
There the rarest term's list, moved by its offset in the window, is intersected
with the lists of the others, rarest first, until what is left are exact
phrases. The same lists give proximity matches: stretches of at most `slack`
words more than the window in which each of its words stands, in any order.

Blocks are independent, so that a frequent term is one row a block and no list
grows with the corpus. Test windows are dealt into groups of bounded size, and a
task sees one block and one group at a time. Test terms and windows are
broadcast while they are small, else shuffled.

Defined results: null texts have no words; rows with equal or null document ids
are documents of their own; test rows with equal ids are one item, rows without
id are one item whose id is the empty text; an item that repeats a window counts
once; texts without words never match; a text of any length lies in one block,
which is then as long as it; empty tables give no rows, an empty benchmark no
hits. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, bounded, frozen, shared_folder, text_udf, written
from .words import batches, split_hashed

#: What stands between words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[48:58], _FOLD[97:123], _FOLD[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_FOLD[65:91] = np.arange(97, 123)
_FOLD_TABLE = _FOLD.tobytes()

_INDEX = "block long, bucket int, terms binary, freqs binary, postings binary, ordinal int, doc_id string, n_words long"
_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("terms", pa.binary()), ("freqs", pa.binary()), ("postings", pa.binary()),
    ("ordinal", pa.int32()), ("doc_id", pa.string()), ("n_words", pa.int64())])
_LIST = "block long, term string, freq long, postings binary"
_LIST_ARROW = pa.schema([("block", pa.int64()), ("term", pa.string()), ("freq", pa.int64()), ("postings", pa.binary())])


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    folded = F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), BREAK, " ")
    return F.filter(F.split(folded, " "), lambda w: w != "")


def _steps(positions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of lists that begin at `first`, each as its distance from the one before; the first of a list as itself."""
    step = np.diff(positions, prepend=0)
    step[first] = positions[first]
    return step.astype("<u4")


def _runs(data: bytes, ends: np.ndarray) -> pa.Array:
    """One buffer cut at the given ends."""
    offsets = np.r_[0, ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def bucket_of(hashed: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a word's hash: buckets are ranges of hashes."""
    return ((hashed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _block(number: int, docs: list[tuple[str | None, bytes]], gap: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows of one block: those of its documents, one with where they begin, and one of each bucket of words."""
    raw, hashes, slots, begins, ends, counts, base, size, done = [], [], [], [], [], [], 0, 0, 0
    for _, texts in batches([t for _, t in docs]):
        buffer, begin, end, hashed, owner = split_hashed(texts)
        raw.append(buffer)
        begins.append(begin + size)
        ends.append(end + size)
        counts.append(np.bincount(owner, minlength=len(texts)))
        hashes.append(hashed)
        slots.append(base + np.arange(len(hashed)) + gap * (owner + done))
        base, done, size = base + len(hashed), done + len(texts), size + len(buffer)
    hashed, slots, counts = np.concatenate(hashes), np.concatenate(slots), np.concatenate(counts)
    starts, n = np.r_[0, np.cumsum(counts + gap)[:-1]], len(docs)
    none = lambda kind, k: pa.nulls(k, kind)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), none(pa.int32(), n), *[none(pa.binary(), n)] * 3,
        pa.array(np.arange(n), pa.int32()), pa.array([d for d, _ in docs], pa.string()), pa.array(counts, pa.int64())], schema=_ARROW)
    order = np.argsort(hashed, kind="stable")
    ranked, slots = hashed[order], slots[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, dtype=np.int64)
    freqs = np.diff(np.r_[first, len(ranked)])
    # each distinct word and a zero byte, one behind the other
    begin, end = (np.concatenate(x)[order[first]] for x in (begins, ends))
    width = end - begin + 1
    to = np.cumsum(width)
    names = np.frombuffer(b"".join(raw), dtype=np.uint8)[np.repeat(begin - (to - width), width) + np.arange(to[-1] if len(to) else 0)].copy()
    names[to - 1] = 0
    cut = np.flatnonzero(np.diff(bucket_of(ranked[first], buckets), append=-1) != 0) if len(first) else first  # last word of each bucket
    upto = np.cumsum(freqs)[cut]
    k = len(cut) + 1
    postings = _steps(starts, np.zeros(1, dtype=np.int64)).tobytes() + _steps(slots, first).tobytes()
    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, number)), pa.array(np.r_[-1, bucket_of(ranked[first][cut], buckets)], pa.int32()),
        _runs(names.tobytes(), np.r_[0, to[cut]]), _runs(freqs.astype("<u4").tobytes(), np.r_[0, (cut + 1) * 4]),
        _runs(postings, np.r_[n, n + upto] * 4), none(pa.int32(), k), none(pa.string(), k), none(pa.int64(), k)], schema=_ARROW)


def _indexer(block_words: int, gap: int, buckets: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        docs: list[tuple[str | None, bytes]] = []
        held = 0
        for batch in rows:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("__text")):
                folded = text.as_buffer().to_pybytes().translate(_FOLD_TABLE)
                docs.append((doc, folded))
                held += folded.count(b" ") + 1
                if held >= block_words:
                    yield from _block(number, docs, gap, buckets)
                    number, docs, held = number + 1, [], 0
        if docs:
            yield from _block(number, docs, gap, buckets)

    return run


def build(df: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_words: int = 1_000_000,
    gap: int = 1, buckets: int = 256) -> DataFrame:
    """The index of a table of texts, written to a folder (by default a new one among the shared) and read from there.

    Rows with a bucket from 0 on: the words of a block whose hash falls into it, their frequencies and postings. Rows of
    bucket -1: where the block's documents begin. Rows without bucket: one per document.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text.alias("__text"))
    with arrow_rows(spark, 1000):
        rows.mapInArrow(_indexer(block_words, gap, buckets), _INDEX).write.option("compression", "zstd").parquet(folder)
    return read(spark, folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(folder)


def _find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of the wanted terms among the words of a bucket."""
    for batch in rows:
        out = []
        for block, names, freqs, postings, wanted in zip(*(batch.column(c) for c in ("block", "terms", "freqs", "postings", "wanted"))):
            place = {t.encode(): None for t in wanted.as_py()}
            for i, name in enumerate(names.as_py().split(b"\0")):
                if name in place:
                    place[name] = i
            n = np.frombuffer(freqs.as_buffer(), dtype="<u4").astype(np.int64)
            to, data = np.cumsum(n), postings.as_py()
            out += [(block.as_py(), t.decode(), int(n[i]), data[4 * (to[i] - n[i]) : 4 * to[i]]) for t, i in place.items() if i is not None]
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LIST_ARROW)], schema=_LIST_ARROW)


def lookup(index: DataFrame, terms: DataFrame, buckets: int = 256) -> DataFrame:
    """(block, term, freq, postings) of distinct terms; buckets as the index was built with."""
    bucket = text_udf(lambda: lambda words: bucket_of(split_hashed([w.encode() for w in words])[3], buckets).tolist(), "int", pa.int32())
    wanted = frozen(terms.select("term", bucket("term").alias("bucket")).groupBy("bucket").agg(F.collect_list("term").alias("wanted")))
    chars = wanted.agg(F.sum(F.length(F.array_join("wanted", " ")))).first()[0] or 0
    met = index.filter("bucket >= 0").join(bounded(wanted, chars), "bucket")
    with arrow_rows(index.sparkSession, 64):
        return written(met.select("block", "terms", "freqs", "postings", "wanted").mapInArrow(_find, _LIST))


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """(item_id string, terms): the distinct runs of `width` words of each item; all its words where it has fewer, but some."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words_of(F.col(text_col)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return words.filter(F.size("w") > 0).select("item_id", F.explode(F.transform(starts,
        lambda i: F.slice("w", i, width))).alias("terms")).distinct()


def candidates(index: DataFrame, windows: DataFrame, group_windows: int = 50_000, buckets: int = 256) -> tuple[DataFrame, DataFrame]:
    """(lists, tests) to be met by block and part: the lists of test terms in a block, and the windows whose rarest term stands in it.

    Windows with a term that no document holds are left out: they cannot occur.
    """
    windows = frozen(windows.withColumn("window", F.xxhash64("item_id", F.array_join("terms", " "))))
    n_windows = windows.count()
    postings = lookup(index, windows.select(F.explode("terms").alias("term")).distinct(), buckets)
    freq = postings.groupBy("term").agg(F.sum("freq").alias("n"))
    known = windows.select("item_id", "window", "terms", F.explode(F.array_distinct("terms")).alias("term")).join(freq, "term")
    rarest = known.groupBy("item_id", "window", "terms").agg(F.min(F.struct("n", "term")).alias("r"), F.count("*").alias("have"))
    part = F.pmod(F.xxhash64("r.term"), F.lit(-(-n_windows // group_windows) or 1)).cast("int")
    rarest = frozen(rarest.filter(F.col("have") == F.size(F.array_distinct("terms"))).select("item_id", "terms",
        F.col("r.term").alias("term"), part.alias("part")))
    needed = rarest.select("part", F.explode("terms").alias("term")).distinct()
    size = n_windows * 200  # bytes of ten words and an id, about
    places = postings.select("block", "term")
    tests = places.join(bounded(rarest, size), "term").select(F.col("block").alias("t_block"), F.col("part").alias("t_part"), "item_id", "terms")
    blocks = frozen(places.join(bounded(rarest.select("term", "part").distinct(), size), "term").select("block", "part").distinct())
    lists = postings.join(bounded(needed, size), "term").select("block", "part", "term", "freq", "postings").join(blocks, ["block", "part"])
    begins = index.filter("bucket = -1").select("block", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("freq"),
        "postings").join(blocks, "block")
    return lists.unionByName(begins), tests


_MATCH = "block long, ordinal int, item_id string, near_id string, at long, to long"
_MATCH_ARROW = pa.schema([("block", pa.int64()), ("ordinal", pa.int32()), ("item_id", pa.string()), ("near_id", pa.string()),
    ("at", pa.int64()), ("to", pa.int64())])


class _Lists:
    """The lists of a block: each word's number where it stands, and all (word, place) pairs in order."""

    def __init__(self, table: pa.Table):
        terms, freq = table.column("term").to_pylist(), table.column("freq").to_numpy()
        raw = [np.frombuffer(x.as_buffer(), dtype="<u4").astype(np.int64).cumsum() for x in table.column("postings")]
        self.begins = raw.pop(terms.index(None))
        freq = np.delete(freq, terms.index(None))
        terms.remove(None)
        self.number = {t: i for i, t in enumerate(terms)}
        self.freq = freq
        self.first = np.cumsum(freq) - freq
        self.places = np.concatenate(raw) if raw else np.zeros(0, dtype=np.int64)
        self.size = int(max(self.places.max(initial=0), self.begins[-1])) + 1
        self.word = np.full(self.size, -1, dtype=np.int64)
        owner = np.repeat(np.arange(len(terms)), freq)
        self.word[self.places] = owner
        self.pairs = owner * self.size + self.places

    def next_at(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first place of each term from `at` on, or beyond the block."""
        i = np.searchsorted(self.pairs, term * self.size + at)
        found = self.pairs[np.minimum(i, len(self.pairs) - 1)] - term * self.size
        return np.where((i < len(self.pairs)) & (found < self.size), found, self.size)


def _occurrences(lists: _Lists, terms: np.ndarray, order: np.ndarray, step: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, place of its rarest term) in runs of bounded size; terms: a row a window, order: its offsets, rarest first."""
    anchor = terms[np.arange(len(terms)), order[:, 0]]
    n = lists.freq[anchor]
    total = np.cumsum(n)
    at, end = 0, int(total[-1]) if len(total) else 0
    while at < end:
        k = np.arange(at, min(end, at + step))
        window = np.searchsorted(total, k, side="right")
        yield window, lists.places[lists.first[anchor[window]] + k - (total[window] - n[window])]
        at += step


def phrases(lists: _Lists, terms: np.ndarray, order: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of exact occurrences: lists moved by their offsets and intersected, rarest first."""
    found = []
    for window, place in _occurrences(lists, terms, order):
        start = place - order[window, 0]
        keep = (start >= 0) & (start + length[window] <= lists.size)
        window, start = window[keep], start[keep]
        for k in range(1, terms.shape[1]):
            if not len(window):
                break
            offset = order[window, k]
            # offsets beyond a short window's end stand last in its order
            beyond = offset >= length[window]
            keep = beyond | (lists.word[np.where(beyond, 0, start + offset)] == terms[window, offset])
            window, start = window[keep], start[keep]
        found.append((window, start))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2


def near(lists: _Lists, terms: np.ndarray, order: np.ndarray, length: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its rarest term) where all its words stand within length + slack words of one document, in any order."""
    ends = np.r_[lists.begins[1:], lists.size]
    found = []
    for window, place in _occurrences(lists, terms, order):
        for k in range(1, terms.shape[1]):  # is each word near the rarest at all
            if not len(window):
                break
            offset = order[window, k]
            beyond, span = offset >= length[window], length[window] + slack
            term = terms[window, np.where(beyond, order[window, 0], offset)]
            keep = beyond | (lists.next_at(term, np.maximum(0, place - span + 1)) < place + span)
            window, place = window[keep], place[keep]
        doc = np.searchsorted(lists.begins, place, side="right") - 1
        low, high = lists.begins[doc], ends[doc]
        ok = np.zeros(len(window), dtype=bool)
        for back in range(int(length.max(initial=0)) + slack):
            todo = np.flatnonzero(~ok & (back < length[window] + slack) & (place - back >= low))
            start, w = place[todo] - back, window[todo]
            limit = np.minimum(start + length[w] + slack, high[todo])
            for k in range(terms.shape[1]):
                if not len(todo):
                    break
                offset = order[w, k]
                beyond = offset >= length[w]
                keep = beyond | (lists.next_at(terms[w, np.where(beyond, order[w, 0], offset)], start) < limit)
                todo, start, w, limit = todo[keep], start[keep], w[keep], limit[keep]
            ok[todo] = True
        found.append((window[ok], place[ok]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2


def _matcher(slack: int | None):
    def match(key, left: pa.Table, right: pa.Table) -> pa.Table:
        none = _MATCH_ARROW.empty_table()
        if not left.num_rows or not right.num_rows:
            return none
        lists = _Lists(left)
        tests = [(i, t) for i, t in zip(right.column("item_id").to_pylist(), right.column("terms").to_pylist())
            if all(x in lists.number for x in t)]
        if not tests:
            return none
        items = np.array([i for i, _ in tests], dtype=object)
        length = np.array([len(t) for _, t in tests], dtype=np.int64)
        width = int(length.max())
        terms = np.array([[lists.number[x] for x in t] + [0] * (width - len(t)) for _, t in tests], dtype=np.int64)
        rarity = np.where(np.arange(width) < length[:, None], lists.freq[terms], np.iinfo(np.int64).max)
        order = np.argsort(rarity, axis=1, kind="stable")
        block, out = key[0].as_py(), []
        doc_of = lambda place: np.searchsorted(lists.begins, place, side="right") - 1

        def pairs(doc: np.ndarray, window: np.ndarray, exact: bool) -> None:
            """One row for each document and item."""
            seen = sorted({(d, items[w]) for d, w in np.unique(np.stack([doc, window], axis=1), axis=0).tolist()})
            ids = pa.array([i for _, i in seen], pa.string())
            blank, k = pa.nulls(len(seen), pa.string()), len(seen)
            out.append(pa.Table.from_arrays([pa.array([block] * k, pa.int64()), pa.array([d for d, _ in seen], pa.int32()),
                ids if exact else blank, blank if exact else ids, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], schema=_MATCH_ARROW))

        window, start = phrases(lists, terms, order, length)
        doc = doc_of(start)
        pairs(doc, window, True)
        # the union of the occurrences, as runs of words
        by = np.lexsort((start, doc))
        at, to, own = start[by], (start + length[window])[by], doc[by]
        reach = np.maximum.accumulate(to) if len(to) else to  # documents lie one behind the other
        fresh = np.r_[True, at[1:] > reach[:-1]] if len(at) else np.zeros(0, dtype=bool)
        first = np.flatnonzero(fresh)
        last = np.r_[first[1:], len(at)] - 1 if len(first) else first
        k, base = len(first), lists.begins[own[first]] if len(first) else np.zeros(0, dtype=np.int64)
        out.append(pa.Table.from_arrays([pa.array([block] * k, pa.int64()), pa.array(own[first], pa.int32()), pa.nulls(k, pa.string()),
            pa.nulls(k, pa.string()), pa.array(at[first] - base, pa.int64()), pa.array(reach[last] - base, pa.int64())], schema=_MATCH_ARROW))
        if slack is not None:
            window, place = near(lists, terms, order, length, slack)
            pairs(doc_of(place), window, False)
        return pa.concat_tables(out)

    return match


def search(index: DataFrame, windows: DataFrame, slack: int | None = None, group_windows: int = 50_000, buckets: int = 256) -> DataFrame:
    """(block, ordinal, item_id, near_id, at, to) of all matches.

    A row has either an item_id of which a window occurs as a phrase, or a near_id of which a window's words stand together
    (with slack), or a run of hit words, from `at` on and before `to`. Groups of one document may tell of the same run.
    """
    lists, tests = candidates(index, windows, group_windows, buckets)
    return lists.groupBy("block", "part").cogroup(tests.groupBy("t_block", "t_part")).applyInArrow(_matcher(slack), _MATCH)


def _covered(runs: Column) -> Column:
    """Words in the union of sorted runs."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["to"] - F.greatest(r["at"], a["end"]))).cast("long").alias("n"),
        F.greatest(a["end"], r["to"]).alias("end"))
    return F.aggregate(runs, start, step)["n"]


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = 10, slack: int | None = 2, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = 1_000_000) -> DataFrame:
    """One row per document: how many words it has, how many lie in an occurrence of a test window, and of which items.

    n_near_items: items of which a window's words stand within width + slack words of the document, phrases included.
    """
    index = build(documents, id_col=id_col, text_col=text_col, block_words=block_words)
    found = search(index, windows_of(benchmark, item_col, item_text_col, width), slack)
    run = F.when(F.col("at").isNotNull(), F.struct("at", "to"))
    per_doc = found.groupBy("block", "ordinal").agg(F.sort_array(F.collect_set("item_id")).alias("items"),
        F.count_distinct("near_id").alias("n_near"), F.sort_array(F.collect_list(run)).alias("runs"))
    docs = index.filter("ordinal IS NOT NULL").select("block", "ordinal", "doc_id", "n_words")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(_covered(F.col("runs")), F.lit(0)).cast("long")
    return docs.join(per_doc, ["block", "ordinal"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near_items"))
