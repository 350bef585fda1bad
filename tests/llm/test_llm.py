"""The training-data operators against brute force, exact round trips and held-out labels, and on awkward tables."""

import hashlib
import html
import itertools
import json
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlake.llm import bpe, embedding_join, exact_dedup, html_text, mixing, ngram_join, packing, queries, sharding, token_counts, tool_calls, toxicity
from marketlake.llm.common import connected_components

BIG = 2**60 + 1  # beside a null, a double would round it
CLASHES = ["shard", "size", "kept", "rep", "h_size", "h_keep", "__id", "__copies", "__row", "__text", "__digest", "__rank", "__size", "__class", "host"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
W = [f"w{i}" for i in range(400)]


def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named as the operators' own."""
    base = " ".join(W[:60])
    rows = [(1, base), (2, base), (2, base), (3, base.replace("w7 ", "x7 ")), (4, None), (5, ""), (6, "  \t\n "), (7, "a b c"), (8, "a  b\nc"), (None, "lone words here"), (9, " ".join(W * 300)), (10, "é <|endoftext|> 中文 İ"), (BIG, "head line\n" + " ".join(W[100:160])), (BIG + 2, "another\nlast one")]
    return spark.createDataFrame([(i, t, "en", None if k % 3 == 0 else f"s{k % 3}", 0, *[f"{c}{k}" for c in CLASHES]) for k, (i, t) in enumerate(rows)], DOCS).coalesce(1)


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


ALPHABET = st.sampled_from(list("abcXYZ 's't'll0123.,!?\n\t\x1c\x85\xa0éÉßİΣσ中文é💡<|>") + ["<|endoftext|>", "thing", "  "])


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=30).map("".join))
def test_ids_are_the_librarys(text):
    library = Tokenizer.from_file(bpe.default_path()) if not hasattr(test_ids_are_the_librarys, "t") else test_ids_are_the_librarys.t
    test_ids_are_the_librarys.t = library
    assert np.frombuffer(bpe.load(bpe.default_path()).encode_bytes([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_counts(docs, none, library):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs).collect())
    want = [(r.doc_id or 0, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert got == sorted((i, b, n, n > 2048) for i, b, n in want)
    assert token_counts.count_tokens(none).count() == 0


def test_packing_round_trip(docs, none, library, spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(docs.filter("doc_id IS NOT NULL").select(F.col("doc_id") + 1_000_000, "text").distinct())
    pieces = packing.pack(table).toPandas()
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in table.collect()}
    for doc, own in pieces.sort_values("start").groupby("doc_id"):
        at = 0
        for p in own.itertuples():
            part = np.array(ids[doc][p.start : p.start + p.length], "<u4").tobytes()
            assert p.start == at and p.doc_tokens == len(ids[doc]) and zlib.crc32(part) == p.ids_crc32
            at += p.length
        assert at == len(ids[doc])
    assert set(pieces.doc_id) == set(ids)
    total, padding = 0, 0
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert (own.offset.to_numpy() == np.r_[0, own.length.cumsum()[:-1]]).all() and len(own) <= 128
        n = int(own.length.sum())
        assert n <= 2048
        total, padding = total + n, padding + (0 if n & (n - 1) == 0 else 2048 - n)
    assert padding < 0.02 * total
    assert packing.pack(none).count() == 0


def test_packing_ids_and_prompts(docs, library):
    got = Counter()
    for r in packing.pack(docs).collect():
        got[r.doc_id] += r.loss_tokens
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    want = Counter()
    for r in docs.collect():
        t = r.text or ""
        want[r.doc_id] += n(t[t.index("\n") + 1 :] if "\n" in t else t) + 1
    assert got == want and got[BIG] and got[BIG + 2] and got[None]


ITEMS = st.lists(st.tuples(st.integers(1, 300), st.integers(0, 300)), min_size=1, max_size=60)
SMALL = packing.Limits(tokens=100, segments=4, loss_tokens=60, least_cut=5)


@settings(max_examples=60, deadline=None)
@given(ITEMS)
def test_placing_keeps_all_limits(items):
    tokens = np.array([t for t, _ in items])
    loss = np.minimum(np.array([x for _, x in items]), tokens)
    seen = [np.zeros(t, dtype=int) for t in tokens]
    for own in packing.place(tokens, loss, SMALL):
        assert 0 < len(own) <= 4 and sum(n for *_, n in own) <= 100
        bearing = sum(max(0, at + n - max(at, int(tokens[i] - loss[i]))) for i, at, n in own)
        assert bearing <= 60
        for i, at, n in own:
            seen[i][at : at + n] += 1
    assert all((s == 1).all() for s in seen)


@settings(max_examples=80, deadline=None)
@given(ITEMS)
def test_placing_takes_the_largest_inner_product(items):
    """Every choice is replayed against all pieces left; only the last of a sequence may be a cut, where nothing fits."""
    tokens = np.array([t for t, _ in items])
    loss = np.minimum(np.array([x for _, x in items]), tokens)
    bears = lambda i, at, n: max(0, at + n - max(at, int(tokens[i] - loss[i])))
    left = [(int(i), int(a), int(n)) for i, a, n, _ in zip(*packing.pieces_of(tokens, loss, SMALL))]
    for own in packing.place(tokens, loss, SMALL):
        room = np.array([100, 60])
        limit = np.array([100, 60])
        for i, at, n in own:
            score = lambda p: float(np.array([p[2], bears(*p)]) / limit @ (room / limit))
            fit = [p for p in left if p[2] <= room[0] and bears(*p) <= room[1]]
            if fit:
                assert abs(score((i, at, n)) - max(map(score, fit))) < 1e-12 and (i, at, n) in left
                left.remove((i, at, n))
            else:
                whole = next(p for p in left if p[0] == i and p[1] == at)
                assert n == min(room[0], whole[2] - bears(*whole) + room[1]) < whole[2] and (i, at, n) == own[-1]
                left.remove(whole)
                left.append((i, at + n, whole[2] - n))
            room = room - np.array([n, bears(i, at, n)])
    assert not left


def test_texts_of_one_line_fill_their_sequences(spark):
    """No prompt anywhere: the loss limit closes sequences, which are padded and not cut into small ones."""
    rng = np.random.default_rng(8)
    for tokens in (rng.integers(20, 3000, 300), np.full(20, 20_000)):
        bins = packing.place(tokens, tokens, packing.Limits())
        assert tokens.sum() / len(bins) >= 1900
    ones = np.ones(200_000, dtype=np.int64)
    assert [len(b) for b in packing.place(ones, ones, packing.Limits())] == [128] * 1562 + [64]
    lines = spark.createDataFrame([(i, " ".join(f"word{k}" for k in rng.integers(0, 500, n))) for i, n in enumerate(rng.integers(20, 400, 3000))], "doc_id long, text string")
    pieces = packing.pack(lines.coalesce(1)).toPandas()
    assert pieces.length.sum() / pieces.sequence_id.nunique() >= 1900


def test_dot_product_is_not_longest_fit():
    """With loss room left, a shorter piece that bears loss wins over a longer one of prompt alone."""
    tokens, loss = np.array([60, 30, 28]), np.array([10, 0, 27])
    # longest-fit would put the 60 and the 30 together
    assert packing.place(tokens, loss, packing.Limits(tokens=100, segments=2, loss_tokens=40, least_cut=50))[0] == [(2, 0, 28), (0, 0, 60)]


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups(docs, none, spark):
    for capacity in (1, 2, 1000):
        got = exact_dedup.exact_groups(docs, capacity).collect()
        groups = Counter(squeezed(r.text) for r in docs.collect())
        ids = {}
        for r in docs.collect():
            ids.setdefault(squeezed(r.text), []).append(r.doc_id)
        by_hash = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
        assert len(got) == docs.count()
        kept = Counter()
        for r in got:
            t = by_hash[r.text_sha256]
            assert r.group_size == groups[t] and r.keep_id == min((i for i in ids[t] if i is not None), default=None)
            kept[t] += r.kept
        assert all(kept[t] == 1 for t in groups)
        out = exact_dedup.drop_exact_copies(docs, capacity)
        assert out.columns == docs.columns
        rows = {tuple(r) for r in docs.collect()}
        stay = [r for r in out.collect()]
        assert len(stay) == len(groups) and {tuple(r) for r in stay} <= rows
        assert {(squeezed(r.text), r.doc_id) for r in stay} == {(t, min((i for i in ids[t] if i is not None), default=None)) for t in groups}
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_exact_copies(none).count() == 0


def test_copies_of_a_winner_are_settled_where_they_are_read(spark):
    """Null and repeated ids too: whatever the ids, all rows of a frequent text but the aggregate's one never meet in a window."""
    rows = [(None, "a")] * 300 + [(7, "b")] * 300 + [(i, f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h_size", F.lit("x"))
    got = exact_dedup.exact_groups(df, 8).collect()
    assert Counter((r.keep_id, r.group_size, r.kept) for r in got if r.group_size > 1) == {(None, 300, True): 1, (None, 300, False): 299, (7, 300, True): 1, (7, 300, False): 299}
    out = exact_dedup.drop_exact_copies(df, 8).collect()
    assert len(out) == 52 and {r.h_size for r in out} == {"x"} and sum(r.doc_id is None for r in out) == 1
    heavy = exact_dedup.heavy_digests(df.select(F.col("doc_id").alias("__id"), F.unhex(F.sha2("text", 256)).alias("__digest"), F.monotonically_increasing_id().alias("__key")), 8).collect()
    assert len(heavy) == 2


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=9), st.integers(1, 5))
def test_capacity_is_minimal(sizes, shards):
    best = min(max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *c, len(sizes)))) for c in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1))
    assert sharding.smallest_capacity(sizes, shards) == best
    at = [0, *sharding.cuts(sizes, shards), len(sizes)]
    assert at == sorted(at) and len(at) == shards + 1 and max(sum(sizes[a:b]) for a, b in itertools.pairwise(at)) <= best


def test_sharding(docs, none, spark, sf):
    for table in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        got = sharding.shard(table, 5, cell_rows=2).toPandas()
        assert len(got) == table.count()
        for _, own in got.groupby("shard"):
            assert sorted(own["slot"]) == list(range(len(own)))
        assert got.groupby("text_crc32")["shard"].nunique().max() == 1
        assert sorted(got["size"]) == sorted(len((r.text or "").encode()) + 8 for r in table.select("text").collect())
    assert sharding.shard(none).count() == 0


def grams(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def test_ngram_join(docs, none, spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text for r in table.collect()}
    rng = np.random.default_rng(5)
    extra = []
    for k in range(40):  # near copies at every similarity around the threshold
        w = text[k].split()[:200]
        for i in rng.integers(0, max(1, len(w)), k % 12):
            if w:
                w[i] = f"edit{k}"
        extra.append((10_000 + k, " ".join(w)))
    table = table.union(spark.createDataFrame(extra, "doc_id long, text string"))
    text |= dict(extra)
    sets = {i: grams(t) for i, t in text.items()}
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for i, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(i)
    shared = Counter(p for own in index.values() for p in itertools.combinations(sorted(own), 2))
    for (a, b), n in shared.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    for options in ({"block": 4}, {"block_grams": 500}):
        got = ngram_join.ngram_join(table, **options).collect()
        assert len(got) == len(text)
        for r in got:
            assert (r.n_links, r.class_id, r.kept) == (links[r.doc_id], find(r.doc_id), find(r.doc_id) == r.doc_id)
    got = {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(docs).collect()}
    assert {(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 1), (8, 7, 1)} <= got
    assert ngram_join.ngram_join(none).count() == 0
    left = ngram_join.keep_one_of_each_group(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([1, 4, 5, 6, 7, 9, 10, BIG, BIG + 2, None])
    exact = {r.doc_id for r in ngram_join.ngram_join(docs).collect()}
    assert {BIG, BIG + 2} <= exact  # not rounded beside a null


def test_ngram_join_at_the_threshold():
    for k in range(1, 3000):  # 4k of 5k n-grams shared
        both = np.array([[4 * k]], dtype=np.float32)
        assert ngram_join._alike(both, np.array([5 * k]), np.array([4 * k]), 0.8).all()
        assert not ngram_join._alike(both, np.array([5 * k + 1]), np.array([4 * k]), 0.8).any()


def test_ngram_join_shared_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(120)) for x in "abc")
    rows = [(1, a), (1, b), (1, ""), (2, a + " end"), (3, b + " end"), (4, ""), (None, c), (None, c + " end"), (None, c + " end"), (5, "five")]
    got = {(r.doc_id, r.class_id, r.n_links, r.kept) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id IS NOT NULL").collect()}
    assert got == {(1, 1, 1, True), (1, 1, 0, True), (2, 1, 1, False), (3, 1, 1, False), (4, 4, 0, True), (5, 5, 0, True)}
    null = [(r.class_id, r.n_links) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id IS NULL").collect()]
    assert [n for _, n in null] == [2, 2, 2] and len({c for c, _ in null}) == 1 and null[0][0] < 0


def test_bands_reach_the_recall():
    for recall in (0.9, 0.999, 0.99999):
        b, r = ngram_join.choose_bands(0.8, recall)
        assert 1 - (1 - 0.8**r) ** b >= recall


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 101), (7, 7), (60, 3)]
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in [*range(51), 60]} | {(100, 100), (101, 100)}


def test_embedding_join(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centers[i % 12] + rng.normal(scale=0.18, size=16)], int(i % 3)) for i in range(300)]
    rows += [(300 + i, rows[0][1], 0) for i in range(20)]
    rows += [(410, [1e200, 1e200], 5), (411, [1e-200, 1.1e-200], 5), (412, [3.0, 3.0], 5)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [1.0, None], 0), (403, [float("nan")] * 16, 0), (404, rows[0][1], None), (405, [float("inf")] * 16, 1), (406, [1.0, 0.0], 1), (407, [2.0, 0.0], 1), (408, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = [(i, np.array(v), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = Counter(), {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, v, a), (j, w, b) in itertools.combinations(ok, 2):
        v, w = v / np.abs(v).max(), w / np.abs(w).max()
        if a == b and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93:
            links[i] += 1
            links[j] += 1
            x, y = sorted((find(i), find(j)))
            root[y] = x
    assert sum(links.values()) > 500
    for block in (4, 1024):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_join.embedding_join(df, block=block, axes=4).collect()}
        assert got == {i: (links[i], find(i), find(i) == i) for i, *_ in rows}
    assert embedding_join.embedding_join(df.limit(0)).count() == 0


def test_embedding_keys_do_not_run_together(spark):
    rows = [(1, [2.0], "x,1.0"), (2, [1.0, 2.0], "x"), (3, [1.0, 2.0], "x"), (BIG, [0.0, 1.0], "y"), (BIG + 2, [-0.0, 1.0], "y"), (None, [0.0, 1.0], "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").selectExpr("*", "'a' AS key", "'b' AS vec", "0 AS rep", "0 AS weight", "0 AS dim", "0 AS component_id")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_join.embedding_join(df).collect()}
    assert got == {1: (0, 1), 2: (1, 2), 3: (1, 2), BIG: (1, BIG), BIG + 2: (1, BIG), None: (0, None)}


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 6), min_size=1, max_size=8), st.integers(0, 900))
def test_budget_fit(counts, budget):
    lengths, n = np.array(list(counts)), np.array(list(counts.values()))
    take = mixing.fit_budget(lengths, n, budget)
    assert (take >= 0).all() and (take <= n).all()
    got, total = int((take * lengths).sum()), int((lengths * n).sum())
    share = int((np.array([c * budget // total for c in n.tolist()] if total else n * 0) * lengths).sum())
    base = np.array([c * budget // total for c in n.tolist()]) if total else n * 0
    sums = {share}  # of all that adding documents to the equal share reaches, the nearest
    for size, k in zip(lengths.tolist(), (n - base).tolist()):
        sums = {s + j * size for s in sums for j in range(k + 1)}
    assert abs(budget - got) == min(abs(budget - s) for s in sums) if budget < total else got == total
    for window in (1, 30):  # whatever the window
        assert abs(budget - int((mixing.fit_budget(lengths, n, budget, window) * lengths).sum())) == abs(budget - got)


def test_mixing(docs, none, spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(table).toPandas()
    sizes = got.groupby("source")["size"].sum().sort_index()
    budget, weight = 1.5 * sizes.sum(), dict(zip(sizes.index, itertools.cycle((5, 2, 1))))
    target, free = {}, set(sizes.index)
    while True:
        rate = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    target |= {s: rate * weight[s] for s in free}
    for s, own in got.groupby("source"):
        assert abs(own["target"].iloc[0] - target[s]) < 1e-6 * target[s] and own["source_size"].iloc[0] == sizes[s]
        assert abs(own["taken"].sum() - target[s]) <= max(30, 0.01 * target[s])
    assert (got["taken"] <= 2 * got["size"]).all()
    again = mixing.mix(table.repartition(7)).toPandas()
    assert got.set_index("doc_id")["taken"].sort_index().equals(again.set_index("doc_id")["taken"].sort_index())
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(none).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.filter("text IS NULL OR text RLIKE '^[ \\\\t\\\\n]*$'").count() == 3
    # copies go to the rows the mix gives them, repeated and null ids too
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r.source, r["size"]] += r.taken
    got = Counter()
    for r in out.collect():
        got[r.doc_id, r.source, words(r.text)] += words(r.text)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}


def test_toxicity_held_out(spark, docs, none):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(table, labels)
    got = toxicity.score(table, model).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all()
    assert (got["predicted"] == got["toxic"]).mean() > 0.95 and got[got["toxic"] == 1]["predicted"].mean() > 0.9
    word = lambda *w: toxicity.score_words([toxicity.letters(x) for x in w], model.table, model.decay)
    plain, inserted, gapped = word("the", "idxiot", "i.d.i.o.t")
    assert plain < inserted < gapped
    scores = toxicity.score(docs, model)
    assert Counter(r.doc_id for r in scores.collect()) == Counter(r.doc_id for r in docs.collect())
    by = {r.doc_id: r.score for r in scores.collect()}
    assert by[4] == by[5] == by[6] < 0.5 and all(0 <= x <= 1 for x in by.values())  # null, empty and blank texts
    long = " ".join(W * 50)
    insults = " you idiot. moron, stupid idiot."
    extra = spark.createDataFrame([(1, long), (2, long + insults), (3, "so\u3000i d i o t\u00a0scum, you moron"), (4, "you idiot moron stupid idiot " + long), (5, insults)], "doc_id long, text string")
    judged = toxicity.score(extra, model).orderBy("doc_id").collect()
    assert [r.predicted for r in judged] == [0, 1, 1, 1, 1]
    assert judged[1].score >= judged[4].score - 1e-12  # what stands before a sentence takes nothing from it
    assert model.curve[1] > 0 and model.curve[2] >= 0
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and {tuple(r) for r in left.collect()} == {tuple(r) for r in docs.collect() if by[r.doc_id] < 0.5}
    assert toxicity.score(none, model).count() == 0 and toxicity.drop_toxic(none, model).count() == 0
    blank = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, blank).collect()} == {0.0}
    assert toxicity.lowered("so i d i o t s") == "so idiots"


def letter_kernel(a, b, decay):
    """By the definition: common runs of three letters in order, within the span."""

    def own(w):
        w = f"\x01{w}\x02"
        return [((w[i], w[j], w[k]), decay ** (k - i - 2)) for i, j, k in itertools.combinations(range(len(w)), 3) if k - i < toxicity.SPAN]

    x, y = own(a), own(b)
    norm = lambda v: np.sqrt(sum(n * n for _, n in v))
    return sum(m * n for s, m in x for t, n in y if s == t) / (norm(x) * norm(y))


def evidence(*texts):
    out = np.full((len(texts), toxicity.ABOVE), -9.0)
    for row, windows in zip(out, texts):
        for v in windows:
            if len(v):
                k = min((v > 0).sum(), toxicity.ABOVE - 1)
                row[k] = max(row[k], min(3, max(-3, v.max())))
    return out


def test_toxicity_tables_are_the_kernel():
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 6, rng.integers(1, 18))) for _ in range(30)]
    kernel = toxicity.Kernel(words[:12], 0.5)
    direct = np.array([[letter_kernel(a, b, 0.5) for b in words[:12]] for a in words])
    assert np.allclose(kernel.words(words), direct @ kernel.whiten, atol=1e-4)
    w = rng.normal(size=kernel.whiten.shape[1])
    value = direct @ kernel.whiten @ w
    assert np.allclose(toxicity.score_words(words, kernel.table(w), 0.5), value, atol=1e-4)
    # a text of three sentences: the highest word of those with so many words above zero; and the witness of each sentence
    text = " ".join(words[:7]) + ". " + " ".join(words[7:9]) + "\n" + words[9]
    model = toxicity.Model(kernel.table(w), 0.25, np.zeros(3), 0.5, 0.1)
    own = value[:10] + 0.25
    scorer = toxicity.Scorer(model.table, model.bias, model.decay)
    assert np.allclose(scorer.evidence(["", text]), evidence([np.zeros(0)], [own[:7], own[7:9], own[9:]]), atol=1e-4)
    for n in (31, 32, 33, 48, 49, 200):  # windows of 32 words that begin 16 apart, of which the last reaches the end
        many = rng.integers(0, 10, n)
        cuts = [many[i : i + 32] for i in range(0, max(1, n - 16), 16)]
        assert sum(len(c) for c in cuts) >= n and np.allclose(scorer.evidence([" ".join(words[i] for i in many)]), evidence([own[c] for c in cuts]), atol=1e-4)
    best = [own[:7].argmax(), 7 + own[7:9].argmax(), 9]
    for toxic in (0, 1):
        want = [words[i] for i in best if not toxic or own[i] > 0 or own[i] == own.max()]
        frame = pd.DataFrame({"__text": [text], "toxic": [toxic]})
        assert [*next(toxicity._witnesses(model)(iter([frame])))["word"]] == want


def test_machine_is_the_minimum():
    rng = np.random.default_rng(4)
    x, y, n = rng.normal(size=(80, 5)), np.where(rng.random(80) < 0.3, 1.0, -1.0), rng.integers(1, 9, 80).astype(float)
    x[:, 0] += y
    c = np.where(y > 0, n / n[y > 0].sum(), n / n[y < 0].sum())
    loss = lambda w: (c * np.maximum(0, 1 - y * (np.c_[x, np.ones(80)] @ w)) ** 2).sum() + 1e-3 * w @ w
    w = toxicity.machine(x, y, n, 1e-3)
    assert all(loss(w) <= loss(w + rng.normal(scale=s, size=6)) + 1e-12 for s in (1e-4, 1e-2, 1) for _ in range(50))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><header>Site</header><nav><ul><li><a href=/>Home {i}</a></ul></nav>
<div class="cookie-notice">Accept</div><article><h1>Title {i}</h1><p>First &amp; {t}<p>Second<br>line &copy;<div class="ad">Buy</div><section id="comments">Me too</section></article>
<aside>More</aside><form><input>Send</form><footer>End {i}</footer>"""
PLAIN = '<html><body><div class="menu"><a href=/>Home</a></div><div id=content><p>Body {i} {t}</p><p>Shared line</p></div><div class="footer">x</div></body></html>'


def test_main_text(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.replace("{i}", str(i)).replace("{t}", "text" * i)) for i in range(6)]
    rows += [(10 + i, f"http://b.example:80/{i}?q", PLAIN.replace("{i}", str(i)).replace("{t}", "words " * 5)) for i in range(6)]
    rows += [(20, None, None), (21, "https://a.example/x", ""), (22, "nonsense", "<p>only <b>this</b>"), (22, "nonsense", "<p>only <b>this</b>"), (None, "u", "a < b &lt; c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()]
    by = {}
    for i, t, n in got:
        assert n == len(t)
        by.setdefault(i, []).append(t)
    for i in range(6):
        assert by[i] == [f"Title {i}\nFirst & {'text' * i}".rstrip() + "\nSecond line ©"]
        assert by[10 + i][0].split("\n")[0] == f"Body {i} words words words words words"
    assert by[20] == [""] and by[21] == [""] and by[22] == ["only this"] * 2 and by[None] == ["a < b < c"]
    assert html_text.extract(df.limit(0)).count() == 0


def page_texts(spark, pages):
    df = spark.createDataFrame([(i, f"https://c.example/{i}", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.extract(df).collect()}


def test_main_text_template_inside_main(spark):
    page = "<html><body><main><p>Send this on to friends</p><p>Story {i} of <b>the</b> day</p><p>Get our letter</p></main></body></html>"
    got = page_texts(spark, [page.replace("{i}", f"n{i}") for i in range(12)])
    assert got == {i: f"Story n{i} of the day" for i in range(12)}


def test_main_text_copies_are_no_support(spark):
    page = "<html><body><main><p>One {i}</p><p>Two {i} here</p></main></body></html>"
    got = page_texts(spark, [page.replace("{i}", "x") + f"<!-- {i} -->" for i in range(20)] + [page.replace("{i}", "y")])
    assert got == {i: "One x\nTwo x here" for i in range(20)} | {20: "One y\nTwo y here"}
    plain = "<html><body><div><p>One thing</p><p>Two things</p></div></body></html>"
    assert set(page_texts(spark, [plain + f"<!-- {i} -->" for i in range(6)]).values()) == {"One thing\nTwo things"}


def test_main_text_classes_are_nested():
    text, words = html_text._TEXT, html_text._WORDS
    top, left, right, a, b, c = 8, 16, 24, 32 | text, 40 | text, 48 | text | words
    tokens = [(top, 0, (9,)), (left, top, (1,)), (56, left, (1,)), (right, top, (2,)), (64, right, (2,)), (a, left, (3,)), (b, right, (3,)), (c, right, (4,))]
    assert set(html_text.nested(tokens)) == {left, 56, right, 64, c}  # a and b share a vector, but lie in two classes
    assert {a, b} < set(html_text.nested([(t, left if t == b else u, v) for t, u, v in tokens]))


@pytest.mark.parametrize("page", [
    '<div class="site has-sidebar"><article><p>Body text</p></article></div>', '<div class="page nav-open"><article><p>Body text</p></article></div>', '<div class="sidebar"><main><p>Body text</p></main></div>',
    '<form id=f><div class="promo"><article><p>Body text</p></article></div></form>', '<article><p class="share-price">Body text</p></article>', '<main><div class="search-results-body">Body text</div></main>',
    '<div class="shareholders commentary"><p>Body <a href=/>text</a></p></div>', '<p><a href=/>Body text</a></p>', '<article></article><p>Body text</p>',
    '<article><p>Body <span class="ad">Buy <span>it</span> now</span>text<a class="sponsored-link" href=/>Sponsor</a></p></article>', '<main><section id="side-effects">Body text</section></main>',
    '<article>Body text</article><div class="comment-list"><article class="comment-body">Me too</article></div>', '<article>Body text<div class="ad-slot">Buy</div><ul class="share-buttons"><li>X</ul></article>',
])
def test_main_text_hints(page):
    assert html_text._blocks(page, frozenset()) == ["Body text"]


def test_main_text_deep_pages(spark):
    """Paths of any depth are told apart: the line at the end of one branch is the template's, its copy in the other is text."""
    page = "<html><body>" + "<div class='level of the page'>" * 60 + "<p>Foot line of the site</p>" + "</div>" * 60 + "<div class='first'>" + "<div class='level of the page'>" * 60 + "<p>Story {i} here</p>"
    pages = [page.replace("{i}", f"n{i}") + ("<p>Foot line of the site</p>" if i == 3 else "") for i in range(8)]
    got = page_texts(spark, pages)
    assert got[3].split("\n") == ["Story n3 here", "Foot line of the site"] and got[4] == "Story n4 here"


def test_pages_hold_their_documents(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = 0
    for r in html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect():
        m = re.search(r"/(\d+)(?:[/?#]|$)", r.url)
        if m and int(m[1]) in text:
            want = [" ".join(x.split()) for x in text[int(m[1])].split("\n")]
            assert r.text.split("\n")[1:] == [x for x in want if x]
            n += 1
    assert n > 5 and html.unescape("&amp;") == "&"


CALLS = "conv_id long, call_id string, name string, arguments string, position long, depends_on array<string>"


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, "a", "t", '{"z":1,"b":{"y":[1,2.5,"x"],"a":null}}', 0, ["b"]), (1, "b", "t", '{"z":"q"}', 1, ["c", "gone"]), (1, "c", "t", "nope", 2, []), (1, "d", "u", "{}", 3, ["a", "c"]), (1, "a", "t", '{"z":1}', 9, []),
        (2, "x", "t", '{"z":1,"w":true}', 0, ["y"]), (2, "y", "t", "[1]", 1, ["x"]), (2, "z", "t", None, 2, None), (3, None, "t", '{"z":1}', 0, None),
        (4, "p", "t", '{"z":1}', 0, ["p"]), (4, "p", "t", '{"z":1}', 0, None), (4, "p", "t", '{"z":2}', 0, None), (4, "q", "t", '{"z":1}', None, ["p"]),
    ], CALLS)
    results = spark.createDataFrame([(1, "a", "ok", 5), (1, "a", "later", 6), (1, None, "x", 1)], "conv_id long, call_id string, content string, position long")
    schemas = {"t": {"z": ("integer", True), "b": ("object", False)}, "u": {}}
    got = tool_calls.link_tool_calls(calls, results, schemas, run_length=2).collect()
    order = {c: [r.call_id for r in sorted((r for r in got if r.conv_id == c), key=lambda r: r.topo_order)] for c in (1, 2)}
    assert order[1].index("c") < order[1].index("b") < order[1].index("a") < order[1].index("d") and order[2][0] == "z"
    for c in (1, 2, 3):
        assert sorted(r.topo_order for r in got if r.conv_id == c) == list(range(sum(r.conv_id == c for r in got)))
    by = {(r.conv_id, r.call_id, r.position): r for r in got}
    assert by[1, "a", 0].canonical_json == '{"arguments":{"b":{"a":null,"y":[1,2.5,"x"]},"z":1},"id":"a","name":"t","result":"ok"}'
    assert json.loads(by[1, "a", 0].canonical_json)["result"] == "ok" and by[1, "a", 0].n_results == 2
    assert by[1, "a", 9].status == "duplicate" and by[2, "x", 0].status == "cycle" and by[3, None, 0].status == "no id"
    assert by[1, "b", 1].errors == ["z:type"] and by[2, "x", 0].errors == ["w:unknown"] and by[1, "c", 2].errors == ["arguments:malformed"] and by[2, "y", 1].errors == ["arguments:not an object"]
    assert sorted(r.status for r in got if r.call_id == "p") == ["duplicate", "duplicate", "unanswered"]  # one position
    assert sorted(r.topo_order for r in got if r.conv_id == 4) == [0, 1, 2, 3]
    clash = calls.selectExpr("*", "1 AS level", "2 AS first_row", "3 AS __row", "4 AS content")
    assert tool_calls.link_tool_calls(clash, results, schemas).count() == len(got)
    assert tool_calls.link_tool_calls(calls.limit(0), results, schemas).count() == 0


def test_tool_calls_have_faults(spark):
    got = queries.QUERIES["op2_tool_call_linking"](spark, "/root/testdata/sf0.01").toPandas()
    assert {"duplicate", "answered", "unanswered"} <= set(got["status"]) and {"lines:unknown", "turn:type"} <= {e for x in got["errors"] for e in x.split(",")}
    late = got.sort_values("topo_order").groupby("conv_id")["position"].apply(lambda x: (x.diff() < 0).any())
    assert late.any()  # a call that waits for a later one stands after it


def test_long_conversation(spark):
    """A conversation with all parents late: the order is topological; many calls name one parent."""
    n = 40
    rows = [(1, f"c{i}", "t", "{}", i, [f"c{i + 1}", f"c{n - 1}"]) for i in range(n)] + [(2, f"c{i}", "t", "{}", i, ["c0"]) for i in range(n)]
    got = tool_calls.link_tool_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], "conv_id long, call_id string, content string, position long"), {}).collect()
    assert {r.call_id: r.topo_order for r in got if r.conv_id == 1} == {f"c{i}": n - 1 - i for i in range(n)}
    assert {r.call_id: r.topo_order for r in got if r.conv_id == 2} == {f"c{i}": i for i in range(n)}


def test_tool_plan_has_no_python(spark, sf):
    df = queries.QUERIES["op2_tool_call_linking"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    from compare import rows_match

    rows_match(spark, queries.QUERIES[name], queries.ORACLES[name], sf)


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = table
    for name, stage in P.STAGES[:3]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == table.columns and 0 < out.count() <= docs.count(), name
        docs = out
    assert docs.groupBy("text").count().filter("count > 1").count() == 0
    pieces = P.run(spark, sf)
    assert pieces.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0


def test_pipeline_on_awkward_tables(spark, docs, none, sf):
    import corpus_pipeline as P

    for table in (docs, none):
        now = table
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, now, sf)
            assert out.columns == docs.columns, name
            rows = {tuple(r) for r in now.collect()}
            assert {tuple(r) for r in out.collect()} <= rows, name
            now = spark.createDataFrame(out.collect(), DOCS)
        pieces = P.STAGES[-1][1](spark, now, sf)
        assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in now.collect()}
        if table is docs:
            assert {4, 7, 9, 10, BIG, BIG + 2} & {r.doc_id for r in now.collect()} >= {4, BIG}


def test_session_settings_stay(spark, sf):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name in ("op1_vector_packing", "op5_ngram_jaccard_join", "op6_token_counts", "op9_toxicity", "op10_html_main_text"):
        queries.QUERIES[name](spark, sf)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
