"""Decontamination, prefix trie and token alignment against brute force."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlake.llm import positional_index, prefix_trie, queries, token_alignment

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import rows_match  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HEX = lambda text: hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_benchmark_decontamination", "op12_conversation_prefix_trie"])
def test_sql(spark, sf, name):
    rows_match(spark, queries.QUERIES[name], queries.ORACLES[name], sf)


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def leaks(docs, items, slack):
    """(n_words, n_hit, n_items, sha, contaminated, near items) of each text, window by window."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9)):
            if w:
                windows[tuple(w[i : i + 10])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found, near = words(text), set(), set(), set()
        for x, ids in windows.items():
            n = len(x)
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == x:
                    hit |= set(range(i, i + n))
                    found |= ids
            if any(set(x) <= set(w[i : i + n + slack]) for i in range(len(w))):
                near |= ids
        out.append((doc, len(w), len(hit), len(found), HEX(",".join(sorted(found))), bool(hit), len(near)))
    return sorted(out, key=str)


def test_decontamination(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(30)] + ["É", "ß9", "the"] * 3
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(3, "same id, another text of more than ten words is one item too"), (None, "no id here"), (50, ""), (51, None), (52, "... !"), (53, items[0][1]), (54, "again again again again")]
    docs = [(i, " ".join(make(rng.choice([0, 5, 60, 300])))) for i in range(40)]
    for k in range(30):
        own, text = make(80), words(rng.choice(items)[1])
        if k % 3 == 1:
            rng.shuffle(text)
        if k % 3 == 2 and len(text) > 4:
            text[2:2] = ["between"]
        own[20:20] = text
        docs.append((100 + k, "-".join(own) if k % 2 else " THE ".join([" ".join(own[:50]), " ".join(own[50:])])))
    docs += [(None, None), (None, items[4][1]), (7, items[5][1]), (7, items[5][1]), (8, ""), (9, (" ".join(make(500)) + " ") * 20 + items[2][1] * 2), (10, "again " * 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"block": F.lit("x"), "term": F.lit(1), "__text": F.lit(0)}).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit("clash"))
    for slack, block in ((2, 1000), (0, 10**6), (7, 1)):
        got = positional_index.decontaminate(frame, bench, slack=slack, block_words=block).collect()
        assert sorted(map(tuple, got), key=str) == leaks(docs, items, slack)
    index = positional_index.build(frame, block_words=500)
    found = [positional_index.search(index, positional_index.windows_of(bench), 2, group_windows=n) for n in (3, 50_000)]
    pairs = [{(r.block, r.ordinal, r.item_id, r.near_id) for r in f.filter("at IS NULL").collect()} for f in found]
    assert pairs[0] == pairs[1] and pairs[0]
    for d, b in ((frame.limit(0), bench), (frame, bench.limit(0))):
        got = positional_index.decontaminate(d, b).collect()
        assert len(got) == d.count() and not any(r.n_hit or r.n_items or r.n_near_items for r in got)


def trie(turns):
    """Nodes by definition, from lists of (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = Counter(v[:-1] for v in members if v)
    out = []
    for v, convs in members.items():
        below = [u for u in members if u[: len(v)] == v]
        ends = sorted(c for c in convs if built[c] == v)
        out.append((min(convs), len(v), min(members[v[:-1]]) if v else None, len(convs), kids[v], sum(kids[u] == 0 for u in below), sum((len(members[u]) - 1) * len(u[-1][1]) for u in below if u), HEX(",".join(map(str, ends)))))
    return sorted(out, key=str)


def test_prefix_trie(spark):
    rng = random.Random(6)
    turns = []
    for base in (0, 100, -200, 5000, 7_000_000_000_000_000_000):
        for c in [base, *(base + rng.randrange(1, 100) * (-1 if base < 0 else 1) for _ in range(25))]:
            for k in range(rng.choice([1, 2, 4, 9])):
                turns.append((c, k, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", None, "", "é💡", "long text " * 40])))
    turns += [(c, k, "user", "the same") for c in range(300, 340) for k in range(7)]  # equal whole sequences
    turns += [(205, None, "user", "first"), (205, 3, "user", "x"), (205, 3, "assistant", "x"), (205, 3, "user", "x"), (None, 1, "user", "lost")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("x"), "digest": F.lit(0), "row": F.lit(1)}).repartition(5)
    want = trie(turns)
    for run in (2, 4096):
        assert sorted(map(tuple, prefix_trie.trie(frame, run=run).collect()), key=str) == want
    assert prefix_trie.trie(frame.limit(0)).count() == 0


def test_long_conversations_and_lists_span_tasks(spark):
    frame = spark.range(20_000).select(F.lit(100).cast("long").alias("conv_id"), (19_999 - F.col("id")).alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    places = {r.place: r.digest for r in prefix_trie.numbered(frame).collect()}
    assert sorted(places) == list(range(1, 20_001)) and places[1] == HEX("4:user19999")
    ends = spark.range(30_000).select(F.lit(1).cast("long").alias("depth"), F.lit(2).cast("decimal(38,0)").alias("s1"), F.lit(-3).cast("decimal(38,0)").alias("s2"), F.col("id").alias("conv_id"))
    got = prefix_trie.end_lists(ends, 1000).collect()
    assert [r.ends_sha256 for r in got] == [HEX(",".join(map(str, range(30_000))))]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(1, 9))
def test_merge_path(a, b, work):
    x, y = np.array(sorted(a), dtype=np.int64), np.array(sorted(b), dtype=np.int64)
    i, j = token_alignment.merge_path(x, y, work)
    merged = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
    for at, p, q in zip([*range(0, len(merged), work), len(merged)], i, j):
        assert (p, q) == (sum(s == 0 for _, s in merged[:at]), sum(s == 1 for _, s in merged[:at]))
    left, right = token_alignment.common_ends(x, y, work)
    assert x[left].tolist() == y[right].tolist() == sorted(a & b)


def aligned(docs):
    """Rows by definition: both libraries on whole texts, groups and links by a plain merge."""
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer

    b_lib = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    a_lib = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    a_bytes = lambda i: bytes(byte[c] for c in a_lib.id_to_token(i))

    def b_bytes(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x..>", p) else p.replace("▁", " ").encode()

    rows, total = [], Counter()
    for doc, text in docs:
        raw = (" " + (text or "")).encode()
        a, b = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        if not text or b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            rows.append((doc, 0, 0, [], ""))
            continue
        end_a, end_b = np.cumsum([len(a_bytes(i)) for i in a]), np.cumsum([len(b_bytes(i)) for i in b])
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(end_a.tolist()) & set(end_b.tolist())):
            p, q = int(np.searchsorted(end_a, e)) + 1, int(np.searchsorted(end_b, e)) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        total.update(links)
        rows.append((doc, len(a), len(b), links, HEX(";".join(groups))))
    top = defaultdict(int)
    for (_, y), n in total.items():
        top[y] = max(top[y], n)
    return sorted([(d, m, n, len(x), len(x), sum(total[p] == top[p[1]] for p in x), sum(total[p] for p in x), h) for d, m, n, x, h in rows], key=str)


def test_token_alignment(spark, sf):
    odd = ["", "a  b ", " a", " ", "ﬁ ①▁ Å", "a\tb\n\nc", "x  y", "<s> hi <unk> </s>", "<|endoftext|> x", "\0 a\0b", "é　 b   c", "x\x1c y\x85 z  ", "  \n lead", "word " * 3000, "end\n", "a" * 5000, None]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    docs += [(10**6 + i, t) for i, t in enumerate(odd)] + [(None, "no id"), (1, "twice"), (1, "twice")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"block": F.lit("x"), "pair": F.lit(1), "own": F.lit(0)}).repartition(3)
    want = aligned(docs)
    for options in ({}, {"work": 7, "block_bytes": 20_000, "part": 50}):
        assert sorted(map(tuple, token_alignment.align(frame, **options).collect()), key=str) == want
    assert token_alignment.align(frame.limit(0)).count() == 0


LETTERS = st.sampled_from(list("abcXYZ 'st0123.,!?\n\t\x1c\x85\xa0éßİΣ中文💡▁<|>") + ["<|endoftext|>", "<s>", "  ", " the", "　"])


@settings(max_examples=150, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=30).map("".join))
def test_stretches_have_the_librarys_ids(text):
    import public_tokenizers as public

    if not hasattr(test_stretches_have_the_librarys_ids, "both"):
        test_stretches_have_the_librarys_ids.both = token_alignment.Tokenizers(public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
    both = test_stretches_have_the_librarys_ids.both
    got = both.ids(both.stretches(text))
    if "▁" in text:
        assert any(x is None for x in got)
    else:
        a, b = (np.frombuffer(b"".join(x[side] for x in got), "<u4").tolist() for side in (0, 1))
        assert a == both.a.encode(" " + text, add_special_tokens=False).ids and b == both.b.encode(text)
