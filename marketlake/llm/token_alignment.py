"""Cross-tokenizer alignment by merge-path partitioning.

Each text is encoded by two tokenizers whose tokens are stretches of its bytes.
Where a token of A and one of B end at the same byte both sequences are cut, and
the two tokens are linked. The two lists of ends are merged as a merge path:
diagonals at equal distances cut the merge into pieces of equal work, and a
binary search along every diagonal, all at once, says where. Each piece finds
its common ends alone; a common end that a diagonal splits is found at the
boundary, and groups that reach over one are stitched from the pieces' links.

Tokenizers meet white space alike: neither has a token that goes on from other
characters into a space. Texts are therefore cut before spaces that follow
another character, distinct stretches are encoded once per worker, and a text of
any length is read in parts of bounded size.

How often a pair of ids is linked is counted over the whole corpus in two
steps: blocks of texts hold each distinct pair once with its count, blocks are
summed by pair, and the sums go back to the blocks that hold the pair, where the
texts' own counts wait in a written table. Rows by pair are one a block, so that
no pair is hot; the best count of a B id is a table bounded by the vocabulary.

Defined results: a text that is null or empty, or whose joined tokens are not
its bytes, has no tokens; rows with equal or null ids are texts of their own;
an empty table gives no row; other columns are not read, so their names cannot
clash.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, frozen, text_or_empty, written

#: Before a space that follows a character that is not white space.
_CUT = re.compile(r"(?<=\S) ")
_WIDE = np.int64(1 << 20)  # a pair of ids as one number


class Tokenizers:
    """Ids of stretches of text under both tokenizers, and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str, keep: int = 400_000):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # printable stand-ins of bytes in the vocabulary file: printable Latin-1 as itself, the rest from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(stand[c] for c in n) if all(c in stand for c in n) else n.encode() for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces reach over spaces")
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.width_a, self.width_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        # ids as text with what follows: inside a group, and at the end of its side
        self.shown = [f"{i}{e}" for i in range(len(names)) for e in ",|"] + [f"{i}{e}" for i in range(len(pieces)) for e in ",;"]
        self.base_b = 2 * len(names)
        self.keep, self.known = keep, {}

    def stretches(self, text: str) -> list[str]:
        """The text behind a space, cut before spaces; each stretch without its own first space."""
        return _CUT.split(text) if text else []

    def learn(self, new: list[str], together: int = 256) -> None:
        """Encodes stretches and keeps their (A ids, B ids) as 32-bit integers; None where a tokenizer does not give the bytes back.

        Stretches are encoded many in one text, which no token of theirs reaches over; those that end in white space, which the one
        behind them would change, alone.
        """
        plain = [u for u in new if u and not u[-1].isspace()]
        alone = [[u] for u in new if not u or u[-1].isspace()]
        chunks = [plain[i : i + together] for i in range(0, len(plain), together)] + alone
        while chunks:
            chunks = [[u] for c in self._encode(chunks) for u in c]

    def _encode(self, chunks: list[list[str]]) -> list[list[str]]:
        """Encodes chunks; gives back those of several stretches that have to be taken apart."""
        texts, apart = [" ".join(c) for c in chunks], []
        ids_a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for chunk, text, a, b in zip(chunks, texts, ids_a, self.b.encode(texts, num_threads=1)):
            a, b = a.ids, b if text else [self.b.piece_to_id("▁")]  # a space at the end; the library gives an empty text nothing
            raw = b" " + text.encode("utf-8")
            if not b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b)):
                if len(chunk) > 1:
                    apart.append(chunk)
                else:
                    self.known[chunk[0]] = None
                continue
            a, b = np.array(a, dtype="<u4"), np.array(b, dtype="<u4")
            cuts = np.cumsum([len(u.encode("utf-8")) + 1 for u in chunk])
            at_a, at_b = (np.searchsorted(np.cumsum(w[x]), cuts) + 1 for w, x in ((self.width_a, a), (self.width_b, b)))
            a, b, at_a, at_b = a.tobytes(), b.tobytes(), [0, *(at_a * 4).tolist()], [0, *(at_b * 4).tolist()]
            self.known.update(zip(chunk, zip([a[i:j] for i, j in zip(at_a, at_a[1:])], [b[i:j] for i, j in zip(at_b, at_b[1:])])))
        return apart

    def ids(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        found = list(map(self.known.get, units))
        new = [u for u, x in zip(units, found) if x is None and u not in self.known]
        if new:
            if len(self.known) + len(new) > self.keep:
                self.known = {u: x for u, x in zip(units, found) if x is not None}
            self.learn(list(dict.fromkeys(new)))
            found = list(map(self.known.get, units))
        return found


def merge_path(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How much of each sorted list lies before every cut of their merge, a first among equals; pieces have `work` elements, the last perhaps fewer."""
    diagonal = np.r_[np.arange(0, len(a) + len(b), work), len(a) + len(b)]
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        live = low < high
        # the merge takes a[mid] before b[diagonal - mid - 1] if it is not larger
        more = np.zeros(len(diagonal), dtype=bool)
        more[live] = a[mid[live]] <= b[diagonal[live] - mid[live] - 1]
        low, high = np.where(live & more, mid + 1, low), np.where(live & ~more, mid, high)
    return low, diagonal - low


def common_ends(a: np.ndarray, b: np.ndarray, work: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Indices of equal elements of two strictly rising lists: each piece's own, then those that a cut splits, in order."""
    cut_a, cut_b = merge_path(a, b, work)
    left, right = [], []
    for i, k, j, m in zip(cut_a, cut_a[1:], cut_b, cut_b[1:]):
        if i and j < m and a[i - 1] == b[j]:  # the cut before this piece has split an equal pair
            left.append([i - 1])
            right.append([j])
            j += 1
        if i == k or j == m:
            continue
        own_a, own_b = a[i:k], b[j:m]
        at = np.searchsorted(own_b, own_a)
        hit = np.flatnonzero(own_b[np.minimum(at, len(own_b) - 1)] == own_a)
        left.append(hit + i)
        right.append(at[hit] + j)
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x).astype(np.int64) if x else none for x in (left, right))


class _Texts:
    """Facts of the texts of a block, gathered part by part."""

    def __init__(self, tokenizers: Tokenizers, work: int):
        self.t, self.work = tokenizers, work
        self.ids: list[str | None] = []
        self.facts: list[list[int]] = []
        self.shas: list = []
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []  # (text, pair) of links
        self.bad: set[int] = set()
        self.bytes = 0

    def open(self, doc: str | None) -> int:
        self.ids.append(doc)
        self.facts.append([0, 0, 0])
        self.shas.append(None)
        return len(self.ids) - 1

    def add(self, owners: list[int], units: list[list[str]]) -> None:
        """Parts of texts: the owner of each and its stretches."""
        flat = [u for own in units for u in own]
        distinct = list(dict.fromkeys(flat))
        number = dict(zip(distinct, range(len(distinct))))
        known = self.t.ids(distinct)
        wrong = {i for i, x in enumerate(known) if x is None}
        which = np.array(list(map(number.__getitem__, flat)), dtype=np.int64)
        count = np.array(list(map(len, units)), dtype=np.int64)
        if wrong:
            owner = np.repeat(np.array(owners), count)
            self.bad |= set(owner[np.isin(which, list(wrong))].tolist())
            known = [x or (b"", b"") for x in known]
        part = np.repeat(np.arange(len(units)), count)
        flat_ids, parts, ends = [], [], []
        for side, width in ((0, self.t.width_a), (1, self.t.width_b)):
            raw = [x[side] for x in known]
            size = np.array(list(map(len, raw)), dtype=np.int64) // 4
            ids = np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int64)
            n = size[which]
            to = np.cumsum(n)
            start = np.cumsum(size) - size
            own = ids[np.repeat(start[which] - (to - n), n) + np.arange(to[-1] if len(to) else 0)]
            flat_ids.append(own)
            parts.append(np.repeat(part, n))
            ends.append(np.cumsum(width[own]))
        # all parts' ends are one pair of rising lists: a part's last tokens end together
        link_a, link_b = common_ends(ends[0], ends[1], self.work)
        (a, b), (part_a, part_b) = flat_ids, parts
        k = len(units)
        edge_a, edge_b = np.searchsorted(part_a, np.arange(k + 1)), np.searchsorted(part_b, np.arange(k + 1))
        edge_l = np.searchsorted(link_a, edge_a)
        # the groups in order: A's tokens of a group, then B's
        group_a, group_b = np.searchsorted(link_a, np.arange(len(a))), np.searchsorted(link_b, np.arange(len(b)))
        before_b, upto_a = np.r_[0, link_b + 1], np.r_[link_a + 1, len(a)]
        code_a, code_b = a * 2, b * 2 + self.t.base_b
        code_a[link_a] += 1
        code_b[link_b] += 1
        code = np.empty(len(a) + len(b), dtype=np.int64)
        code[np.arange(len(a)) + before_b[group_a]] = code_a
        code[np.arange(len(b)) + upto_a[group_b]] = code_b
        shown, owners_of = self.t.shown, np.array(owners, dtype=np.int64)
        for i, owner in enumerate(owners):
            if owner in self.bad:
                continue
            fact = self.facts[owner]
            fact[0] += int(edge_a[i + 1] - edge_a[i])
            fact[1] += int(edge_b[i + 1] - edge_b[i])
            fact[2] += int(edge_l[i + 1] - edge_l[i])
            text = "".join(map(shown.__getitem__, code[edge_a[i] + edge_b[i] : edge_a[i + 1] + edge_b[i + 1]].tolist()))[:-1].encode()
            if self.shas[owner] is None:
                self.shas[owner] = hashlib.sha256(text)
            elif text:
                self.shas[owner].update(b";" + text)
        owner = owners_of[part_a[link_a]]
        self.pairs.append((owner.astype(np.int32), a[link_a] * _WIDE + b[link_b]))
        self.bytes += int(ends[0][-1]) if len(ends[0]) else 0


_ROWS = "block long, ordinal int, doc_id string, n_a long, n_b long, n_links long, groups_sha256 string, pair long, n long, own binary"
_ROWS_ARROW = pa.schema([("block", pa.int64()), ("ordinal", pa.int32()), ("doc_id", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pair", pa.int64()), ("n", pa.int64()), ("own", pa.binary())])


def _rows(size: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _ROWS_ARROW],
        schema=_ROWS_ARROW)


def _block(number: int, texts: _Texts) -> Iterator[pa.RecordBatch]:
    """A row of each text, one of each distinct pair, and one with the texts' own counts of pairs."""
    n = len(texts.ids)
    good = [i not in texts.bad for i in range(n)]
    fact = [f if g else [0, 0, 0] for f, g in zip(texts.facts, good)]
    sha = [s.hexdigest() if s is not None and g else "" for s, g in zip(texts.shas, good)]
    yield _rows(n, block=np.full(n, number), ordinal=np.arange(n), doc_id=texts.ids, n_a=[f[0] for f in fact], n_b=[f[1] for f in fact],
        n_links=[f[2] for f in fact], groups_sha256=sha)
    owner = np.concatenate([o for o, _ in texts.pairs] or [np.zeros(0, dtype=np.int32)]).astype(np.int64)
    pair = np.concatenate([p for _, p in texts.pairs] or [np.zeros(0, dtype=np.int64)])
    if texts.bad:
        keep = ~np.isin(owner, list(texts.bad))
        owner, pair = owner[keep], pair[keep]
    distinct, which, count = np.unique(pair, return_inverse=True, return_counts=True)
    k = len(distinct)
    for at in range(0, k, 50_000):
        own = slice(at, at + 50_000)
        m = len(distinct[own])
        yield _rows(m, block=np.full(m, number), pair=distinct[own], n=count[own])
    cell, times = np.unique(owner * max(k, 1) + which, return_counts=True)
    per_text = np.bincount(cell // max(k, 1), minlength=n)
    own = np.concatenate([per_text, np.diff(cell % max(k, 1), prepend=0), times]).astype("<i4")
    yield _rows(1, block=[number], own=[own.tobytes()], n=[n])


def _encoder(path_a: str | None, path_b: str | None, work: int, block_bytes: int, part: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        both = Tokenizers(path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model"))
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        texts = _Texts(both, work)
        owners, units, held = [], [], 0
        for batch in rows:
            for doc, text in zip(batch.column("doc_id"), batch.column("__text")):
                owner, own = texts.open(doc.as_py()), both.stretches(text.as_py())
                for at in range(0, len(own), part):
                    owners.append(owner)
                    units.append(own[at : at + part])
                    held += len(units[-1])
                    if held >= part:
                        texts.add(owners, units)
                        owners, units, held = [], [], 0
                if texts.bytes >= block_bytes and not held:
                    yield from _block(number, texts)
                    number, texts = number + 1, _Texts(both, work)
        if units:
            texts.add(owners, units)
        if texts.ids:
            yield from _block(number, texts)

    return run


_SCORE = "block long, ordinal int, n_best long, count_sum long"


def _score(key, pairs: pa.Table, own: pa.Table) -> pa.Table:
    """The texts' links by how often their pairs are linked in the corpus."""
    if not own.num_rows:
        n, cells = 0, np.zeros(0, dtype=np.int64)
    else:
        n, cells = own.column("texts")[0].as_py(), np.frombuffer(own.column("own")[0].as_buffer(), dtype="<i4").astype(np.int64)
    per_text, rest = cells[:n], cells[n:]
    k = len(rest) // 2
    step, times = rest[:k], rest[k:]
    order = np.argsort(pairs.column("pair").to_numpy(), kind="stable")
    count, best = pairs.column("count").to_numpy()[order], pairs.column("best").to_numpy()[order]
    which, text = np.cumsum(step), np.repeat(np.arange(n), per_text)
    total, top = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if k:
        np.add.at(total, text, times * count[which])
        np.add.at(top, text, times * best[which])
    return pa.Table.from_arrays([pa.array(np.full(n, key[0].as_py())), pa.array(np.arange(n), pa.int32()), pa.array(top), pa.array(total)],
        ["block", "ordinal", "n_best", "count_sum"])


def align(df: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    work: int = 1 << 14, block_bytes: int = 6_000_000, part: int = 100_000) -> DataFrame:
    """One row per text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. See the module's text."""
    rows = df.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text_or_empty(text_col).alias("__text"))
    with arrow_rows(df.sparkSession, 500):
        encoded = written(rows.mapInArrow(_encoder(path_a, path_b, work, block_bytes, part), _ROWS))
    pairs = encoded.filter("pair IS NOT NULL").select("block", "pair", "n")
    counts = frozen(pairs.groupBy("pair").agg(F.sum("n").alias("count")))
    b_id = (F.col("pair") % int(_WIDE)).alias("b")
    top = counts.groupBy(b_id).agg(F.max("count").alias("top"))  # at most one row for each id of B's vocabulary
    counts = counts.withColumn("b", b_id).join(F.broadcast(top), "b").select(F.col("pair").alias("c_pair"), "count",
        (F.col("count") == F.col("top")).cast("long").alias("best"))
    known = pairs.join(counts, F.col("pair") == F.col("c_pair")).select(F.col("block").alias("p_block"), "pair", "count", "best")
    own = encoded.filter("own IS NOT NULL").select("block", "own", F.col("n").alias("texts"))
    scored = known.groupBy("p_block").cogroup(own.groupBy("block")).applyInArrow(_score, _SCORE)
    texts = encoded.filter("ordinal IS NOT NULL").select(F.col("block").alias("t_block"), F.col("ordinal").alias("t_ordinal"), "doc_id", "n_a", "n_b",
        "n_links", "groups_sha256")
    out = texts.join(scored, (F.col("t_block") == F.col("block")) & (F.col("t_ordinal") == F.col("ordinal")))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best",
        "count_sum", "groups_sha256")
