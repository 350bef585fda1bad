"""Vector bin packing of documents into training sequences.

Every document is tokenised and ended with the end id. Its prompt, its leading
characters up to `prompt_chars`, bears no loss; the rest does. A document above
a limit is cut into pieces as long as the limits allow. Pieces are vectors
(tokens, segments, loss-bearing tokens) that a dot-product heuristic places: an
open sequence takes, of all pieces that fit its three limits, the one whose
demand has the largest inner product with what the sequence has left, each as a
share of its limit. Where nothing fits, the shortest of the pieces whose
beginning fills most of the gap, as the loss limit allows, is cut. A sequence that its loss limit
closes is padded, by 32 tokens or little more; one that stays emptier is cut into
powers of two, which need no padding. Work runs window by window
inside each input partition, so that nothing is shuffled and memory is bounded
by a window; the pieces are written to the checkpoint folder.

Defined results: a null text counts as empty and has the end id alone; rows
with equal or null ids are packed as separate documents; an empty table gives no
row. Ids pass through Python as text, so that none is rounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_rows, frozen, text_or_empty

_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")
SCHEMA = "doc_id string, " + ", ".join(f"{c} long" for c in _FIELDS[1:])

Piece = tuple[int, int, int]  # item, start in item, length


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold; a gap below least_cut is left as padding; a window is so many tokens that are packed together."""

    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2016
    least_cut: int = 8
    window_tokens: int = 2_000_000


def pieces_of(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, length, loss-bearing) of the longest pieces from each item's beginning that keep the limits; loss-bearing tokens are an item's last ones."""
    item, start, length = [np.arange(len(tokens))], [np.zeros(len(tokens), dtype=np.int64)], [tokens.astype(np.int64)]
    long = np.flatnonzero((tokens > limits.tokens) | (loss > limits.loss_tokens))
    for i in long.tolist():
        n, prompt, at, own = int(tokens[i]), int(tokens[i] - loss[i]), 0, []
        while at < n:
            own.append(at)
            at += min(limits.tokens, max(0, prompt - at) + limits.loss_tokens)
        item.append(np.full(len(own), i))
        start.append(np.array(own, dtype=np.int64))
        length.append(np.diff(np.r_[own, n]))
    item, start, length = (np.concatenate(x) for x in (item, start, length))
    keep = (length > 0) & ~(np.isin(item, long) & (np.arange(len(item)) < len(tokens)))
    item, start, length = item[keep], start[keep], length[keep]
    return item, start, length, np.minimum(length, np.maximum(0, start + length - (tokens - loss)[item]))


class _Left:
    """The pieces left, as kinds of equal (tokens, loss-bearing) in falling order, with how many there are of each."""

    def __init__(self, item: np.ndarray, start: np.ndarray, length: np.ndarray, bearing: np.ndarray):
        order = np.lexsort((start, item, -bearing, -length))
        self.item, self.start = item[order], start[order]
        falling, bearing = -length[order], bearing[order]
        first = np.flatnonzero(np.r_[True, (np.diff(falling) != 0) | (np.diff(bearing) != 0)]) if len(order) else order
        self.falling, self.bearing, self.head, self.stop = falling[first], bearing[first], first, np.r_[first[1:], len(order)]
        self.more: list[list[tuple[int, int]]] = [[] for _ in first]  # what cuts have left over

    def take(self, kind: int) -> tuple[int, int, int, int]:
        """(item, start, length, loss-bearing) of the first piece of a kind, which is taken out."""
        n, x = int(-self.falling[kind]), int(self.bearing[kind])
        if self.head[kind] < self.stop[kind]:
            at = int(self.head[kind])
            self.head[kind] += 1
            piece = int(self.item[at]), int(self.start[at]), n, x
        else:
            piece = *self.more[kind].pop(0), n, x
        if self.head[kind] == self.stop[kind] and not self.more[kind]:
            for name in ("falling", "bearing", "head", "stop"):
                setattr(self, name, np.delete(getattr(self, name), kind))
            del self.more[kind]
        return piece

    def put(self, item: int, start: int, n: int, x: int) -> None:
        lo, hi = np.searchsorted(self.falling, -n, side="left"), np.searchsorted(self.falling, -n, side="right")
        kind = int(lo + np.searchsorted(-self.bearing[lo:hi], -x))
        if kind == hi or self.bearing[kind] != x:
            for name, value in (("falling", -n), ("bearing", x), ("head", 0), ("stop", 0)):
                setattr(self, name, np.insert(getattr(self, name), kind, value))
            self.more.insert(kind, [])
        self.more[kind].append((item, start))

    def best(self, room_t: int, room_l: int, limits: Limits) -> int:
        """The kind that fits and has the largest inner product with what is left of the limits; -1 if none fits."""
        if len(self.falling) == 1:
            return 0 if -self.falling[0] <= room_t and self.bearing[0] <= room_l else -1
        by_t, by_l = room_t / limits.tokens**2, room_l / limits.loss_tokens**2
        lo, step, best, pick = int(np.searchsorted(self.falling, -room_t)), 64, -1.0, -1
        # loss is at most tokens, so what comes later in the order is bounded by its tokens
        while lo < len(self.falling) and -self.falling[lo] * (by_t + by_l) > best:
            x = self.bearing[lo : lo + step]
            score = np.where(x > room_l, -1.0, -self.falling[lo : lo + step] * by_t + x * by_l)
            k = int(score.argmax())
            if score[k] > best and score[k] >= 0:
                best, pick = float(score[k]), lo + k
            lo, step = lo + step, step * 4
        return pick

    def to_cut(self, room_t: int, room_l: int) -> tuple[int, int]:
        """(kind, tokens) of the piece whose beginning, prompt first, fills most of the gap within the loss limit, the shortest of equals; none fits whole."""
        if not len(self.falling):
            return -1, 0
        most = np.minimum(room_t, room_l - self.falling - self.bearing)
        kind = len(most) - 1 - int(most[::-1].argmax())
        return kind, int(most[kind])


def place(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> list[list[Piece]]:
    """Sequences of pieces. Each choice weighs every piece left that fits; of equal ones the longest, then the one with most loss, then the first goes."""
    left = _Left(*pieces_of(tokens, loss, limits))
    bins: list[list[Piece]] = []
    while len(left.falling):
        room_t, room_s, room_l = limits.tokens, limits.segments, limits.loss_tokens
        own: list[Piece] = []
        while room_s and room_t and (kind := left.best(room_t, room_l, limits)) >= 0:
            i, at, n, x = left.take(kind)
            own.append((i, at, n))
            room_t, room_s, room_l = room_t - n, room_s - 1, room_l - x
        kind, most = left.to_cut(room_t, room_l) if room_s else (-1, 0)
        if most >= limits.least_cut:
            i, at, n, x = left.take(kind)
            own.append((i, at, most))
            left.put(i, at + most, n - most, min(x, n - most))
        bins.append(own)
    return bins


def in_powers_of_two(own: list[Piece]) -> list[list[Piece]]:
    """One partly filled sequence as sequences whose lengths are powers of two."""
    out: list[list[Piece]] = []
    total, room = sum(n for *_, n in own), 0
    for i, at, n in own:
        while n:
            if room == 0:
                room = 1 << (total.bit_length() - 1)
                out.append([])
            part = min(n, room)
            out[-1].append((i, at, part))
            at, n, room, total = at + part, n - part, room - part, total - part
    return out


def _packer(path: str | None, end_id: int, limits: Limits, rows: int = 500):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(path or bpe.default_path())
        end = int(end_id).to_bytes(4, "little")
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36
        docs: list[tuple[str | None, bytes, int]] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence, docs
            tokens = np.array([len(x) // 4 for _, x, _ in docs], dtype=np.int64)
            loss = np.array([p for *_, p in docs], dtype=np.int64)
            whole = lambda b: sum(n for *_, n in b) > min(limits.tokens, limits.loss_tokens) - limits.least_cut
            out = []
            for own in [y for x in place(tokens, loss, limits) for y in ([x] if whole(x) else in_powers_of_two(x))]:
                offset = 0
                for i, at, n in own:
                    doc, ids, p = docs[i]
                    size = len(ids) // 4
                    out.append((doc, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), size, sequence, offset,
                        max(0, at + n - max(at, size - p))))
                    offset += n
                sequence += 1
            docs = []
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                list(_FIELDS))

        held = 0
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows).to_pydict()
                texts, prompts = part["__text"], part["__prompt"]
                heads = encoder.encode_bytes([t[:p] for t, p in zip(texts, prompts)])
                for doc, head, tail in zip(part["doc_id"], heads, encoder.encode_bytes([t[p:] for t, p in zip(texts, prompts)])):
                    docs.append((doc, head + tail + end, len(tail) // 4 + 1))
                    held += (len(head) + len(tail)) // 4 + 1
                    if held >= limits.window_tokens:
                        yield flush()
                        held = 0
        if docs:
            yield flush()

    return run


def first_line_chars(text: Column) -> Column:
    """The characters of a text's first line and its line feed; 0 where it has one line only."""
    return F.instr(text, "\n")


def pack(df: DataFrame, path: str | None = None, end_id: int = 1, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text",
    prompt_chars: Column | None = None) -> DataFrame:
    """One row per piece. prompt_chars: how many leading characters, up to a white space, are the prompt (by default the first of several lines)."""
    text = text_or_empty(text_col)
    prompt = F.coalesce(prompt_chars if prompt_chars is not None else first_line_chars(text), F.lit(0))
    rows = df.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text.alias("__text"), prompt.cast("int").alias("__prompt"))
    with arrow_rows(df.sparkSession, 1000):
        pieces = frozen(rows.mapInArrow(_packer(path, end_id, limits), SCHEMA))
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))
