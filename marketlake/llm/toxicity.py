"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine trained on labelled sentences.

The kernel of two words is the inner product of their weighted counts of three
letters in order, gaps allowed within a span of seven letters and damped by
`decay` a letter, so that words with inserted or missing letters stay close; it
is normalised. A sentence scores as its highest word, its witness, and the
kernel of two sentences is that of their witnesses. Sentences have the label of
their document. Training goes round by round (multiple instances): the machine
before names the witness of every labelled sentence, and the next is trained on
the sentences of clean documents and on those of toxic ones that score above
zero, each document's highest at least, so that a document is toxic by its
highest sentence. The first witnesses are the words that set toxic documents
apart. The machine works on the Nystroem map over `landmarks` words, half of
them those; what it learns folds into one weight per letter triple, so that a
word is scored by table look-ups. A logistic curve over a sentence's highest
word and its number of words above zero, neither of which can lower it, gives a
probability, and a text has that of its highest sentence: nothing else in it
counts, so that length dilutes nothing. Sentences of more than 32 words are read
in windows of 32 that begin 16 apart.

Words are white-space pieces (any Unicode white space) in lower case without
digits and punctuation, after look-alike digits and signs inside a word become
letters; runs of three or more single characters are one word.

Learning uses at most `toxic_docs` and `clean_docs` labelled rows, chosen by a
seeded hash (the documented bound), and at most `witnesses` different witnesses
of a label a round; scoring covers whole texts of all rows. Near copies within a
label count once. A null text counts as empty; texts without words score the
share of toxic labels, and so does every text where the labels are not of both
kinds (0 without labels). Repeated rows get a row each; a document with labels of both
kinds is toxic. Ids and other columns never leave the JVM when texts are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, frozen, text_or_empty, text_udf
from .ngram_join import signer
from .words import batches, split_hashed

SPAN, WIDTH, CODES = 7, 24, 64
WINDOW, ABOVE = 32, 8  # words of a window; numbers of words above zero that are told apart, the last one and more
_SPACED = re.compile(r"(?<!\S)(?:\w[ \t]){2,}\w(?!\S)")
_OTHER_SPACE = re.compile(r"[^\S\t-\r ]")
_ALIKE = str.maketrans("013457@$!", "oieastasi")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit."""

    toxic_docs: int = 4000
    clean_docs: int = 8000
    landmarks: int = 384
    witnesses: int = 3000
    decay: float = 0.5
    ridge: float = 1e-3
    rounds: int = 4
    odds: float = 20.0
    sure: float = 3.0
    toxic_weight: float = 0.25  # of all toxic rows in the curve; clean ones have the rest
    seed: int = 77


@dataclass(frozen=True)
class Model:
    table: np.ndarray  # weight of each letter triple
    bias: float
    curve: np.ndarray  # of a sentence's (1, highest word, log1p(words above zero))
    decay: float
    share: float  # of toxic labels, the score without evidence
    constant: bool = False


def lowered(text: str) -> str:
    low = _OTHER_SPACE.sub(" ", text.lower())
    return _SPACED.sub(lambda m: re.sub(r"[ \t]", "", m.group()), low) if _SPACED.search(low) else low


def letters(piece: str) -> str:
    if piece.isalpha():
        return piece
    return _NOT_LETTERS.sub("", _EDGE.sub("", piece).translate(_ALIKE))


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as codes in rows of WIDTH, zero-padded, with the word of each row; longer words take overlapping rows."""
    owner, rows = [], []
    for i, w in enumerate(words):
        marked = f"\x01{w}\x02" if w else ""
        for at in range(0, max(1, len(marked) - SPAN), WIDTH - SPAN):
            rows.append(marked[at : at + WIDTH])
            owner.append(i)
    flat = np.frombuffer("".join(r.ljust(WIDTH, "\0") for r in rows).encode("utf-32-le"), dtype="<u4").reshape(len(rows), WIDTH)
    latin = (flat >= 97) & (flat <= 122)
    codes = np.where(latin, flat - 96, np.where(flat > 2, 27 + flat % 35, np.where(flat > 0, flat + 61, 0)))
    return codes.astype(np.int64), np.array(owner, dtype=np.int64)


def triples(words: list[str], decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple, weight) of all letter triples within the span; weights of a word have norm one."""
    codes, owner = _coded(words)
    out = []
    for last in range(2, SPAN):
        for mid in range(1, last):
            a, b, c = codes[:, : WIDTH - last], codes[:, mid : WIDTH - last + mid], codes[:, last:]
            r, k = np.nonzero((c > 0) & (a > 0))
            out.append((owner[r], (a[r, k] * CODES + b[r, k]) * CODES + c[r, k], np.full(len(r), decay ** (last - 2))))
    word, triple, weight = (np.concatenate(x) for x in zip(*out))
    norm = np.sqrt(np.bincount(word, weight * weight, minlength=len(words)))
    return word, triple, weight / np.maximum(norm[word], 1e-9)


def score_words(words: list[str], table: np.ndarray, decay: float) -> np.ndarray:
    """The machine's value of each word without its bias; 0 for one without letters."""
    out = np.empty(len(words))
    for lo in range(0, len(words), 4096):  # a word has some 200 triples
        part = words[lo : lo + 4096]
        word, triple, weight = triples(part, decay)
        out[lo : lo + 4096] = np.bincount(word, weight * table[triple], minlength=len(part))
    return out


class Kernel:
    """The Nystroem map of the kernel over landmark words: one row a letter triple that a landmark has.

    The driver keeps that one array and works in small runs of words, so that its memory does not grow with the sample.
    """

    def __init__(self, marks: list[str], decay: float):
        self.decay = decay
        word, triple, weight = triples(marks, decay)
        self.known, at = np.unique(triple, return_inverse=True)
        basis = np.zeros((len(marks), len(self.known)))
        np.add.at(basis, (word, at), weight)
        values, vectors = np.linalg.eigh(basis @ basis.T)
        keep = values > 1e-6 * values[-1]
        self.whiten = vectors[:, keep] / np.sqrt(values[keep])
        self.rows = np.empty((len(self.known), self.whiten.shape[1]), dtype=np.float32)
        for lo in range(0, len(self.known), 4096):
            self.rows[lo : lo + 4096] = basis[:, lo : lo + 4096].T @ self.whiten

    def table(self, w: np.ndarray) -> np.ndarray:
        """The weight of each letter triple under the machine's weights."""
        out = np.zeros(CODES**3)
        out[self.known] = self.rows @ w
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """Words in the map."""
        out = np.zeros((len(words), self.rows.shape[1]), dtype=np.float32)
        for lo in range(0, len(words), 64):
            word, triple, weight = triples(words[lo : lo + 64], self.decay)
            at = np.searchsorted(self.known, triple)
            at[at == len(self.known)] = 0
            hit = self.known[at] == triple
            word, at, weight = word[hit], at[hit], weight[hit]
            if len(word):
                order = np.argsort(word, kind="stable")
                start = np.flatnonzero(np.r_[True, np.diff(word[order]) > 0])
                part = self.rows[at[order]] * weight[order, None].astype(np.float32)
                out[lo + word[order][start]] = np.add.reduceat(part, start)
        return out


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """A squared-hinge machine, both classes of one weight in sum; the last weight is the bias."""
    c = np.where(y > 0, weight / weight[y > 0].sum(), weight / weight[y < 0].sum())
    size = x.shape[1] + 1
    w = np.zeros(size)
    for _ in range(50):  # Newton steps on the active set
        active = np.flatnonzero(y * (x @ w[:-1] + w[-1]) < 1)
        square, cross = ridge * np.eye(size), np.zeros(size)
        for lo in range(0, len(active), 1024):
            own = active[lo : lo + 1024]
            part = np.c_[x[own].astype(np.float64), np.ones(len(own))]
            square += (part * c[own, None]).T @ part
            cross += (part * c[own, None]).T @ y[own]
        new = np.linalg.solve(square, cross)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def _words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct words of each text."""
    for frame in frames:
        own = [{letters(w) for w in lowered(t).split()} - {""} for t in frame["__text"]]
        n = np.array([len(x) for x in own], dtype=np.int64)
        yield pd.DataFrame({"word": [w for x in own for w in x], "toxic": np.repeat(frame["toxic"].to_numpy(dtype=np.int32), n)})


def _without_near_copies(sample: DataFrame, bands: int = 8, rows: int = 4) -> DataFrame:
    """Of texts of a label that share a MinHash band, those with the least id of the band stay; a sample for learning needs no more."""
    signed = frozen(sample.select("__id", "toxic", signer(5, bands, rows)("__text").alias("__bands")))
    banded = signed.distinct().select("__id", "toxic", F.posexplode(F.slice("__bands", 1, bands)).alias("k", "h"))
    least = banded.groupBy("toxic", "k", "h").agg(F.min("__id").alias("least"))
    gone = banded.join(least, ["toxic", "k", "h"]).filter(F.col("__id") > F.col("least")).select("__id").distinct()
    return sample.join(gone, "__id", "left_anti").dropDuplicates(["__id"])


def _sentence_starts(begin: np.ndarray, end: np.ndarray, owner: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """The first word of each sentence: of each text, and after a full stop, a question or exclamation mark, or a line feed."""
    lines = np.cumsum(buf == 10)
    new = np.ones(len(begin), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | np.isin(buf[end[:-1] - 1], (33, 46, 63)) | (lines[begin[1:]] > lines[end[:-1] - 1])
    return np.flatnonzero(new)


def _windows(start: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the windows of sentences with the given first words."""
    size = np.diff(np.r_[start, total])
    n = np.maximum(1, -(-(size - WINDOW // 2) // (WINDOW // 2)))
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(start, n) + k * (WINDOW // 2)
    return begin, np.minimum(begin + WINDOW, np.repeat(start + size, n))


class Scorer:
    """Scores of words in whole texts; words are scored once while they are remembered."""

    def __init__(self, table: np.ndarray, bias: float, decay: float, most: int = 300_000):
        self.table, self.bias, self.decay, self.most, self.cache = table, bias, decay, most, {}

    def words(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]]:
        """By run of texts: index of its first; text and score of each word; first word of each sentence; distinct pieces and which each word is."""
        for at, batch in batches([lowered(t).encode("utf-8") for t in texts]):
            buffer, begin, end, hashed, owner = split_hashed(batch)
            if not len(begin):
                continue
            _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
            pieces = [buffer[i:j].decode() for i, j in zip(begin[first].tolist(), end[first].tolist())]
            new = [x for x in pieces if x not in self.cache]
            if len(self.cache) + len(new) > self.most:
                self.cache = {x: self.cache[x] for x in pieces if x in self.cache}
            scores = score_words([letters(x) for x in new], self.table, self.decay) + self.bias
            self.cache.update(zip(new, scores.tolist()))
            score = np.array([self.cache[x] for x in pieces])[which]
            yield at, owner, score, _sentence_starts(begin, end, owner, np.frombuffer(buffer, dtype=np.uint8)), pieces, which

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Per text: the highest word of its windows with 0, 1, ... words above zero, at most 3 and at least -3, where none is -9."""
        out = np.full((len(texts), ABOVE), -9.0)
        for at, owner, score, start, *_ in self.words(texts):
            begin, end = _windows(start, len(score))
            highest = np.maximum.reduceat(np.r_[score, -9.0], np.stack([begin, end], axis=1).ravel())[::2]
            above = np.r_[0, np.cumsum(score > 0)]
            np.maximum.at(out, (owner[begin] + at, np.minimum(above[end] - above[begin], ABOVE - 1)), np.clip(highest, -3, 3))
        return out


def _witnesses(model: Model):
    """The witness of each sentence; of a toxic text those above zero and the highest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model.table, model.bias, model.decay)
        for frame in frames:
            out, label = [], frame["toxic"].to_numpy()
            for at, owner, score, start, pieces, which in scorer.words(frame["__text"].tolist()):
                best = np.maximum.reduceat(score, start)
                top = np.flatnonzero(score == np.repeat(best, np.diff(np.r_[start, len(score)])))
                top = top[np.unique(np.searchsorted(start, top, side="right"), return_index=True)[1]]  # the first of equals
                text = owner[start]
                first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                highest = np.repeat(np.maximum.reduceat(best, first), np.diff(np.r_[first, len(text)]))
                toxic = label[at + text]
                keep = (toxic == 0) | (best > 0) | (best == highest)
                out += zip([letters(pieces[i]) for i in which[top[keep]]], best[keep].tolist(), toxic[keep].tolist())
            yield pd.DataFrame([x for x in out if x[0]], columns=["word", "score", "toxic"])

    return run


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, t: Training = Training(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits the model on a bounded sample of labelled rows; batches are small, so that workers hold few words at once."""
    with arrow_rows(docs.sparkSession, 1000):
        return _train(docs, labels, t, id_col, text_col)


def _train(docs: DataFrame, labels: DataFrame, t: Training, id_col: str, text_col: str) -> Model:
    known = labels.filter(F.col("toxic").isin(0,
        1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(
        F.max("toxic").cast("int").alias("toxic"))
    luck = F.xxhash64(F.lit(t.seed), "__id")
    chosen = known.filter("toxic = 1").orderBy(luck,
        "__id").limit(t.toxic_docs).union(known.filter("toxic = 0").orderBy(luck, "__id").limit(t.clean_docs))
    sample = frozen(docs.select(F.col(id_col).cast("long").alias("__id"), text_or_empty(text_col).alias("__text")).join(F.broadcast(chosen),
        "__id").select("__id", "__text", "toxic"))  # bounded by the settings
    total = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    constant = Model(np.zeros(CODES**3), -1.0, np.zeros(3), t.decay, share, True)
    if set(total) != {0, 1}:
        return constant
    apart = frozen(_without_near_copies(sample))
    seeds, likely, plain = _seeds(apart, t)
    if not seeds or not plain:
        return constant
    half = t.landmarks // 2
    kernel = Kernel(list(dict.fromkeys(likely[:half] + plain[:half])), t.decay)
    positive, negative = seeds, dict.fromkeys(plain, 1)
    ratio = total[1] / total[0]
    for k in range(t.rounds + 1):
        words = [*positive, *negative]
        y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        weight = np.r_[np.array(list(positive.values()), dtype=float), 1 + np.log1p(list(negative.values()))]
        w = machine(kernel.words(words), y, weight, t.ridge)
        model = Model(kernel.table(w[:-1]), float(w[-1]), np.zeros(3), t.decay, share)
        if k == t.rounds:
            break
        named = apart.mapInPandas(_witnesses(model), "word string, score double, toxic int").groupBy("word")
        found = frozen(named.agg(F.max("score").alias("score"), F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")))
        for word, n in found.filter("n > 0").orderBy(F.desc("score"), "word").limit(t.witnesses).select("word", "n").collect():
            negative[word] = max(n, negative.get(word, 0))
        toxic = found.filter(F.col("p") > ratio * F.col("n")).orderBy(F.desc("p"), "word").limit(t.witnesses).select("word", "p").collect()
        positive = {word: p for word, p in toxic if p > ratio * negative.get(word, 0)} or seeds
    rows = sample.select("toxic", evidence_udf(model)("__text").alias("e")).groupBy("toxic", "e").agg(F.count("*").alias("n")).collect()
    toxic, n = np.array([r.toxic for r in rows], dtype=float), np.array([r.n for r in rows], dtype=float)  # at most the sample
    weight = n * np.where(toxic > 0, t.toxic_weight / total[1], (1 - t.toxic_weight) / total[0])
    return Model(model.table, model.bias, curve(np.array([r.e for r in rows]), toxic, weight), t.decay, share)


def curve(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray, rounds: int = 6) -> np.ndarray:
    """A logistic curve over each text's highest sentence, which the curve before names; weights of sentences are not negative."""
    w = np.array([0.0, 1.0, 0.5])
    for _ in range(rounds):
        best, above = highest_sentence(evidence, w)
        f = np.stack([np.ones(len(best)), np.maximum(best, -3), np.log1p(above)], axis=-1)
        for _ in range(100):  # Newton steps of a ridge logistic fit
            p = 1 / (1 + np.exp(-f @ w))
            grad = f.T @ (weight * (p - toxic)) + 1e-4 * w
            step = np.linalg.solve((f * (weight * p * (1 - p))[:, None]).T @ f + 1e-4 * np.eye(3), grad)
            w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        w[1:] = np.maximum(w[1:], 0)
    return w


def highest_sentence(evidence: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(highest word, words above zero) of each text's sentence of the largest value."""
    value = np.where(evidence > -9, w[1] * evidence + w[2] * np.log1p(np.arange(ABOVE)), -np.inf)
    at = value.argmax(axis=1)
    return evidence[np.arange(len(evidence)), at], at


def _seeds(sample: DataFrame, t: Training) -> tuple[dict[str, float], list[str], list[str]]:
    """Words that set toxic documents apart, with the square of how sure they do; words of toxic documents, the likeliest first; words of clean ones by a seeded hash."""
    counts = frozen(sample.mapInPandas(_words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")))
    sums = counts.agg(F.sum("p"), F.sum("n")).first()
    odds = F.log((F.col("p") + 0.5) / (sums[0] + 1)) - F.log((F.col("n") + 0.5) / (sums[1] + 1))
    sure = odds / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    luck = F.xxhash64(F.lit(t.seed), "word")
    likely = [r[0] for r in counts.filter("p > 0").orderBy(sure.desc(), "word").limit(t.landmarks).select("word").collect()]
    plain = [r[0] for r in counts.filter("n > 0 AND p <= n").orderBy(luck, "word").limit(t.witnesses).select("word").collect()]
    apart = counts.filter((F.col("p") >= 2) & (sure > t.sure) & (odds > float(np.log(t.odds)))).orderBy(sure.desc(), "word")
    return {r[0]: r[1] ** 2 for r in apart.limit(t.witnesses).select("word", sure).collect()}, likely, plain


def evidence_udf(model: Model):
    """A column function: the evidence of a text (`Scorer.evidence`)."""
    return text_udf(lambda: (lambda scorer: lambda texts: list(scorer.evidence(texts)))(Scorer(model.table, model.bias, model.decay)),
        "array<double>", pa.list_(pa.float64()))


def score_udf(model: Model):
    """A column function: the probability that a text is toxic."""

    def make():
        scorer = Scorer(model.table, model.bias, model.decay)

        def probability(texts: list[str]) -> np.ndarray:
            if model.constant:
                return np.full(len(texts), model.share)
            best, above = highest_sentence(scorer.evidence(texts), model.curve)
            value = model.curve[0] + model.curve[1] * best + model.curve[2] * np.log1p(above)
            return np.where(best > -9, 1 / (1 + np.exp(-value)), model.share)

        return probability

    return text_udf(make, "double", pa.float64())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; the score reads the text alone. Scores are written to the checkpoint folder."""
    with arrow_rows(docs.sparkSession, 1000):
        rows = frozen(docs.select(F.col(id_col).cast("long").alias("doc_id"), score_udf(model)(text_or_empty(text_col)).alias("score")))
    return rows.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows below the threshold, with all their columns, written to the checkpoint folder; nothing is shuffled and Python sees the text alone."""
    with arrow_rows(docs.sparkSession, 1000):
        return frozen(docs.filter(score_udf(model)(text_or_empty(text_col)) < threshold))
