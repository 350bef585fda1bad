"""Token ids of a word-end BPE vocabulary by rank-synchronous merging of ragged numpy arrays.

Texts are cut at white space, where no pre-token ever spans, and each distinct
piece is cut into pre-tokens and encoded once per worker. All pre-tokens of a
batch lie in one flat array; in each round every pre-token applies its own
lowest-rank pair wherever that pair occurs, all sequences in step, until none
has a mergeable pair.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

from .words import batches, split_hashed

#: White space as the vocabulary's patterns read it (Unicode White_Space; not U+001C to U+001F).
_WS = "\t-\r \x85\xa0  -     　"
_SPLIT = re.compile(f"[{_WS}]+")
#: str.split() also cuts at these.
_CONTROL = re.compile("[\x1c-\x1f]")
_CONTROL_BYTES = b"\0\x1c\x1d\x1e\x1f"
#: Texts with these go piece by piece: special strings, and white space beyond ASCII or that only the library sees as text.
_ODD = re.compile("<\\||[\x00\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ud800-\udfff]")
#: Upper-case sigma is lowered by its place in a word by str.lower(), but not by the library.
_SIGMA = "Σ"
#: Code points that this process's Unicode tables and the library's class alike; other pieces are cut into pre-tokens by the library.
_RARE = re.compile("[^\x01-\u058f\u2000-\u206f\u20a0-\u20bf\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")
_NONE = np.int64(2**62)


class WordBpe:
    """Encodes as `tokenizers` does for the file, without added special tokens; special strings inside texts are matched."""

    def __init__(self, path: str, cache_words: int = 400_000):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape,
            sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if kinds != ["NFC", "Replace", "Lowercase"] or model.get("byte_fallback") or model.get("unk_token"):
            raise ValueError("not a lower-casing word-end BPE file")
        self.pre = regex.compile("\n|" + pattern.replace(r"[^\s", f"[^{_WS}"))
        # printable stand-ins of bytes in vocabulary files: printable Latin-1 as itself, the rest from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.path, self.library, self.byte_of = path, None, {c: b for b, c in stand.items()}
        self.first = np.array([vocab[stand[b]] for b in range(256)] + [vocab[stand[b] + suffix] for b in range(256)], dtype=np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made_by_rank = keys[order], order.astype(np.int64), made
        self.first_rank = self.ranks(self.first[:, None], self.first[None, :])
        self.cache_words, self.ids, self.known = cache_words, {}, {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def merged(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of pre-tokens, one after another, to their surviving symbols in order and the number of each; none is empty."""
        ends = np.cumsum(lengths)
        last = np.zeros(len(flat), dtype=bool)
        last[ends - 1] = True
        base = flat + last.astype(np.int64) * 256
        symbols = self.first[base]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(symbols), _NONE)
        rank[:-1] = np.where(last[:-1], _NONE, self.first_rank[base[:-1], base[1:]])
        done_sym, done_own = [], []
        while True:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[starts, len(owner)])
            best = np.minimum.reduceat(rank, starts)
            live = best < _NONE
            if np.count_nonzero(live) < 0.6 * len(live):  # finished sequences leave the arrays
                keep = np.repeat(live, size)
                done_sym.append(symbols[~keep])
                done_own.append(owner[~keep])
                symbols, owner, rank, best, size = symbols[keep], owner[keep], rank[keep], best[live], size[live]
                if not len(symbols):
                    break
            hit = (rank == np.repeat(best, size)) & (rank < _NONE)
            # of a run of overlapping hits (x x x), every second one merges, from the left
            if (hit[1:] & hit[:-1]).any():
                index = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], index, 0))
                hit &= (index - begin) % 2 == 0
            spot = np.flatnonzero(hit)
            symbols[spot] = self.made_by_rank[rank[spot]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[spot + 1] = False
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            spot -= np.arange(len(spot))
            # only pairs beside a merged symbol have new ranks
            for at in (spot, spot - 1):
                at = at[(at >= 0) & (at < len(symbols) - 1)]
                same = owner[at] == owner[at + 1]
                rank[at[~same]] = _NONE
                at = at[same]
                rank[at] = self.ranks(symbols[at], symbols[at + 1])
            if len(spot) and spot[-1] == len(symbols) - 1:
                rank[-1] = _NONE
        symbols, owner = np.concatenate(done_sym), np.concatenate(done_own)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(lengths))

    def _cut_by_library(self, piece: str) -> list[bytes]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [bytes(self.byte_of[c] for c in w) for w, _ in shown]

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces without white space and keeps their ids."""
        joined = "\n".join(pieces)
        if _RARE.search(joined):
            rare = [x for x in pieces if _RARE.search(x)]
            if len(rare) < len(pieces):
                odd = set(rare)
                self._learn([x for x in pieces if x not in odd])
            words = [self._cut_by_library(x) for x in rare]
            shown = b"\0".join(b"\0".join([*w, b"\n"]) for w in words)
            pieces = rare
        else:
            low = joined if unicodedata.is_normalized("NFC", joined) else unicodedata.normalize("NFC", joined)
            low = "".join(c.lower() for c in low) if _SIGMA in low else low.lower()
            shown = "\0".join(self.pre.findall(low) + ["\n"]).encode("utf-8")
        # pre-tokens end at a zero byte, pieces at a line feed among them
        flat = np.frombuffer(shown + b"\0", dtype=np.uint8)
        ends = np.flatnonzero(flat == 0)
        begins = np.r_[0, ends[:-1] + 1]
        split = flat[begins] == 10
        lengths = (ends - begins)[~split]
        per_piece = np.diff(np.r_[0, np.cumsum(~split)[split]])
        flat = flat[(flat != 0) & (flat != 10)]
        symbols, counts = self.merged(flat, lengths) if len(lengths) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        raw = symbols.astype("<u4").tobytes()
        cut = (np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum(per_piece)]] * 4).tolist()
        self.ids.update(zip(pieces, [raw[i:j] for i, j in zip(cut, cut[1:])]))

    def _pieces(self, text: str) -> list:
        """White-space pieces; special strings stand as their ids' bytes."""
        if self.special_re is not None and "<|" in text and self.special_re.search(text):
            out = []
            for part in self.special_re.split(text):
                out += [self.special[part].to_bytes(4, "little")] if part in self.special else self._pieces(part)
            return out
        return [x for x in _SPLIT.split(text) if x] if _CONTROL.search(text) else text.split()

    def _slow(self, text: str) -> bytes:
        pieces = self._pieces(text)
        new = {x for x in pieces if type(x) is str and x not in self.ids}
        if new:
            self._learn(list(new))
        return b"".join([self.ids[x] if type(x) is str else x for x in pieces])

    def encode_bytes(self, texts: list[str]):
        """Yields each text's ids as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(texts)
        plain, raw = [], []
        for i, text in enumerate(texts):
            own = text.encode("utf-8")
            odd = b"<|" in own or len(own.translate(None, _CONTROL_BYTES)) != len(own) if len(own) == len(text) else _ODD.search(text)
            if odd:
                out[i] = self._slow(text)
            else:
                plain.append(i)
                raw.append(own)
        for at, batch in batches(raw, 2_000_000):
            buffer, begin, end, hashed, owner = split_hashed(batch)
            _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
            pieces = [buffer[i:j] for i, j in zip(begin[first].tolist(), end[first].tolist())]
            encoded = list(map(self.known.get, pieces))
            new = [k for k, x in enumerate(encoded) if x is None]
            if new:
                if len(self.known) + len(new) > self.cache_words:
                    self.known = {x: y for x, y in zip(pieces, encoded) if y is not None}
                    self.ids = {}
                words = [pieces[k].decode() for k in new]
                self._learn(words)
                for k, w in zip(new, words):
                    encoded[k] = self.known[pieces[k]] = self.ids.pop(w)
            # the distinct pieces' ids in one array, then each word's run of it
            flat = np.frombuffer(b"".join(encoded), dtype="<u4")
            size = np.array(list(map(len, encoded)), dtype=np.int64) // 4
            start = np.cumsum(size) - size
            n = size[which]
            to = np.cumsum(n)
            ids = flat[np.repeat(start[which] - (to - n), n) + np.arange(to[-1] if len(to) else 0)]
            cut = np.r_[0, to][np.searchsorted(owner, np.arange(len(batch) + 1))] * 4
            raw, cut = ids.tobytes(), cut.tolist()
            for k in range(len(batch)):
                out[plain[at + k]] = raw[cut[k] : cut[k + 1]]
        return out


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
