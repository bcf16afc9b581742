"""Byte-pair merges for many words at once, in numpy.

The merge table comes from a public tokenizer's JSON. Words are merged side by
side: each round finds every word's lowest-ranked adjacent pair and merges all
its occurrences, left to right, until no word has a pair left. In a merge table
a pair's parts always rank before the pair, so this gives the tokens that
merging one pair at a time gives.
"""

from __future__ import annotations

import json

import numpy as np

NONE = np.iinfo(np.int32).max
#: Longer words are left to the tokenizer's own heap-based merging.
LONGEST = 600
BITS = 17


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class Merges:
    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        vocab = self.vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in self.symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in self.symbols], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bits = 18
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        for rank, (a, b) in enumerate(pairs):
            key = vocab[a] << BITS | vocab[b]
            at = self._slot(np.array([key]))[0]
            while self.keys[at] >= 0 and self.keys[at] != key:
                at = (at + 1) % len(self.keys)
            if self.keys[at] < 0:
                self.keys[at], self.ranks[at] = key, rank

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, key: np.ndarray) -> np.ndarray:
        at = self._slot(key)
        found, out = self.keys[at], self.ranks[at]
        out = np.where(found == key, out, NONE)
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.keys)
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        sym = self.inner[data]
        full = sizes > 0
        sym[ends[full] - 1] = self.last[data[ends[full] - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_word, done_sym = [word[:0]], [sym[:0]]
        while len(sym):
            rank = np.full(len(sym), NONE, np.int32)
            rank[:-1] = self._rank(sym[:-1] << BITS | sym[1:])
            change = word[1:] != word[:-1]
            rank[:-1][change] = NONE
            starts = np.flatnonzero(np.concatenate(([True], change)))
            best = np.minimum.reduceat(rank, starts)
            best = np.repeat(best, np.diff(np.append(starts, len(sym))))
            over = best == NONE
            if over.any():
                done_word.append(word[over])
                done_sym.append(sym[over])
            at = np.flatnonzero((rank == best) & ~over)
            keep = ~over
            if len(at):
                # aaa: of neighbouring candidates only every other one merges
                order = np.arange(len(at))
                first = np.concatenate(([True], np.diff(at) != 1))
                at = at[(order - np.maximum.accumulate(np.where(first, order, 0))) % 2 == 0]
                sym[at] = self.made[rank[at]]
                keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        return sym[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(words))
