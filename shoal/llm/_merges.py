"""Byte-pair merges of many pre-tokens at once, by column.

A group of pre-tokens is a matrix, a pre-token a column of symbols. Each round
merges the pair of least rank, the first of equals, in every column, as the
model does in one; only the two pairs beside it are looked up anew.
"""

from __future__ import annotations

import json

import numpy as np

#: Lengths of pre-tokens that are merged together, by the most bytes, and pre-tokens in a group.
LENGTHS, GROUP = (1, 4, 9, 14, 24, 80), 1 << 14
#: Low bits that hold the place of a pair beside its rank.
PLACE = 7
_NONE = np.int32(((1 << 31) - 1) >> PLACE << PLACE)


def _either(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a where mask is all ones, b where it is 0; faster than a choice by bool."""
    return b ^ ((a ^ b) & mask)


class Merges:
    """The merges of a plain byte-level BPE model."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], letters: list[str]):
        self.pad = max(vocabulary.values()) + 1  # stands for nothing, and is in no pair
        self.kind, self.pair = (np.int32, np.uint32) if self.pad < 1 << 16 else (np.int64, np.uint64)  # symbols have half the bits of a pair
        self.half = self.kind(np.dtype(self.kind).itemsize * 4)
        self.byte = np.asarray([vocabulary[x] for x in letters], dtype=self.kind)
        ranks = {(vocabulary[a], vocabulary[b]): i for i, (a, b) in enumerate(merges)}
        self.made = np.asarray([vocabulary[a + b] for a, b in merges], dtype=self.kind)
        pairs = np.asarray(list(ranks), dtype=self.kind).reshape(-1, 2)
        keys, ranks = (pairs[:, 0] << self.half | pairs[:, 1]).view(self.pair), np.fromiter(ranks.values(), dtype=np.int32, count=len(ranks)) << PLACE
        bits = max(8, (8 * len(keys)).bit_length())
        self.odd = self.pair(0x9E3779B97F4A7C15 >> (64 - 2 * int(self.half)) | 1)
        self.shift, self.mask = self.pair(2 * self.half - bits), (1 << bits) - 1
        self.free = ~self.pair(0)
        self.keys, self.ranks = np.full(1 << bits, self.free), np.full(1 << bits, _NONE)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at, which = np.unique(slot[left], return_index=True)  # one pair for each slot
            empty = self.keys[at] == self.free
            self.keys[at[empty]], self.ranks[at[empty]] = keys[left[which[empty]]], ranks[left[which[empty]]]
            left = np.delete(left, which[empty])
            slot[left] = (slot[left] + 1) & self.mask

    @classmethod
    def of(cls, path: str, letters: list[str]) -> Merges | None:
        """The merges of a tokenizer's file; None if its model does anything else besides."""
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        odd = model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        odd = odd or any(not t.get("special") for t in held.get("added_tokens") or [])
        if odd or not all(x in model.get("vocab", ()) for x in letters):
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, letters) if len(merges) < _NONE >> PLACE else None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.odd) >> self.shift).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair above its place's bits, _NONE if it isn't merged."""
        keys = (a << self.half | b).view(self.pair)
        slot = self._slot(keys)
        found = self.keys[slot]
        same = found == keys
        out = np.where(same, self.ranks[slot], _NONE)
        left = np.flatnonzero(~same & (found != self.free))
        while len(left):
            slot[left] = at = (slot[left] + 1) & self.mask
            found = self.keys[at]
            same = found == keys[left]
            out[left[same]] = self.ranks[at[same]]
            left = left[~same & (found != self.free)]
        return out

    def _merge(self, symbols: np.ndarray) -> np.ndarray:
        """The columns of symbols (filled up with pad) with all merges done."""
        out, columns = np.full_like(symbols, self.pad), np.arange(symbols.shape[1])
        at = np.arange(len(symbols), dtype=np.int32)[:, None]
        ranks = self._rank(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(-1, len(columns))
        while len(ranks) and len(columns):  # a merge makes every column that is left shorter by one
            best = (ranks | at[: len(ranks)]).min(axis=0)
            live, done = np.flatnonzero(best < _NONE), np.flatnonzero(best >= _NONE)
            if len(done):
                out[: len(symbols), columns[done]] = symbols.take(done, axis=1)
                symbols, ranks, columns, best = symbols.take(live, axis=1), ranks.take(live, axis=1), columns[live], best[live]
            place, new, n = best & ((1 << PLACE) - 1), self.made[best >> PLACE], np.arange(len(columns))
            symbols = _either((place - at[: len(ranks)]) >> 31, symbols[1:], symbols[:-1])  # those after the place
            symbols[place, n] = new
            ranks = _either((place - 1 - at[: len(ranks) - 1]) >> 31, ranks[1:], ranks[:-1])
            before, after = np.flatnonzero(place), np.flatnonzero(place < len(ranks))
            others = symbols[np.concatenate((place[before] - 1, place[after] + 1)), np.concatenate((before, after))]
            k = len(before)
            found = self._rank(np.concatenate((others[:k], new[after])), np.concatenate((new[before], others[k:])))
            ranks[place[before] - 1, before], ranks[place[after], after] = found[:k], found[k:]
        out[: len(symbols), columns] = symbols
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pre-tokens data[starts[i]:ends[i]] one after the other, and how many each has; none is longer than LENGTHS."""
        sizes = ends - starts
        lengths, made, low = np.zeros(len(starts), dtype=np.int64), [], 0
        for most in LENGTHS:
            those = np.flatnonzero((sizes > low) & (sizes <= most))
            for a in range(0, len(those), GROUP):
                which = those[a : a + GROUP]
                at = np.arange(most)[:, None]
                symbols = self.byte[data[np.minimum(starts[which] + at, len(data) - 1)]]
                symbols = self._merge(np.where(at < sizes[which], symbols, self.kind(self.pad))).T
                held = symbols != self.pad
                lengths[which] = held.sum(axis=1)
                made.append((which, symbols[held]))
            low = most
        ends = np.cumsum(lengths)
        ids = np.empty(ends[-1] if len(ends) else 0, dtype="<u4")
        for which, found in made:
            n = lengths[which]
            upto = np.cumsum(n)
            ids[np.repeat(ends[which] - upto, n) + np.arange(len(found))] = found
        return ids, lengths
