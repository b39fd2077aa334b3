"""Minimal perfect hashing of 64-bit keys by levels of bit arrays with rank.

Each level hashes the keys that are left into a bit array; a key alone at its
bit is placed there, the others go on to the next level. A key's slot is the
number of bits set before its own. Keys left after the last level are listed.
"""

from __future__ import annotations

import io

import numpy as np

LEVELS, GAMMA = 24, 2.0


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 999) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    def __init__(self, sizes, bits, rest):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.ranks = [np.concatenate(([0], np.cumsum(b, dtype=np.int64))) for b in bits]
        self.bases = np.concatenate(([0], np.cumsum([int(r[-1]) for r in self.ranks]))).astype(np.int64)
        self.listed = {int(k): int(self.bases[-1]) + i for i, k in enumerate(rest)}

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys, sizes, bits = keys.astype(np.uint64), [], []
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys must differ")
        for level in range(LEVELS):
            if not len(keys):
                break
            size = max(64, int(GAMMA * len(keys)))
            at = (mix(keys, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            keys = keys[~alone[at]]
        return cls(sizes, bits, keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where a key can't be one of those built."""
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (size, bits) in enumerate(zip(self.sizes, self.bits, strict=True)):
            at = (mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.bases[level] + self.ranks[level][at[hit]]
            left = left[~hit]
        for i in left:
            out[i] = self.listed.get(int(keys[i]), -1)
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=np.asarray(self.sizes, dtype=np.int64), rest=self.rest, **{f"b{i}": np.packbits(b) for i, b in enumerate(self.bits)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        with np.load(io.BytesIO(data)) as z:
            sizes = [int(s) for s in z["sizes"]]
            return cls(sizes, [np.unpackbits(z[f"b{i}"], count=s).astype(bool) for i, s in enumerate(sizes)], z["rest"])
