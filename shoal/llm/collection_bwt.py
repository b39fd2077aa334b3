"""Burrows-Wheeler transform and common prefixes of a collection, column by column.

The strings are written as columns, the last symbols of all strings first. Round
by round one more symbol of each string is inserted. A round reads the files of
the one before in order, block by block, and finds for every string where its
suffix, one symbol longer, belongs (the symbols less than it, and its equals
before its place) and what it has in common with its new neighbours; a second
pass in order merges the new rows in and writes the files anew. In memory are a
block, one number per symbol and three per string.
"""

from __future__ import annotations

import contextlib

import numpy as np

BLOCK = 1 << 20
#: A row of the files is 64 bits: the symbol before the suffix (16), the weight it has in common with the suffix before it (16), and whose suffix (22) of how many symbols (10) it is.
ROW = np.dtype(np.uint64)
MOST_STRINGS, MOST_SYMBOLS = 1 << 22, 1 << 10
_SYMBOL, _PREFIX, _OWNER = np.uint64(48), np.uint64(32), np.uint64(10)
_ALL_BUT_PREFIX = np.uint64(0xFFFF_0000_FFFF_FFFF)
_FAR = np.int64(1) << 40


class Folder:
    """Sequential files in a folder of any file system that the cluster shares."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.files, self.path = fs.FileSystem.from_uri(uri)
        self.files.create_dir(self.path, recursive=True)

    def write(self, name: str, blocks) -> None:
        with self.files.open_output_stream(f"{self.path}/{name}", compression=None) as f:
            for block in blocks:
                f.write(np.array([len(block)], dtype=np.int64).tobytes())
                f.write(memoryview(np.ascontiguousarray(block)).cast("B"))

    def read(self, name: str, kind):
        with self.files.open_input_stream(f"{self.path}/{name}", compression=None) as f:
            while head := f.read(8):
                n = int(np.frombuffer(head, dtype=np.int64)[0])
                yield np.frombuffer(f.read(n * np.dtype(kind).itemsize), dtype=kind)

    def remove(self, name: str | None = None) -> None:
        with contextlib.suppress(FileNotFoundError):
            if name is None:
                self.files.delete_dir(self.path)
            else:
                self.files.delete_file(f"{self.path}/{name}")


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo:hi]) of each range, lo < hi."""
    if not len(lo):
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(lo, kind="stable")
    at = np.empty(2 * len(lo), dtype=np.int64)
    at[0::2], at[1::2] = lo[order], hi[order]
    out = np.empty(len(lo), dtype=np.int64)
    out[order] = np.minimum.reduceat(np.append(x, x.dtype.type(0)), at)[0::2]
    return out


class _Taker:
    """The rows of a file, as many at a time as asked for."""

    def __init__(self, blocks):
        self.blocks, self.held = blocks, np.zeros(0, ROW)

    def take(self, n: int) -> np.ndarray:
        parts = []
        while n > 0:
            if not len(self.held):
                self.held = next(self.blocks)
            parts.append(self.held[:n])
            self.held = self.held[n:]
            n -= len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, ROW)


def _places(blocks, place: np.ndarray, alphabet: int) -> tuple[np.ndarray, ...]:
    """First pass, for the strings at place (ascending): symbol, equals before it, common weights with the equal before and after it (-1: none), and the count of each symbol."""
    n = len(place)
    symbol, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
    own, follow = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    seen = np.zeros(alphabet, np.int64)
    since = np.full(alphabet, _FAR)  # least prefix after a symbol's last row so far
    open_, after = np.full(alphabet, -1, np.int64), np.full(alphabet, _FAR)  # string that waits for the next row of its symbol, least prefix after it
    base = first = 0
    for x, p in blocks:
        m = len(x)
        last = int(np.searchsorted(place, base + m))
        a = place[first:last] - base
        order = np.argsort(x, kind="stable")
        line = x[order]
        starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        kinds = line[starts].astype(np.int64)
        ends = np.append(starts[1:], m)
        group = np.zeros(alphabet, np.int64)
        group[kinds] = np.arange(len(kinds))
        upto = np.minimum.accumulate(p).astype(np.int64)
        onward = np.append(np.minimum.accumulate(p[::-1])[::-1].astype(np.int64), _FAR)
        # strings of earlier blocks whose symbol comes again
        waiting = np.flatnonzero(open_[kinds] >= 0)
        c = kinds[waiting]
        follow[open_[c]] = np.minimum(after[c], upto[order[starts[waiting]]])
        open_[c] = -1
        c = x[a].astype(np.int64)
        asked = np.zeros(m, dtype=bool)
        asked[a] = True
        r = np.empty(len(a), dtype=np.int64)
        r[np.argsort(c, kind="stable")] = np.flatnonzero(asked[order])  # both in the order of symbols
        g = group[c]
        symbol[first:last], before[first:last] = c, seen[c] + r - starts[g]
        inside = r > starts[g]
        mine = own[first:last]
        mine[inside] = _range_min(p, order[r[inside] - 1] + 1, a[inside] + 1)
        across = ~inside & (seen[c] > 0)
        mine[across] = np.minimum(since[c[across]], upto[a[across]])
        inside = r + 1 < ends[g]
        mine = follow[first:last]
        mine[inside] = _range_min(p, a[inside] + 1, order[r[inside] + 1] + 1)
        since, after = np.minimum(since, onward[0]), np.minimum(after, onward[0])
        since[kinds] = onward[order[ends - 1] + 1]
        seen[kinds] += ends - starts
        waits = np.flatnonzero(~inside)
        open_[c[waits]], after[c[waits]] = first + waits, onward[a[waits] + 1]
        base, first = base + m, last
    return symbol, before, own, follow, seen


def _merged(taker: _Taker, total: int, target: np.ndarray, rows: np.ndarray, late: np.ndarray, late_prefix: np.ndarray, block: int):
    """Second pass: the old rows with the new ones at target, and the prefixes of the rows at late set anew."""
    for base in range(0, total, block):
        m = min(block, total - base)
        a, b = np.searchsorted(target, (base, base + m))
        old = np.ones(m, dtype=bool)
        old[target[a:b] - base] = False
        out = np.empty(m, dtype=ROW)
        out[old] = taker.take(m - (b - a))
        out[target[a:b] - base] = rows[a:b]
        a, b = np.searchsorted(late, (base, base + m))
        at = late[a:b] - base
        out[at] = out[at] & _ALL_BUT_PREFIX | late_prefix[a:b].astype(np.uint64) << _PREFIX
        yield out


def _packed(symbol: np.ndarray, prefix: np.ndarray, owner: np.ndarray, depth: int) -> np.ndarray:
    as_bits = lambda x, by: x.astype(np.uint64) << by
    return as_bits(symbol, _SYMBOL) | as_bits(prefix, _PREFIX) | as_bits(owner, _OWNER) | np.uint64(depth)


def _symbols_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (rows >> _SYMBOL).astype(np.uint16), (rows >> _PREFIX).astype(np.uint16)


def unpacked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """symbol, prefix, owner and depth of rows."""
    low = rows.astype(np.uint32)
    return *_symbols_prefixes(rows), (low >> np.uint32(_OWNER)).astype(np.int64), (low & np.uint32(MOST_SYMBOLS - 1)).astype(np.int64)


def transform(strings: list[np.ndarray], weights: np.ndarray, folder: Folder, block: int = BLOCK):
    """Blocks of packed rows, one for each suffix, in sorted order.

    strings hold symbols from 1 to 65535. symbol is the transform, with 0 where
    a string begins; prefix the weight, below 65536, that a suffix has in
    common with the one before it (weights: of each symbol); owner and depth
    tell whose suffix it is and of how many symbols. Empty suffixes come first.
    """
    n = len(strings)
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    longest = int(lengths.max()) if n else 0
    if n >= MOST_STRINGS or longest >= MOST_SYMBOLS:
        raise ValueError("too many strings, or too long ones, for a shard")
    flat = np.concatenate(strings).astype(np.uint16) if n else np.zeros(0, np.uint16)
    ends = np.cumsum(lengths)
    for d in range(longest):
        folder.write(f"column-{d}", [flat[ends[lengths > d] - 1 - d]])
    del flat
    alphabet = len(weights)
    weights = weights.astype(np.int64)

    def column(d: int, owner: np.ndarray) -> np.ndarray:
        """The symbols that come before the suffixes of d symbols, 0 where there is none."""
        out = np.zeros(n, dtype=np.uint16)
        if d < longest:
            out[lengths > d] = next(folder.read(f"column-{d}", np.uint16))
            folder.remove(f"column-{d}")
        return out[owner]

    everyone = np.arange(n)
    first = _packed(column(0, everyone), np.zeros(n, np.uint16), everyone, 0)
    folder.write("round-0", (first[a : a + block] for a in range(0, n, block)))
    active = place = np.flatnonzero(lengths)
    total, done = n, 0
    while len(active):
        blocks = folder.read(f"round-{done}", ROW)
        symbol, before, own, follow, seen = _places(map(_symbols_prefixes, blocks), place, alphabet)
        less = np.cumsum(seen) - seen
        target = n + less[symbol] - seen[0] + before
        own = np.where(own >= 0, own + weights[symbol], 0)
        has = follow >= 0
        late, late_prefix = target[has] + 1, follow[has] + weights[symbol[has]]
        order = np.argsort(target, kind="stable")
        active, target, own = active[order], target[order], own[order]
        done += 1
        rows = _packed(column(done, active), own, active, done)
        by = np.argsort(late, kind="stable")
        total += len(active)
        taker = _Taker(folder.read(f"round-{done - 1}", ROW))
        folder.write(f"round-{done}", _merged(taker, total, target, rows, late[by], late_prefix[by], block))
        folder.remove(f"round-{done - 1}")
        left = lengths[active] > done
        active, place = active[left], target[left]
    yield from folder.read(f"round-{done}", ROW)
    folder.remove(f"round-{done}")
