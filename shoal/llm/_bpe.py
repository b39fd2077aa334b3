"""Byte-level BPE ids of whole texts, by way of a cache of the pieces between spaces.

In the byte-level pre-tokenizer a single space or line feed between two
characters that aren't white space always begins a new pre-token (and such a
line feed is one by itself), so that the pieces between them encode alone as
they do in the text. Pieces repeat a great deal;
only new ones go through the tokenizers library, words by its model alone; in
whole columns, new words of letters and signs are merged by column instead.
"""

from __future__ import annotations

import json
import re
import string
import sys
import zlib
from array import array

import numpy as np

from ._merges import Merges
from ._words import stretches, words_of

_OTHER_SPACE = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c != " "]
_OTHER_ASCII = [c for c in _OTHER_SPACE if c.isascii()]
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Pieces that a cache holds, and the longest piece that it takes.
CACHE_PIECES, CACHE_CHARS = 200_000, 64
#: With these at its end a word is still two pre-tokens: the word and all its signs.
_SIGNS = string.punctuation.replace("'", "")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in prints)
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def pieces(text: str) -> list[str]:
    """text, cut before every single blank or line feed that stands between two other characters than white space.

    All parts but the first go without their blank, with their line feed.
    """
    odd = "  " in text or "\n\n" in text or text[:1].isspace() or text[-1:].isspace() or any(c in text and any(c + d in text or d + c in text for d in " \n") for c in (_OTHER_ASCII if text.isascii() else _OTHER_SPACE))
    if odd:
        return [p[1:] if i and p[0] == " " else p for i, p in enumerate(_BOUNDARY.split(text))]
    return text.replace("\n", " \n").split(" ")


class _Pieces(dict):
    """The ids of pieces after a blank, or after a line feed that they begin with; a new one is coded when it's asked for."""

    def __init__(self, code):
        super().__init__()
        self.code = code

    def __missing__(self, piece: str) -> bytes:
        out = self.code(piece)
        if len(piece) <= CACHE_CHARS:
            self[piece] = out
        return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1 and so on, lengths[i] of them, one i after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts.astype(np.int64) - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Table:
    """Ids of pieces by two hashes of 64 bits, in open addressing: many at once are looked up by column."""

    def __init__(self, bits: int = 20):
        self.mask = np.uint64((1 << bits) - 1)
        self.first, self.second = (np.zeros(1 << bits, dtype=np.uint64) for _ in range(2))
        self.start, self.length = np.zeros(1 << bits, dtype=np.int32), np.full(1 << bits, -1, dtype=np.int32)
        self.ids, self.end, self.held = np.zeros(1 << 16, dtype="<u4"), 0, 0
        self.times = np.zeros(1 << bits, dtype=np.uint16)  # that it was found since it was added

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of each piece, -1 if it isn't held."""
        slot = (first & self.mask).astype(np.int64)
        out = np.where((self.first[slot] == first) & (self.second[slot] == second), slot, -1)
        left = np.flatnonzero(out < 0)
        left = left[self.length[slot[left]] >= 0]
        while len(left):
            slot[left] = (slot[left] + 1) & int(self.mask)
            at = slot[left]
            good = (self.first[at] == first[left]) & (self.second[at] == second[left]) & (self.length[at] >= 0)
            out[left[good]] = at[good]
            left = left[~good & (self.length[at] >= 0)]
        return out

    def add(self, first: np.ndarray, second: np.ndarray, lengths: np.ndarray | list[int], ids: np.ndarray | list[int]) -> None:
        """Hold new pieces; of equal first hashes only one may come at a time."""
        length = np.asarray(lengths, dtype=np.int64)
        start = self.end + np.cumsum(length) - length
        while self.end + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.end : self.end + len(ids)] = ids
        self.end, self.held = self.end + len(ids), self.held + len(first)
        slot, left = (first & self.mask).astype(np.int64), np.arange(len(first))
        while len(left):
            at, which = np.unique(slot[left], return_index=True)  # one piece for each slot
            free = self.length[at] < 0
            at, mine = at[free], left[which[free]]
            self.first[at], self.second[at], self.start[at], self.length[at] = first[mine], second[mine], start[mine], length[mine]
            left = np.delete(left, which[free])
            slot[left] = (slot[left] + (self.length[slot[left]] >= 0)) & int(self.mask)

    def full(self) -> bool:
        return 2 * self.held > len(self.first)

    def forget(self) -> None:
        """Keep those found most often since they were added, at most a quarter of the slots."""
        often = np.cumsum(np.bincount(self.times)[::-1])  # how many were found 0, 1, 2... times less than the most
        at = np.flatnonzero(self.times >= max(1, len(often) - int(np.searchsorted(often, len(self.first) // 4, "right"))))
        first, second, length = self.first[at], self.second[at], self.length[at]
        ids = self.ids[spread(self.start[at], length)]
        self.first[:], self.second[:], self.length[:], self.times[:], self.end, self.held = 0, 0, -1, 0, 0, 0
        one = np.unique(first, return_index=True)[1]  # of equal first hashes one
        if len(one) == len(at):
            self.add(first, second, length, ids)


#: Bytes of white space other than blank and line feed, and pairs of bytes that begin one beyond ASCII.
_ODD_BYTE = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31])
_ODD_PAIRS = [(0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)]
_LETTER_BYTE = np.isin(np.arange(256), list(string.ascii_letters.encode()))
_SIGN_BYTE = np.isin(np.arange(256), list(_SIGNS.encode()))
_KIND = (np.arange(3, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


class PieceCoder:
    """Encodes texts as little-endian 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary = self.tokenizer.get_vocab_size()
        # the state of the pre-tokenizer alone, not of the whole vocabulary
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer is not None else {}
        self.cuts = self.tokenizer.normalizer is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.known = _Pieces(self._new)
        self.signs: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.tokenize = self.model.tokenize
        self._lf = self._whole("\n")
        self.table = _Table()
        self.merges = Merges.of(path, [_BYTE_LETTERS.get(b, chr(b)) for b in range(256)]) if self.cuts else None

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str, blank: bool = True) -> bytes:
        """The ids of a piece, after a blank or not; a word, or signs after a word, goes straight to the model."""
        word = piece.rstrip(_SIGNS)
        if len(word) > CACHE_CHARS or not word.isalpha():
            return self._whole(" " + piece if blank else piece)
        if len(word) == len(piece):
            return self._word(word, blank)
        out = self.known[word] if blank else self._word(word, blank)
        signs = piece[len(word) :]
        return out + (self.signs.get(signs) or self._sign(signs))

    def _word(self, word: str, blank: bool) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.tokenize("\u0120" + letters if blank else letters)]).tobytes()

    def _sign(self, signs: str) -> bytes:
        self.signs[signs] = out = self._whole(signs)
        return out

    def _new(self, piece: str) -> bytes:
        return self._lf + self._piece(piece[1:], False) if piece[:1] == "\n" else self._piece(piece)

    def _parts(self, parts: list[str]) -> bytes:
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, parts))

    def encode_pieces(self, parts: list[str]) -> bytes:
        """The ids of a text cut by pieces()."""
        return (self._piece(parts[0], False) if parts[0] else b"") + self._parts(parts[1:])

    def encode(self, text: str) -> bytes:
        return self.encode_pieces(pieces(text)) if self.cuts else self._whole(text)

    def _plain(self, data: np.ndarray, body: bytes, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are letters, with or without signs after them; how many ids each of these has, after the blank or line feed of its kind, and all of them."""
        cut = ends.copy()
        plain = ends - starts <= CACHE_CHARS
        left = np.flatnonzero(plain)
        while len(left := left[(cut[left] > starts[left]) & _SIGN_BYTE[data[cut[left] - 1]]]):
            cut[left] -= 1
        plain &= cut > starts
        # nearly all letters are ASCII ones or of two bytes, U+00C0 to U+023F but for two signs; the rest are asked for one by one
        after = np.append(data[1:], np.uint8(0))
        lead = (data >= 0xC4) & (data <= 0xC8) | (data == 0xC3) & (after != 0x97) & (after != 0xB7)
        letter = _LETTER_BYTE[data] | lead
        letter[1:] |= lead[:-1]
        others = np.flatnonzero(~letter)
        letters = np.searchsorted(others, starts) == np.searchsorted(others, cut)
        at = np.flatnonzero(plain & ~letters)
        plain[at] = [body[a:b].decode().isalpha() for a, b in zip(starts[at].tolist(), cut[at].tolist(), strict=True)]
        starts, cut, ends, kind = starts[plain], cut[plain], ends[plain], kind[plain]
        # a line feed, the word with its blank, and the signs are pre-tokens
        firsts = np.stack((starts - (kind == 2), starts - (kind == 1), cut), axis=1).ravel()
        lasts = np.stack((starts, cut, ends), axis=1).ravel()
        ids, lengths = self.merges.encode(data, firsts, lasts)
        return plain, lengths.reshape(-1, 3).sum(axis=1), ids

    def encode_all(self, column):
        """The ids of each text of a column, an array each.

        Texts whose words stand one blank or line feed apart, and hold no other
        white space, are looked up word by word, all at once; the others go one by one.
        """
        for first, data, offsets in stretches(column):
            w = words_of(data, offsets, fold=False, twice=True)
            n = len(w.starts)
            count = np.diff(w.bounds)
            texts = np.repeat(np.arange(len(count)), count)
            leads = np.zeros(n, dtype=bool)
            leads[w.bounds[:-1][count > 0]] = True
            gap = np.where(leads, w.starts - offsets[texts], w.starts - np.append(0, w.ends[:-1])[:n])
            odd = gap != np.where(leads, 0, 1)
            bad = np.bincount(texts[odd], minlength=len(count)) > 0
            bad |= (count == 0) | (not self.cuts)
            last = w.bounds[1:][~bad] - 1
            bad[np.flatnonzero(~bad)[w.ends[last] != offsets[1:][~bad]]] = True
            at = np.flatnonzero(_ODD_BYTE[data])
            for a, b in _ODD_PAIRS:
                at = np.append(at, np.flatnonzero((data[:-1] == a) & (data[1:] == b)))
            bad[np.searchsorted(offsets, at, "right") - 1] = True
            kind = np.where(leads, 0, np.where(data[np.maximum(w.starts - 1, 0)] == 10, 2, 1))
            use = np.flatnonzero(~bad[texts])
            one, two = w.hashes[use] ^ _KIND[kind[use]], w.second[use]
            if self.table.full():
                self.table.forget()
            slot = self.table.find(one, two)
            self.table.times[slot[slot >= 0]] += 1  # by so many calls, since equal slots count once
            body = data.tobytes() if (slot < 0).any() else b""
            while len(missing := np.flatnonzero(slot < 0)):
                new = missing[np.unique(one[missing], return_index=True)[1]]
                if self.merges is not None:
                    plain, lengths, ids = self._plain(data, body, w.starts[use[new]], w.ends[use[new]], kind[use[new]])
                    self.table.add(one[new[plain]], two[new[plain]], lengths, ids)
                    new = new[~plain]
                lengths, ids = [], []
                for a, b, k in zip(w.starts[use[new]].tolist(), w.ends[use[new]].tolist(), kind[use[new]].tolist(), strict=True):
                    word = body[a:b].decode()
                    if k == 1 and b - a <= CACHE_CHARS and word.isalpha() and word.isascii():
                        got = [t.id for t in self.tokenize("\u0120" + word)]
                    else:
                        got = array("I", self._piece(word, False) if k == 0 else self._new(word if k == 1 else "\n" + word)).tolist()
                    ids += got
                    lengths.append(len(got))
                self.table.add(one[new], two[new], lengths, ids)
                slot[missing] = self.table.find(one[missing], two[missing])
            size = self.table.length[slot]
            ids = self.table.ids[spread(self.table.start[slot], size)]
            upto = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
            of_text = upto[np.concatenate(([0], np.cumsum(np.where(bad, 0, count))))]
            for i, (a, b) in enumerate(zip(of_text[:-1].tolist(), of_text[1:].tolist(), strict=True)):
                yield np.frombuffer(self.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode()), dtype="<u4") if bad[i] else ids[a:b]


_coders: dict[str, PieceCoder] = {}


def coder_of(path: str) -> PieceCoder:
    """The coder of this worker: its cache outlives a task."""
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
