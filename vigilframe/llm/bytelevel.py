"""Vectorised splitting of texts at the byte-level BPE pattern, and a bounded table of the pieces' ids.

The pattern (a contraction; an optional space and letters, numbers or other characters; white space) is applied to many
texts at once by character classes: pieces begin where the class changes, a space before a run belongs to it, and a
contraction ends two or three characters after its apostrophe. A piece's ids come from the tokenizers library; they don't
depend on its neighbours, so each is asked for once and kept by a 64-bit hash, with its characters: a piece that only
shares another one's hash is encoded by itself.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

from .textkit import U64, word_hashes

LETTER, NUMBER, SPACE = 1, 2, 3
SLICE_CHARS = 1 << 19
SLOTS, MOST_ENTRIES = 1 << 21, 1_000_000
#: Fixed value: the characters with the property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for k, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for low, high in ((0, 0xD800), (0xE000, 0x110000)):
            for m in regex.finditer(pattern, "".join(map(chr, range(low, high)))):
                out[low + m.start() : low + m.end()] = k
    out[list(WHITE_SPACE)] = SPACE
    return out


def piece_starts(chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts that lie behind each other; bounds holds each text's first place and the end."""
    n = len(chars)
    kind = classes()[chars]
    begins = np.zeros(n + 1, bool)
    begins[bounds] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= begins[:n]
    space = kind == SPACE
    blank = chars == 0x20
    joined = np.zeros(n, bool)  # a space stands before it, in its text
    joined[1:] = blank[:-1] & ~begins[1:n]
    out = change & (space | ~joined)
    # The last of white space before something else begins a piece: alone, or as that one's space.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~begins[1:n]
    out |= last
    mark = np.flatnonzero((chars == 0x27) & change & ~joined)
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == LETTER) & ~begins[mark + 1]]
    if len(mark):
        end_of = bounds[np.searchsorted(bounds, mark, "right")]
        for letters in CONTRACTIONS:
            k = len(letters)
            fits = mark + 1 + k <= end_of
            for j, c in enumerate(letters):
                fits &= chars[np.minimum(mark + 1 + j, n - 1)] == ord(c)
            at = mark[fits]
            out[at + 1] = False
            rest = (at + 1 + k)[at + 1 + k < end_of[fits]]
            out[rest[kind[rest] == LETTER]] = True
    return np.flatnonzero(out)


class Pieces:
    """Ids of pieces by hash, in an open-addressing table; emptied when full."""

    def __init__(self, encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(SLOTS, U64), np.zeros(SLOTS, np.int32)
        self.n = 0
        self.offset, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)  # of ids
        self.begin, self.chars = np.zeros(1 << 16, np.int64), np.zeros(1 << 20, np.uint32)  # of characters

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entries, -1 where a key isn't there."""
        out = np.full(len(keys), -1, np.int32)
        left, slot = np.arange(len(keys)), (keys & U64(SLOTS - 1)).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.entry[slot[hit]]
            go = ~hit & (there != 0)
            left, slot = left[go], (slot[go] + 1) & (SLOTS - 1)
        return out

    def add(self, keys: np.ndarray, ids: list[np.ndarray], chars: list[np.ndarray]) -> None:
        first = self.n
        while first + len(keys) + 1 > len(self.offset):
            self.offset, self.begin = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.begin))
        self.pool = _append(self.pool, self.offset, first, ids)
        self.chars = _append(self.chars, self.begin, first, chars)
        self.n = first + len(keys)
        left, slot = np.arange(len(keys)), (keys & U64(SLOTS - 1)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            take = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[take]], self.entry[slot[take]] = keys[left[take]], first + left[take]
            rest = np.ones(len(left), bool)
            rest[take] = False
            left, slot = left[rest], (slot[rest] + 1) & (SLOTS - 1)

    def __call__(self, text: str, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of each text's ids) of texts joined in `text`."""
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = piece_starts(chars, bounds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        ends = np.append(starts[1:], len(chars))
        keys = word_hashes(chars.view(np.uint8), 4 * starts, 4 * ends) | U64(1)
        found = self.find(keys)
        gone = np.flatnonzero(found < 0)
        if len(gone):
            new, at = np.unique(keys[gone], return_index=True)
            if self.n + len(new) > MOST_ENTRIES:
                self.clear()
                gone = np.arange(len(keys))
                new, at = np.unique(keys, return_index=True)
            at = gone[at]
            pieces = [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self.add(new, self.encode(pieces), [chars[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            found[gone] = self.find(keys[gone])
        sizes = self.offset[found + 1] - self.offset[found]
        total = np.concatenate([[0], sizes.cumsum()])
        ids = self.pool[np.repeat(self.offset[found] - total[:-1], sizes) + np.arange(total[-1])]
        other = self._others(chars, starts, ends, found)
        if len(other):
            own = self.encode([text[a:b] for a, b in zip(starts[other].tolist(), ends[other].tolist(), strict=True)])
            parts = np.split(ids, total[1:-1])
            for i, x in zip(other.tolist(), own, strict=True):
                parts[i] = x
            ids, total = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, total[np.searchsorted(starts, bounds)]

    def _others(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Pieces whose characters aren't those of the entry found by their hash."""
        size = ends - starts
        same = self.begin[found + 1] - self.begin[found] == size
        at = np.repeat(np.where(same, self.begin[found], 0) - starts, size) + np.arange(starts[0], ends[-1])
        equal = self.chars[np.minimum(at, len(self.chars) - 1)] == chars[starts[0] : ends[-1]]
        return np.flatnonzero(~same | ~np.logical_and.reduceat(equal, starts - starts[0]))


def _append(pool: np.ndarray, bounds: np.ndarray, first: int, parts: list[np.ndarray]) -> np.ndarray:
    """pool (twice as large where it must) with parts from bounds[first] on; their ends go into bounds."""
    ends = bounds[first] + np.cumsum([len(x) for x in parts])
    while ends[-1] > len(pool):
        pool = np.concatenate([pool, np.zeros_like(pool)])
    pool[bounds[first] : ends[-1]] = np.concatenate(parts)
    bounds[first + 1 : first + 1 + len(parts)] = ends
    return pool
