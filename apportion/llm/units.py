"""Texts as sequences of units whose tokens never depend on their neighbours, each distinct unit encoded once.

A unit is a run of blanks with the other characters up to the next blank; where
the tokenizer parts letters from marks, a unit also ends before a mark. A
tokenizer that never joins over such a border gives a text the tokens of its
units, one after another. Units are cut, hashed (128 bits) and
looked up with array operations; only units that a worker has not met are
encoded, all new ones of a batch together. The worker forgets its units when
they are more than KEPT, so its memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from apportion.llm.seq import mix, ragged

U = np.uint64
KEPT = 1_500_000
#: Units of more bytes are hashed byte by byte and not kept.
LONG = 32
_SLOTS = 1 << 22
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def table(blanks: bytes, letters: bytes = b"", marks: bytes = b"") -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for k, chars in enumerate((blanks, letters, marks), 1):
        out[list(chars)] = k
    return out


def cuts(b: np.ndarray, firsts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Starts of the units of texts that begin at ``firsts`` (none of them empty): where a blank (kind 1) follows another byte, or a mark (kind 3) a letter (kind 2)."""
    kind = kinds[b]
    space = kind == 1
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[1:] |= (kind[1:] == 3) & (kind[:-1] == 2)
    cut[firsts] = True
    return np.flatnonzero(cut)


class Units:
    """encode: the new units' ids, one unit after another, each unit's number of ids, and a score for each unit."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.slots = np.zeros(_SLOTS, np.int32)  # number of the unit, from 1
        self.n = 1
        self.check = np.zeros((KEPT + 2, 2), U)
        self.at, self.size, self.score = np.zeros(KEPT + 2, np.int64), np.zeros(KEPT + 2, np.int32), np.zeros(KEPT + 2, np.int32)
        self.flat = np.zeros(1 << 20, np.uint32)
        self.used = 0

    @staticmethod
    def _keys(b: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each unit of at most LONG bytes; b has 32 bytes more than the units."""
        words = np.ndarray((len(b) - 7,), "<u8", b, strides=(1,))
        one, two = n.astype(U) * U(0x9E3779B97F4A7C15), n.astype(U) + U(0x632BE59BD9B4E019)
        with np.errstate(over="ignore"):
            for k in range(0, LONG, 8):
                some = slice(None) if not k else np.flatnonzero(n > k)
                if k and not len(some):
                    break
                w = words[starts[some] + k] & _MASKS[np.minimum(n[some] - k, 8)]
                one[some] = (one[some] ^ w) * U(0xBF58476D1CE4E5B9)
                one[some] ^= one[some] >> U(29)
                two[some] = (two[some] + w) * U(0xD1342543DE82EF95)
                two[some] ^= two[some] >> U(32)
        return mix(one), two

    def _find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Numbers of the units; 0 for unknown ones."""
        out = np.zeros(len(one), np.int32)
        todo, at = np.arange(len(one)), (one & U(_SLOTS - 1)).astype(np.int64)
        while len(todo):
            got = self.slots[at]
            same = (self.check[got, 0] == one[todo]) & (self.check[got, 1] == two[todo]) & (got > 0)
            out[todo[same]] = got[same]
            on = (got > 0) & ~same
            todo, at = todo[on], (at[on] + 1) & (_SLOTS - 1)
        return out

    def _add(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, counts: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Keep distinct new units; their numbers."""
        k = len(one)
        own = np.arange(self.n, self.n + k, dtype=np.int32)
        self.n += k
        if self.n > len(self.size):
            more = self.n - len(self.size)
            self.check = np.concatenate((self.check, np.zeros((more, 2), U)))
            self.at, self.size, self.score = (np.concatenate((x, np.zeros(more, x.dtype))) for x in (self.at, self.size, self.score))
        self.check[own, 0], self.check[own, 1] = one, two
        self.at[own], self.size[own], self.score[own] = self.used + np.cumsum(counts) - counts, counts, scores
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        if k < _SLOTS // 2:
            left, at = np.arange(k), (one & U(_SLOTS - 1)).astype(np.int64)
            while len(left):
                free = np.flatnonzero(self.slots[at[left]] == 0)
                self.slots[at[left[free]]] = own[left[free]]
                left = left[self.slots[at[left]] != own[left]]
                at[left] = (at[left] + 1) & (_SLOTS - 1)
        return own

    def look(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For units b[start:end]: all ids, one unit after another, the number of ids of each unit, and each unit's score."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = ends - starts
        if self.n > KEPT:
            self._clear()
        padded = np.concatenate((b, np.zeros(LONG, np.uint8)))
        short = np.flatnonzero(n <= LONG)
        long = np.flatnonzero(n > LONG)
        one, two = self._keys(padded, starts[short], n[short])
        number = np.zeros(len(n), np.int32)
        number[short] = self._find(one, two)
        new = np.flatnonzero(number[short] == 0)
        raw = None
        if len(new):
            raw = b.tobytes()
            _, first, back = np.unique(one[new], return_index=True, return_inverse=True)
            at = short[new[first]]
            got = self._add(one[new[first]], two[new[first]], *self.encode([raw[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
            number[short[new]] = got[back]
        size, score, at = self.size[number].astype(np.int64), self.score[number].astype(np.int64), self.at[number]
        if not len(long):
            return self.flat[ragged(at, size)], size, score
        raw = raw or b.tobytes()
        names: dict[bytes, int] = {}
        which = np.array([names.setdefault(raw[i:j], len(names)) for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
        ids, counts, scores = self.encode([*names])
        size[long], score[long] = counts[which], scores[which]
        flat = np.concatenate((self.flat[: self.used], ids))
        at[long] = (self.used + np.cumsum(counts) - counts)[which]
        return flat[ragged(at, size)], size, score
