"""Vectorised hashing of words and windows, shared by the operators that run in Arrow batches.

All hashes are 64 bits wide, wrap modulo 2**64 and are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_K = U(0x9E3779B97F4A7C15)
_BASE = U(0xD6E8FEB86659FD93)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    edge = np.diff(np.concatenate(([True], IS_SPACE[b], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


#: Words of more bytes are hashed byte by byte.
_LONG = 256
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes and length, from eight bytes at a time."""
    n = ends - starts
    out = mix(n.astype(U) * _K)
    eights = np.ndarray((len(b) + 1,), "<u8", np.concatenate((b, np.zeros(8, np.uint8))), strides=(1,))
    some = np.flatnonzero(n <= _LONG)
    at, left = starts[some], n[some]
    while len(some):
        w = eights[at] & _MASKS[np.minimum(left, 8)]
        out[some] = mix((out[some] ^ w) * _BASE)
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > _LONG):
        own = b[starts[i] : ends[i]].astype(U) + U(1)
        out[i] = mix(out[i : i + 1] + (own * powers(len(own))).sum())[0]
    return out


def gram_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of k values: len(w) - k + 1 of them, by doubling."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, h, size = None, 0, w.astype(U) + U(0x632BE59BD9B4E019), 1
    while True:
        if k & size:
            part = h[done : done + n]
            out = part.copy() if out is None else out * (_BASE + U(2 * size)) + part
            done += size
        if size * 2 > k:
            return mix(out)
        h = mix(h[:-size] * (_K + U(2 * size)) + h[size:])
        size *= 2


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1, one run after another."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first, lengths) + np.repeat(starts, lengths)


def groups(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text stands alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


#: Bytes whose words are looked for at once: these and the arrays made from them stay in the cache.
_AT_ONCE = 1 << 18


def batch_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts joined by line feeds: the bytes, each word's start and end, its text's number, and its hash."""
    b = np.frombuffer(b"\n".join(texts), np.uint8)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    parts = []
    for i, j in groups(texts, _AT_ONCE):
        own = b[first[i] : first[j] - 1]
        starts, ends = word_spans(own)
        parts.append((starts + first[i], ends + first[i], i + np.searchsorted(first[i:j] - first[i], starts, "right") - 1, word_hashes(own, starts, ends)))
    if not parts:
        none = np.zeros(0, np.int64)
        return b, none, none, none, np.zeros(0, U)
    return b, *(np.concatenate([x[k] for x in parts]) for k in range(4))
