"""Suffix-array dedup: a distributed merge sort that is aware of common prefixes.

Texts are UTF-8 bytes. A byte goes if it is covered by a 50-byte string that
also starts in a document with a smaller doc_id. ``repeats`` says which suffixes
are sorted and how the answers come back; this module has the sort. Every chunk
sorts its own suffixes (50 bytes, then the bytes before them) and sends them as
front-coded runs. A bucket's task merges its runs with a loser tree that keeps,
for each waiting suffix, how much of it agrees with the last one put out: of two
suffixes the one that agrees further is smaller, and only suffixes that agree
equally far are compared, from there on. The agreed lengths that fall out of the
merge are the common-prefix array from which the nodes are read.

Defined cases: a null text is empty; texts under 50 bytes keep all; a null
doc_id counts as greatest; rows with the same doc_id never remove each other's
bytes; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from apportion.llm import repeats

WINDOW, GRAM = 50, 20


def _agree(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    x = int.from_bytes(a[known:]) ^ int.from_bytes(b[known:])
    return len(a) - (x.bit_length() + 7) // 8


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Sorted runs of equally long strings, with the prefix that each string shares with the one before in its run.

    Yields (run, index, shared with the one yielded before), in order.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    shared = [r[1] for r in runs] + [[]] * (k - len(runs))
    at = [0] * k
    agree = [0 if s else -1 for s in strings]  # with the last string put out; -1: the run is at its end

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's agreement becomes that with the winner."""
        x, y = agree[a], agree[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = strings[a][at[a]], strings[b][at[b]]
        n = _agree(s, t, x)
        if n == len(s) or s[n] < t[n]:
            agree[b] = n
            return a, b
        agree[a] = n
        return b, a

    losers = [0] * k
    up = list(range(k))
    level = k
    while level > 1:
        level //= 2
        won = []
        for i in range(level):
            w, x = play(up[2 * i], up[2 * i + 1])
            losers[level + i] = x
            won.append(w)
        up = won
    top = up[0]
    while agree[top] >= 0:
        i = at[top]
        yield top, i, agree[top]
        at[top] = i = i + 1
        agree[top] = shared[top][i] if i < len(strings[top]) else -1
        node = (top + k) // 2
        while node:
            x = losers[node]
            if agree[top] < agree[x]:  # the usual case, without a call
                losers[node], top = top, x
            elif agree[top] == agree[x]:
                top, losers[node] = play(top, x)
            node //= 2


#: Merged contexts that are judged at once, unless one gram has more.
BLOCK = 50_000


def order(rows: np.ndarray, prefix: np.ndarray, ends: np.ndarray, spec: repeats.Spec) -> Iterator[tuple]:
    """All contexts of a bucket, merged, in blocks that part no gram. Runs end at ``ends``; prefix: what a row shares with the one before."""
    raw, w, lengths = rows.tobytes(), spec.width, prefix.tolist()
    begins = [0, *ends[:-1].tolist()]
    runs = [([raw[i * w : (i + 1) * w] for i in range(b, e)], lengths[b:e]) for b, e in zip(begins, ends.tolist(), strict=True)]
    del raw
    held, first = array("q"), np.array(begins, np.int64)

    def block() -> tuple:
        run, index, shared = np.frombuffer(held, np.int64).reshape(-1, 3).T
        at = first[run] + index
        return rows[at], shared.copy(), at

    n = 0
    for got in merge(runs):
        if n >= BLOCK and got[2] < spec.gram:
            yield block()
            held, n = array("q"), 0
        held.extend(got)
        n += 1
    if n:
        yield block()


SPEC = repeats.Spec(WINDOW, GRAM, words=False, smaller=True, order=order)


def _report(c: repeats.Chunk, covered: np.ndarray) -> pd.DataFrame:
    rows = []
    for i, (b, e) in enumerate(zip(c.begin, c.end, strict=True)):
        gone = covered[b:e]
        n = int(gone.sum())
        kept = c.texts[i] if not n else c.symbols[b:e][~gone].tobytes()
        spans = int((np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1).sum()) if n else 0
        rows.append((None if c.null[i] else int(c.ids[i]), int(e - b), n, spans, hashlib.sha256(kept).hexdigest()))
    out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return out.astype({"doc_id": "Int64"})


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return repeats.repeated(docs, SPEC, _report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
