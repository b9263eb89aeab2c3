"""Packing: vector bin packing of token pieces under simultaneous limits.

An item needs tokens, one segment and some loss-bearing tokens; a sequence has
room for LIMITS of each. ``Packer`` fills one sequence at a time: of the items
that fit, the next is the one whose needs, as shares of the limits, have the
greatest dot product with the room that is left. Items of equal needs are one
class, so a choice costs no more than the number of classes. When nothing fits
any more, or one segment is left, the rest of the sequence is filled with the
head of the largest item, which stays with its tail. What remains at a task's
end is cut at powers of two, which need no padding.

In ``pack`` every token bears loss, so the third limit is idle there; counting the
answers' tokens of instruction data is not built, though ``Packer`` has room for it.

Each task packs its own documents, HELD tails at a time, and numbers its
sequences from its partition's number up, so nothing is shuffled and a task that
runs again gives the same rows.

Defined cases: a null or empty text is the closing id alone; a null doc_id stays
null; repeated rows are packed each; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from apportion.llm.common import plain, tidy
from apportion.llm.tokens import default_path, encoder

LENGTH = 1024
#: Tokens, segments and loss-bearing tokens of a sequence.
LIMITS = (LENGTH, 32, LENGTH)
HELD = 4096
END = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Items are (tokens, loss, payload); payload[0] is where in its document the item starts. ``done`` gets (sequence, offset, start, length, payload)."""

    def __init__(self, limits: tuple[int, int, int] = LIMITS):
        self.limits = limits
        self.room = list(limits)
        self.classes: dict[tuple[int, int], list] = defaultdict(list)
        self.done: list[tuple] = []
        self.sequence, self.offset = 0, 0
        self._keys: np.ndarray | None = None
        self.whole = 0  # sequences that one piece fills

    def add(self, tokens: int, loss: int, start: int, payload) -> None:
        key = (tokens, loss)
        if not self.classes[key]:
            self._keys = None
        self.classes[key].append((start, payload))

    def _take(self, key: tuple[int, int]) -> tuple:
        items = self.classes[key]
        item = items.pop()
        if not items:
            del self.classes[key]
            self._keys = None
        return item

    def _place(self, tokens: int, loss: int, start: int, payload) -> None:
        self.done.append((self.sequence, self.offset, start, tokens, payload))
        self.offset += tokens
        for i, need in enumerate((tokens, 1, loss)):
            self.room[i] -= need

    def next_sequence(self) -> None:
        self.sequence, self.offset, self.room = self.sequence + 1, 0, list(self.limits)

    def run(self, keep: int = 0) -> None:
        """Pack until at most ``keep`` items wait."""
        waiting = sum(map(len, self.classes.values()))
        share = np.array([1 / x for x in self.limits])
        while waiting > keep:
            if self._keys is None:
                ks = sorted(self.classes)
                self._keys = np.array([(t, 1, s) for t, s in ks], float)
            needs, room = self._keys, np.array(self.room, float)
            fits = (needs <= room).all(1) if room[1] > 1 else (needs[:, 0] == room[0]) & (needs[:, 2] <= room[2])
            if fits.any():
                score = (needs * share) @ (room * share)
                score[~fits] = -1
                t, _, s = self._keys[int(score.argmax())].astype(int).tolist()
                self._place(t, s, *self._take((t, s)))
                waiting -= 1
            elif room[1] >= 1 and room[0] > 0 and needs[:, 0].max() > room[0]:
                t, _, s = self._keys[int(needs[:, 0].argmax())].astype(int).tolist()
                start, payload = self._take((t, s))
                cut = int(room[0])
                lost = -(-s * cut // t)
                if lost > room[2]:  # the loss is used up: pad
                    self.add(t, s, start, payload)
                    self.next_sequence()
                    continue
                self._place(cut, lost, start, payload)
                self.add(t - cut, s - lost, start + cut, payload)
            else:
                self.next_sequence()
                continue
            if not self.room[0]:
                self.next_sequence()

    def close(self) -> None:
        """Pack what waits, and cut an unfilled last sequence at powers of two."""
        self.run()
        if self.offset == 0:
            return
        last = [d for d in self.done if d[0] == self.sequence]
        self.done = [d for d in self.done if d[0] != self.sequence]
        total = self.offset
        parts = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
        ends = np.cumsum(parts)
        for _, offset, start, tokens, payload in last:
            while tokens:
                i = int(np.searchsorted(ends, offset, "right"))
                n = min(tokens, int(ends[i]) - offset)
                self.done.append((self.sequence + i, offset - int(ends[i]) + parts[i], start, n, payload))
                offset, start, tokens = offset + n, start + n, tokens - n
        self.sequence += len(parts) - 1
        self.next_sequence()


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece (PIECES)."""
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        packer = Packer()

        def out() -> pd.DataFrame:
            ready = [d for d in packer.done if d[0] < packer.sequence]
            packer.done = [d for d in packer.done if d[0] >= packer.sequence]
            rows = [(doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) >> 2, base + seq, offset) for seq, offset, start, n, (doc, ids) in ready]
            return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})

        for batch in batches:
            for i in range(0, len(batch), 2000):
                part = batch.iloc[i : i + 2000]
                ids, counts = encoder(path).encode(part.text.tolist())
                raw, ends = ids.tobytes(), np.cumsum(counts)
                rows = []
                for doc, e, n in zip(part.doc_id, ends, counts, strict=True):
                    own = raw[4 * (e - n) : 4 * e] + END.to_bytes(4, "little")
                    doc = None if pd.isna(doc) else int(doc)
                    full = (int(n) + 1) // LENGTH
                    for k in range(full):
                        rows.append((doc, k * LENGTH, LENGTH, zlib.crc32(own[4 * k * LENGTH : 4 * (k + 1) * LENGTH]), int(n) + 1, base + (1 << 39) + packer.whole, 0))
                        packer.whole += 1
                    tail = int(n) + 1 - full * LENGTH
                    if tail:
                        packer.add(tail, tail, full * LENGTH, (doc, own))
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})
                packer.run(keep=HELD)
                yield out()
        packer.close()
        yield out()

    return plain(docs).mapInPandas(lambda batches: tidy(run(batches)), PIECES)

