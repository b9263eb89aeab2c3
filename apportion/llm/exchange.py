"""Which 64-bit values of a chunk of documents are also found elsewhere?

A chunk is one row that holds some documents. Its distinct values go out as
runs: for each bucket (the upper bits of the value) one row with the next 32
bits of its values, sorted, four bytes each. A bucket's task merges the runs
and sends every run a bit mask back: set where another run, or the run itself
more than once, has the value. 32 bits within a bucket may agree by chance, so
a set bit is a candidate, a clear one is certain. A value comes at most once a
chunk, so no group of copies is larger than the number of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of runs that a bucket's task should meet.
BUCKET_BYTES = 4 << 20
LEAST_BITS, MOST_BITS = 8, 30

RUN = "bucket int, chunk long, run binary"
MASK = "chunk long, bucket int, mask binary"


def bucket_bits(run_bytes: float) -> int:
    """Bits of the bucket number for so many bytes of runs in all."""
    return min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1.0, run_bytes / BUCKET_BYTES))))))


def runs(chunk: int, values: np.ndarray, bits: int) -> pd.DataFrame:
    """values: sorted and distinct."""
    buckets, first = np.unique(values >> np.uint64(64 - bits), return_index=True)
    low = ((values >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
    ends = [*first[1:], len(values)]
    return pd.DataFrame({"bucket": buckets.astype("int32"), "chunk": np.int64(chunk), "run": [low[i:j].tobytes() for i, j in zip(first, ends, strict=True)]})


def masks(found: DataFrame) -> DataFrame:
    """RUN rows to MASK rows."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(r, "<u4") for r in pdf.run]
        every = np.concatenate(parts)
        _, where, count = np.unique(every, return_inverse=True, return_counts=True)
        twice = count[where] > 1
        ends = np.cumsum([len(p) for p in parts])
        return pd.DataFrame({"chunk": pdf.chunk, "bucket": pdf.bucket, "mask": [np.packbits(twice[e - len(p) : e]).tobytes() for e, p in zip(ends, parts, strict=True)]})

    return found.groupBy("bucket").applyInPandas(meet, MASK)


def shared(values: np.ndarray, bits: int, answers: pd.DataFrame) -> np.ndarray:
    """Which of a chunk's values (sorted, distinct, as given to ``runs``) have their bit set."""
    out = np.zeros(len(values), bool)
    buckets = (values >> np.uint64(64 - bits)).astype(np.int64)
    for b, mask in zip(answers.bucket, answers["mask"], strict=True):
        i, j = np.searchsorted(buckets, [b, b + 1])
        out[i:j] = np.unpackbits(np.frombuffer(mask, np.uint8))[: j - i].astype(bool)
    return out


def bucket_of(numbers: np.ndarray, n: int) -> np.ndarray:
    """The bucket of n that Spark gives to long values (its 32-bit Murmur hash, seed 42)."""
    u = np.uint32

    def turn(x: np.ndarray, k: int) -> np.ndarray:
        return (x << u(k)) | (x >> u(32 - k))

    v = numbers.astype(np.int64).view(np.uint64)
    h = np.full(len(v), 42, u)
    with np.errstate(over="ignore"):
        for part in (v & np.uint64(0xFFFFFFFF), v >> np.uint64(32)):
            k = turn(part.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593)
            h = turn(h ^ k, 13) * u(5) + u(0xE6546B64)
        h ^= u(8)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ (h >> u(shift))) * u(factor)
    return h.view(np.int32).astype(np.int64) % n


def numbers(part: int, homes: int) -> Iterator[int]:
    """Chunk numbers of a task, the same whenever it runs again; with ``homes`` buckets all of them belong to one."""
    if homes < 2:
        yield from range(part << 32, part + 1 << 32)
    for first in range(part << 32, part + 1 << 32, 1 << 14):
        at = np.arange(first, first + (1 << 14))
        yield from at[bucket_of(at, homes) == part % homes].tolist()


def numbered(batches: Iterator[pd.DataFrame], texts: str = "text", most: int = 1 << 21, homes: int = 0) -> Iterator[tuple[int, pd.DataFrame]]:
    """Batches cut into chunks of about ``most`` characters, each with its number."""
    from pyspark import TaskContext

    number = numbers(TaskContext.get().partitionId(), homes)
    held, size = [], 0
    for batch in batches:
        lengths = batch[texts].str.len().to_numpy()
        at = 0
        while at < len(batch):
            fit = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), most - size, "right")))
            held.append(batch.iloc[at : at + fit])
            size += int(lengths[at : at + fit].sum())
            at += fit
            if size >= most or at < len(batch):
                yield next(number), pd.concat(held, ignore_index=True)
                held, size = [], 0
    if held:
        yield next(number), pd.concat(held, ignore_index=True)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
