"""Token-ID files: an adaptive context-mixing range coder in independent blocks.

A file is a table of segments in ascending order of (part, segment); a segment
holds whole documents: their lengths, then blocks of ``coder.BLOCK`` ids. Every
block is coded on its own, from a reset model (``coder``), with its number of
ids and of distinct ids, the bytes of their list and of its code, and the crc32
of its ids, which the reader compares.

A segment is closed at SEGMENT ids; the texts that are encoded together have at
most about AT_ONCE characters, so only a single larger text makes a larger one.

Defined cases: a null or empty text has the closing id alone; null doc_ids come
first; rows with equal doc_id are in the order of their text's hash; ids are
any below 2**32; extra columns are ignored; an empty table gives an empty file
and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apportion.llm import coder, exchange
from apportion.llm.common import plain, tidy, write_table
from apportion.llm.tokens import default_path, encoder

END = 2
SEGMENT, AT_ONCE = 12 << 20, 2 << 20
#: Bytes of text that a range of documents should have.
PART_BYTES = 28 << 20
MAGIC = b"APTK3\0"
_SEGMENT, _BLOCK = "<6sIQI", "<IIIII"


def write_segment(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    ids = ids.astype("<u4")
    blocks = coder.encode(ids)
    cut = [ids[coder.BLOCK * i : coder.BLOCK * (i + 1)] for i in range(len(blocks))]
    heads = b"".join(struct.pack(_BLOCK, len(own), distinct, len(listed), len(code), zlib.crc32(own)) for own, (distinct, listed, code) in zip(cut, blocks, strict=True))
    head = struct.pack(_SEGMENT, MAGIC, len(lengths), len(ids), len(blocks))
    return head + lengths.astype("<u8").tobytes() + heads + b"".join(x for _, listed, code in blocks for x in (listed, code))


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Document lengths and ids; raises ValueError if the segment is damaged."""
    size = struct.calcsize(_SEGMENT)
    magic, docs, total, n = struct.unpack(_SEGMENT, data[:size])
    if magic != MAGIC:
        raise ValueError("not a token segment")
    lengths = np.frombuffer(data, "<u8", docs, size).astype(np.int64)
    at = size + 8 * docs
    heads = [struct.unpack_from(_BLOCK, data, at + struct.calcsize(_BLOCK) * i) for i in range(n)]
    at += struct.calcsize(_BLOCK) * n
    blocks = []
    for _, distinct, a, b, _ in heads:
        blocks.append((distinct, data[at : at + a], data[at + a : at + a + b]))
        at += a + b
    try:
        ids = coder.decode(blocks, total).astype("<u4", copy=False)
    except (IndexError, ValueError) as e:
        raise ValueError("a block is damaged") from e
    for i, (_, _, _, _, crc) in enumerate(heads):
        if zlib.crc32(ids[coder.BLOCK * i : coder.BLOCK * (i + 1)]) != crc:
            raise ValueError(f"block {i} is damaged")
    return lengths, ids


SEGMENTS = "part int, segment int, doc_ids binary, n_ids long, payload binary"


def write_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the token files of docs, in ascending doc_id, to the shared folder; the table of their segments."""
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def out() -> pd.DataFrame:
            ids = np.concatenate([h[2] for h in held])
            lengths = np.concatenate([h[1] for h in held])
            doc = np.concatenate([h[0] for h in held])
            return pd.DataFrame({"part": np.array([part], "int32"), "segment": np.array([n], "int32"), "doc_ids": [doc.tobytes()], "n_ids": [len(ids)], "payload": [write_segment(lengths, ids)]})

        for _, b in exchange.numbered(batches, most=AT_ONCE):
            ids, lengths = encoder(path).encode(b.text.tolist())
            full = np.full(len(ids) + len(b), END, "<u4")
            full[np.arange(len(ids)) + np.repeat(np.arange(len(b)), lengths)] = ids
            # A null id is written as the least number of 64 bits.
            held.append((b.doc_id.fillna(np.iinfo(np.int64).min).to_numpy("<i8"), lengths + 1, full))
            size += len(full)
            if size >= SEGMENT:
                yield out()
                held, size, n = [], 0, n + 1
        if held:
            yield out()

    d = plain(docs)
    n = max(d.sparkSession.sparkContext.defaultParallelism, -(-exchange.text_bytes(d) // PART_BYTES))
    d = d.repartitionByRange(n, F.col("doc_id")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return write_table(d.mapInPandas(lambda batches: tidy(run(batches)), SEGMENTS), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one number a file
    starts = dict(zip(sorted(totals), np.cumsum([0, *(totals[p] for p in sorted(totals))]).tolist(), strict=False))
    sizes = files.select("part", F.struct("segment", "n_ids").alias("s")).groupBy("part").agg(F.sort_array(F.collect_list("s")).alias("all"))
    placed = files.join(sizes, "part").withColumn("before", F.aggregate(F.filter("all", lambda s: s["segment"] < F.col("segment")), F.lit(0).cast("long"), lambda a, s: a + s["n_ids"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                lengths, ids = read_segment(r.payload)
                ends = np.cumsum(lengths)
                raw = memoryview(ids).cast("B")
                doc = pd.Series(np.frombuffer(r.doc_ids, "<i8")).astype("Int64")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": doc.mask(doc == np.iinfo(np.int64).min), "start": starts[r.part] + r.before + ends - lengths, "n_tokens": lengths, "ids_crc32": np.array(crc, "int64")})

    return placed.select("part", "doc_ids", "payload", "before").mapInPandas(lambda batches: tidy(run(batches)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame) -> DataFrame:
    return read_files(write_files(docs))
