"""Windows of symbols that occur more than once in a corpus: what substring dedup and suffix-array dedup share.

A text is a sequence of symbols (bytes, or hashed words); a window is WINDOW of
them. Not every suffix is moved. Each window's anchors are the positions of its
GRAM-symbol grams with the least hash, so equal windows have equal anchors at
equal places, and about 2 / (WINDOW - GRAM + 2) of the positions are anchors.
Three steps then lose no repeated window:

1. Anchors whose gram is found nowhere else (``exchange``) are done with.
2. Each other anchor sends its context: the suffix of WINDOW symbols from the
   anchor on, then the symbols before it, backwards. Equal contexts of a chunk
   go once. A bucket's task puts the contexts in order of their suffixes; runs of
   neighbours that share at least d symbols are the nodes of depth d of the tree
   of these suffixes. The window that starts ``a`` symbols before an anchor is
   given by the node of depth WINDOW - a and the ``a`` symbols before. How contexts
   are put in order is the operators' own part (``order``).
3. The task answers each context with the least and the greatest such ``a`` that
   is repeated. All windows around an anchor overlap in it, so what they cover
   is one stretch.

Chunks, the values that decide and the answers are rows of fixed-size parts; no
row holds all places of a passage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from apportion.llm import exchange, seq
from apportion.llm.common import homes, plain, tidy, write_bucketed, write_table

U = np.uint64
_NEVER = U(0xFFFFFFFFFFFFFFFF)
NULL_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Spec:
    """What is searched. smaller: a window counts if a document with a smaller id has it; else if it starts anywhere else."""

    window: int
    gram: int
    words: bool
    smaller: bool
    order: Callable

    @property
    def before(self) -> int:
        return self.window - self.gram

    @property
    def kind(self) -> np.dtype:
        return np.dtype(">u8" if self.words else "u1")

    @property
    def width(self) -> int:
        return (self.window + self.before) * self.kind.itemsize + 2


@dataclass
class Chunk:
    """A chunk's texts as symbols: begin and end of each text, and for words their place in ``data``."""

    ids: np.ndarray
    null: np.ndarray
    texts: list[bytes]
    symbols: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    data: np.ndarray | None = None


def _open(row, spec: Spec) -> Chunk:
    ids = np.frombuffer(row.ids, "<i8")
    null = np.unpackbits(np.frombuffer(row.nulls, np.uint8))[: len(ids)].astype(bool)
    lens = np.frombuffer(row.lens, "<i8")
    data = zstandard.ZstdDecompressor().decompress(row.payload)
    at = np.cumsum(lens) - lens
    texts = [data[i : i + n] for i, n in zip(at, lens, strict=True)]
    if not spec.words:
        return Chunk(ids, null, texts, np.frombuffer(data, np.uint8), at, at + lens)
    b, s, e, owner, hashes = seq.batch_words(texts)
    n = np.bincount(owner, minlength=len(texts))
    last = np.cumsum(n)
    return Chunk(ids, null, texts, hashes, last - n, last, s, e, b)


def _slide(x: np.ndarray, m: int, f: np.ufunc) -> np.ndarray:
    """f over each m neighbours: len(x) - m + 1 results, by doubling."""
    done = 1
    while done * 2 <= m:
        x = f(x[:-done], x[done:])
        done *= 2
    return f(x[: len(x) - (m - done)], x[m - done :]) if m > done else x


#: Positions whose anchors are looked for at once.
_AT_ONCE = 1 << 17


def anchors(c: Chunk, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors and the hashes of their grams."""
    n = len(c.symbols)
    parts = [_anchors(c, spec, lo, min(n, lo + _AT_ONCE)) for lo in range(0, n, _AT_ONCE)] if n >= spec.window else []
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _anchors(c: Chunk, spec: Spec, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Those in lo .. hi - 1, from the symbols that windows around them reach."""
    m = spec.before + 1
    a, b = max(0, lo - m + 1), min(len(c.symbols), hi + m + spec.gram)
    grams = seq.gram_hashes(c.symbols[a:b], spec.gram)
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, U)
    np.minimum(grams, _NEVER - U(1), out=grams)
    i, j = np.searchsorted(c.end, a, "right"), np.searchsorted(c.begin, b, "left")
    left = np.repeat(c.end[i:j], np.clip(c.end[i:j], a, b) - np.clip(c.begin[i:j], a, b)) - np.arange(a, b)  # symbols from here to the text's end
    grams[left[: len(grams)] < spec.gram] = _NEVER
    if len(grams) < m:
        grams = np.concatenate((grams, np.full(m - len(grams), _NEVER)))
    low = _slide(grams, m, np.minimum)
    low[left[: len(low)] < spec.window] = 0  # no window starts here
    pad = np.zeros(m - 1, U)
    high = _slide(np.concatenate((pad, low, pad)), m, np.maximum)
    at = np.flatnonzero((high == grams) & (grams != _NEVER))
    at = at[(at + a >= lo) & (at + a < hi)]
    return at + a, grams[at]


def _contexts(c: Chunk, at: np.ndarray, spec: Spec) -> np.ndarray:
    """A row of bytes per anchor: the suffix, the symbols before it backwards, and how many of either there are."""
    text = np.searchsorted(c.end, at, "right")
    la = np.minimum(at - c.begin[text], spec.before)
    ra = np.minimum(c.end[text] - at, spec.window)
    cols = np.concatenate((np.arange(spec.window), -1 - np.arange(spec.before)))
    wide = c.symbols[np.clip(at[:, None] + cols, 0, len(c.symbols) - 1)].astype(spec.kind)
    inside = np.concatenate((np.arange(spec.window)[None, :] < ra[:, None], np.arange(spec.before)[None, :] < la[:, None]), axis=1)
    wide[~inside] = 0
    out = np.empty((len(at), spec.width), np.uint8)
    out[:, :-2] = wide.view(np.uint8).reshape(len(at), -1)
    out[:, -2], out[:, -1] = la, ra
    return out


def front_code(rows: np.ndarray) -> bytes:
    """Sorted rows of bytes: for each the length of the prefix that it shares with the one before, then the rest; compressed."""
    if not len(rows):
        return b""
    differ = rows[1:] != rows[:-1]
    shared = np.concatenate(([0], np.where(differ.any(1), differ.argmax(1), rows.shape[1]))).astype("<u2")
    rest = rows[np.arange(rows.shape[1])[None, :] >= shared[:, None]]
    return zstandard.ZstdCompressor(level=1).compress(shared.tobytes() + rest.tobytes())


def front_decode(blob: bytes, n: int, width: int, out: np.ndarray | None = None, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows, and the lengths that each shares with the one before; filled into ``out`` and ``shared`` if given."""
    out = np.empty((n, width), np.uint8) if out is None else out
    shared = np.empty(n, np.int64) if shared is None else shared
    if not n:
        return out, shared
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    shared[:] = raw[: 2 * n].view("<u2")
    at = 2 * n
    for i, k in enumerate(shared.tolist()):
        out[i, :k] = out[i - 1, :k]
        out[i, k:] = raw[at : at + width - k]
        at += width - k
    return out, shared


#: An anchor's place in its chunk, its context's number, and whether the chunk alone tells that all its windows are repeated.
PLACE = np.dtype([("at", "<u4"), ("context", "<u4"), ("full", "?")])
CHUNKS = "chunk long, ids binary, nulls binary, lens binary, payload binary"
ANSWERS = "chunk long, bucket int, mask binary"


def chunked(docs: DataFrame, homes: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3)
        for chunk, b in exchange.numbered(batches, most=1 << 20, homes=homes):
            texts = [t.encode() for t in b.text]
            null = b.doc_id.isna().to_numpy()
            ids = np.where(null, NULL_ID, b.doc_id.fillna(0)).astype("<i8")
            yield pd.DataFrame({"chunk": [chunk], "ids": [ids.tobytes()], "nulls": [np.packbits(null).tobytes()], "lens": [np.array([len(t) for t in texts], "<i8").tobytes()], "payload": [pack.compress(b"".join(texts))]})

    return plain(docs).mapInPandas(lambda batches: tidy(run(batches)), CHUNKS)


def _void(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel()


def _pick(row, answers: pd.DataFrame, spec: Spec, bits: int) -> pd.DataFrame:
    """The anchors that may be repeated: their places (bucket -1), and for each bucket a run of their distinct contexts."""
    c = _open(row, spec)
    at, grams = anchors(c, spec)
    values, where, count = np.unique(grams, return_inverse=True, return_counts=True)
    hit = (exchange.shared(values, bits, answers) | (count > 1))[where]
    at, bucket = at[hit], (grams[hit] >> U(64 - bits)).astype(np.int64)
    rows, places = [], np.zeros(len(at), PLACE)
    order = np.argsort(bucket, kind="stable")
    at, bucket = at[order], bucket[order]
    text = np.searchsorted(c.end, at, "right")
    ids = c.ids[text]
    done = 0
    for b, i, j in zip(*_ranges(bucket), strict=True):
        ctx = _contexts(c, at[i:j], spec)
        _, one, back, n = np.unique(_void(ctx), return_index=True, return_inverse=True, return_counts=True)
        if spec.smaller:
            weight = np.full(len(one), NULL_ID, "<i8")
            np.minimum.at(weight, back, ids[i:j])
        else:
            weight = n.astype("<i8")
        places["at"][i:j], places["context"][i:j] = at[i:j], done + back
        places["full"][i:j] = ids[i:j] > weight[back] if spec.smaller else weight[back] > 1
        rows.append((int(b), front_code(ctx[one]), weight.tobytes()))
        done += len(one)
    rows.append((-1, places.tobytes(), b""))
    return pd.DataFrame({"chunk": np.int64(row.chunk), "bucket": np.array([r[0] for r in rows], "int32"), "run": [r[1] for r in rows], "weight": [r[2] for r in rows]})


def _ranges(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, first, count = np.unique(sorted_keys, return_index=True, return_counts=True)
    return keys, first, first + count


def _symbol(ctx: np.ndarray, j: int, spec: Spec) -> np.ndarray:
    """The j-th symbol of each context."""
    size = spec.kind.itemsize
    return np.ascontiguousarray(ctx[:, j * size : (j + 1) * size]).view(spec.kind).ravel().astype(U)


def nodes_of(ctx: np.ndarray, shared: np.ndarray, weight: np.ndarray, spec: Spec) -> Iterator[tuple[int, np.ndarray]]:
    """For distinct contexts in order, with the prefix each shares with the one before: each ``a`` with the weights (least id, or number of places) of the contexts' windows that start ``a`` before the anchor."""
    depth = np.minimum(shared // spec.kind.itemsize, spec.window)
    la, ra = ctx[:, -2].astype(np.int64), ctx[:, -1].astype(np.int64)
    back = np.zeros(len(ctx), U)
    for a in range(spec.before + 1):
        if a:
            back = seq.mix(back * U(0x9E3779B97F4A7C15) + _symbol(ctx, spec.window + a - 1, spec) + U(1))
        fits = np.flatnonzero((la >= a) & (ra >= spec.window - a))
        if not len(fits):
            continue
        node = np.cumsum(depth < spec.window - a)[fits]
        key = seq.mix(seq.mix(back[fits]) * U(0xD1342543DE82EF95) + node.astype(U))
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        total = (np.minimum if spec.smaller else np.add).reduceat(weight[fits[order]], first)
        out = np.full(len(ctx), NULL_ID if spec.smaller else 0, np.int64)
        out[fits[order]] = np.repeat(total, np.diff(np.append(first, len(order))))
        yield a, out


def window_keys(ctx: np.ndarray, least: int, spec: Spec) -> np.ndarray:
    """For each context and each ``a`` from ``least`` on, a hash of the window that starts ``a`` before the anchor."""
    keys = np.empty((len(ctx), spec.before + 1 - least), U)
    back, ahead = np.zeros(len(ctx), U), np.zeros(len(ctx), U)
    for a in range(spec.before + 1):
        if a:
            back = seq.mix(back * U(0x9E3779B97F4A7C15) + _symbol(ctx, spec.window + a - 1, spec) + U(1))
        if a >= least:
            keys[:, a - least] = back
    for depth in range(1, spec.window - least + 1):
        ahead = seq.mix(ahead * U(0x9E3779B97F4A7C15) + _symbol(ctx, depth - 1, spec) + U(1))
        if depth >= spec.gram:
            i = spec.window - depth - least
            keys[:, i] = seq.mix(seq.mix(keys[:, i]) * U(0xD1342543DE82EF95) + ahead)
    return keys


def _across(rows: np.ndarray, weights: np.ndarray, parted: np.ndarray, found: np.ndarray, spec: Spec) -> None:
    """Add to ``found`` the windows of nodes that lie in several groups of contexts: those of depths under ``parted``."""
    picked = np.flatnonzero(parted)
    if not len(picked):
        return
    depth, own, got = parted[picked].astype(np.int64), weights[picked], found[picked]
    least = spec.window - int(depth.max()) + 1
    ctx = rows[picked]
    keys = window_keys(ctx, least, spec)
    la, ra = ctx[:, -2].astype(np.int64), ctx[:, -1].astype(np.int64)
    for a in range(least, spec.before + 1):
        fits = np.flatnonzero((la >= a) & (ra >= spec.window - a) & (depth > spec.window - a))
        if not len(fits):
            continue
        order = fits[np.argsort(keys[fits, a - least], kind="stable")]
        key = keys[order, a - least]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        total = np.repeat((np.minimum if spec.smaller else np.add).reduceat(own[order], first), np.diff(np.append(first, len(order))))
        ok = order[(total < own[order]) if spec.smaller else (total > 1)]
        got[ok, 0] = np.where(got[ok, 1] < 0, a, np.minimum(got[ok, 0], a))
        got[ok, 1] = np.maximum(got[ok, 1], a)
    found[picked] = got


def _answer(pdf: pd.DataFrame, spec: Spec) -> pd.DataFrame:
    """The runs of a bucket to, for each context of each run, the least and the greatest ``a`` (greatest -1: none)."""
    sizes = [len(w) // 8 for w in pdf.weight]
    ends = np.cumsum(sizes, dtype=np.int64)
    weights = np.frombuffer(b"".join(pdf.weight), "<i8")
    rows, prefix = np.empty((len(weights), spec.width), np.uint8), np.empty(len(weights), np.int64)
    for r, e, n in zip(pdf.run, ends.tolist(), sizes, strict=True):
        front_decode(r, n, spec.width, rows[e - n : e], prefix[e - n : e])
    found, parted = np.zeros((len(weights), 2), np.int8), np.zeros(len(weights), np.int8)
    found[:, 1] = -1
    for ctx, shared, at, *depth in spec.order(rows, prefix, ends, spec):
        # ctx: in order, repeated where several runs have it; at: their rows; depth: nodes under it lie in other groups too.
        new = shared < spec.width
        new[0] = True
        which, own, first = np.cumsum(new) - 1, weights[at], np.flatnonzero(new)
        total = (np.minimum if spec.smaller else np.add).reduceat(own, first)
        lo, hi = np.zeros(len(ctx), np.int8), np.full(len(ctx), -1, np.int8)
        for a, w in nodes_of(ctx[first], shared[first], total, spec):
            ok = (w[which] < own) if spec.smaller else (w > 1)[which]
            lo[ok & (hi < 0)] = a
            hi[ok] = a
        found[at, 0], found[at, 1] = lo, hi
        if depth:
            parted[at] = depth[0]
    _across(rows, weights, parted, found, spec)
    return pd.DataFrame({"chunk": pdf.chunk, "bucket": pdf.bucket, "mask": [found[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes, strict=True)]})


def _covered(row, places: bytes, answers: pd.DataFrame, spec: Spec) -> tuple[Chunk, np.ndarray]:
    """Which symbols of a chunk lie in a repeated window."""
    c = _open(row, spec)
    p = np.frombuffer(places, PLACE)
    edge = np.zeros(len(c.symbols) + 1, np.int64)
    if len(p):
        got = np.concatenate([np.frombuffer(m, "i1").reshape(-1, 2) for m in answers.sort_values("bucket")["mask"]]).astype(np.int64)
        at, lo, hi = p["at"].astype(np.int64), got[p["context"], 0], got[p["context"], 1]
        text = np.searchsorted(c.end, at, "right")
        la, ra = np.minimum(at - c.begin[text], spec.before), np.minimum(c.end[text] - at, spec.window)
        full = p["full"]
        lo, hi = np.where(full, np.maximum(0, spec.window - ra), lo), np.where(full, la, hi)
        ok = hi >= lo
        np.add.at(edge, at[ok] - hi[ok], 1)
        np.add.at(edge, at[ok] - lo[ok] + spec.window, -1)
    return c, np.cumsum(edge[:-1]) > 0


def repeated(docs: DataFrame, spec: Spec, report: Callable, schema: str) -> DataFrame:
    """Each chunk's ``report(chunk, covered)``, a pandas frame of the schema."""
    n = homes(docs.sparkSession)
    chunks = write_bucketed(chunked(docs, n), "chunks", n)
    bits = exchange.bucket_bits(exchange_bytes(chunks))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                v = np.unique(anchors(_open(row, spec), spec)[1])
                if len(v):
                    yield exchange.runs(row.chunk, v, bits)

    masks = exchange.masks(chunks.mapInPandas(lambda batches: tidy(send(batches)), exchange.RUN))

    def pick(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_pick(row, right, spec, bits) for row in left.itertuples()]) if len(left) else pd.DataFrame({"chunk": [], "bucket": [], "run": [], "weight": []})

    runs = write_table(chunks.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInPandas(pick, "chunk long, bucket int, run binary, weight binary"), "runs")
    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        return next(tidy(iter([_answer(pdf, spec)])))

    answers = runs.filter("bucket >= 0").groupBy("bucket").applyInPandas(answer, ANSWERS)
    answers = answers.union(runs.filter("bucket < 0").select("chunk", "bucket", "run"))

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([report(*_covered(row, b"".join(right["mask"][right.bucket < 0]), right[right.bucket >= 0], spec)) for row in left.itertuples()])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(finish, schema)


def exchange_bytes(chunks: DataFrame) -> int:
    """About the bytes that the anchors' runs take: four for each sixteenth of the (compressed) text, times the usual compression."""
    from pyspark.sql import functions as F

    return (chunks.agg(F.sum(F.octet_length("payload"))).first()[0] or 0) * 3 // 4
