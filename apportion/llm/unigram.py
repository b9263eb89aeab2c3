"""SentencePiece encoding and decoding as a max-plus parallel scan.

The pieces of a SentencePiece model are read as a unigram model: a text's
encoding is the segmentation whose pieces' scores have the greatest sum (of
equals, the one whose last pieces are longest). The installed model file is of
the pair-merging kind and its scores are merge ranks, so a piece of rank r has
the score -round(100 * ln(r + 2)), the code length of its place under Zipf's law;
``model_proto`` gives the same model to the sentencepiece library. So the ids are
those of that unigram model, not those of the file's own pair merging, which is
no sum of scores; both decode to the same text.

In this algebra (max, +) a stretch of text is a transfer matrix from the state at
its start to the state at its end; the state is how many characters of the
stretch a piece that crosses the border has taken already. Texts of more than
CHUNK characters are cut anywhere into chunks; each chunk's matrix is worked out
on its own, the matrices are combined associatively (``scan``), which gives the
scores of the states before each chunk; from these each chunk works out, on its
own, which state at its start each state at its end comes from, those maps are
followed from the text's end, and each chunk is then traced back on its own. Within a
stretch, a blank after another character always starts a piece, and so does a
mark that no piece has after a letter, which the vocabulary is checked for; so
units between them are encoded apart (``units``), repeated ones once, and new
ones together: their best segmentations advance by one character a step.
Pieces are looked up by 64-bit hashes there.

As in the library: a blank is U+2581, a text that is not empty gets one in
front, and a character without a piece becomes its bytes.

Defined cases: a null or empty text has no tokens; a null doc_id stays null;
U+2581 itself decodes to a blank, as in the library; repeated rows are
encoded each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apportion.llm import exchange, units
from apportion.llm.common import plain, write_table
from apportion.llm.seq import mix, ragged

CHUNK = 1 << 15
BLANK = "▁"
NEVER = -(1 << 60)
U = np.uint64
#: Characters of new units that are segmented together, and slots of the table of pieces.
AT_ONCE, _SLOTS = 1 << 18, 1 << 18
_NONE = -(1 << 30)
_LETTERS = string.ascii_letters


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model_proto(path: str):
    """The model file as a unigram model with the scores used here."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    rank = 0
    for p in m.pieces:
        if p.type == 1:
            p.score = -round(100 * math.log(rank + 2))
            rank += 1
    m.trainer_spec.model_type = 1
    return m


class Unigram:
    """Texts here have a plain blank for U+2581."""

    def __init__(self, path: str):
        m = model_proto(path)
        self.score = {p.piece.replace(BLANK, " "): int(p.score) for p in m.pieces if p.type == 1}
        self.id = {p.piece.replace(BLANK, " "): i for i, p in enumerate(m.pieces) if p.type == 1}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.longest = max(map(len, self.score))
        self.unknown = min(self.score.values()) - 10
        if any(" " in p.lstrip(" ") for p in self.score):
            raise ValueError("a piece has a blank after another character")
        back = [b""] * len(m.pieces)
        for p, i in self.id.items():
            back[i] = p.encode()
        for b, i in self.byte.items():
            back[i] = bytes([b])
        self.width = np.array([len(x) for x in back])
        self.at = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(back), np.uint8)
        self.of_byte = np.array([self.byte[b] for b in range(256)], np.uint32)
        # A unit also ends between a letter and a mark that no piece has after a letter.
        joined = {y for p in self.score for x, y in zip(p, p[1:], strict=False) if x in _LETTERS}
        marks = bytes(c for c in range(33, 127) if chr(c) not in _LETTERS and chr(c) not in joined)
        self.kinds = units.table(b" ", _LETTERS.encode(), marks)
        self._hash_pieces()
        self.units = units.Units(self._learn)

    def _hash_pieces(self) -> None:
        self.keys, self.piece = np.zeros(_SLOTS, U), np.zeros(_SLOTS, np.int64)
        by_length: dict[int, list[str]] = {}
        for p in self.id:
            by_length.setdefault(len(p), []).append(p)
        for n, ps in by_length.items():
            codes = np.frombuffer("".join(ps).encode("utf-32-le"), "<u4").reshape(len(ps), n)
            h = np.zeros(len(ps), U)
            for k in range(n):
                h = _step(h, codes[:, k])
            for key, p in zip(_key(h, n).tolist(), ps, strict=True):
                at = key & (_SLOTS - 1)
                while self.keys[at]:
                    at = (at + 1) & (_SLOTS - 1)
                self.keys[at], self.piece[at] = key, self.id[p]
        self.scores = np.full(len(self.width), _NONE, np.int64)
        for p, i in self.id.items():
            self.scores[i] = self.score[p]

    def _pieces(self, h: np.ndarray, n: int) -> np.ndarray:
        """The ids of the pieces of n characters with the hashes h; -1 for none."""
        key = _key(h, n)
        out = np.full(len(h), -1, np.int64)
        todo, at = np.arange(len(h)), (key & U(_SLOTS - 1)).astype(np.int64)
        while len(todo):
            got = self.keys[at]
            same = got == key[todo]
            out[todo[same]] = self.piece[at[same]]
            on = (got != 0) & ~same
            todo, at = todo[on], (at[on] + 1) & (_SLOTS - 1)
        return out

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [u.decode() for u in new]
        n = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-n, kind="stable")
        ids, counts, scores = [], np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        ends = np.cumsum(n[order])
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            own = order[at:to]
            got, counts[own], scores[own] = self._segment([texts[i] for i in own.tolist()], n[own])
            ids.append(got)
            at = to
        flat, by = np.concatenate(ids), counts[order]
        first = np.zeros(len(new), np.int64)
        first[order] = np.cumsum(by) - by
        return flat[ragged(first, counts)], counts, scores

    def _segment(self, texts: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best segmentations of texts in descending order of length: all ids, their numbers, the scores. All texts advance together."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        first, most = np.cumsum(n) - n, min(self.longest, int(n[0]))
        left = np.repeat(first + n, n) - np.arange(len(codes))
        # piece[i, most - l]: the piece of l characters that starts at i.
        piece = np.full((len(codes), most), -1, np.int32)
        h, rows = np.zeros(len(codes), U), np.arange(len(codes))
        for length in range(1, most + 1):
            keep = left[rows] >= length
            rows, h = rows[keep], h[keep]
            h = _step(h, codes[rows + length - 1])
            piece[rows, most - length] = self._pieces(h, length)
        score = np.where(piece >= 0, self.scores[piece], _NONE)
        score[:, most - 1] = np.maximum(score[:, most - 1], self.unknown)
        best = np.full(len(codes) + len(n), _NONE, np.int64)
        came = np.zeros(len(codes) + len(n), np.int32)
        base = first + np.arange(len(n))
        best[base] = 0
        for j in range(1, int(n[0]) + 1):
            m = int(np.searchsorted(-n, -j, "right"))
            some = min(most, j)
            lengths = np.arange(some, 0, -1)  # of equals the longest
            got = best[base[:m, None] + j - lengths] + score[first[:m, None] + j - lengths, most - lengths]
            one = got.argmax(1)
            best[base[:m] + j], came[base[:m] + j] = got[np.arange(m), one], lengths[one]
        # Back from the ends, one piece of every text at a time.
        at, live, steps = n.copy(), np.arange(len(n)), []
        while len(live):
            length = came[base[live] + at[live]].astype(np.int64)
            at[live] -= length
            begin = first[live] + at[live]
            steps.append((live, begin, length, piece[begin, most - length]))
            live = live[at[live] > 0]
        owner, begin, length, got = (np.concatenate([x[k] for x in steps]) for k in range(4))
        by = np.lexsort((begin, owner))
        owner, begin, got = owner[by], begin[by], got[by].astype(np.int64)
        width = np.ones(len(got), np.int64)
        lost = np.flatnonzero(got < 0)
        if len(lost):  # characters without a piece, as bytes
            c = codes[begin[lost]]
            width[lost] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        ids = np.repeat(got, width).astype(np.uint32)
        if len(lost):
            raw = codes[begin[lost]].astype("<u4").tobytes().decode("utf-32-le").encode()
            ids[ragged((np.cumsum(width) - width)[lost], width[lost])] = self.of_byte[np.frombuffer(raw, np.uint8)]
        return ids, np.bincount(owner, width, len(n)).astype(np.int64), best[base + n]

    def segment(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts whose borders are borders of units: all ids, the number of ids and the score of each text."""
        n = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(n)
        b = np.frombuffer(b"".join(raw), np.uint8)
        starts = units.cuts(b, (ends - n)[n > 0], self.kinds)
        ids, size, score = self.units.look(b, starts, np.append(starts[1:], len(b))[: len(starts)])
        i, j = np.searchsorted(starts, ends - n), np.searchsorted(starts, ends)
        sums = [np.concatenate(([0], np.cumsum(x))) for x in (size, score)]
        return ids, sums[0][j] - sums[0][i], sums[1][j] - sums[1][i]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        return self.bytes[ragged(self.at[ids], self.width[ids])]

    def _forward(self, text: str, starts: dict[int, int], stop: int) -> tuple[list[int], list[int]]:
        """Best score of each position of text, from starts (position -> score), by pieces that start before ``stop``; where the last piece began."""
        n = len(text)
        best, came = [NEVER] * (n + 1), [-1] * (n + 1)
        for i, s in starts.items():
            best[i] = s
        score, longest, unknown = self.score.get, self.longest, self.unknown
        for i in range(min(stop, n)):
            b = best[i]
            if b == NEVER:
                continue
            for j in range(i + 1, min(n, i + longest) + 1):
                s = score(text[i:j])
                if s is None:
                    if j > i + 1:
                        continue
                    s = unknown
                if b + s > best[j]:
                    best[j], came[j] = b + s, i
        return best, came

    def _ids(self, piece: str) -> list[int]:
        got = self.id.get(piece)
        return [got] if got is not None else [self.byte[b] for b in piece.encode()]

    def matrix(self, text: str, n: int) -> np.ndarray:
        """The transfer matrix of the first n characters; the rest of text is what follows them, ``longest - 1`` characters at most."""
        k = self.longest
        out = np.full((k, k), NEVER, np.int64)
        head, tail = _borders(text, n)
        if head < 0:
            for d in range(min(k, n + 1)):
                out[d] = self._last(text, {d: 0}, n)
            for d in range(n + 1, k):  # a piece that covers the whole chunk
                out[d, d - n] = 0
            return out
        middle = int(self.segment([text[head:tail].encode()])[2][0]) if tail > head else 0
        last = self._last(text[tail:], {0: 0}, n - tail)
        for d in range(min(k, head + 1)):
            s = self._forward(text[:head], {d: 0}, head)[0][head]
            if s > NEVER:
                out[d] = np.where(last > NEVER, s + middle + last, NEVER)
        return out

    def _last(self, text: str, starts: dict[int, int], n: int) -> np.ndarray:
        """Scores of the states at the end of n characters."""
        out = np.full(self.longest, NEVER, np.int64)
        best, _ = self._forward(text, starts, n)
        for e in range(min(self.longest, len(text) - n + 1)):
            out[e] = best[n + e]
        return out

    def _back(self, text: str, vec: np.ndarray, end: int) -> tuple[int, list[int]]:
        """The best path to ``end`` from the states at the start, whose scores are vec: the state it comes from, and its ids."""
        starts = {d: int(v) for d, v in enumerate(vec) if v > NEVER and d <= end}
        _, came = self._forward(text[:end], starts, end)
        pieces = []
        while came[end] >= 0:
            pieces.append(text[came[end] : end])
            end = came[end]
        return end, [i for p in reversed(pieces) for i in self._ids(p)]

    def sources(self, text: str, n: int, vec: np.ndarray) -> np.ndarray:
        """For each state at the chunk's end, the state at its start from which the best path comes (-1: none)."""
        out = np.full(self.longest, -1, np.int64)
        cut = _START.search(text, 0, n)
        if cut and cut.start() + 1 < n:
            out[:] = self._back(text, vec, cut.start() + 1)[0]
            return out
        for e in range(min(self.longest, len(text) - n + 1)):
            # Only pieces that start in the chunk; a state that passes over the whole chunk stays itself, less the chunk.
            starts = {d: int(v) for d, v in enumerate(vec) if v > NEVER and d <= n + e}
            _, came = self._forward(text[: n + e], starts, n)
            at = n + e
            while came[at] >= 0:
                at = came[at]
            out[e] = at
        return out

    def trace(self, text: str, n: int, vec: np.ndarray, d_out: int) -> np.ndarray:
        """The ids of the pieces that start in the chunk, given the scores of the states before it and the state after it."""
        head, tail = _borders(text, n)
        end = n + d_out
        if head < 0:
            return np.array(self._back(text, vec, end)[1], np.uint32)
        first = np.array(self._back(text, vec, head)[1], np.uint32)
        return np.concatenate((first, self.segment([text[head:tail].encode(), text[tail:end].encode()])[0]))


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return h * U(0x9E3779B97F4A7C15) + c.astype(U) + U(1)


def _key(h: np.ndarray, n: int) -> np.ndarray:
    return mix(h ^ U(n * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)) | U(1 << 63)


_START = re.compile("[^ ](?= )")
_MODELS: dict[str, Unigram] = {}


def _borders(text: str, n: int) -> tuple[int, int]:
    """The first and the last start of a unit after another, within the first n characters; -1 if there is none."""
    first = _START.search(text, 0, n)
    if not first or first.start() + 1 >= n:
        return -1, -1
    last = n - 1
    while not (text[last] == " " and text[last - 1] != " "):
        last -= 1
    return first.start() + 1, last


def model(path: str) -> Unigram:
    if path not in _MODELS:
        _MODELS[path] = Unigram(path)
    return _MODELS[path]


def normal(text: str) -> str:
    return " " + text.replace(BLANK, " ") if text else ""


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product, over the last two axes."""
    return np.maximum(NEVER, (a[..., :, :, None] + b[..., None, :, :]).max(-2))


def scan(ms: np.ndarray) -> np.ndarray:
    """All prefix products, by doubling: each round combines neighbours twice as far apart."""
    out, far = ms.copy(), 1
    while far < len(ms):
        out[far:] = times(out[:-far], out[far:])
        far *= 2
    return out


def before(ms: np.ndarray) -> np.ndarray:
    """For each chunk, the scores of the states at its start."""
    out = np.full((len(ms), ms.shape[1]), NEVER, np.int64)
    out[0, 0] = 0
    out[1:] = scan(ms)[:-1, 0, :]
    return out


def follow(sources: np.ndarray) -> np.ndarray:
    """The state at each chunk's end: from 0 at the text's end back through the sources."""
    out = np.zeros(len(sources), np.int64)
    for i in range(len(sources) - 1, 0, -1):
        out[i - 1] = sources[i, out[i]]
    return out


SHORT = "doc_id long, n_chars long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def _short(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u = model(path)
        for _, b in exchange.numbered(batches):
            raw = [normal(t).encode() for t in b.text]
            ids, counts, _ = u.segment(raw)
            back, ids = u.decode(ids), ids.astype("<u4")
            widths = np.concatenate(([0], np.cumsum(u.width[ids])))
            rows, at = [], 0
            for doc, t, r, n in zip(b.doc_id, b.text, raw, counts.tolist(), strict=True):
                got = back[widths[at] : widths[at + n]].tobytes()[1:]  # without the blank in front
                rows.append((None if pd.isna(doc) else int(doc), len(t), n, zlib.crc32(ids[at : at + n]) if n else 0, hashlib.sha256(got).hexdigest(), got == r[1:]))
                at += n
            yield pd.DataFrame(rows, columns=["doc_id", "n_chars", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"]).astype({"doc_id": "Int64"})

    return run


def _cut(path: str, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        u, n = model(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc, t in zip(batch.doc_id, batch.text, strict=True):
                s = normal(t)
                at = range(0, len(s), size)
                for k in range(0, len(at), 64):
                    part = at[k : k + 64]
                    yield pd.DataFrame({"row": n, "doc_id": pd.Series([None if pd.isna(doc) else int(doc)] * len(part), dtype="Int64"), "k": np.arange(k, k + len(part)), "n": [min(size, len(s) - i) for i in part], "text": [s[i : i + size + u.longest - 1] for i in part]})
                n += 1

    return run


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per document (SHORT): its tokens' number and crc32 (little-endian unsigned 32-bit ids), and what they decode to."""
    path = path or default_path()
    d = plain(docs)
    short = d.filter(F.char_length("text") <= chunk).mapInPandas(_short(path), SHORT)
    cut = write_table(d.filter(F.char_length("text") > chunk).mapInPandas(_cut(path, chunk), "row long, doc_id long, k long, n long, text string"), "cuts")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u = model(path)
        for b in batches:
            yield pd.DataFrame({"row": b.row, "k": b.k, "m": [u.matrix(t, n).astype("<i8").tobytes() for t, n in zip(b.text, b.n, strict=True)]})

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        ms = np.array([np.frombuffer(m, "<i8") for m in pdf.m])
        w = math.isqrt(ms.shape[1])
        return pd.DataFrame({"row": pdf.row.to_numpy(), "k": pdf.k.to_numpy(), "vec": [v.astype("<i8").tobytes() for v in before(ms.reshape(-1, w, w))]})

    vecs = cut.select("row", "k", "n", "text").repartition("row", "k").mapInPandas(matrices, "row long, k long, m binary").groupBy("row").applyInPandas(starts, "row long, k long, vec binary")
    cut = write_table(cut.join(vecs, ["row", "k"]), "cuts")

    def sources(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u = model(path)
        for b in batches:
            yield pd.DataFrame({"row": b.row, "k": b.k, "s": [u.sources(t, n, np.frombuffer(v, "<i8")).astype("<i8").tobytes() for t, n, v in zip(b.text, b.n, b.vec, strict=True)]})

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pd.DataFrame({"row": pdf.row.to_numpy(), "k": pdf.k.to_numpy(), "d_out": follow(np.array([np.frombuffer(s, "<i8") for s in pdf.s]))})

    at = cut.select("row", "k", "n", "text", "vec").mapInPandas(sources, "row long, k long, s binary").groupBy("row").applyInPandas(ends, "row long, k long, d_out long")

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u = model(path)
        for b in batches:
            got = [u.trace(t, n, np.frombuffer(v, "<i8"), o) for t, n, v, o in zip(b.text, b.n, b.vec, b.d_out, strict=True)]
            yield pd.DataFrame({"row": b.row, "doc_id": b.doc_id, "k": b.k, "text": [t[:n] for t, n in zip(b.text, b.n, strict=True)], "ids": [g.astype("<u4").tobytes() for g in got], "back": [u.decode(g).tobytes() for g in got]})

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        s = "".join(pdf.text)
        raw, back = b"".join(pdf.ids), b"".join(pdf.back)[1:]
        out = pd.DataFrame({"doc_id": pdf.doc_id.iloc[:1].astype("Int64"), "n_chars": [len(s) - 1], "n_tokens": [len(raw) >> 2], "ids_crc32": [zlib.crc32(raw)], "decoded_sha256": [hashlib.sha256(back).hexdigest()]})
        return out.assign(same=[hashlib.sha256(back).hexdigest() == hashlib.sha256(s[1:].encode()).hexdigest()])

    long = cut.join(at, ["row", "k"]).mapInPandas(trace, "row long, doc_id long, k long, text string, ids binary, back binary")
    long = long.groupBy("row").applyInPandas(together, SHORT.replace("round_trip", "same"))
    return short.union(long)
