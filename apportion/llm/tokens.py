"""Token ids of whole texts by the tokenizers library, with repeated units encoded once.

A byte-level tokenizer of this family never merges across the start of a
white-space run, nor from a letter to a mark; so a text's ids are those of its
units (``units``). New units are encoded together, joined as they may stand in a
text, and told apart by the bytes of their tokens. Texts that hold a special
token's string, or white space outside ASCII, are encoded whole.
"""

from __future__ import annotations

import os
import string
from itertools import chain

import numpy as np

from apportion.llm import units
from apportion.llm.seq import ragged

_BLANKS = b" \t\n\x0b\x0c\r"
#: New units that are joined.
AT_ONCE = 24
_LETTERS = string.ascii_letters.encode()
#: ASCII characters that are neither blank, letter nor control character.
_MARKS = bytes(c for c in range(33, 127) if c not in _LETTERS)
#: White space outside ASCII, and the separators that some count as white space.
_ODD = [chr(c) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.whole = [*_ODD[:4], *special], [*_ODD, *special]
        # A byte-level vocabulary writes each byte as one character.
        alphabet = set(pre_tokenizers.ByteLevel.alphabet())
        size = self.tok.get_vocab_size(with_added_tokens=True)
        names = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.width = np.array([len(x) if set(x) <= alphabet else 0 for x in names])
        self.kinds = units.table(_BLANKS, _LETTERS, _MARKS)
        self.units = units.Units(self._learn)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.array([len(g) for g in got], np.int64)
        return np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum())), n

    def _joined(self, new: list[bytes], before: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Units that may stand one after another in a text if ``before``, one token, is put before each."""
        joined = [before.join([b"", *new[i : i + AT_ONCE]]).decode() for i in range(0, len(new), AT_ONCE)]
        ids, n = self._plain(joined)
        lens = np.array([len(u) for u in new], np.int64) + len(before)
        ends, sums = np.cumsum(lens), np.cumsum(self.width[ids])
        at = np.searchsorted(sums, ends) + 1
        if len(ids) != at[-1] or (sums[at - 1] != ends).any():
            return self._plain([u.decode() for u in new])
        n = np.diff(at, prepend=0)
        if not before:
            return ids, n
        keep = np.ones(len(ids), bool)
        keep[at - n] = False
        return ids[keep], n - 1

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kind = self.kinds[np.array([u[0] for u in new], np.uint8)]
        flat, n, at, used = [], np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), 0
        # Units with a blank in front; with a mark, which follows a letter; at a text's start.
        for which, encode in ((kind == 1, lambda us: self._joined(us, b"")), (kind == 3, lambda us: self._joined(us, b" a")), ((kind != 1) & (kind != 3), lambda us: self._plain([u.decode() for u in us]))):
            own = np.flatnonzero(which)
            if len(own):
                ids, m = encode([new[i] for i in own.tolist()])
                n[own], at[own] = m, used + np.cumsum(m) - m
                flat.append(ids)
                used += len(ids)
        return np.concatenate(flat)[ragged(at, n)], n, np.zeros(len(n), np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of ids of each text."""
        hard = [i for i, t in enumerate(texts) if any(x in t for x in self.whole[not t.isascii()])]
        raw = [t.encode() for t in texts]
        for i in hard:
            raw[i] = b""
        n = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(n)
        b = np.frombuffer(b"".join(raw), np.uint8)
        starts = units.cuts(b, (ends - n)[n > 0], self.kinds)
        ids, size, _ = self.units.look(b, starts, np.append(starts[1:], len(b))[: len(starts)])
        sums = np.concatenate(([0], np.cumsum(size)))
        counts = sums[np.searchsorted(starts, ends)] - sums[np.searchsorted(starts, ends - n)]
        if not hard:
            return ids, counts
        more, m = self._plain([texts[i] for i in hard])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i, part in zip(hard, np.split(more, np.cumsum(m)[:-1]), strict=True):
            parts[i] = part
        counts[hard] = m
        return np.concatenate(parts), counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
