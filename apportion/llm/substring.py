"""Substring dedup: prefix-partitioned suffix trees over words.

A word goes if it is covered by a window of 35 words whose sequence also starts
anywhere else. ``repeats`` says which suffixes take part; this module has the
trees. A bucket's suffixes are split by prefixes of growing length into groups
of at most GROUP suffixes (a group whose prefix is a whole window is one node and
is not split). Each group's tree is held as its sorted suffixes with their common
prefixes; its deep internal nodes, those of a window's depth less what lies
before the anchor, are the repeats. Nodes shallower than the prefix by which a
group was parted lie in several groups; their places are summed over all of them.

Words are 64-bit hashes here: two different windows count as equal only if all
hashes agree.

Defined cases: a null text has no words; texts under 35 words keep all; a null
doc_id stays null; a repeated row is another text, so both lose what they share;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apportion.llm import repeats

WINDOW, GRAM = 35, 12
#: Most suffixes that one tree holds.
GROUP = 50_000


def split(rows: np.ndarray, at: np.ndarray, depth: int, spec: repeats.Spec, most: int = 0, parted: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Row numbers of groups that share a prefix of ``depth`` symbols or are put together with others, at most ``most`` a group.

    ``parted`` gets, for each row whose prefix is parted by longer ones, the length of these: shallower nodes lie in several groups.
    """
    if len(at) <= (most or GROUP):
        yield at
        return
    if depth >= spec.window:
        yield at
        return
    size = spec.kind.itemsize
    prefix = np.ascontiguousarray(rows[at, : depth * size]).view(f"V{depth * size}").ravel()
    _, which, count = np.unique(prefix, return_inverse=True, return_counts=True)
    by = np.argsort(which, kind="stable")
    ends = np.cumsum(count)
    held: list[np.ndarray] = []
    n = 0
    for e, c in zip(ends, count, strict=True):
        part = at[by[e - c : e]]
        if c > (most or GROUP):
            deeper = min(spec.window, depth + 6)
            if parted is not None:
                parted[part] = deeper
            yield from split(rows, part, deeper, spec, most, parted)
            continue
        if n + c > (most or GROUP):
            yield np.concatenate(held)
            held, n = [], 0
        held.append(part)
        n += c
    if held:
        yield np.concatenate(held)


def order(rows: np.ndarray, prefix: np.ndarray, ends: np.ndarray, spec: repeats.Spec) -> Iterator[tuple]:
    """The trees of a bucket, each as its sorted suffixes."""
    parted = np.zeros(len(rows), np.int8)
    for at in split(rows, np.arange(len(rows)), spec.gram, spec, parted=parted):
        at = at[np.argsort(rows[at].view(f"V{spec.width}").ravel(), kind="stable")]
        ctx = rows[at]
        differ = ctx[1:] != ctx[:-1]
        shared = np.concatenate(([0], np.where(differ.any(1), differ.argmax(1), spec.width)))
        yield ctx, shared, at, parted[at]


SPEC = repeats.Spec(WINDOW, GRAM, words=True, smaller=False, order=order)


def _texts(c: repeats.Chunk, covered: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """For each text: its number, its words, how many went, and the kept words joined by one space."""
    for i, (b, e) in enumerate(zip(c.begin, c.end, strict=True)):
        keep = np.flatnonzero(~covered[b:e]) + b
        yield i, int(e - b), int(e - b - len(keep)), b" ".join([c.data[c.starts[j] : c.ends[j]].tobytes() for j in keep])


def _report(c: repeats.Chunk, covered: np.ndarray) -> pd.DataFrame:
    rows = [(None if c.null[i] else int(c.ids[i]), n, gone, hashlib.sha256(kept).hexdigest()) for i, n, gone, kept in _texts(c, covered)]
    return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"]).astype({"doc_id": "Int64"})


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    return repeats.repeated(docs, SPEC, _report, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cuts(c: repeats.Chunk, covered: np.ndarray) -> pd.DataFrame:
    rows = []
    for i, _, gone, kept in _texts(c, covered):
        if gone:
            rows.append((None if c.null[i] else int(c.ids[i]), hashlib.md5(c.texts[i]).hexdigest(), kept.decode()))
    return pd.DataFrame(rows, columns=["_id", "_md5", "_kept"]).astype({"_id": "Int64"})


def strip(docs: DataFrame) -> DataFrame:
    """docs with the repeated words taken out of text (what is left joined by one space, and n_chars its length). All rows stay, untouched texts as they are."""
    cuts = repeats.repeated(docs, SPEC, _cuts, "_id long, _md5 string, _kept string").dropDuplicates(["_id", "_md5"])
    d = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    d = d.join(cuts, d["doc.doc_id"].eqNullSafe(cuts["_id"]) & (F.md5(F.coalesce(d["doc.text"], F.lit("")).cast("binary")) == cuts["_md5"]), "left")
    text = F.coalesce("_kept", "doc.text")
    cols = {c: F.col(f"doc.`{c}`").alias(c) for c in docs.columns}
    cols["text"] = text.alias("text")
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("_kept").isNull(), F.col("doc.n_chars")).otherwise(F.char_length("_kept")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return d.select(*cols.values())
