"""Quality rules: learned decision lists over text statistics.

``statistics`` measures every whole text. ``learn`` grows rules that tell texts
labelled low in quality from the others by sequential covering: a rule is a
conjunction of thresholds, grown on two thirds of the labelled rows by the gain
of information that each next threshold brings, pruned on the remaining third,
and kept while it is right on more than LEAST_RIGHT of the texts that it covers
there; then the texts it covers are set aside and the next one is grown. The
list becomes one ordered Spark conditional expression (``verdict``).

Learning uses at most about TRAIN_ROWS labelled rows, those with the lowest hash
of the id.

Defined cases: a null or empty text has no words and fails the base rule; a null
doc_id is kept and never labelled; where a document has several labels the
lowest quality counts; without labels the list is empty and keeps what the base
rule keeps; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.llm import seq
from apportion.llm.common import plain, write_table

#: Bound on the labelled rows that are learned from.
TRAIN_ROWS = 20_000
LEAST_RIGHT, LEAST_COVERED, MOST_RULES, MOST_TERMS, CUTS = 0.7, 5, 24, 4, 48
WINDOW = 5

# The symbols of the base statistics.
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_long", "n_lines", "n_distinct"]
#: The statistics that rules may test: name -> expression.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "long": "n_long / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(chars)] = 1
    return t


_SYMBOL, _UPPER, _DIGIT, _MARK = _table(SYMBOLS.encode()), _table(bytes(range(65, 91))), _table(b"0123456789"), _table(b"!?;:\"'()[]{}~^_=+@")


def measure(texts: list[bytes]) -> pd.DataFrame:
    """The COUNTS of each text."""
    n = len(texts)
    b, starts, ends, owner, hashes = seq.batch_words(texts)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    lens = np.array([len(t) for t in texts])

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[first + lens] - sums[first]

    per = lambda which: np.bincount(owner[which], minlength=n)
    out = {"n_words": np.bincount(owner, minlength=n), "word_chars": total((b & 0xC0 != 0x80) & ~seq.IS_SPACE[b])}
    out |= {"n_symbols": total(_SYMBOL[b]), "n_upper": total(_UPPER[b]), "n_digits": total(_DIGIT[b]), "n_marks": total(_MARK[b]), "n_long": per(ends - starts > 16)}
    lines = [t.split(b"\n") for t in texts]
    solid = [[x for x in ls if x.strip(b" \t\n\x0b\x0c\r")] for ls in lines]
    out |= {"n_lines": np.array([len(x) for x in lines]), "n_dup_lines": np.array([len(x) - len(set(x)) for x in solid])}
    salt = seq.mix(owner.astype(seq.U) + seq.U(1))
    own = hashes ^ salt
    out["n_distinct"] = per(np.unique(own, return_index=True)[1])
    grams = seq.gram_hashes(own, WINDOW)
    whole = owner[: len(grams)] == owner[WINDOW - 1 :] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    order = np.argsort(grams[at], kind="stable")
    g = grams[at][order]
    same = g[1:] == g[:-1]
    twice = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]] if len(g) else at
    covered = np.zeros(len(owner) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    out["n_repeat_words"] = per(np.cumsum(covered[:-1]) > 0)
    return pd.DataFrame({c: np.asarray(out[c]).astype("int64") for c in COUNTS})


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the COUNTS of each whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode() for t in batch.text]
            for i, j in seq.groups(texts):
                yield pd.concat([batch.doc_id.iloc[i:j].astype("Int64").reset_index(drop=True), measure(texts[i:j])], axis=1)

    return plain(docs).mapInPandas(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


Rule = list[tuple[str, str, float]]


def _covers(x: pd.DataFrame, rule: Rule) -> np.ndarray:
    keep = np.ones(len(x), bool)
    for name, side, cut in rule:
        v = x[name].to_numpy()
        keep &= v <= cut if side == "<=" else v > cut
    return keep


def _grow(x: pd.DataFrame, y: np.ndarray) -> Rule:
    rule: Rule = []
    keep = np.ones(len(x), bool)
    while len(rule) < MOST_TERMS and y[keep].any() and not y[keep].all():
        p0, n0 = y[keep].sum(), keep.sum()
        best = (0.0, None)
        for name in FEATURES:
            v = x[name].to_numpy()
            cuts = np.unique(np.quantile(v[keep & y], np.linspace(0, 1, CUTS)))
            near = np.unique(v[keep])
            # A cut lies halfway to the next value on its outer side, so that it does not sit on a value.
            for side in ("<=", ">"):
                for c in cuts:
                    i = np.searchsorted(near, c, "right" if side == "<=" else "left")
                    nxt = near[i] if side == "<=" and i < len(near) else near[i - 1] if side == ">" and i > 0 else c
                    cut = float((c + nxt) / 2)
                    k = keep & (v <= cut if side == "<=" else v > cut)
                    p, n = y[k].sum(), k.sum()
                    if p >= LEAST_COVERED and n < n0:
                        gain = p * (np.log2(p / n) - np.log2(p0 / n0))
                        if gain > best[0] + 1e-9:
                            best = (gain, (name, side, cut))
        if best[1] is None:
            break
        rule.append(best[1])
        keep &= _covers(x, rule[-1:])
    return rule


def _worth(x: pd.DataFrame, y: np.ndarray, rule: Rule) -> float:
    k = _covers(x, rule)
    p, n = y[k].sum(), k.sum()
    return (2 * p - n) / max(n, 1)


def cover(x: pd.DataFrame, bad: np.ndarray, held: np.ndarray) -> list[Rule]:
    """The rules, in order. held marks the rows that prune."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < MOST_RULES and bad[left & ~held].sum() >= LEAST_COVERED:
        grow, prune = left & ~held, left & held
        rule = _grow(x[grow], bad[grow])
        while len(rule) > 1 and _worth(x[prune], bad[prune], rule[:-1]) >= _worth(x[prune], bad[prune], rule):
            rule = rule[:-1]
        k = _covers(x, rule) & prune
        if not rule or k.sum() == 0 or bad[k].sum() < LEAST_RIGHT * k.sum():
            break
        rules.append(rule)
        left &= ~_covers(x, rule)
    return rules


def learn(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = marks.count()
    if n > TRAIN_ROWS:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(TRAIN_ROWS / n * (1 << 20)))
    rows = stats.join(F.broadcast(marks), "doc_id").filter(~base_failed())  # about TRAIN_ROWS rows of numbers at most
    rows = rows.select("quality", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)).alias("part"), *[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()])
    x = rows.toPandas()
    x = x.sort_values(list(x.columns), ignore_index=True)
    return cover(x, (x.quality == 0).to_numpy(), (x.part == 0).to_numpy()) if len(x) else []


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that covers the text; 0 if none does."""
    out = F.lit(0)
    for i, rule in reversed([*enumerate(rules, 1)]):
        test = F.lit(True)
        for name, side, cut in rule:
            v = F.expr(FEATURES[name])
            test = test & (v <= cut if side == "<=" else v > cut)
        out = F.when(test, i).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, the four base counts, base_failed, kept, rule."""
    stats = write_table(statistics(docs), "statistics")
    d = stats.withColumn("rule", verdict(learn(stats, labels)))
    return d.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), (~base_failed() & (F.col("rule") == 0)).alias("kept"), "rule")
