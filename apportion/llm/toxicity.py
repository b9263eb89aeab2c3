"""Toxicity: a weighted finite-state pattern grammar over clauses.

A lexicon maps words to classes: insult, threat, target, negation, reported
speech, copula, degree, future, other. Transducers over these classes are
composed once, on the driver: one finds insults that are said of a target
(target, copula, degrees, insult), one finds announced threats (a future within
reach before), reported speech and negation rewrite the insults and threats in
their reach, a target raises the clause's weight, and the last transducer weighs
what is left.
A text's score is 1 - prod(1 - p) over its matched clauses, p being the weight
of the clause's best path times the precision of its strongest lexicon entry.

The insults are learned: word stems of STEM letters whose texts are labelled
toxic, chosen greedily so that each next one covers the most labelled toxic
texts not covered yet, less PENALTY times the clean ones. The seeds below are
used as well. A third of the labelled texts (near copies together) only confirms:
a stem must hold there for CONFIRMED texts at least, mostly toxic ones. Learning uses at most about TRAIN_ROWS labelled rows, those with
the lowest hash of the id, and only rows whose crc32(doc_id as text) mod 4 is
not 2. Labels, language, source and id are no inputs of a score.

Defined cases: a null or empty text has no clause and scores 0; a null doc_id
counts as not held out; labels of null or unknown documents are ignored, and
where one document has several, the highest counts; without labels the seeds
stand alone; repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.llm.common import plain, tidy

#: Bound on the labelled rows that are learned from.
TRAIN_ROWS = 20_000
#: Most stems kept as candidates, and most entries of the lexicon.
CANDIDATES, ENTRIES = 4_000, 200
STEM = range(4, 10)
SUPPORT, PENALTY, LEAST_GAIN, CONFIRMED, PARTS = 4, 2, 3, 2, 3
THRESHOLD = 0.3
#: Words after a negation that it rewrites.
REACH = 3

# Seeds of the lexicon.
INSULTS = "idiot moron imbecile scum loser pathetic worthless disgusting stupid".split()
THREATS = "kill hurt destroy burn beat shoot".split()
TARGETS = "you your yours he she they them him her du dich ihr euch sie tu toi vous te usted ustedes tú".split()
NEGATIONS = "not no never nobody nicht kein keine niemals pas jamais nunca jamás".split()
COPULAS = "am are is was were be bin bist ist sind seid war suis es est sommes êtes sont soy eres somos son".split()
DEGREES = "a an the so such really very complete total ein eine so sehr total un une si très vraiment una tan muy tal".split()
FUTURES = "will shall gonna going must should werde wirst werden muss sollte vais vas allons devrais voy vamos deberías".split()
REPORTS = "said says wrote called claims claimed quoted reported sagte schrieb dit écrit dijo escribió".split()

#: Texts with a stem: clean and toxic ones that it is chosen by, and those that confirm it.
COUNTED = ["clean", "toxic", "clean2", "toxic2"]

Arcs = dict[tuple[int, str], list[tuple[str, float, int]]]


class Transducer:
    """A weighted transducer over single characters: arcs[state, read] = [(written, weight, next state)], weights multiply, state 0 starts, all states end."""

    def __init__(self, arcs: Arcs):
        self.arcs = arcs

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: other reads what self writes."""
        names, todo, arcs, by = {(0, 0): 0}, [(0, 0)], {}, {}
        for (state, read), outs in self.arcs.items():
            by.setdefault(state, []).append((read, outs))
        while todo:
            p, q = todo.pop()
            for read, outs in by.get(p, []):
                for mid, weight, p2 in outs:
                    for out, w2, q2 in other.arcs.get((q, mid), []):
                        if (p2, q2) not in names:
                            names[p2, q2] = len(names)
                            todo.append((p2, q2))
                        arcs.setdefault((names[p, q], read), []).append((out, weight * w2, names[p2, q2]))
        return Transducer(arcs)

    def best(self, word: str) -> float:
        """The weight of the best path that reads word; 0 if there is none."""
        at = {0: 1.0}
        for c in word:
            to: dict[int, float] = {}
            for s, w in at.items():
                for _, v, n in self.arcs.get((s, c), []):
                    to[n] = max(to.get(n, 0.0), w * v)
            at = to
        return max(at.values(), default=0.0)


# Classes: x other, i insult, t threat, y target, n negation, r reported speech, c copula, d degree, f future;
# written: I insult said of a target, T announced threat, j weakened insult, u weakened threat.
def _insult() -> Transducer:
    """State 1: a target was read, 2: then a copula, and degrees."""
    arcs: Arcs = {}
    for s in range(3):
        for c in "xntrf":
            arcs[s, c] = [(c, 1.0, 0)]
        arcs[s, "y"] = [("y", 1.0, 1)]
        arcs[s, "c"] = [("x", 1.0, 2 if s else 0)]
        arcs[s, "d"] = [("x", 1.0, s)]
        arcs[s, "i"] = [("I" if s == 2 else "i", 1.0, 0)]
    return Transducer(arcs)


def _threat(reach: int = REACH) -> Transducer:
    """The state counts the words that a future still reaches."""
    arcs: Arcs = {}
    for s in range(reach + 1):
        nxt = max(0, s - 1)
        for c in "xynriI":
            arcs[s, c] = [(c, 1.0, nxt)]
        arcs[s, "f"] = [("x", 1.0, reach)]
        arcs[s, "t"] = [("T" if s else "t", 1.0, nxt)]
    return Transducer(arcs)


def _reported() -> Transducer:
    arcs: Arcs = {}
    for s in (0, 1):
        for c in "xyn":
            arcs[s, c] = [(c, 1.0, s)]
        arcs[s, "r"] = [("x", 1.0, 1)]
        for c in "iItT":
            arcs[s, c] = [("ju"[c in "tT"] if s else c, 1.0, s)]
    return Transducer(arcs)


def _negated(reach: int = REACH) -> Transducer:
    arcs: Arcs = {}
    for s in range(reach + 1):
        nxt = max(0, s - 1)
        for c in "xyju":
            arcs[s, c] = [(c, 1.0, nxt)]
        arcs[s, "n"] = [("x", 1.0, reach)]
        for c in "iItT":
            arcs[s, c] = [("ju"[c in "tT"] if s else c, 1.0, nxt)]
    return Transducer(arcs)


def _target() -> Transducer:
    """State bit 1: a target was read, bit 2: an insult, bit 4: a threat. A target raises an insult a little and makes a threat count."""
    arcs: Arcs = {}
    for s in range(8):
        for c in "xyiIjtTu":
            n = s | (c == "y") | 2 * (c in "iIj") | 4 * (c in "tTu")
            raised = (1.1 if n & 3 == 3 and s & 3 != 3 else 1.0) * (2.5 if n & 5 == 5 and s & 5 != 5 else 1.0)
            arcs[s, c] = [(c, raised, n)]
    return Transducer(arcs)


def _weights() -> Transducer:
    """Each path weighs one match (to state 1); in state 0 nothing is weighed yet, and matches may be passed over for a later one."""
    each = {"I": 0.95, "i": 0.9, "j": 0.5, "T": 0.25, "t": 0.15, "u": 0.05}
    arcs: Arcs = {(s, c): [("x", 1.0, s)] for s in (0, 1) for c in "xy"}
    for c, w in each.items():
        arcs[0, c], arcs[1, c] = [("x", w, 1), ("x", 0.01, 0)], [("x", 1.0, 1)]
    return Transducer(arcs)


_WORD, _CLAUSE = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?;\n]+")
#: After REACH other words in a row, more of them change neither state nor weight.
_IDLE = re.compile(f"x{{{REACH + 1},}}")


class Grammar:
    """entries: stem -> precision on the labelled rows."""

    def __init__(self, entries: dict[str, float]):
        self.entries = entries
        self.machine = _insult() @ _threat() @ _reported() @ _negated() @ _target() @ _weights()
        self.classes = {w: c for c, ws in (("c", COPULAS), ("d", DEGREES), ("f", FUTURES), ("y", TARGETS), ("n", NEGATIONS), ("r", REPORTS), ("t", THREATS)) for w in ws}
        stems = sorted({*entries, *THREATS}, key=lambda s: (-len(s), s))
        self.longest = max(map(len, entries), default=0)
        self.hint = re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, stems)) + ")")

    def word(self, w: str) -> tuple[str, float]:
        found = max((self.entries[w[:n]] for n in range(2, min(len(w), self.longest) + 1) if w[:n] in self.entries), default=0.0)
        return ("i", found) if found else (self.classes.get(w, "x"), 1.0 if w in THREATS else 0.0)

    def clause(self, text: str) -> float:
        read, most = "", 0.0
        for m in _WORD.finditer(text):
            c, p = self.word(m[0])
            read, most = read + c, max(most, p)
        if not most:
            return 0.0
        return min(0.99, self.machine.best(_IDLE.sub("x" * REACH, read)) * most)

    def score(self, text: str | None) -> float:
        low = (text or "").lower()
        if not self.hint.search(low):
            return 0.0
        clean = 1.0
        for part in _CLAUSE.split(low):
            if self.hint.search(part):
                clean *= 1 - self.clause(part)
        return 1 - clean


def _stems(text: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.update(w[:n] for n in STEM if n <= len(w))
        if len(w) not in STEM and len(w) > STEM[-1]:
            out.add(w[: STEM[-1]])
    return out


def _confirms(text: str) -> bool:
    """Whether a labelled text confirms. By the least hash of its words, so that copies and near copies are on the same side."""
    return min((zlib.crc32(w.encode()) for w in set(_WORD.findall(text.lower()))), default=1) % PARTS == 0


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Grammar:
    d = plain(docs)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~held_out())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    if n > TRAIN_ROWS:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(TRAIN_ROWS / n * (1 << 20)))
    rows = d.join(F.broadcast(marks), "doc_id").select("text", "toxic")  # about TRAIN_ROWS pairs of numbers at most

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both: dict[int, Counter] = {k: Counter() for k in range(4)}
        for b in batches:
            for text, toxic in zip(b.text, b.toxic, strict=True):
                both[int(toxic > 0) + 2 * int(_confirms(text))].update(_stems(text))
            if sum(map(len, both.values())) > 500_000:
                yield from out(both)
                both = {k: Counter() for k in range(4)}
        yield from out(both)

    def out(both: dict[int, Counter]) -> Iterator[pd.DataFrame]:
        for k, c in both.items():
            if c:
                yield pd.DataFrame({"stem": list(c)} | {name: np.array(list(c.values())) * (j == k) for j, name in enumerate(COUNTED)})

    counts = rows.mapInPandas(lambda batches: tidy(count(batches)), "stem string, " + ", ".join(f"{c} long" for c in COUNTED)).groupBy("stem").agg(*[F.sum(c).alias(c) for c in COUNTED])
    confirmed = (F.col("toxic2") >= CONFIRMED) & (F.col("toxic2") > PENALTY * F.col("clean2"))
    counts = counts.filter((F.col("toxic") >= SUPPORT) & (F.col("toxic") > PENALTY * F.col("clean")) & confirmed).orderBy(F.desc(F.col("toxic") - PENALTY * F.col("clean")), F.desc(F.length("stem")), "stem").limit(CANDIDATES)
    found = {r["stem"]: (r["clean"] + r["clean2"], r["toxic"] + r["toxic2"]) for r in counts.collect()}  # CANDIDATES at most

    def has(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"has": [sorted(s for s in _stems(t) if s in found) for t in b.text]})

    texts = [frozenset(r["has"]) for r in rows.filter("toxic > 0").mapInPandas(has, "has array<string>").collect()] if found else []
    entries: dict[str, float] = {}
    left = texts
    while left and len(entries) < ENTRIES:
        cover = Counter(s for t in left for s in t)
        best = max(cover, key=lambda s: (cover[s] - PENALTY * found[s][0], len(s), s), default=None)
        if best is None or cover[best] - PENALTY * found[best][0] < LEAST_GAIN:
            break
        entries[best] = (found[best][1] + 1) / (found[best][1] + found[best][0] + 2)
        left = [t for t in left if best not in t]
    seeds = {w: 0.95 for w in INSULTS if not any(w[:k] in entries for k in range(2, len(w) + 1))}
    return Grammar({**seeds, **entries})


def scorer(grammar: Grammar):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([grammar.score(t) for t in texts], dtype="float64")

    return score


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    score = scorer(learn(docs, labels))
    d = plain(docs).select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return d.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under THRESHOLD, with all their columns."""
    score = scorer(learn(docs, labels))
    return docs.filter(score(F.coalesce(F.col("text"), F.lit(""))) < THRESHOLD)
