"""The read model: lengths, start positions, base errors, noise; and the probability of a read given a hit.

Model tables have a fixed size (a length each up to the longest fragment, BINS
positions, QUALITIES x 5 x 5 substitutions), so they live on the driver as arrays
and go to the tasks with the function that uses them. Sufficient statistics are
aggregated in Spark: each base, length or position adds its hit's share.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apportion.functions.scalar import TINY, reverse_complement
from apportion.session import ship

# Base codes, number of quality levels, position bins, width of a normal length distribution, chance of an unknown base.
CODES, QUALITIES, BINS, RANGE, P_UNKNOWN = "ACGTN", 100, 20, 201, 1e-5
_CODE = np.full(256, 4, np.int64)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


@dataclass
class Lengths:
    """p[i] is the probability of length low + i."""

    low: int
    p: np.ndarray
    cdf: np.ndarray = field(init=False)

    def __post_init__(self):
        some = np.flatnonzero(self.p > 0)
        if not len(some):
            raise ValueError("no length has any weight")
        self.low, self.p = self.low + int(some[0]), self.p[some[0] : some[-1] + 1] / self.p.sum()
        self.cdf = np.cumsum(self.p)

    @property
    def high(self) -> int:
        return self.low + len(self.p) - 1

    def within(self, length, limit) -> np.ndarray:
        """Probability of length given that no length is over limit."""
        length, limit = np.asarray(length), np.asarray(limit)
        ok = (length >= self.low) & (length <= np.minimum(self.high, limit))
        below = self.cdf[np.clip(np.minimum(limit, self.high) - self.low, 0, len(self.p) - 1)]
        return np.where(ok, self.p[np.clip(length - self.low, 0, len(self.p) - 1)] / below, 0.0)


def normal_lengths(mean: float, sd: float, low: int, high: int) -> Lengths:
    """A normal distribution on whole lengths from low to high, on at most RANGE of them around the mean."""
    middle = int(mean + 0.5)
    if sd < TINY:
        if not low <= middle <= high:
            raise ValueError("the mean lies outside the possible lengths")
        return Lengths(middle, np.ones(1))
    if high - low + 1 > RANGE:
        half = RANGE / 2
        if middle <= low or mean - (low - 0.5) < half:
            high = low + RANGE - 1
        elif middle >= high or high + 0.5 - mean < half:
            low = high - RANGE + 1
        else:
            low, high = int(mean - half + 1), int(mean + half)
    at = NormalDist(mean, sd).cdf
    return Lengths(low, np.diff([at(x - 0.5) for x in range(low, high + 2)]))


def observed_lengths(rows: DataFrame, length: str, weight: str) -> Lengths:
    """From the summed weights of each length: one row a length."""
    x = rows.groupBy(F.col(length).alias("l")).agg(F.sum(weight).alias("w")).toPandas().sort_values("l")
    p = np.zeros(int(x.l.max() - x.l.min()) + 1)
    p[(x.l - x.l.min()).to_numpy()] = x.w
    return Lengths(int(x.l.min()), p)


class Positions:
    """Where fragments start along a target, in bins of equal share; None is evenly."""

    def __init__(self, p: np.ndarray | None = None):
        self.p = None if p is None else p / p.sum()
        self.cdf = None if p is None else np.concatenate(([0.0], np.cumsum(self.p)))

    def upto(self, pos, full) -> np.ndarray:
        at = np.asarray(pos) / full * len(self.p)
        i = np.minimum(np.floor(at).astype(int), len(self.p) - 1)
        return self.cdf[i] + (at - i) * self.p[i]

    def prob(self, pos, room, full) -> np.ndarray:
        pos, room, full = (np.asarray(x, float) for x in (pos, room, full))
        if self.p is None:
            return np.where(room > 0, 1 / np.maximum(room, 1), 0.0)
        below = self.upto(np.maximum(room, 0), full)
        return np.where(below >= TINY, (self.upto(pos + 1, full) - self.upto(pos, full)) / np.maximum(below, TINY), 0.0)


def position_mass(hits: DataFrame, bins: int = BINS) -> DataFrame:
    """bin (from 0), mass: each hit's frac spread over the bins that its start covers. hits: fpos, full_len, frac."""
    first = F.floor(F.col("fpos") * bins / F.col("full_len"))
    last = F.floor(((F.col("fpos") + 1) * bins - 1) / F.col("full_len"))
    x = hits.filter("fpos < full_len").select("fpos", "full_len", "frac", F.explode(F.sequence(first, F.greatest(first, last))).alias("bin"))
    share = F.least((F.col("fpos") + 1) / F.col("full_len"), (F.col("bin") + 1) / F.lit(bins)) - F.greatest(F.col("fpos") / F.col("full_len"), F.col("bin") / F.lit(bins))
    return x.groupBy("bin").agg(F.sum(share * F.col("full_len") * F.col("frac")).alias("mass"))


def initial_errors() -> np.ndarray:
    """[quality, base of the reference, base read] from the Phred scale."""
    q = 10.0 ** (-np.arange(QUALITIES) / 10)
    p = np.empty((QUALITIES, 5, 5))
    p[:, :4, :4] = (q / 3)[:, None, None]
    p[:, range(4), range(4)] = (1 - q)[:, None]
    p[:, :4, :4] *= 1 - P_UNKNOWN
    p[:, :4, 4] = P_UNKNOWN
    p[:, 4, :4], p[:, 4, 4] = (1 - P_UNKNOWN) / 4, P_UNKNOWN
    return p


def substitutions(aligned: DataFrame, by: str = "quality") -> DataFrame:
    """k (quality, or cycle from 0), r, c, w: weights of the bases read. aligned: seq, qual, ref (as the read runs), frac."""
    i = F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("i")
    at = lambda c: F.substring(F.col(c), F.col("i"), F.lit(1))
    k = F.ascii(at("qual")) - 33 if by == "quality" else F.col("i") - 1
    x = aligned.filter("length(seq) > 0").select("seq", "qual", "ref", "frac", i).select(k.alias("k"), F.upper(at("ref")).alias("r"), F.upper(at("seq")).alias("c"), "frac")
    return x.groupBy("k", "r", "c").agg(F.sum("frac").alias("w"))


def errors_from(counts: DataFrame) -> np.ndarray:
    """Substitution weights to probabilities; a row without weight stays zero."""
    w = np.zeros((QUALITIES, 5, 5))
    for r in counts.collect():  # 2 500 rows at most
        w[r["k"], _CODE[ord(r["r"])], _CODE[ord(r["c"])]] += r["w"]
    return np.divide(w, w.sum(2, keepdims=True), out=np.zeros_like(w), where=w.sum(2, keepdims=True) >= TINY)


def noise_from(reads: DataFrame, pseudo: float = 1.0) -> np.ndarray:
    """[quality, base] of unaligned reads (seq, qual), with a pseudo-count."""
    c = np.full((QUALITIES, 5), pseudo)
    x = reads.select("seq", "qual", F.col("seq").alias("ref"), F.lit(1.0).alias("frac"))
    for r in substitutions(x).collect():
        c[r["k"], _CODE[ord(r["c"])]] += r["w"]
    return c / c.sum(1, keepdims=True)


@dataclass
class Model:
    forward: float
    fragments: Lengths
    reads: Lengths
    positions: Positions
    errors: np.ndarray
    noise: np.ndarray


def _codes(s: str) -> np.ndarray:
    return _CODE[np.frombuffer(s.encode(), np.uint8)]


def likelihoods(hits: DataFrame, model: Model) -> DataFrame:
    """hits with conprb. Columns: dir (0 forward), fpos (start on the forward strand), insert_len, full_len, tot_len, masked, mw, low,
    and for each mate seq, qual, ref (what the reference has there, as the read runs): seq1, qual1, ref1, seq2, qual2, ref2 (null for single reads).
    """
    ship(hits.sparkSession)

    def mate(seqs, quals, refs) -> np.ndarray:
        out = np.ones(len(seqs))
        for i, (s, q, r) in enumerate(zip(seqs, quals, refs, strict=True)):
            if s is not None:
                out[i] = model.errors[np.frombuffer(q.encode(), np.uint8).astype(np.int64) - 33, _codes(r), _codes(s)].prod()
        return out

    def run(batches):
        for b in batches:
            room = np.minimum(b.full_len, b.tot_len - b.insert_len + 1)
            p = np.where(b.dir == 0, model.forward, 1 - model.forward) * model.fragments.within(b.insert_len, b.tot_len) * model.positions.prob(b.fpos, room, b.full_len)
            for k in (1, 2):
                n = b[f"seq{k}"].str.len()
                p = p * np.where(n.isna(), 1.0, model.reads.within(n.fillna(0).astype(int), b.insert_len)) * mate(b[f"seq{k}"], b[f"qual{k}"], b[f"ref{k}"])
            p = np.where(b.low | b.masked | (b.fpos >= b.full_len) | (p < TINY), 0.0, p)
            yield b.assign(conprb=np.where(b.mw < TINY, 0.0, p / np.maximum(b.mw, TINY)))

    return hits.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema) + ", conprb double")


def noise_probabilities(reads: DataFrame, model: Model) -> DataFrame:
    """rid, noise: the chance of a read that comes from no target."""
    ship(reads.sparkSession)

    def run(batches):
        for b in batches:
            p = np.ones(len(b))
            for k in (1, 2):
                for i, (s, q) in enumerate(zip(b[f"seq{k}"], b[f"qual{k}"], strict=True)):
                    if s is not None:
                        n = len(s) - model.reads.low
                        p[i] *= (model.reads.p[n] if 0 <= n < len(model.reads.p) else 0.0) * model.noise[np.frombuffer(q.encode(), np.uint8).astype(np.int64) - 33, _codes(s)].prod()
            yield pd.DataFrame({"rid": b.rid, "noise": np.where(b.low | (p < TINY), 0.0, p)})

    return reads.select("rid", "low", "seq1", "qual1", "seq2", "qual2").mapInPandas(run, "rid long, noise double")


def with_reference(hits: DataFrame, refs: DataFrame) -> DataFrame:
    """hits (rid, sid, dir, pos on the strand of the hit, insert_len, seq1, qual1, seq2, qual2, low) joined with refs (sid, seq, full_len, tot_len, mask_from, mw): the columns of ``likelihoods``."""
    x = hits.join(refs.withColumnRenamed("seq", "ref_seq"), "sid")
    fpos = F.when(F.col("dir") == 0, F.col("pos")).otherwise(F.col("tot_len") - F.col("pos") - F.col("insert_len"))
    x = x.withColumn("fpos", fpos)
    frag = F.substring(F.col("ref_seq"), F.col("fpos") + 1, F.col("insert_len"))
    x = x.withColumn("frag", F.when(F.col("dir") == 0, frag).otherwise(reverse_complement(frag)))
    one, two = F.substring(F.col("frag"), F.lit(1), F.length("seq1")), F.substring(reverse_complement(F.col("frag")), F.lit(1), F.length("seq2"))
    return x.select(*hits.columns, "fpos", "full_len", "tot_len", "mw", F.coalesce(F.col("fpos") >= F.col("mask_from"), F.lit(False)).alias("masked"), one.alias("ref1"), two.alias("ref2"))


def mask_weights(refs: pd.DataFrame, fragments: Lengths, positions: Positions) -> np.ndarray:
    """1 - the chance that a fragment of a target starts in its masked tail. refs: full_len, tot_len, mask_from (null: no mask), a row a target."""
    out = np.ones(len(refs))
    for i, r in enumerate(refs.itertuples()):
        if pd.isna(r.mask_from):
            continue
        lost = 0.0
        for pos in range(int(r.mask_from), min(r.full_len, r.tot_len - fragments.low + 1)):
            n = np.arange(fragments.low, min(fragments.high, r.tot_len - pos) + 1)
            lost += float((fragments.within(n, r.tot_len) * positions.prob(pos, np.minimum(r.full_len, r.tot_len - n + 1), r.full_len)).sum())
        out[i] = 1 - lost if 1 - lost >= 1e-8 else 0.0
    return out


def marginal_length(model: Model, length, limit) -> np.ndarray:
    """Probability of a single read's length when its fragment's length is unknown: summed over all fragments that can hold it."""
    n = np.arange(model.fragments.low, model.fragments.high + 1)
    return np.array([(model.fragments.within(n, t) * np.where(n >= m, model.reads.within(np.full(len(n), m), n), 0.0)).sum() for m, t in zip(np.atleast_1d(length), np.atleast_1d(limit), strict=True)])


def fit(hits: DataFrame, start: Model, rounds: int = 10, learn_positions: bool = False, noise: DataFrame | None = None, write=None) -> tuple[Model, DataFrame, DataFrame]:
    """EM with the model learned along: each round the hits' likelihoods under the model, their shares, then theta and the model from the shares.

    hits as of ``with_reference`` with ord; returns the model, theta and the last posteriors.
    """
    from apportion.operators import em

    cut = write or (lambda df: df.checkpoint())
    model, theta, post = start, cut(em.uniform_theta(hits)), None
    few = theta.count() <= em.FEW_TARGETS
    for _ in range(rounds):
        scored = em.by_record(likelihoods(hits, model))
        if noise is not None:
            scored = scored.join(noise, "rid", "left")
        post = cut(em.posteriors(scored, theta, few, noise=F.coalesce(F.col("noise"), F.lit(0.0)) if noise is not None else None))
        theta = cut(em.m_step(em.expected_counts(post)))
        used = post.filter(F.col("frac") >= TINY)
        sides = [used.filter(f"seq{k} is not null").select(F.col(f"seq{k}").alias("seq"), F.col(f"qual{k}").alias("qual"), F.col(f"ref{k}").alias("ref"), "frac") for k in (1, 2)]
        positions = model.positions
        if learn_positions:
            mass = np.zeros(BINS)
            for r in position_mass(used).collect():  # BINS rows
                mass[int(r["bin"])] = r["mass"]
            positions = Positions(mass)
        model = Model(model.forward, observed_lengths(used, "insert_len", "frac"), model.reads, positions, errors_from(substitutions(sides[0].union(sides[1]))), model.noise)
    return model, theta, post


def plot_data(errors: np.ndarray) -> pd.DataFrame:
    """quality, base, observed: the quality that the learned errors amount to, where there is any weight."""
    rows = [(q, CODES[b], float(-10 * np.log10(max(1 - errors[q, b, b], 1e-10)))) for q in range(QUALITIES) for b in range(4) if errors[q, b].sum() >= 1e-8]
    return pd.DataFrame(rows, columns=["quality", "base", "observed"])
