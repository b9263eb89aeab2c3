"""Priors from external intervals: training targets, features of targets, partitions and their prior parameters.

Targets: trid, chrom, strand, start, end (1-based, inclusive). Peaks: chrom, start, end. Fragments: chrom, start, end, strand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apportion.functions.scalar import log10_floor
from apportion.operators import sampling
from apportion.operators.intervals import overlap_join

# Flank of starts and ends, least mappability, greatest p-value of an informative signal, width of a join bin.
FLANK, MAPPABILITY, P_VALUE, WIDTH = 500, 0.8, 0.01, 4096


def _half_open(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, "chrom", F.col("start").cast("long").alias("start"), (F.col("end") + 1).cast("long").alias("end"))


def with_sites(targets: DataFrame) -> DataFrame:
    plus = F.col("strand") == "+"
    return targets.withColumn("tss", F.when(plus, F.col("start")).otherwise(F.col("end"))).withColumn("tes", F.when(plus, F.col("end")).otherwise(F.col("start")))


def training_targets(targets: DataFrame, exons: DataFrame, flank: int = FLANK, mappability: float = MAPPABILITY) -> DataFrame:
    """Well mappable targets that lie in no other target, whose exons are not all inside other targets' exons, with no other start near theirs.

    targets also has tss_mpp, body_mpp, tes_mpp; exons: trid, exon_index, chrom, start, end.
    """
    good = with_sites(targets).filter(" and ".join(f"coalesce({c}_mpp > {mappability}, false)" for c in ("tss", "body", "tes")))
    every = _half_open(targets, "trid")
    nested = overlap_join(every, _half_open(good, "trid"), WIDTH, "within").filter("a_trid != b_trid").select(F.col("b_trid").alias("trid")).distinct()
    good = good.join(nested, "trid", "left_anti")
    e = _half_open(exons, "trid", "exon_index")
    own = e.join(good.select("trid"), "trid", "left_semi")
    inside = overlap_join(e, own, WIDTH, "within").filter("a_trid != b_trid").groupBy(F.col("b_trid").alias("trid")).agg(F.count_distinct("b_exon_index").alias("n"))
    covered = inside.join(own.groupBy("trid").agg(F.count_distinct("exon_index").alias("all")), "trid").filter("n = all")
    good = good.join(covered, "trid", "left_anti")
    near = good.select("trid", "chrom", (F.col("tss") - flank).cast("long").alias("start"), (F.col("tss") + flank + 1).cast("long").alias("end"))
    sites = with_sites(targets).select("trid", "chrom", F.col("tss").cast("long").alias("start"), (F.col("tss") + 1).cast("long").alias("end"))
    crowded = overlap_join(near, sites, WIDTH).filter("a_trid != b_trid").select(F.col("a_trid").alias("trid")).distinct()
    return good.join(crowded, "trid", "left_anti")


def zones(targets: DataFrame, flank: int = FLANK) -> DataFrame:
    """trid, zone (tss, body, tes), chrom, start, end (half-open): flanks of both ends and what lies between; a body that is too short is turned round."""
    t = with_sites(targets)
    a, b = F.col("start") + flank + 1, F.col("end") - flank - 1
    z = lambda n, s, e: F.struct(F.lit(n).alias("zone"), s.cast("long").alias("start"), (e + 1).cast("long").alias("end"))
    each = F.array(z("tss", F.col("tss") - flank, F.col("tss") + flank), z("body", F.least(a, b), F.greatest(a, b)), z("tes", F.col("tes") - flank, F.col("tes") + flank))
    return t.select("trid", "chrom", F.explode(each).alias("z")).select("trid", "chrom", "z.*")


def capped(fragments: DataFrame, most: int = 5) -> DataFrame:
    """At most so many fragments at the same place and strand."""
    w = Window.partitionBy("chrom", "start", "end", "strand").orderBy(F.lit(0))
    return fragments.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most).drop("rn")


def features(targets: DataFrame, peaks: DataFrame, fragments: DataFrame, gc: DataFrame, expression: DataFrame, training: DataFrame, flank: int = FLANK) -> DataFrame:
    """Per target: whether each zone has a peak and the density of fragments in it, effective length, count, GC, and whether it is in the training set.

    fragments count where their middle lies in the zone; density is per base of the zone and 1e9 fragments.
    """
    z = zones(targets, flank)
    pk = overlap_join(z, _half_open(peaks), WIDTH).groupBy(F.col("a_trid").alias("trid")).pivot("a_zone", ["tss", "body", "tes"]).agg(F.lit(1))
    pk = pk.select("trid", *[F.col(c).alias(f"{c}_pk") for c in ("tss", "body", "tes")])
    f = _half_open(fragments)
    total = f.agg(F.count("*").alias("all"))
    j = overlap_join(z, f, WIDTH)
    middle = F.floor((F.col("b_start") + F.col("b_end") - 1) / 2)
    j = j.filter((middle >= F.col("a_start")) & (middle < F.col("a_end")))
    sig = j.groupBy(F.col("a_trid").alias("trid"), F.col("a_zone").alias("zone")).agg(F.count("*").alias("n"), F.max(F.col("a_end") - F.col("a_start")).alias("w"))
    sig = sig.crossJoin(F.broadcast(total)).withColumn("v", F.col("n") * 1e9 / F.col("w") / F.col("all")).groupBy("trid").pivot("zone", ["tss", "body", "tes"]).agg(F.sum("v"))
    sig = sig.select("trid", *[F.col(c).alias(f"{c}_sig") for c in ("tss", "body", "tes")])
    x = with_sites(targets).join(expression, "trid", "left").join(gc, "trid", "left").join(pk, "trid", "left").join(sig, "trid", "left")
    x = x.join(training.select("trid", F.lit(1).alias("is_training")).distinct(), "trid", "left")
    return x.fillna(0, ["tss_pk", "body_pk", "tes_pk", "is_training"]).fillna(0.0, ["tss_sig", "body_sig", "tes_sig"])


def model_columns(x: DataFrame) -> DataFrame:
    """The regression's columns: logarithms with a floor of -4, and complements of the peak flags."""
    out = x.withColumn("log10_count", F.log10(F.col("pme_count") + 1)).withColumn("log10_eff_len", log10_floor(F.col("efflen")))
    for c in ("tss", "body", "tes"):
        out = out.withColumn(f"log10_{c}_sig", log10_floor(F.col(f"{c}_sig"))).withColumn(f"no_{c}_pk", 1 - F.col(f"{c}_pk"))
    return out


def _design(x: pd.DataFrame) -> np.ndarray:
    cols = [np.ones(len(x)), x.log10_eff_len, x.GC_fraction]
    for c in ("tss", "body", "tes"):
        s = x[f"log10_{c}_sig"]
        cols += [x[f"{c}_pk"], x[f"{c}_pk"] * s, x[f"no_{c}_pk"] * s]
    return np.column_stack([np.asarray(c, float) for c in cols])


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Upper limits of equally wide bins over the values, without the last."""
    lo, hi = float(values.min()), float(values.max())
    return lo + (hi - lo) / bins * np.arange(1, bins)


def partition(train: pd.DataFrame, every: pd.DataFrame, kind: str = "pk", bins: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Part of each training row and of each row: by the peak at the start (pk), by the regression's prediction (lm), by both (pklm), or by a logistic fit of being expressed (logit)."""
    if kind == "pk":
        return train.tss_pk.to_numpy(int), every.tss_pk.to_numpy(int)
    a, b = _design(train), _design(every)
    if kind == "logit":
        y, w = (train.pme_count.to_numpy() > 0).astype(float), np.zeros(a.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w = w + np.linalg.pinv(a.T @ (a * (p * (1 - p))[:, None])) @ (a.T @ (y - p))
    else:
        w = np.linalg.lstsq(a, train.log10_count.to_numpy(float), rcond=None)[0]
    pa, pb = a @ w, b @ w
    c = cuts(pa, bins if kind != "logit" else 2)
    qa, qb = np.searchsorted(c, pa, "left"), np.searchsorted(c, pb, "left")
    if kind == "pklm":
        return qa + (len(c) + 1) * train.tss_pk.to_numpy(int), qb + (len(c) + 1) * every.tss_pk.to_numpy(int)
    return qa, qb


def priors(x: DataFrame, kind: str = "pk", bins: int = 3) -> pd.DataFrame:
    """trid, part, prior, loglik: the prior parameter of each target's part, fitted on the training targets. One row a target meets on the driver, as one transcriptome's table does."""
    every = model_columns(x).orderBy("trid").toPandas()
    train = every[(every.is_training == 1) & every.pme_count.notna()]
    pa, pb = partition(train, every, kind, bins)
    used, pa = np.unique(pa, return_inverse=True)
    alpha, ll = sampling.dirichlet_multinomial(train.pme_count.to_numpy(float), pa)
    at = np.clip(np.searchsorted(used, pb), 0, len(used) - 1)
    return pd.DataFrame({"trid": every.trid, "part": used[at], "prior": alpha[at], "loglik": ll})
