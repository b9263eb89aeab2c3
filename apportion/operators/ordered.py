"""Order-dependent operators: capping, picking, prefixes, runs, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """At most so many rows of each key, in order."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= most).drop("rn")


def best(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row of each key with the greatest score, the least ``tie`` among equals."""
    return cap(df, keys, [F.desc(score), F.asc(tie)], 1)


def mates(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Neighbours in order two by two (0 with 1, 2 with 3): each row with its mate's columns as mate_*."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.row_number().over(w)
    x = df.withColumn("rn", n)
    for c in cols:
        x = x.withColumn(f"mate_{c}", F.when(F.col("rn") % 2 == 1, F.lead(c).over(w)).otherwise(F.lag(c).over(w)))
    return x.drop("rn")


def group_changes(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Numbers the stretches of equal neighbouring values: column run."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.withColumn("new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1))
    return x.withColumn("run", F.sum("new").over(w)).drop("new")


def running_mean(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.avg(value).over(w))


def fdr_prefix(df: DataFrame, keys: list[str], order: list, error: str, alpha: float, soft: bool) -> DataFrame:
    """The rows before the first one whose error (or running mean of errors, if soft) is over alpha."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = F.avg(error).over(w) if soft else F.col(error)
    x = df.withColumn("bad", F.when(e > alpha, 1).otherwise(0))
    return x.withColumn("bad", F.sum("bad").over(w)).filter("bad = 0").drop("bad")


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Column rank: ranks from 1, equal values share their mean rank."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return df.withColumn("rank", F.rank().over(w) + (ties - 1) / 2.0)


def rank_sum(df: DataFrame, keys: list[str], value: str, flag: str) -> DataFrame:
    """Wilcoxon's rank sum of flagged rows against the others: w, n1, n2 and z of the normal approximation (no tie correction)."""
    g = average_ranks(df, keys, value).groupBy(*keys).agg(F.sum(F.when(F.col(flag), F.col("rank")).otherwise(0.0)).alias("w"), F.count_if(F.col(flag)).alias("n1"), F.count_if(~F.col(flag)).alias("n2"))
    mean = F.col("n1") * (F.col("n1") + F.col("n2") + 1) / 2.0
    sd = F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12.0)
    return g.withColumn("z", F.when(sd > 0, (F.col("w") - mean) / sd))


def cutoff_counts(df: DataFrame, keys: list[str], value: str, cutoffs: list[float]) -> DataFrame:
    """How many rows of each key are at most each cutoff: one pass, cutoffs as columns, then unpivoted."""
    g = df.groupBy(*keys).agg(*[F.count_if(F.col(value) <= c).alias(f"c{i}") for i, c in enumerate(cutoffs)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"c{i}").alias("n")) for i, c in enumerate(cutoffs)]))
    return g.select(*keys, each.alias("e")).select(*keys, "e.cutoff", "e.n")


def kmeans_1d(df: DataFrame, value: str, centres: list[float], rounds: int) -> DataFrame:
    """Lloyd's rounds from given centres on a line; clusters are numbered by ascending centre. Returns df with cluster."""

    def nearest(cs: list[float]) -> Column:
        out = F.lit(len(cs))
        for i in range(len(cs) - 1, 0, -1):
            out = F.when(F.col(value) <= (cs[i - 1] + cs[i]) / 2, i).otherwise(out)
        return out

    cs = sorted(centres)
    for _ in range(rounds):
        got = {r["c"]: r["m"] for r in df.groupBy(nearest(cs).alias("c")).agg(F.avg(value).alias("m")).collect()}  # one number a cluster
        cs = sorted(got.get(i + 1, c) for i, c in enumerate(cs))
    return df.withColumn("cluster", nearest(cs))
