"""Bases over positions, and counts over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apportion.functions.scalar import any_flag


def bases(records: DataFrame, min_quality: int = 0, drop: tuple[str, ...] = ("UNMAP", "SECONDARY", "QCFAIL", "DUP")) -> DataFrame:
    """A row for each base, deletion or skip over a position: rname, pos (1-based), base ('*' deleted, '>' skipped), quality, reverse, qname, ord."""
    upto = lambda kinds, i: F.aggregate(F.filter(F.slice("cigar", F.lit(1), i), lambda z: z["op"].isin(*kinds)), F.lit(0), lambda a, z: a + z["len"])
    part = F.transform("cigar", lambda o, i: F.struct(o["op"].alias("op"), o["len"].alias("n"), upto("MIS=X", i).alias("q"), upto("MDN=X", i).alias("r")))
    x = records.filter(~any_flag(F.col("flag"), *drop))
    x = x.select("rname", "pos", "seq", "qual", "qname", "ord", any_flag(F.col("flag"), "REVERSE").alias("reverse"), F.explode(F.filter(part, lambda o: o["op"].isin("M", "=", "X", "D", "N"))).alias("o"))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.col("o.n") - 1)).alias("k"))
    match = F.col("o.op").isin("M", "=", "X")
    at = F.col("o.q") + F.col("k") + 1
    base = F.when(match, F.upper(F.substring(F.col("seq"), at, F.lit(1)))).when(F.col("o.op") == "D", "*").otherwise(">")
    x = x.select("rname", (F.col("pos") + F.col("o.r") + F.col("k")).alias("pos"), base.alias("base"), F.when(match, F.ascii(F.substring(F.col("qual"), at, F.lit(1))) - 33).alias("quality"), "reverse", "qname", "ord")
    return x.filter(F.col("quality").isNull() | (F.col("quality") >= min_quality))


def columns(b: DataFrame, genome: DataFrame | None = None) -> DataFrame:
    """rname, pos, depth, bases, quals: each position's bases in input order, lower case on the reverse strand; '.' and ',' where they agree with the genome (name, seq)."""
    shown = F.when(F.col("reverse"), F.lower("base")).otherwise(F.col("base"))
    if genome is not None:
        b = b.join(genome.select(F.col("name").alias("rname"), "seq"), "rname").withColumn("ref", F.upper(F.substring(F.col("seq"), F.col("pos"), F.lit(1))))
        shown = F.when(F.col("base") == F.col("ref"), F.when(F.col("reverse"), ",").otherwise(".")).otherwise(shown)
    g = b.groupBy("rname", "pos").agg(F.sort_array(F.collect_list(F.struct("ord", shown.alias("b"), F.coalesce(F.char(F.col("quality") + 33), F.lit("!")).alias("q")))).alias("a"))
    return g.select("rname", "pos", F.size("a").alias("depth"), F.array_join(F.transform("a", lambda x: x["b"]), "").alias("bases"), F.array_join(F.transform("a", lambda x: x["q"]), "").alias("quals"))


def allele_counts(b: DataFrame) -> DataFrame:
    """rname, pos and the number of each base: partial sums, no lists."""
    return b.groupBy("rname", "pos").agg(*[F.count_if(F.col("base") == c).alias(c) for c in "ACGT"], F.count_if(F.col("base") == "*").alias("deleted"))


def genotypes(counts: DataFrame, error: float = 0.01) -> DataFrame:
    """The most likely diploid genotype of each position from its counts: gt, and the log-likelihoods' lead over the next."""
    pairs = [(a, b) for i, a in enumerate("ACGT") for b in "ACGT"[i:]]
    p = lambda g, c: (1 - error if g[0] == g[1] else (1 - error) / 2 + error / 6) if c in g else error / 3
    ll = [F.struct(sum(F.col(c) * F.log(F.lit(p(g, c))) for c in "ACGT").alias("ll"), F.lit("".join(g)).alias("gt")) for g in pairs]
    x = counts.withColumn("best", F.sort_array(F.array(*ll), asc=False))
    return x.select("rname", "pos", F.col("best")[0]["gt"].alias("gt"), (F.col("best")[0]["ll"] - F.col("best")[1]["ll"]).alias("lead"))


def overlap_fixed(b: DataFrame) -> DataFrame:
    """Where two mates of a name cover a position, only the base of better quality stays (of equals the first)."""
    from pyspark.sql import Window

    w = Window.partitionBy("qname", "rname", "pos").orderBy(F.desc("quality"), "ord")
    return b.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
