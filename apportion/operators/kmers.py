"""k-mer ambiguity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ambiguity(seqs: DataFrame, k: int) -> DataFrame:
    """name, score: the share of a sequence's k-mers (by place) that another sequence has as well; -1 if it is shorter than k.

    Two aggregations by k-mer hash out, no pairs: places per (k-mer, name) first, so a k-mer repeated within a sequence moves once.
    """
    at = F.when(F.length("seq") >= k, F.sequence(F.lit(1), F.length("seq") - k + 1)).otherwise(F.array().cast("array<int>"))
    x = seqs.select("name", F.explode(F.transform(at, lambda i: F.substring(F.col("seq"), i, F.lit(k)))).alias("kmer"))
    per = x.groupBy("kmer", "name").agg(F.count("*").alias("n"))
    owners = per.groupBy("kmer").agg(F.count("*").alias("owners"))
    g = per.join(owners, "kmer").groupBy("name").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("owners") > 1, F.col("n")).otherwise(0)).alias("shared"))
    return seqs.select("name").join(g, "name", "left").select("name", F.when(F.col("all").isNull(), -1.0).otherwise(F.col("shared") / F.col("all")).alias("score"))
