"""Feature by sample matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivoted(long: DataFrame, row: str, col: str, value: str, cols: list) -> DataFrame:
    """One row per ``row``, one column per entry of cols, 0 where there is none."""
    return long.groupBy(row).pivot(col, cols).agg(F.sum(value)).fillna(0.0)


def size_factors(long: DataFrame) -> DataFrame:
    """Median over features of count / geometric mean, per sample; only features counted in every sample. long: feature, sample, cnt."""
    n = long.agg(F.count_distinct("sample").alias("m"))
    geo = long.filter("cnt > 0").groupBy("feature").agg(F.avg(F.log("cnt")).alias("lg"), F.count("*").alias("k")).crossJoin(F.broadcast(n)).filter("k = m").select("feature", "lg")
    x = long.join(geo, "feature").withColumn("ratio", F.exp(F.log("cnt") - F.col("lg")))
    return x.groupBy("sample").agg(F.percentile("ratio", 0.5).alias("factor"))


def lag_correlation(plus: DataFrame, minus: DataFrame, lags: list[int], positions: int) -> DataFrame:
    """Pearson's correlation of two position counts (chrom, pos, c), the first shifted by each lag; absent positions count as zero."""
    shifted = plus.select("chrom", F.explode(F.array(*map(F.lit, lags))).alias("lag"), "pos", "c").select("chrom", "lag", (F.col("pos") + F.col("lag")).alias("pos"), F.col("c").alias("p"))
    xy = shifted.join(minus.withColumnRenamed("c", "m"), ["chrom", "pos"]).groupBy("chrom", "lag").agg(F.sum(F.col("p") * F.col("m")).alias("xy"))
    sums = lambda d, a: d.groupBy("chrom").agg(F.sum("c").alias(f"s{a}"), F.sum(F.col("c") * F.col("c")).alias(f"q{a}"))
    base = sums(plus, "p").join(sums(minus, "m"), "chrom").crossJoin(F.broadcast(plus.sparkSession.createDataFrame([(i,) for i in lags], "lag int")))
    n = float(positions)
    x = base.join(xy, ["chrom", "lag"], "left").fillna(0, ["xy"])
    top = F.col("xy") - F.col("sp") * F.col("sm") / n
    low = F.sqrt((F.col("qp") - F.col("sp") * F.col("sp") / n) * (F.col("qm") - F.col("sm") * F.col("sm") / n))
    return x.select("chrom", "lag", F.when(low > 0, top / low).otherwise(0.0).alias("r"))
