"""Headers of alignment files, as tables of lines; VCF and bedGraph records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apportion.operators.intervals import overlap_join
from apportion.sources.text import numbered_lines


def header(spark: SparkSession, path: str) -> DataFrame:
    """kind (HD, SQ, RG, PG, CO), attrs (a map; null for CO), line, ord."""
    x = numbered_lines(spark, path).filter(F.col("value").startswith("@"))
    kind = F.substring("value", 2, 2)
    attrs = F.str_to_map(F.regexp_replace("value", r"^@..\t", ""), F.lit("\t"), F.lit(":"))
    return x.select(kind.alias("kind"), F.when(kind != "CO", attrs).alias("attrs"), F.col("value").alias("line"), "ord")


def with_targets(h: DataFrame, targets: DataFrame) -> DataFrame:
    """The header with its targets replaced: targets has name and len."""
    first = h.agg(F.coalesce(F.min(F.when(F.col("kind") == "SQ", F.col("ord"))), F.lit(1)).alias("o"))
    new = targets.crossJoin(F.broadcast(first)).select(F.lit("SQ").alias("kind"), F.create_map(F.lit("SN"), F.col("name"), F.lit("LN"), F.col("len").cast("string")).alias("attrs"), F.concat_ws("", F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("len").cast("string")).alias("line"), F.col("o").alias("ord"))
    return h.filter("kind != 'SQ'").unionByName(new)


def with_program(h: DataFrame, pid: str, **attrs: str) -> DataFrame:
    """One more program line, unless the id is there."""
    if h.filter((F.col("kind") == "PG") & (F.col("attrs")["ID"] == pid)).limit(1).count():
        return h
    spark = h.sparkSession
    every = {"ID": pid, **attrs}
    line = "@PG\t" + "\t".join(f"{k}:{v}" for k, v in every.items())
    return h.unionByName(spark.createDataFrame([("PG", every, line, 1 << 60)], "kind string, attrs map<string,string>, line string, ord long"))


def renamed_ids(first: DataFrame, second: DataFrame, kind: str) -> DataFrame:
    """id, new: the ids of one kind in the second header, renamed where the first has them already."""
    ids = lambda h: h.filter(F.col("kind") == kind).select(F.col("attrs")["ID"].alias("id"))
    taken = ids(first).withColumn("taken", F.lit(True))
    return ids(second).join(taken, "id", "left").select("id", F.when(F.col("taken"), F.concat(F.col("id"), F.lit("-"), F.substring(F.md5(F.col("id").cast("binary")), 1, 8))).otherwise(F.col("id")).alias("new"))


def with_read_group(records: DataFrame, group: str, orphans_only: bool = False) -> DataFrame:
    own = F.coalesce(F.col("tags")["RG"], F.lit(group)) if orphans_only else F.lit(group)
    rest = F.map_filter("tags", lambda k, _: k != "RG")
    return records.withColumn("tags", F.map_concat(rest, F.create_map(F.lit("RG"), own)))


def vcf(spark: SparkSession, path) -> DataFrame:
    """chrom, pos, id, ref, alts, qual, filter, info, samples (the columns after FORMAT)."""
    f = F.split("value", "\t")
    x = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(f) >= 8))
    info = F.str_to_map(f[7], F.lit(";"), F.lit("="))
    return x.select(f[0].alias("chrom"), f[1].cast("int").alias("pos"), f[2].alias("id"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"), f[5].try_cast("double").alias("qual"), f[6].alias("filter"), info.alias("info"), F.slice(f, 10, 1 << 20).alias("samples"))


def merged_variants(a: DataFrame, b: DataFrame) -> DataFrame:
    """Variants of two files side by side by position and alleles, where either has them."""
    k = ["chrom", "pos", "ref", "alts"]
    x = lambda v, p: v.select(*k, *[F.col(c).alias(f"{p}_{c}") for c in v.columns if c not in k])
    return x(a, "a").join(x(b, "b"), k, "full_outer")


def subsequence(genome: DataFrame, name: str, start: int, end: int) -> DataFrame:
    """start and end 1-based, inclusive."""
    return genome.filter(F.col("name") == name).select("name", F.substring("seq", start, end - start + 1).alias("seq"))


def region_mean(signal: DataFrame, regions: DataFrame, width: int = 4096) -> DataFrame:
    """Mean over the covered bases of each region (id, chrom, start, end) of a bedGraph's values (chrom, start, end, value); null where nothing is covered."""
    j = overlap_join(regions, signal, width)
    n = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    g = j.groupBy(F.col("a_id").alias("id")).agg((F.sum(n * F.col("b_value")) / F.sum(n)).alias("mean"), F.max("b_value").alias("max"))
    return regions.select("id").join(g, "id", "left")
