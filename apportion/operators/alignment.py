"""Filters, counters and rules over alignment records (see ``sources.sam`` for the columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apportion.functions.scalar import any_flag, cigar_length, has_flags, single_match


def view(df: DataFrame, min_mapq: int = 0, require: int = 0, exclude: int = 0, min_length: int = 0, keep: float = 1.0, seed: int = 0) -> DataFrame:
    """Records by quality, flags and length; ``keep`` takes that share of names, all records of a name alike."""
    f = F.col("flag")
    out = df.filter((F.col("mapq") >= min_mapq) & (f.bitwiseAND(F.lit(require)) == require) & (f.bitwiseAND(F.lit(exclude)) == 0))
    if min_length and "cigar" in df.columns:
        out = out.filter(cigar_length(F.col("cigar"), "MIS=X") >= min_length)
    return out if keep >= 1 else out.filter(F.pmod(F.xxhash64("qname", F.lit(seed)), F.lit(1 << 24)) < int(keep * (1 << 24)))


def read_class(paired: bool = False, tag: str = "XM") -> Column:
    """1 aligned, 2 suppressed (unmapped, its tag above 0), 0 neither."""
    unmapped = any_flag(F.col("flag"), "UNMAP") | (any_flag(F.col("flag"), "MUNMAP") if paired else F.lit(False))
    return F.when(~unmapped, 1).when(F.coalesce(F.col("tags")[tag].try_cast("int"), F.lit(0)) > 0, 2).otherwise(0)


def unique_alignments(df: DataFrame, paired: bool = False) -> DataFrame:
    """Records of the names that have just one alignment (two records if paired), none unmapped."""
    w = Window.partitionBy("qname")
    x = df.withColumn("n", F.count("*").over(w)).withColumn("un", F.max(any_flag(F.col("flag"), "UNMAP").cast("int")).over(w))
    return x.filter((F.col("n") == (2 if paired else 1)) & (F.col("un") == 0)).drop("n", "un")


def flagstat(df: DataFrame) -> DataFrame:
    """Thirteen counters for each QC class."""
    f = F.col("flag")
    sec = any_flag(f, "SECONDARY")
    sup = ~sec & any_flag(f, "SUPPLEMENTARY")
    pair = ~sec & ~any_flag(f, "SUPPLEMENTARY") & any_flag(f, "PAIRED")
    mapped, mate = ~any_flag(f, "UNMAP"), ~any_flag(f, "MUNMAP")
    apart = pair & mapped & mate & (F.col("rnext") != F.col("rname")) & (F.col("rnext") != "=")
    counters = {
        "total": F.lit(True), "secondary": sec, "supplementary": sup, "duplicates": any_flag(f, "DUP"), "mapped": mapped, "paired": pair,
        "read1": pair & any_flag(f, "READ1"), "read2": pair & any_flag(f, "READ2"), "proper": pair & mapped & any_flag(f, "PROPER_PAIR"), "both_mapped": pair & mapped & mate,
        "singletons": pair & mapped & ~mate, "mate_elsewhere": apart, "mate_elsewhere_q5": apart & (F.col("mapq") >= 5),
    }
    return df.groupBy(any_flag(f, "QCFAIL").alias("failed")).agg(*[F.count_if(c).alias(n) for n, c in counters.items()])


def idxstats(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Mapped and unmapped records of each target, zero rows included."""
    g = df.groupBy(F.col("rname").alias("name")).agg(F.count_if(~any_flag(F.col("flag"), "UNMAP")).alias("mapped"), F.count_if(any_flag(F.col("flag"), "UNMAP")).alias("unmapped"))
    return targets.join(g, "name", "left").fillna(0, ["mapped", "unmapped"])


def broken_rules(df: DataFrame) -> DataFrame:
    """rule, n: how many records break each rule of an input for quantification."""
    w = Window.partitionBy("qname")
    x = df.withColumn("n_pair", F.sum(any_flag(F.col("flag"), "PAIRED").cast("int")).over(w)).withColumn("n_all", F.count("*").over(w)).withColumn("n_len", F.size(F.collect_set(F.struct(any_flag(F.col("flag"), "READ1"), F.length("seq"))).over(w)))
    mapped = ~any_flag(F.col("flag"), "UNMAP")
    rules = {
        "gapped": mapped & ~single_match(F.col("cigar"), F.length("seq")),
        "mixed_pairing": (F.col("n_pair") > 0) & (F.col("n_pair") < F.col("n_all")),
        "one_mate_mapped": any_flag(F.col("flag"), "PAIRED") & (any_flag(F.col("flag"), "UNMAP") != any_flag(F.col("flag"), "MUNMAP")),
        "same_strand": mapped & any_flag(F.col("flag"), "PAIRED") & (any_flag(F.col("flag"), "REVERSE") == any_flag(F.col("flag"), "MREVERSE")),
        "odd_mates": any_flag(F.col("flag"), "PAIRED") & (F.col("n_all") % 2 == 1),
        "unequal_lengths": F.col("n_len") > 2,
    }
    g = x.agg(*[F.count_if(c).alias(r) for r, c in rules.items()])
    return g.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules])).alias("e")).select("e.*")


def duplicates_removed(df: DataFrame) -> DataFrame:
    """Pairs with equal target, position and insert length: only the one with the greatest sum of base qualities stays, with its mate."""
    cand = has_flags(F.col("flag"), "PAIRED") & ~any_flag(F.col("flag"), "UNMAP", "MUNMAP") & F.col("rnext").isin("=") & (F.col("tlen") > 0)
    q = F.aggregate(F.transform(F.split("qual", ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c) - 33)), F.lit(0), lambda a, v: a + v)
    heads = df.filter(cand).withColumn("q", q)
    rn = F.row_number().over(Window.partitionBy("rname", "pos", "tlen").orderBy(F.desc("q"), "ord"))
    gone = heads.withColumn("rn", rn).filter("rn > 1").select("qname").distinct()
    return df.join(gone, "qname", "left_anti")


def collapsed(df: DataFrame) -> DataFrame:
    """Equal placements (qname, rname, pos, strand, cigar) as one record, their weights summed in single precision."""
    return df.groupBy("qname", "rname", "pos", any_flag(F.col("flag"), "REVERSE").alias("reverse"), "cigar_text").agg(F.sum(F.col("weight").cast("float")).cast("float").alias("weight"))


def markov_counts(df: DataFrame, text: str) -> DataFrame:
    """Transitions between neighbouring characters: a, b, n. ('' is the start.)"""
    pairs = F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda i: F.struct(F.when(i == 0, F.lit("")).otherwise(F.substring(F.col(text), i, F.lit(1))).alias("a"), F.substring(F.col(text), i + 1, F.lit(1)).alias("b")))
    x = df.filter(F.length(text) > 0).select(F.explode(pairs).alias("p"))
    return x.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
