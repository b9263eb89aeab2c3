"""Whole flows: build a reference, parse alignments, quantify, compare conditions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apportion.functions.scalar import any_flag, low_quality, mapq_from_posterior, reverse_complement, single_match
from apportion.operators import alignment, em, matrix, model, ordered, reference, sampling
from apportion.sources import tables, text

SEED, TAIL = 25, 125


def prepare_reference(genome: DataFrame, exons: DataFrame, mapping: DataFrame | None = None, tail: int = 0, exempt: DataFrame | None = None) -> DataFrame:
    """sid, transcript_id, gene_id, seqname, strand, exons, seq, full_len, tot_len, mask_from. mapping (gene_id, transcript_id) replaces the genes of the annotation; ``exempt`` (transcript_id) gets no tail."""
    if mapping is not None:
        m = mapping.select("transcript_id", F.col("gene_id").alias("own_gene"))
        exons = exons.join(m, "transcript_id", "left").withColumn("gene_id", F.coalesce("own_gene", F.raise_error(F.concat(F.lit("no gene for "), "transcript_id")))).drop("own_gene")
    t = reference.sequences(reference.transcripts(exons), genome).withColumn("seq", F.upper("seq"))
    full = F.length("seq")
    if not tail:
        return t.withColumn("full_len", full).withColumn("tot_len", full).withColumn("mask_from", F.lit(None).cast("int"))
    plain = F.lit(False)
    if exempt is not None:
        t = t.join(exempt.select("transcript_id", F.lit(True).alias("plain")), "transcript_id", "left")
        plain = F.coalesce(F.col("plain"), F.lit(False))
    t = t.withColumn("full_len", full).withColumn("mask_from", F.when(~plain, F.greatest(F.col("full_len") - SEED + 1, F.lit(0))))
    t = t.withColumn("seq", F.when(plain, F.col("seq")).otherwise(F.concat("seq", F.repeat(F.lit("A"), tail)))).withColumn("tot_len", F.length("seq"))
    return t.drop("plain")


@dataclass
class Parsed:
    reads: DataFrame
    hits: DataFrame
    counts: DataFrame
    omitted: DataFrame


def parse_alignments(records: DataFrame, targets: DataFrame, paired: bool = False, seed: int = SEED, tail: bool = False) -> Parsed:
    """reads (rid, cls, seq1, qual1, seq2, qual2, low), hits (rid, ord, sid, dir, pos, insert_len and the read), class counts, and targets that no header or record names."""
    rev = any_flag(F.col("flag"), "REVERSE")
    first = ~any_flag(F.col("flag"), "READ2")
    w = Window.partitionBy("qname")
    x = records.withColumn("rid", F.min("ord").over(w)).withColumn("cls", alignment.read_class(paired)).withColumn("first", first)
    x = x.withColumn("s", F.when(rev, reverse_complement(F.upper("seq"))).otherwise(F.upper("seq"))).withColumn("q", F.when(rev, F.reverse("qual")).otherwise(F.col("qual")))
    side = lambda c, f, n: F.max(F.when(F.col("first") == f, F.col(c))).alias(n)
    reads = x.groupBy("rid").agg(F.max("cls").alias("cls"), side("s", True, "seq1"), side("q", True, "qual1"), side("s", False, "seq2"), side("q", False, "qual2"))
    low = lambda c: low_quality(F.col(c), seed) if tail else F.length(c) < seed
    is_low = low("seq1") if not paired else (F.least(F.length("seq1"), F.length("seq2")) < seed) | (low("seq1") & low("seq2"))
    reads = reads.withColumn("low", F.coalesce(is_low, F.lit(False)))
    gapped = F.when(~single_match(F.col("cigar"), F.length("seq")), F.raise_error(F.concat(F.lit("gapped alignment: "), "qname"))).otherwise(F.length("seq"))
    k = F.row_number().over(Window.partitionBy("rid", "first").orderBy("ord"))
    a = x.filter("cls = 1").withColumn("n", gapped).withColumn("k", k).withColumn("rev", rev).select("rid", "k", "first", "rname", "rev", (F.col("pos") - 1).alias("p"), "n")
    one = a.filter("first")
    if paired:
        two = a.filter("not first").select("rid", "k", F.col("rname").alias("rname2"), F.col("p").alias("p2"), F.col("n").alias("n2"))
        one = one.join(two, ["rid", "k"]).filter("rname = rname2")
        start, end = F.least("p", "p2"), F.greatest(F.col("p") + F.col("n"), F.col("p2") + F.col("n2"))
    else:
        start, end = F.col("p"), F.col("p") + F.col("n")
    one = one.select("rid", F.col("k").cast("int").alias("ord"), "rname", "rev", start.alias("start"), (end - start).alias("insert_len"))
    t = targets.select("sid", F.col("transcript_id").alias("rname"), "tot_len")
    h = one.join(t, "rname")
    h = h.select("rid", "ord", "sid", F.col("rev").cast("int").alias("dir"), F.when(F.col("rev"), F.col("tot_len") - F.col("start") - F.col("insert_len")).otherwise(F.col("start")).alias("pos"), "insert_len")
    hits = h.join(reads.select("rid", "seq1", "qual1", "seq2", "qual2", "low"), "rid")
    return Parsed(reads, hits, reads.groupBy("cls").agg(F.count("*").alias("n")), targets.join(records.select(F.col("rname").alias("transcript_id")).distinct(), "transcript_id", "left_anti"))


@dataclass
class Quantified:
    isoforms: DataFrame
    genes: DataFrame
    posteriors: DataFrame
    model: model.Model


def quantify(parsed: Parsed, targets: DataFrame, forward: float = 0.5, fragment: tuple[float, float] | None = None, shortest: int = 1, longest: int = 1000, learn_positions: bool = False, model_rounds: int = 10, write=tables.cut_lineage) -> Quantified:
    """Learn the read model, resolve the hits and give abundances per transcript and gene.

    fragment: mean and deviation of the fragments of single reads; else they are learned from the hits.
    """
    one = parsed.hits.withColumn("one", F.lit(1.0))
    seen = model.observed_lengths(one, "insert_len", "one")
    fragments = model.normal_lengths(*fragment, shortest, longest) if fragment else seen
    n = parsed.reads.select(F.explode(F.array(F.length("seq1"), F.length("seq2"))).alias("l")).filter("l is not null").withColumn("one", F.lit(1.0))
    m = model.Model(forward, fragments, model.observed_lengths(n, "l", "one"), model.Positions(np.ones(model.BINS)) if learn_positions else model.Positions(), model.initial_errors(), model.noise_from(_unaligned(parsed.reads)))
    refs = targets.select("sid", "seq", "full_len", "tot_len", "mask_from").withColumn("mw", F.lit(1.0))
    hits = write(model.with_reference(parsed.hits, refs))
    noise = write(model.noise_probabilities(parsed.reads.filter("cls = 1"), m))
    m, theta, post = model.fit(hits, m, model_rounds, learn_positions, noise, write)
    theta = em.run(post.select("rid", "sid", "conprb"), least=5, most=200, write=write)
    post = em.posteriors(post.drop("frac", "theta", "noise"), theta)
    counts = em.expected_counts(post)
    lengths = targets.sparkSession.createDataFrame([(m.fragments.low + i, float(p)) for i, p in enumerate(m.fragments.p)], "l int, p double")
    x = em.effective_lengths(targets.select("sid", "full_len", "tot_len"), lengths).withColumn("mw", F.lit(1.0))
    x = x.join(theta, "sid", "left").join(counts, "sid", "left").fillna(0.0, ["theta", "cnt"])
    x = em.abundances(em.polish(x)).join(targets.select("sid", "transcript_id", "gene_id"), "sid").withColumn("length", F.col("full_len"))
    x = write(x)
    iso = x.withColumn("IsoPct", em.share_of("tpm", "gene_id", "IsoPct")).select("transcript_id", "gene_id", "length", F.col("eel").alias("effective_length"), F.col("cnt").alias("expected_count"), F.col("tpm").alias("TPM"), F.col("fpkm").alias("FPKM"), "IsoPct")
    genes = em.rollup_weighted(x, "gene_id").join(em.ordered_members(x, "gene_id", "sid", "transcript_id").withColumnRenamed("members", "transcript_id(s)"), "gene_id")
    genes = genes.select("gene_id", "transcript_id(s)", "length", F.col("eel").alias("effective_length"), F.col("cnt").alias("expected_count"), F.col("tpm").alias("TPM"), F.col("fpkm").alias("FPKM"))
    return Quantified(iso, genes, post.select("rid", "ord", "sid", F.col("frac").cast("float").alias("weight"), mapq_from_posterior(F.col("frac")).alias("mapq")), m)


def _unaligned(reads: DataFrame) -> DataFrame:
    side = lambda k: reads.filter(f"cls = 0 and seq{k} is not null").select(F.col(f"seq{k}").alias("seq"), F.col(f"qual{k}").alias("qual"))
    return side(1).union(side(2))


def intervals(post: DataFrame, lengths: DataFrame, chains: int = 4, burn_in: int = 200, samples: int = 1000, draws: int = 50, confidence: float = 0.95, pseudo: float = 1.0, seed: int = 0, write=tables.cut_lineage) -> DataFrame:
    """sid, mean and variance of counts, credibility bounds of TPM and their quartile variation. lengths: sid, eel."""
    c = write(sampling.gibbs(post, chains, burn_in, samples, 1, pseudo, seed))
    m = em.moments(c, "sid", "cnt")
    d = write(sampling.resample_theta(c, lengths, draws, pseudo, seed).withColumn("tpm", F.col("tpm").cast("double")))
    return m.join(em.shortest_interval(d, "sid", "tpm", confidence), "sid").join(em.quartile_variation(d, "sid", "tpm"), "sid")


def data_matrix(results: dict[str, DataFrame], feature: str = "gene_id", value: str = "expected_count") -> DataFrame:
    """One row a feature, one column a sample; every sample must have the same features."""
    long = None
    for name, r in results.items():
        x = r.select(F.col(feature).alias("feature"), F.lit(name).alias("sample"), F.col(value).alias("cnt"))
        long = x if long is None else long.unionByName(x)
    n = len(results)
    uneven = long.groupBy("feature").agg(F.count_distinct("sample").alias("n")).filter(F.col("n") != n)
    if uneven.limit(1).count():
        raise ValueError(f"samples differ in their features, for example {uneven.first()[0]}")
    return matrix.pivoted(long, "feature", "sample", "cnt", list(results))


def differential(long: DataFrame, alpha: float = 0.05, soft: bool = False, rounds: int = 5) -> DataFrame:
    """long (feature, sample, cond, cnt) to the features that differ at the false-discovery rate, by falling ppde."""
    f = matrix.size_factors(long.select("feature", "sample", "cnt"))
    x = long.join(f, "sample").withColumn("cnt", F.col("cnt") / F.col("factor"))
    t = sampling.nb_two_conditions(x, rounds).withColumn("all", F.lit(0))
    return ordered.fdr_prefix(t, ["all"], [F.desc("ppde"), "feature"], "ppee", alpha, soft).drop("all").orderBy(F.desc("ppde"))


def from_files(spark: SparkSession, fasta: str, gtf: str, sam: str, paired: bool = False) -> Quantified:
    t = tables.cut_lineage(prepare_reference(text.fasta(spark, fasta), text.gtf(spark, gtf)))
    return quantify(parse_alignments(tables.cut_lineage(text.sam(spark, sam)), t, paired), t)
