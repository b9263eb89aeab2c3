"""Building transcript references from annotations and genome sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apportion.functions.scalar import splice
from apportion.operators.intervals import merge


def transcripts(exons: DataFrame) -> DataFrame:
    """transcript_id, gene_id, gene_name, transcript_name, seqname, strand, length, exons (merged, ascending), sid in order of (gene, transcript, seqname)."""
    keys = ["gene_id", "transcript_id", "seqname", "strand"]
    m = merge(exons, keys, gap=1)  # inclusive ends: neighbours merge
    g = m.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("exons"), F.sum(F.col("end") - F.col("start") + 1).cast("int").alias("length"))
    names = exons.groupBy(*keys).agg(F.min("gene_name").alias("gene_name"), F.min("transcript_name").alias("transcript_name"))
    return with_sids(g.join(names, keys))


def with_sids(t: DataFrame) -> DataFrame:
    """Numbers from 1 in order of (gene_id, transcript_id, seqname): places within a gene, and the sizes of the genes before."""
    genes = t.groupBy("gene_id").agg(F.count("*").alias("n"))
    before = genes.select("gene_id", F.coalesce(F.sum("n").over(Window.orderBy("gene_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a gene
    rn = F.row_number().over(Window.partitionBy("gene_id").orderBy("transcript_id", "seqname"))
    return t.withColumn("rn", rn).join(before, "gene_id").withColumn("sid", (F.col("before") + F.col("rn")).cast("int")).drop("rn", "before")


def sequences(t: DataFrame, genome: DataFrame) -> DataFrame:
    """t with seq; transcripts whose chromosome is missing are dropped (see ``missing``)."""
    return t.join(genome.select(F.col("name").alias("seqname"), F.col("seq").alias("chrom_seq")), "seqname").withColumn("seq", splice(F.col("chrom_seq"), F.col("exons"), F.col("strand"))).drop("chrom_seq")


def missing(t: DataFrame, genome: DataFrame) -> DataFrame:
    return t.join(genome.select(F.col("name").alias("seqname")), "seqname", "left_anti")


def from_gff3(features: DataFrame, rna: list[str] | None = None, genes_as_transcripts: bool = False) -> DataFrame:
    """Exon rows as of ``sources.text.gtf``: gene, transcript and exon are joined by Parent; coding and untranslated parts count as exons."""
    # The feature types.
    gene_types, exon_types = ("gene",), ("exon", "CDS", "five_prime_UTR", "three_prime_UTR", "UTR")
    f = features.withColumn("id", F.col("attrs")["ID"]).withColumn("name", F.col("attrs")["Name"])
    genes = f.filter(F.col("type").isin(*gene_types)).select(F.col("id").alias("gene_id"), F.col("name").alias("gene_name"))
    tr = f.filter(~F.col("type").isin(*gene_types, *exon_types))
    if rna:
        tr = tr.filter(F.col("type").isin(*rna))
    tr = tr.select(F.col("id").alias("transcript_id"), F.col("name").alias("transcript_name"), F.explode("parents").alias("gene_id")).join(genes, "gene_id")
    ex = f.filter(F.col("type").isin(*exon_types)).select(F.col("seqid").alias("seqname"), "source", "start", "end", "strand", F.explode("parents").alias("parent"))
    if genes_as_transcripts:
        tr = tr.select("gene_id", "gene_name", F.col("transcript_id").alias("parent")).withColumn("transcript_id", F.col("gene_id")).withColumn("transcript_name", F.col("gene_name"))
    else:
        tr = tr.withColumn("parent", F.col("transcript_id"))
    return ex.join(tr, "parent").select("seqname", "source", "start", "end", "strand", "gene_id", "transcript_id", "gene_name", "transcript_name")
