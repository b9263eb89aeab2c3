"""Readers of sequence, annotation, alignment and interval text formats. All return DataFrames and read in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apportion.functions.scalar import cigar_ops, soft_masked_bases


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path)


def _must(ok: Column, value: Column, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(what + ": "), F.coalesce(value.cast("string"), F.lit("null")))).cast("string"))


def fasta(spark: SparkSession, path, whole_header: bool = False) -> DataFrame:
    """name, seq: the name is the header's first word (or all of it); other characters than letters are refused; case is kept and unknown bases become N or n."""
    x = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v"))
    head = F.regexp_extract("v", r"^([^\n\r]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("v", r"^[^\n]*(\n|$)", ""), r"\s", "")
    x = x.select((head if whole_header else F.split(head, r"\s")[0]).alias("name"), seq.alias("seq")).filter("name != '' or seq != ''")
    return x.select("name", soft_masked_bases(_must(F.col("seq").rlike("^[A-Za-z]*$"), F.col("seq"), "not a sequence")).alias("seq"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """ord, value: lines with their number in the input."""
    rdd = spark.sparkContext.textFile(path).zipWithIndex().map(lambda x: (x[1], x[0]))
    return spark.createDataFrame(rdd, "ord long, value string")


def fastq(spark: SparkSession, path: str, quality: bool = True) -> DataFrame:
    """rid, name, seq, qual: records of four lines (two without quality)."""
    n = 4 if quality else 2
    x = numbered_lines(spark, path).select(F.floor(F.col("ord") / n).alias("rid"), (F.col("ord") % n).alias("k"), "value")
    g = x.groupBy("rid").agg(*[F.max(F.when(F.col("k") == i, F.col("value"))).alias(f"l{i}") for i in range(n)])
    return g.select("rid", F.split(F.substring("l0", 2, 1 << 30), r"\s")[0].alias("name"), F.col("l1").alias("seq"), (F.col("l3") if quality else F.lit(None).cast("string")).alias("qual"))


def read_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates of two files by record number."""
    return first.select("rid", "name", F.col("seq").alias("seq1"), F.col("qual").alias("qual1")).join(second.select("rid", F.col("seq").alias("seq2"), F.col("qual").alias("qual2")), "rid")


def gtf(spark: SparkSession, path, sources: list[str] | None = None) -> DataFrame:
    """Exon rows: seqname, source, start, end, strand, gene_id, transcript_id, gene_name, transcript_name. Rows that are empty or begin before 1 are dropped."""
    f = F.split("value", "\t")
    x = _lines(spark, path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(f[0].alias("seqname"), f[1].alias("source"), f[2].alias("feature"), f[3].try_cast("int").alias("start"), f[4].try_cast("int").alias("end"), f[6].alias("strand"), f[8].alias("attrs"))
    x = x.filter("feature = 'exon' and start <= end and start >= 1")
    if sources:
        x = x.filter(F.col("source").isin(*sources))
    attr = lambda k: F.regexp_extract("attrs", rf'(?:^|;)\s*{k}\s+"([^"]*)"', 1)
    need = lambda k: _must(attr(k) != "", attr(k), f"no {k}")
    strand = _must(F.col("strand").isin("+", "-"), F.col("strand"), "bad strand")
    return x.select("seqname", "source", "start", "end", strand.alias("strand"), need("gene_id").alias("gene_id"), need("transcript_id").alias("transcript_id"), F.nullif(attr("gene_name"), F.lit("")).alias("gene_name"), F.nullif(attr("transcript_name"), F.lit("")).alias("transcript_name"))


def gff3(spark: SparkSession, path) -> DataFrame:
    """seqid, source, type, start, end, strand, attrs (a map), parents; what follows ##FASTA must be in another file."""
    f = F.split("value", "\t")
    x = _lines(spark, path).filter(~F.col("value").startswith("#") & (F.size(f) >= 9))
    attrs = F.str_to_map(F.regexp_replace(f[8], r";\s*$", ""), F.lit(";"), F.lit("="))
    return x.select(f[0].alias("seqid"), f[1].alias("source"), f[2].alias("type"), f[3].cast("int").alias("start"), f[4].cast("int").alias("end"), f[6].alias("strand"), attrs.alias("attrs")).withColumn("parents", F.split(F.coalesce(F.col("attrs")["Parent"], F.lit("")), ","))


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, transcript_id, allele_id (null with two columns); the last line of a key wins."""
    x = numbered_lines(spark, path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    key = F.element_at("f", -1)
    x = x.groupBy(key.alias("key")).agg(F.max_by("f", "ord").alias("f"))
    return x.select(F.col("f")[0].alias("gene_id"), F.col("f")[1].alias("transcript_id"), F.get("f", F.lit(2)).alias("allele_id"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records: qname, flag, rname, pos (1-based), mapq, cigar (array of op and len), cigar_text, rnext, pnext, tlen, seq, qual, tags (name to value), ord."""
    f = F.split("value", "\t")
    x = numbered_lines(spark, path).filter(~F.col("value").startswith("@") & (F.size(f) >= 11))
    tag = lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, 6, 1 << 30).alias("v"))
    return x.select(f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("rname"), f[3].cast("int").alias("pos"), f[4].cast("int").alias("mapq"), cigar_ops(f[5]).alias("cigar"), f[5].alias("cigar_text"), f[6].alias("rnext"), f[7].cast("int").alias("pnext"), f[8].cast("int").alias("tlen"), f[9].alias("seq"), f[10].alias("qual"), F.map_from_entries(F.transform(F.slice(f, 12, 1 << 20), tag)).alias("tags"), "ord")


def sam_targets(spark: SparkSession, path: str) -> DataFrame:
    """name, len, ord of the @SQ lines."""
    x = numbered_lines(spark, path).filter(F.col("value").startswith("@SQ"))
    return x.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("int").alias("len"), "ord")


def bed(spark: SparkSession, path) -> DataFrame:
    """chrom, start, end, name, score, strand: blank, comment, browser and track lines are skipped; two columns are a 1-based position."""
    f = F.split("value", r"[\t ]+")
    x = _lines(spark, path).filter((F.trim("value") != "") & ~F.col("value").startswith("#") & F.get(f, F.lit(1)).try_cast("int").isNotNull())
    two = F.get(f, F.lit(2)).try_cast("int").isNull()
    return x.select(f[0].alias("chrom"), F.when(two, f[1].try_cast("int") - 1).otherwise(f[1].try_cast("int")).alias("start"), F.when(two, f[1].try_cast("int")).otherwise(F.get(f, F.lit(2)).try_cast("int")).alias("end"), F.get(f, F.lit(3)).alias("name"), F.get(f, F.lit(4)).alias("score"), F.get(f, F.lit(5)).alias("strand"))


def peaks(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, start int, end int, name string, score int, strand string, signal double, p double, q double, summit int")


def results(spark: SparkSession, path, schema: str | None = None) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema) if schema else spark.read.csv(path, sep="\t", header=True, inferSchema=True)


def write_fasta(seqs: DataFrame, path: str) -> None:
    seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.text(path)


def write_sam(records: DataFrame, path: str) -> None:
    tags = F.array_join(F.transform(F.map_entries("tags"), lambda t: F.concat(t["key"], F.lit(":Z:"), t["value"])), "\t")
    cols = ["qname", "flag", "rname", "pos", "mapq", "cigar_text", "rnext", "pnext", "tlen", "seq", "qual"]
    records.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in cols], F.nullif(tags, F.lit(""))).alias("value")).write.text(path)


def fastq_export(records: DataFrame, suffix: bool = True) -> DataFrame:
    """mate (0, 1, 2) and the four lines of each primary record; reverse records are turned back."""
    from apportion.functions.scalar import any_flag, reverse_complement

    rev = any_flag(F.col("flag"), "REVERSE")
    mate = F.when(any_flag(F.col("flag"), "READ1"), 1).when(any_flag(F.col("flag"), "READ2"), 2).otherwise(0)
    name = F.concat(F.col("qname"), F.when((mate > 0) & F.lit(suffix), F.concat(F.lit("/"), mate.cast("string"))).otherwise(""))
    s, q = F.when(rev, reverse_complement(F.col("seq"))).otherwise(F.col("seq")), F.when(rev, F.reverse("qual")).otherwise(F.col("qual"))
    return records.filter(~any_flag(F.col("flag"), "SECONDARY", "SUPPLEMENTARY")).select(mate.alias("mate"), F.concat(F.lit("@"), name, F.lit("\n"), s, F.lit("\n+\n"), q).alias("value"))
