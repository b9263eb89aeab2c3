"""Hand-worked cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from apportion import registry
from apportion.functions import scalar
from apportion.operators import alignment, em, intervals, kmers, ordered, reference, sampling
from apportion.sources import text

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_merge(spark):
    x = spark.createDataFrame([("t", 1, 10), ("t", 11, 20), ("t", 25, 30), ("t", 5, 12)], "k string, start int, end int")
    assert rows(intervals.merge(x, ["k"], gap=1), "start", "end") == [(1, 20), (25, 30)]


def test_splice_reverse(spark):
    x = spark.createDataFrame([("AACCGGTT", [(1, 2), (5, 6)], "-")], "s string, e array<struct<start:int,end:int>>, strand string")
    assert x.select(scalar.splice(F.col("s"), F.col("e"), F.col("strand"))).first()[0] == "CCTT"


def test_em_rounds(spark):
    hits = spark.createDataFrame([(1, "A", 1, 1.0), (2, "A", 1, 1.0), (2, "B", 2, 1.0)], "rid long, sid string, ord int, conprb double")
    got = [{r.sid: r.theta for r in em.fixed_rounds(hits, k)[0].collect()}["A"] for k in (1, 2, 3)]
    assert np.allclose(got, [0.75, 0.875, 0.9375])
    assert {r.sid: r.theta for r in em.run(hits, least=20, most=60).collect()}["A"] > 0.999


def test_mass_is_kept(spark):
    hits = spark.createDataFrame([(r, s, 1, ((r * 7 + s) % 5) / 5) for r in range(50) for s in range(4)], "rid long, sid int, ord int, conprb double")
    _, c = em.fixed_rounds(hits, 2)
    assert abs(c.agg(F.sum("cnt")).first()[0] - 50) < 1e-9


def test_effective_length(spark):
    x = spark.createDataFrame([(1, 10, 10), (2, 10, 4)], "sid int, full_len int, tot_len int")
    one = spark.createDataFrame([(5, 1.0)], "l int, p double")
    assert rows(em.effective_lengths(x, one), "sid", "eel") == [(1, 6.0), (2, 0.0)]


def test_mapq(spark):
    x = spark.createDataFrame([(1.0,), (0.9,), (0.5,)], "w double")
    assert [r[0] for r in x.select(scalar.mapq_from_posterior(F.col("w"))).collect()] == [100, 10, 3]


@pytest.mark.parametrize(("n", "want"), [(8, 4 / 9), (5, 2 / 6), (6, 2 / 6), (7, 3 / 8)])
def test_quartiles(spark, n, want):
    x = spark.createDataFrame([("a", float(i)) for i in range(1, n + 1)], "k string, v double")
    assert abs(em.quartile_variation(x, "k", "v").first()["cqv"] - want) < 1e-12


def test_fdr(spark):
    x = spark.createDataFrame(enumerate([0.01, 0.02, 0.10, 0.03]), "i int, e double").withColumn("k", F.lit(0))
    assert ordered.fdr_prefix(x, ["k"], ["i"], "e", 0.05, False).count() == 2
    assert ordered.fdr_prefix(x, ["k"], ["i"], "e", 0.05, True).count() == 4


def test_kmers(spark):
    x = spark.createDataFrame([("a", "AAAC"), ("b", "AAAG"), ("c", "AA")], "name string, seq string")
    assert rows(kmers.ambiguity(x, 3), "name", "score") == [("a", 0.5), ("b", 0.5), ("c", -1.0)]


def test_lift(spark):
    x = spark.createDataFrame([(7, 6, [(1, 10), (21, 30)]), (18, 5, [(1, 10), (21, 30)])], "offset int, length int, exons array<struct<start:int,end:int>>")
    assert [(r.pos, r.cigar) for r in intervals.lift(x).collect()] == [(8, "3M10N3M"), (29, "2M3I")]


def test_read_classes(spark):
    x = spark.createDataFrame([(4, {}), (4, {"XM": "2"}), (0, {})], "flag int, tags map<string,string>")
    assert [r[0] for r in x.select(alignment.read_class()).collect()] == [0, 2, 1]


def test_overlap_join_is_naive_join(spark):
    rng = np.random.default_rng(0)
    mk = lambda n: spark.createDataFrame([(i, "ab"[int(rng.integers(2))], int(s), int(s + rng.integers(1, 300))) for i, s in enumerate(rng.integers(0, 3000, n))], "id int, chrom string, start int, end int")
    a, b = mk(60), mk(60)
    got = rows(intervals.overlap_join(a, b, 64), "a_id", "b_id")
    x, y = a.collect(), b.collect()
    assert got == sorted((p.id, q.id) for p in x for q in y if p.chrom == q.chrom and p.start < q.end and q.start < p.end)


def test_natural_order(spark):
    x = spark.createDataFrame([("r10",), ("r9",), ("r1a2",), ("a",)], "n string")
    assert [r.n for r in x.orderBy(scalar.natural_key(F.col("n"))).collect()] == ["a", "r1a2", "r9", "r10"]


def test_reference_from_files(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1 first\nAACCGGTT\nAACC\n>c2\nacgtn\n")
    (tmp_path / "a.gtf").write_text('#x\nc1\ts\texon\t1\t2\t.\t-\t.\tgene_id "g"; transcript_id "t";\nc1\ts\texon\t5\t6\t.\t-\t.\tgene_id "g"; transcript_id "t";\nc9\ts\texon\t1\t4\t.\t+\t.\tgene_id "g2"; transcript_id "u";\nc1\ts\tCDS\t1\t4\t.\t+\t.\tgene_id "g2"; transcript_id "u";\n')
    genome = text.fasta(spark, str(tmp_path / "g.fa"))
    assert rows(genome, "name", "seq") == [("c1", "AACCGGTTAACC"), ("c2", "acgtn")]
    t = reference.transcripts(text.gtf(spark, str(tmp_path / "a.gtf")))
    assert rows(t, "sid", "transcript_id", "length") == [(1, "t", 4), (2, "u", 4)]
    assert rows(reference.sequences(t, genome), "transcript_id", "seq") == [("t", "CCTT")]
    assert rows(reference.missing(t, genome), "transcript_id") == [("u",)]


def test_gff3(spark, tmp_path):
    (tmp_path / "a.gff3").write_text("##gff\nc\ts\tgene\t1\t9\t.\t+\t.\tID=g;Name=G\nc\ts\tmRNA\t1\t9\t.\t+\t.\tID=t;Parent=g\nc\ts\texon\t1\t4\t.\t+\t.\tParent=t\nc\ts\tCDS\t3\t9\t.\t+\t0\tParent=t\n")
    e = reference.from_gff3(text.gff3(spark, str(tmp_path / "a.gff3")))
    assert rows(reference.transcripts(e), "gene_id", "transcript_id", "length") == [("g", "t", 9)]


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@SQ\tSN:c1\tLN:100\na\t0\tc1\t5\t30\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:1\tRG:Z:x\nb\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    x = text.sam(spark, str(tmp_path / "a.sam"))
    a, b = sorted(x.collect(), key=lambda r: r.ord)
    assert (a.cigar[0].op, a.cigar[0].len, a.tags, b.cigar) == ("M", 4, {"NM": "1", "RG": "x"}, [])
    assert rows(alignment.idxstats(x, text.sam_targets(spark, str(tmp_path / "a.sam"))), "name", "mapped") == [("c1", 1)]
    assert rows(text.fastq_export(x), "mate", "value")[0] == (0, "@a\nACGT\n+\nIIII")


def test_fastq_and_bed(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nAC\n+\n@@\n")
    assert rows(text.fastq(spark, str(tmp_path / "a.fq")), "rid", "name", "seq", "qual") == [(0, "r1", "ACGT", "IIII"), (1, "r2", "AC", "@@")]
    (tmp_path / "a.bed").write_text("track x\nc\t5\nc\t1\t9\tn\t0\t+\n")
    assert rows(text.bed(spark, str(tmp_path / "a.bed")), "chrom", "start", "end") == [("c", 1, 9), ("c", 4, 5)]


def test_gibbs_is_stable_and_keeps_records(spark):
    hits = spark.createDataFrame([(1, 1, 1.0), (2, 1, 1.0), (2, 2, 1.0), (3, 2, 0.5)], "rid long, sid long, conprb double")
    g = lambda d: rows(sampling.gibbs(d, 2, 5, 10), "chain", "sample", "sid", "cnt")
    a = g(hits)
    assert a == g(hits.repartition(3)) and all(sum(r[3] for r in a if r[:2] == k) == 3 for k in {r[:2] for r in a})


def test_digamma_and_dirichlet():
    assert abs(sampling.digamma(np.array([1.0]))[0] + 0.5772156649) < 1e-9
    a, ll = sampling.dirichlet_multinomial(np.array([90.0, 110.0, 10.0, 12.0]), np.array([0, 0, 1, 1]))
    assert a[0] > a[1]


def test_idr_separates():
    rng = np.random.default_rng(1)
    s = np.concatenate((rng.normal(4, 1, 200), rng.normal(0, 1, 200)))
    x, y = s + rng.normal(0, 0.3, 400), np.concatenate((s[:200] + rng.normal(0, 0.3, 200), rng.normal(0, 1, 200)))
    idr = sampling.copula_idr(x, y)
    assert 2 * idr[:200].mean() < idr[200:].mean()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_queries_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_stream(spark, tmp_path):
    from apportion.streaming import ingest

    spark.createDataFrame([(1,), (1,), (2,)], "cls int").write.parquet(str(tmp_path / "in"))
    q = ingest.keep_counters(ingest.watch(spark, str(tmp_path / "in"), "cls int"), str(tmp_path / "out"), str(tmp_path / "cp"), ["cls"])
    q.awaitTermination(60)
    assert rows(ingest.totals(spark, str(tmp_path / "out"), ["cls"]), "cls", "n") == [(1, 2), (2, 1)]
