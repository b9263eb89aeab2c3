import numpy as np
from pyspark.sql import functions as F

from apportion.functions.scalar import cigar_ops
from apportion.operators import pileup, priors
from apportion.sources import header


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_training_targets(spark):
    t = spark.createDataFrame([("a", "c", "+", 1000, 3000, 0.9), ("b", "c", "+", 1700, 2000, 0.9), ("d", "c", "-", 9000, 9900, 0.9), ("e", "c", "+", 20000, 22000, 0.5), ("f", "c", "+", 10200, 12000, 0.9)], "trid string, chrom string, strand string, start int, end int, m double")
    t = t.select("*", *[F.col("m").alias(f"{k}_mpp") for k in ("tss", "body", "tes")])
    ex = spark.createDataFrame([("a", 0, "c", 1000, 1200), ("a", 1, "c", 2500, 3000), ("b", 0, "c", 1700, 2000), ("d", 0, "c", 9000, 9900), ("f", 0, "c", 10200, 12000)], "trid string, exon_index int, chrom string, start int, end int")
    assert rows(priors.training_targets(t, ex), "trid") == [("a",)]  # b is nested, d and f start near each other, e maps badly


def test_features_and_priors(spark):
    rng = np.random.default_rng(0)
    n = 40
    t = spark.createDataFrame([(f"t{i:02}", "c", "+", 10000 * i + 2000, 10000 * i + 5000) for i in range(n)], "trid string, chrom string, strand string, start int, end int")
    peaks = spark.createDataFrame([("c", 10000 * i + 1900, 10000 * i + 2100) for i in range(0, n, 2)], "chrom string, start int, end int")
    frags = spark.createDataFrame([("c", int(10000 * i + 1950 + k), int(10000 * i + 2050 + k), "+") for i in range(0, n, 2) for k in range(5)], "chrom string, start int, end int, strand string")
    expr = spark.createDataFrame([(f"t{i:02}", 1000.0, float(rng.poisson(100 if i % 2 == 0 else 3))) for i in range(n)], "trid string, efflen double, pme_count double")
    gc = spark.createDataFrame([(f"t{i:02}", 0.4 + i / 200) for i in range(n)], "trid string, GC_fraction double")
    x = priors.features(t, peaks, frags, gc, expr, t.filter("trid < 't30'"))
    got = {r.trid: r for r in x.collect()}
    assert got["t00"].tss_pk == 1 and got["t01"].tss_pk == 0 and got["t00"].tss_sig > 0 and got["t01"].tss_sig == 0 and got["t35"].is_training == 0
    for kind in ("pk", "lm", "pklm", "logit"):
        p = priors.priors(x, kind).set_index("trid").prior
        assert len(p) == n and (p > 0).all()
    p = priors.priors(x, "pk").set_index("trid").prior
    assert p["t00"] > p["t01"] and p["t36"] == p["t00"]
    assert priors.capped(frags.union(frags).union(frags), 2).count() == 2 * frags.count()


SAM = "qname string, flag int, rname string, pos int, c string, seq string, qual string, tags map<string,string>, ord long"


def test_pileup(spark):
    x = spark.createDataFrame([("a", 0, "c", 1, "2M1D1M", "ACG", "II5", {}, 0), ("b", 16, "c", 2, "2M", "GT", "II", {}, 1), ("b2", 1024, "c", 2, "2M", "GT", "II", {}, 2)], SAM).withColumn("cigar", cigar_ops(F.col("c")))
    b = pileup.bases(x)
    g = spark.createDataFrame([("c", "ACTG")], "name string, seq string")
    assert rows(pileup.columns(b, g), "pos", "depth", "bases") == [(1, 1, "."), (2, 2, ".g"), (3, 2, "*,"), (4, 1, ".")]
    assert rows(pileup.allele_counts(b), "pos", "C", "G", "deleted")[1] == (2, 1, 1, 0)
    assert rows(pileup.genotypes(pileup.allele_counts(b)), "pos", "gt")[0] == (1, "AA")
    assert pileup.bases(x, 30).count() == 4 + 2 - 1


def test_headers_and_variants(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1\n@SQ\tSN:c\tLN:9\n@RG\tID:x\n@CO\tfree: text\n")
    h = header.header(spark, str(tmp_path / "a.sam"))
    assert rows(h, "kind", "ord") == [("CO", 3), ("HD", 0), ("RG", 2), ("SQ", 1)]
    new = header.with_targets(h, spark.createDataFrame([("d", 5)], "name string, len int"))
    assert [r.line for r in new.filter("kind = 'SQ'").collect()] == ["@SQ\tSN:d\tLN:5"]
    p = header.with_program(header.with_program(h, "me", VN="1"), "me")
    assert p.filter("kind = 'PG'").count() == 1
    assert header.renamed_ids(h, h, "RG").first()["new"] != "x"
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\nc\t3\t.\tA\tC,G\t9.5\tPASS\tDP=4;AF=0.5\tGT\t0/1\n")
    v = header.vcf(spark, str(tmp_path / "a.vcf"))
    r = v.first()
    assert (r.pos, r.alts, r.info["DP"], r.samples) == (3, ["C", "G"], "4", ["0/1"]) and header.merged_variants(v, v).count() == 1
    s = spark.createDataFrame([("c", 0, 10, 2.0), ("c", 10, 20, 4.0)], "chrom string, start long, end long, value double")
    q = spark.createDataFrame([(1, "c", 5, 15), (2, "d", 0, 5)], "id int, chrom string, start long, end long")
    assert rows(header.region_mean(s, q), "id", "mean") == [(1, 3.0), (2, None)]
