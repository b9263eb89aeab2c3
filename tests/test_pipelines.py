"""Files in, abundances out."""

import numpy as np
from pyspark.sql import functions as F

from apportion import pipelines
from apportion.operators import sampling


def test_quantify_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    chrom = "".join(rng.choice(list("ACGT"), 1200))
    (tmp_path / "g.fa").write_text(f">c\n{chrom}\n")
    genes = {"t1": ("g1", 1, 300, "+"), "t2": ("g1", 151, 450, "+"), "t3": ("g2", 601, 1000, "-")}
    (tmp_path / "a.gtf").write_text("".join(f'c\ts\texon\t{b}\t{e}\t.\t{s}\t.\tgene_id "{g}"; transcript_id "{t}";\n' for t, (g, b, e, s) in genes.items()))
    seqs = {t: chrom[b - 1 : e] if s == "+" else chrom[b - 1 : e][::-1].translate(str.maketrans("ACGT", "TGCA")) for t, (_, b, e, s) in genes.items()}
    tpm = {"t1": 600.0, "t2": 200.0, "t3": 200.0}
    t = spark.createDataFrame([(i, seqs[k], tpm[k]) for i, k in enumerate(seqs)], "sid long, seq string, tpm double")
    lines = [f"@SQ\tSN:{k}\tLN:{len(s)}" for k, s in seqs.items()]
    for r in sampling.simulate(t, 500, 40, 60, 0.01, seed=3).toPandas().itertuples():
        read = r.seq if r.dir == 0 else r.seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
        start = r.pos if r.dir == 0 else r.pos + r.insert_len - 40
        name = [*seqs][r.sid]
        hits = [(name, start)]
        if name == "t1" and start >= 150:
            hits.append(("t2", start - 150))
        if name == "t2" and start + 40 <= 150:
            hits.append(("t1", start + 150))
        lines += [f"r{r.rid}\t{16 * r.dir}\t{k}\t{p + 1}\t255\t40M\t*\t0\t0\t{read}\t{'I' * 40}" for k, p in hits]
    lines += [f"u{i}\t4\t*\t0\t0\t*\t*\t0\t0\t{'ACGT' * 10}\t{'I' * 40}" for i in range(5)]
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    q = pipelines.from_files(spark, str(tmp_path / "g.fa"), str(tmp_path / "a.gtf"), str(tmp_path / "a.sam"))
    iso = {r.transcript_id: r for r in q.isoforms.collect()}
    assert abs(sum(r.TPM for r in iso.values()) - 1e6) < 1 and abs(sum(r.expected_count for r in iso.values()) - 500) < 5
    assert np.allclose([iso[k].TPM / 1e6 for k in seqs], [0.6, 0.2, 0.2], atol=0.09)
    g = {r.gene_id: r for r in q.genes.collect()}
    assert g["g1"]["transcript_id(s)"] == "t1,t2" and abs(g["g1"].TPM - iso["t1"].TPM - iso["t2"].TPM) < 1e-6
    assert abs(iso["t1"].IsoPct + iso["t2"].IsoPct - 100) < 1e-6
    per = q.posteriors.groupBy("rid").agg(F.sum("weight").alias("w")).agg(F.min("w"), F.max("w")).first()
    assert per[0] > 0.95 and per[1] < 1.0001


def test_matrix_and_test(spark):
    mk = lambda s: spark.createDataFrame([(f"g{i}", float(v)) for i, v in enumerate(s)], "gene_id string, expected_count double")
    m = pipelines.data_matrix({"a": mk([1, 2]), "b": mk([3, 4])})
    assert sorted(tuple(r) for r in m.collect()) == [("g0", 1.0, 3.0), ("g1", 2.0, 4.0)]
    rng = np.random.default_rng(0)
    rows = [(f"g{i}", f"s{k}", k // 3, float(rng.poisson(200 * (8 if i < 10 and k >= 3 else 1)) + 1)) for i in range(60) for k in range(6)]
    got = {r.feature for r in pipelines.differential(spark.createDataFrame(rows, "feature string, sample string, cond int, cnt double")).collect()}
    assert {f"g{i}" for i in range(10)} <= got and len(got) < 25
