"""The read model, tracks and mates on small cases."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from apportion.functions.scalar import cigar_ops
from apportion.operators import model, sampling, tracks


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_lengths():
    n = model.normal_lengths(200, 30, 1, 1000)
    assert abs(n.p.sum() - 1) < 1e-12 and len(n.p) <= model.RANGE and n.low + int(n.p.argmax()) == 200
    assert model.normal_lengths(50, 0, 1, 100).low == 50
    d = model.Lengths(5, np.array([0.0, 1, 3, 0]))
    assert (d.low, d.high) == (6, 7) and np.allclose(d.within([6, 7, 7], [10, 10, 6]), [0.25, 0.75, 0])


def test_positions(spark):
    x = spark.createDataFrame([(0, 10, 1.0), (7, 10, 0.5), (3, 7, 1.0), (12, 10, 1.0)], "fpos int, full_len int, frac double")
    m = {r.bin: r.mass for r in model.position_mass(x, 20).collect()}
    assert abs(sum(m.values()) - 2.5) < 1e-9 and abs(m[0] - 0.5) < 1e-9 and abs(m[14] - 0.25) < 1e-9
    even = model.Positions(np.ones(20))
    assert np.allclose(even.prob([0, 5], [10, 8], [10, 10]), [0.1, 0.125]) and np.allclose(model.Positions().prob([3], [4], [9]), 0.25)


def test_errors(spark):
    p = model.initial_errors()
    assert np.allclose(p.sum(2), 1) and abs(p[10, 0, 0] - 0.9 * (1 - 1e-5)) < 1e-12
    x = spark.createDataFrame([("ACN", "!!I", "AGT", 0.5), ("A", "!", "A", 1.0)], "seq string, qual string, ref string, frac double")
    assert rows(model.substitutions(x), "k", "r", "c", "w") == [(0, "A", "A", 1.5), (0, "G", "C", 0.5), (40, "T", "N", 0.5)]
    assert np.allclose(model.errors_from(model.substitutions(x))[0, 2], [0, 1, 0, 0, 0])


def test_likelihood(spark):
    refs = spark.createDataFrame([(1, "ACGTACGTAC", 10, 10, None, 1.0)], "sid long, seq string, full_len int, tot_len int, mask_from int, mw double")
    hits = spark.createDataFrame([(1, 1, 0, 2, 4, "GTA", "III", "GTA", "III", False), (2, 1, 1, 2, 4, "ACG", "III", None, None, False), (3, 1, 0, 2, 4, "GTA", "III", None, None, True)], "rid long, sid long, dir int, pos int, insert_len int, seq1 string, qual1 string, seq2 string, qual2 string, low boolean")
    x = model.with_reference(hits, refs)
    assert rows(x, "rid", "fpos", "ref1", "ref2") == [(1, 2, "GTA", "GTA"), (2, 4, "ACG", None), (3, 2, "GTA", None)]
    m = model.Model(0.5, model.Lengths(4, np.array([1.0, 1])), model.Lengths(3, np.ones(1)), model.Positions(), model.initial_errors(), np.full((100, 5), 0.2))
    base = 0.5 * 0.5 * (1 / 7)
    ok = m.errors[40, 0, 0] ** 3
    got = [r[1] for r in rows(model.likelihoods(x, m), "rid", "conprb")]
    assert np.allclose(got, [base * ok * ok, base * ok, 0.0])
    assert np.allclose([r[1] for r in rows(model.noise_probabilities(hits, m), "rid", "noise")], [0.2**6, 0.2**3, 0])


def test_mask_weights():
    refs = pd.DataFrame({"full_len": [10, 10], "tot_len": [12, 10], "mask_from": [8, None]})
    w = model.mask_weights(refs, model.Lengths(3, np.ones(1)), model.Positions())
    assert np.allclose(w, [0.8, 1.0])


def test_simulated_reads_are_found_again(spark):
    rng = np.random.default_rng(5)
    seqs = ["".join(rng.choice(list("ACGT"), 300)) for _ in range(3)]
    seqs.append(seqs[0][:150] + "".join(rng.choice(list("ACGT"), 150)))  # shares its first half with the first
    tpm = [100.0, 300.0, 50.0, 200.0]
    t = spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(zip(seqs, tpm, strict=True))], "sid long, seq string, tpm double")
    reads = sampling.simulate(t, 600, 40, 80, 8, seed=1).toPandas()
    hits = []
    for r in reads.itertuples():
        for s in {0, 3} if r.sid in (0, 3) and r.pos + r.insert_len <= 150 else {r.sid}:
            hits.append((r.rid, int(s), 1, int(r.dir), int(r.pos if r.dir == 0 else 300 - r.pos - r.insert_len), int(r.insert_len), r.seq, "I" * 40, None, None, False))
    hits = spark.createDataFrame(hits, "rid long, sid long, ord int, dir int, pos int, insert_len int, seq1 string, qual1 string, seq2 string, qual2 string, low boolean")
    refs = t.select("sid", "seq", F.lit(300).alias("full_len"), F.lit(300).alias("tot_len"), F.lit(None).cast("int").alias("mask_from"), F.lit(1.0).alias("mw"))
    start = model.Model(0.5, model.normal_lengths(100, 30, 40, 200), model.Lengths(40, np.ones(1)), model.Positions(), model.initial_errors(), np.full((100, 5), 0.2))
    fitted, theta, _ = model.fit(model.with_reference(hits, refs).repartition(2), start, rounds=3)
    got = {r.sid: r.theta for r in theta.collect()}
    assert np.corrcoef([got[i] for i in range(4)], tpm)[0, 1] > 0.97
    assert abs((np.arange(fitted.fragments.low, fitted.fragments.high + 1) * fitted.fragments.p).sum() - 80) < 2


SAM = "qname string, flag int, rname string, pos int, mapq int, c string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>, ord long"


def sam(spark, rows):
    return spark.createDataFrame(rows, SAM).withColumn("cigar", cigar_ops(F.col("c")))


def test_depth_tracks(spark):
    x = sam(spark, [("a", 0, "c", 2, 9, "2M1D2M", "*", 0, 0, "ACGT", "IIII", {}, 0), ("b", 0, "c", 3, 9, "2M", "*", 0, 0, "AC", "II", {}, 1)])
    steps = tracks.record_depth(x)
    assert rows(tracks.wiggle(steps), "rname", "start", "values") == [("c", 2, ["1.00", "2.00", "1.00", "1.00", "1.00"])]
    got = tracks.read_depth(steps, spark.createDataFrame([("c", 8), ("d", 3)], "name string, len int"))
    assert rows(got, "name", "depth") == [("c", [0.0, 1.0, 2.0, 1.0, 1.0, 1.0, 0.0, 0.0]), ("d", None)]
    assert rows(tracks.to_bed(x), "start", "end") == [(1, 6), (2, 4)]
    assert tracks.region(x, "c", 5, 9).count() == 1
    s = tracks.summary(x).first()
    assert (s.sequences, s.total_length, s.bases_mapped_cigar) == (2, 6, 6) and tracks.summary(x.orderBy(F.desc("ord"))).first() == s


def test_fix_mates(spark):
    x = sam(spark, [("a", 1 + 64, "c", 10, 9, "5M", "*", 0, 0, "ACGTA", "IIIII", {}, 0), ("a", 1 + 16 + 128, "c", 30, 9, "5M", "*", 0, 0, "ACGTA", "IIIII", {}, 1), ("b", 1 + 64, "c", 7, 9, "5M", "*", 0, 0, "ACGTA", "IIIII", {}, 2)])
    got = {r.ord: r for r in tracks.fix_mates(x).collect()}
    assert [(got[i].rnext, got[i].pnext, got[i].tlen) for i in range(3)] == [("=", 30, 25), ("=", 10, -25), ("*", 0, 0)]
    assert got[0].flag & 32 and not got[1].flag & 32 and got[2].flag == 0


def test_mismatches(spark):
    g = spark.createDataFrame([("c", "ACGTACGT")], "name string, seq string")
    x = sam(spark, [("a", 0, "c", 1, 9, "2M1I2M1D1M", "*", 0, 0, "ACTGAC", "IIIIII", {}, 0)])
    assert tracks.mismatch_tag(x, g).first().nm == 1 + 1 + 1


def test_peaks(spark):
    mk = lambda v: spark.createDataFrame(v, "chrom string, start int, end int, signal double")
    got = tracks.matched_peaks(mk([("c", 0, 10, 4.0), ("c", 50, 60, 2.0)]), mk([("c", 5, 20, 3.0), ("c", 15, 30, 5.0)]))
    assert rows(got, "start", "end", "sig_a", "sig_b") == [(0, 30, 4.0, 4.0), (50, 60, 2.0, 0.0)]
