"""Registered statistics without SQL, on hand-made tables."""

import itertools
import math
from collections import Counter

import numpy as np

from apportion import registry


def lineitem(spark, tmp_path, rows):
    spark.createDataFrame([(r, s, i, float(q)) for i, (r, s, q) in enumerate(rows)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))


def test_em_converged_takes_all_records(spark, tmp_path):
    rows = [(r, s, q) for r in range(1, 10) for s, q in ((r % 3, 20 + r), ((r + 1) % 3, 45 - r), (3, 12))]
    lineitem(spark, tmp_path, rows)
    r, s, p = (np.array(x) for x in zip(*rows, strict=True))
    theta = np.full(4, 0.25)
    for k in range(1, 10_001):
        w = theta[s] * p
        cnt = np.bincount(s, w / np.bincount(r, w)[r], minlength=4)
        old, theta = theta, cnt / cnt.sum()
        if k >= 20 and not ((theta >= 1e-7) & (np.abs(theta - old) >= 1e-3 * old)).any():
            break
    got = {x.sid: x.theta for x in registry.QUERIES["em_converged"](spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2, 3} and np.allclose([got[i] for i in range(4)], theta, rtol=1e-6, atol=1e-12), (k, got, theta)


def test_gibbs_counts_takes_all_targets(spark, tmp_path):
    """Posterior means against all assignments of six records to targets of two brands."""
    records = [((1, 10), (2, 30)), ((2, 25), (3, 20)), ((1, 40), (3, 5)), ((3, 50),), ((2, 8), (4, 9)), ((4, 30), (1, 12))]
    lineitem(spark, tmp_path, [(r, s, q) for r, hits in enumerate(records) for s, q in hits])
    spark.createDataFrame([(s, f"Brand#{1 + s % 2}", "t", 9) for s in range(1, 5)], "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    total, mean = 0.0, Counter()
    for z in itertools.product(*records):
        c = Counter(s for s, _ in z)
        w = math.prod(q for _, q in z) * math.prod(math.gamma(c[s] + 1) for s in range(1, 5))
        total += w
        for s in c:
            mean[s] += w * c[s]
    got = {x.sid: x["mean"] for x in registry.QUERIES["gibbs_counts"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4} and all(abs(got[s] - mean[s] / total) < 0.2 for s in got), (got, mean, total)


def test_simulate_reads_takes_all_targets(spark, tmp_path):
    keys = [1, 199, 200, 5_000, 70_000]
    spark.createDataFrame([(k, 100.0) for k in keys], "p_partkey long, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = {x.sid: x.n for x in registry.QUERIES["simulate_reads"](spark, str(tmp_path)).collect()}
    assert set(got) == set(keys) and sum(got.values()) == 2000 and all(abs(n - 400) < 120 for n in got.values())
