"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of tables (default /root/testdata/sf0.1); BENCH_CPUS: threads (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "em_gene_expression", "em_theta_fixed_rounds", "em_equivalence_classes", "posterior_mapq", "tpm_fpkm", "multiread_counts", "hpd_interval", "tukey_cqv",
    "overlap_any", "overlap_within", "overlap_self_nested", "interval_merge", "depth_runs", "region_coverage", "strand_cross_correlation",
    "flagstat", "unique_alignments", "cap_duplicates", "fdr_soft", "running_idr", "kmer_ambiguity", "wilcoxon_ranksum", "median_ratio_norm", "count_matrix_pivot",
]


def main() -> None:
    from apportion import registry
    from apportion.session import build

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            s = time.perf_counter() - began
            best = s if best is None else min(best, s)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
