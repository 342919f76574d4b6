"""Time headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from methyloom.plans.queries import QUERIES

HEADLINE = ["f01_read_filter_reason", "j01_mate_pairs", "w01_islands", "w02_dedup", "a01_pileup", "m03_genotype", "f13_site_filters", "w03_context", "w05_cpg_pairs", "a08_mutations", "a12_coverage", "a14_methylation_posterior", "a16_contig_rollup", "j09_snp_lookup", "j10_region_sites", "a22_index_totals", "st1_session_blocks"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "6g", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run also compiles code
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
