"""Seconds of the headline queries on BENCH_SF_DIR with BENCH_CPUS threads: one JSON line."""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

HEADLINES = ["quality_score", "phash_bits", "ncc_similarity", "best_match", "ratio_test", "pairs_smart", "graph_edges", "blend_weighted", "blend_first_wins", "blend_median", "unsharp", "percentile_stretch", "topk_by_response"]


def main() -> None:
    from pyspark.sql import SparkSession

    from lattica.plans import registry

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{folder}").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINES:
        for _ in range(2):  # the second run counts: code is compiled then
            began = time.time()
            registry.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
