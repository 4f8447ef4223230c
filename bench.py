"""Time the headline queries once each on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from lexigrid.plans.catalogue import QUERIES

HEADLINE = ("unigram_counts", "cooccurrence_flat", "cooccurrence_dynamic", "cooccurrence_pmi", "cooccurrence_undersampled", "embedding_nearest_cosine")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse").config("spark.checkpoint.dir", f"file://{scratch}/checkpoints").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Warms up the JVM and the Python workers, so that the first query doesn't carry it.
    QUERIES["cooccurrence_shard"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    found = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        found[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
