"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from codexa.plans.queries import QUERIES

NAMES = ["hybrid_search", "hybrid_batch", "bm25_topn_padded", "cosine_topk_batch", "statute_articles", "article_record_json", "chunk_ids", "dedup_first"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.files.maxPartitionBytes", "2m").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["short_hash"](spark, d).write.format("noop").mode("overwrite").save()  # starts the session
    took = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 2)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": d.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
