"""Headline linkage queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Records are normalised and landed once, as normalize_table, and the queries read
the landed table, as the published blockers read a normalised one. Everything is
run on a small table first, so that no query pays for the start."""

import json
import os
import time

from pyspark.sql import SparkSession

from tessella.plans.queries import QUERIES, normal

HEADLINE = ("block_exact", "block_pin", "block_pin_num", "block_pin_tok", "block_rare", "block_token", "block_char", "block_acronym", "union_candidates", "features_full", "eval_matches", "flagship", "profile_lengths")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    times = {}
    for at in ([small] if os.path.isdir(small) else []) + [sf]:
        times = {}
        for name in ("normalize_table", *HEADLINE):
            t = time.time()
            if name == "normalize_table":
                normal(spark, at)
            QUERIES[name](spark, at).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "linkage queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
