"""Times the headline batch queries of the set engine; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark.plans import catalogue

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "expr_nested",
    "expr_cardinality",
    "expr_orders_segment",
    "cardinality_all",
    "cardinality_range_hour",
    "union_many",
    "intersect_many",
    "union_many_bitmap",
    "intersect_many_bitmap",
    "rollup_auto",
    "lww_fold",
    "rollup_erasure",
    "compact_state",
    "range_put_occupancy",
    "dict_assign",
    "find_memberships_batch",
    "inverted_index",
    "delete_entity",
    "serialize_portable",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered, took = catalogue.queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            registered[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(sorted(times[1:])[1], 4)  # the first run compiles; the median of the others
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
