"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = [
    "type_int_range", "type_pattern", "key_unique", "leafref_anti", "mandatory_child", "must_compare", "must_count_pred",
    "must_exists_other", "deref_nested", "positional_predicate", "document_rules",
]


def single_process(n: int = 3000) -> float:
    """Documents a second that one process checks, without Spark: what the distributed plan is to be held against."""
    from treeline.plans.catalog import ROWS_SCHEMA
    from treeline.plans.documents import Validator
    from treeline.schema.load import parse_string

    v = Validator(parse_string(ROWS_SCHEMA))
    began = time.perf_counter()
    for i in range(n):
        v.validate({"order": {"o_orderkey": i, "o_orderstatus": "F", "o_totalprice": 100.5 + i, "o_orderpriority": "1-URGENT"}})
    return n / (time.perf_counter() - began)


def main() -> None:
    from pyspark.sql import SparkSession

    from treeline.plans.catalog import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        best = float("inf")
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        seconds[name] = round(best, 3)
    documents = spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    print(
        json.dumps(
            {
                "metric": "rule_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": float(os.path.basename(SF_DIR).removeprefix("sf") or 0) if os.path.basename(SF_DIR).startswith("sf") else SF_DIR,
                "documents_per_second": round(documents / seconds["document_rules"]),
                "single_process_documents_per_second": round(single_process()),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
