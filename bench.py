"""Prints one JSON line: seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]. Each is written to a sink that
takes all rows and columns, once to warm up and then, where that took under twenty seconds, once more for the figure."""

from __future__ import annotations

import importlib.util
import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

HEADLINE = (
    "thread_length_by_block", "plan_counts", "plan_stats", "sequence_view", "validation_issues", "machine_ops", "sim_frames", "long_stitch_split", "shoelace_area", "point_in_polygon", "containment_depth", "scan_rows",
    "nearest_palette", "nearest_center_embedding", "library_search", "text_layout_horizontal", "work_order", "op1_substring_dedup", "op2_chat_format", "op3_toxicity", "op4_language", "op5_pii", "op6_exact_dedup",
    "op7_near_dedup", "op8_mixing", "op9_quality", "op10_bpe", "op11_quality_classifier", "op12_conversation_repair", "op13_lexical_search",
)


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", "/tmp/threadloom-bench")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(HERE, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    queries, took = entry.queries(), {}

    def once(name: str) -> float:
        t = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    for name in (n for n in HEADLINE if n in queries):
        first = once(name)
        took[name] = round(once(name) if first < 20 else first, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
