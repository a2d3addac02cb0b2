"""Timed headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the number of threads. Every query runs once to warm up (that is also when
derived files are written), then is timed, its whole result going to a null sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from rowloom.plans.run import run_recipe  # noqa: E402
from rowloom.session import configure, fresh_path  # noqa: E402
from rowloom.sources.csv import has_quoted_breaks, read_csv  # noqa: E402
from rowloom.sources.jsonl import read_jsonl, read_jsonl_columns, read_lines, with_cells  # noqa: E402
from rowloom.sources.scan import with_position  # noqa: E402
from rowloom.sources.splitting import CSV_ROWS, split_records  # noqa: E402
from rowloom.suite import QUERIES  # noqa: E402
from rowloom.suite.files import csv_of, jsonl_of  # noqa: E402

HEADLINES = [
    "recipe_passthrough", "recipe_chained", "recipe_lineitem_report", "recipe_format_ts_text", "view_labels", "view_cast_ts",
    "filter_text_contains", "filter_num_gt", "filter_num_text_mixed", "filter_ts_text", "filter_multi_and", "filter_documents_text",
    "csv_scan", "csv_round_trip", "csv_row_count", "csv_recipe", "jsonl_scan", "jsonl_round_trip", "jsonl_raw_columns", "json_keys_union",
    "csv_to_jsonl", "jsonl_to_csv", "json_array_scan", "json_object_scan", "recipe_on_lines", "json_display", "json_exact_text",
    "drill_object", "drill_array_objects", "drill_nested_arrays", "drill_mixed_leaf", "drill_then_filter", "json_children",
    "schema_csv", "schema_csv_nullable", "schema_jsonl", "schema_drilled", "cell_types", "record_position", "row_ranges",
]


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 4)


def sunk(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def size_of(path: str) -> int:
    return sum(p.stat().st_size for p in Path(path).glob("part-*"))


def throughput(spark, sf_dir: str) -> dict[str, float]:
    """MB/s of whole-file passes, over ten times the same files so that the fixed
    cost of starting a job does not decide."""
    csv_path, jsonl_path = [csv_of(spark, sf_dir, "lineitem")] * 10, [jsonl_of(spark, sf_dir, "lineitem")] * 10
    names = ["l_orderkey", "l_quantity", "l_shipdate"]
    quoted = fresh_path(spark, "bench-quoted")
    spark.read.text(csv_path).write.text(quoted)
    passes = {
        "csv_count": (csv_path, lambda: read_csv(spark, csv_path, quoted_breaks=False).count()),
        "csv_quote_check": (csv_path, lambda: has_quoted_breaks(spark, csv_path)),
        "csv_quoted_break_rows": ([quoted], lambda: sunk(split_records(spark, quoted, CSV_ROWS, "\n"))),
        "csv_scan": (csv_path, lambda: sunk(read_csv(spark, csv_path, quoted_breaks=False))),
        "jsonl_count": (jsonl_path, lambda: read_lines(spark, jsonl_path).count()),
        "jsonl_positions": (jsonl_path, lambda: sunk(with_position(read_lines(spark, jsonl_path)))),
        "jsonl_columns": (jsonl_path, lambda: sunk(read_jsonl_columns(spark, jsonl_path, names))),
        "jsonl_cells": (jsonl_path, lambda: sunk(with_cells(read_jsonl(spark, jsonl_path), ["l_orderkey", "l_returnflag"]))),
        "csv_to_jsonl_written": (csv_path[:1], lambda: run_recipe(spark, csv_path[0], [], fresh_path(spark, "bench") + ".jsonl", input_format="csv")),
        "jsonl_to_csv_written": (jsonl_path[:1], lambda: run_recipe(spark, jsonl_path[0], [], fresh_path(spark, "bench") + ".csv", input_format="jsonl")),
    }
    out = {}
    for name, (path, run) in passes.items():
        run()
        out[name] = round(sum(map(size_of, path)) / 1e6 / max(timed(run), 1e-6), 1)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        def run(name=name) -> None:
            sunk(QUERIES[name](spark, sf_dir))

        run()
        times[name] = min(timed(run), timed(run))
    rates = throughput(spark, sf_dir)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale, "throughput_mb_s": rates,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
