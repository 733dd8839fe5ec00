"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs twice into the no-op sink and the faster run counts.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession

from timeloom.plans import workload
from timeloom.plans.session import build_session

HEADLINE = [
    "merge_wide_second", "merge_wide_hour", "merge_wide_exact", "merge_inline", "line_numbers",
    "collapse_multiline", "collapse_lines_doc", "merge_dup_ts", "out_of_order", "forward_fill",
    "run_groups", "number_rows", "merge_two_full_outer", "parse_mixed_formats", "detect_format",
    "ts_fmt_iso_space_comma", "ts_fmt_iso_t_dot_zone", "ts_fmt_access_log", "ts_fmt_apache_error",
    "clip_multiline", "autoclip", "file_stats", "search", "goto_ts_fwd", "asof_probe_table",
    "text_gzip_lines", "csv_lines", "csv_quoted_lines", "jsonl_lines", "packet_format",
    "markdown_rows", "csv_sink", "align_clip",
]


def run(spark: SparkSession, query: workload.Query, sf_dir: str) -> float:
    begun = time.perf_counter()
    df: DataFrame = query(spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    every = workload.queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the executors
    seconds = {
        name: round(min(run(spark, every[name], sf_dir) for _ in range(2)), 3)
        for name in HEADLINE
    }
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale[1]) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
