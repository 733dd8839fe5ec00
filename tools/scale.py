"""Generate logs of a given size and time the merge on them.

    python tools/scale.py [megabytes per log] [logs] [folder]

Prints lines per second, and per stage the slowest task against the median one.
"""

from __future__ import annotations

import statistics
import sys
import tempfile
import time
from datetime import datetime, timedelta
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from timeloom.operators.order import number_rows  # noqa: E402
from timeloom.plans.align import align  # noqa: E402
from timeloom.plans.session import build_session  # noqa: E402
from timeloom.sources.synthetic import lines_for_megabytes, write_synthetic_log  # noqa: E402


def stage_skew(spark) -> None:
    context = spark.sparkContext
    store = context._jsc.sc().statusStore()
    none = context._jvm.java.util.ArrayList()
    quantiles = context._gateway.new_array(context._jvm.double, 0)
    for s in reversed(list(_items(store.stageList(none, False, False, quantiles, none)))):
        tasks = list(_items(store.taskList(s.stageId(), s.attemptId(), 100_000)))
        times = [float(t.duration().get()) / 1000 for t in tasks if t.duration().isDefined()]
        if sum(times) > 2:
            print(f"  stage {s.stageId()}: {len(times)} tasks, sum {sum(times):.1f}s, median "
                  f"{statistics.median(times):.2f}s, max {max(times):.2f}s, "
                  f"read {(s.inputBytes() + s.shuffleReadBytes()) / 1e6:.0f} MB, shuffle write "
                  f"{s.shuffleWriteBytes() / 1e6:.0f} MB, "
                  f"spill {s.diskBytesSpilled() / 1e6:.0f} MB")


def _items(seq):
    for i in range(seq.size()):
        yield seq.apply(i)


def main() -> None:
    megabytes = int(sys.argv[1]) if len(sys.argv) > 1 else 100
    logs = int(sys.argv[2]) if len(sys.argv) > 2 else 3
    folder = sys.argv[3] if len(sys.argv) > 3 else tempfile.mkdtemp(prefix="run-")
    spark = build_session("scale", "local[8]", **{
        "spark.driver.memory": "16g", "spark.sql.shuffle.partitions": "64",
        "spark.ui.enabled": "false", "spark.sql.files.maxPartitionBytes": "32m",
    })
    spark.sparkContext.setLogLevel("ERROR")
    begun = time.perf_counter()
    count = 0
    for i in range(logs):
        path = f"{folder}/log{i}"
        count += lines_for_megabytes(megabytes)
        if not Path(path).exists():
            write_synthetic_log(
                spark, path, megabytes, datetime(2025, 1, 1) + timedelta(seconds=i), seed=i)
    print(f"generated {count} lines in {time.perf_counter() - begun:.1f}s")

    begun = time.perf_counter()
    merged = align(spark, [f"{folder}/log{i}/part-*" for i in range(logs)])
    read = time.perf_counter() - begun
    print(f"read, detected, parsed and staged in {read:.1f}s ({count / read:,.0f} lines/s)")
    for name, build in {
        "entries": lambda: merged.entries,
        "long": lambda: merged.long(),
        "numbered": lambda: number_rows(merged.entries),
    }.items():
        begun = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - begun
        print(f"{name}: {took:.1f}s ({count / took:,.0f} lines/s)")
    stage_skew(spark)


if __name__ == "__main__":
    main()
