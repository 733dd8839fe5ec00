"""Running values over segments against a plain loop, for several segment sizes."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timeloom.operators.order import (
    TOTAL,
    LineOrder,
    carry_segments,
    flag_disorder,
    forward_fill,
    number_rows,
    number_runs,
    running_sum,
    with_segments,
)

BASE = datetime(2024, 1, 1)


def random_lines(seed: int, stamped: float = 0.2):
    """Three sources; one holds most lines and has long stretches without a time."""
    rng = random.Random(seed)
    rows = []
    for file, n, share in (("big", 700, stamped), ("small", 40, 0.9), ("none", 25, 0.0)):
        for seq in range(n):
            quiet = file == "big" and 200 <= seq < 420
            has = rng.random() < share and not quiet
            ts = BASE + timedelta(seconds=rng.randrange(300)) if has else None
            rows.append((file, 0, seq, ts, rng.randrange(5)))
    rng.shuffle(rows)
    return rows


SCHEMA = "file string, block_start bigint, seq bigint, ts timestamp_ntz, n int"


def in_order(rows):
    files: dict[str, list] = {}
    for row in sorted(rows):
        files.setdefault(row[0], []).append(row)
    return files


@pytest.mark.parametrize("bits, group_bits", [(0, 2), (0, 12), (3, 0), (3, 3), (6, 1), (17, 12)])
def test_forward_fill_runs_and_sums(spark, bits, group_bits):
    rows = random_lines(bits)
    expected = {}
    for file, lines in in_order([(f, b, s, t and t.isoformat(), n) for f, b, s, t, n in rows]
                                ).items():
        last, total, run, before = None, 0, 0, "start"
        for _, _, seq, ts, n in lines:
            last = ts or last
            total += n
            run += last != before
            before = last
            expected[file, seq] = (last, total, run)
    df = with_segments(spark.createDataFrame(rows, SCHEMA), bits)
    order = LineOrder(group_bits=group_bits)
    runs = number_runs(forward_fill(df, order=order), order=order)
    got = running_sum(runs, "n", "total", order)
    found = {
        (r.file, r.seq): (r.rec_ts and r.rec_ts.isoformat(), r.total, r.run_id)
        for r in got.collect()
    }
    assert found == expected


@pytest.mark.parametrize("bits, group_bits", [(0, 2), (0, 12), (4, 1), (17, 12)])
def test_flag_disorder(spark, bits, group_bits):
    rows = random_lines(bits + 50, 0.6)
    expected = {}
    for file, lines in in_order([(f, b, s, t and t.isoformat(), n) for f, b, s, t, n in rows]
                                ).items():
        top = None
        for _, _, seq, text, _ in lines:
            ts = text and datetime.fromisoformat(text)
            late = bool(ts and top and ts < top)
            lateness = (top - ts) // timedelta(microseconds=1) if late else None
            expected[file, seq] = (late, lateness)
            top = max(filter(None, (top, ts)), default=None)
    df = with_segments(spark.createDataFrame(rows, SCHEMA), bits)
    found = {(r.file, r.seq): (r.is_out_of_order, r.lateness_us)
             for r in flag_disorder(df, order=LineOrder(group_bits=group_bits)).collect()}
    assert found == expected


def test_number_rows(spark):
    rng = random.Random(3)
    times = {BASE + timedelta(days=rng.randrange(-900, 900), seconds=rng.randrange(3),
                              microseconds=rng.randrange(3)) for _ in range(400)}
    rows = [(t, part, f"{t} {part}") for t in times for part in range(rng.choice([1, 1, 3]))]
    rows += [(None, 0, "first"), (None, 1, "first again")]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, part int, body string")
    got = {(r.ts, r.part): r.line for r in number_rows(df).collect()}
    order = [None, *sorted(times)]
    assert got == {(t, p): order.index(t) + 1 for t, p, _ in rows}
    without = number_rows(df.where(F.col("ts").isNotNull())).agg(F.min("line"), F.max("line"))
    assert tuple(without.first()) == (1, len(times))


def test_segments_of_one_source_do_not_meet_in_one_task(spark):
    """The largest window over segments holds one group of them, the one over groups one row each."""
    order = LineOrder(group_bits=5)
    df = with_segments(spark.range(4096).select(
        F.when(F.col("id") >= 0, "one").alias("file"), F.lit(0).cast("bigint").alias("block_start"),
        F.col("id").alias("seq"), F.lit(1).alias("n")), 2)  # 1024 segments in 32 groups
    reduced = df.groupBy(*order.keys).agg(F.sum("n").alias("n"))
    carried = carry_segments(reduced, order, {"before": ("n", TOTAL)})
    wrong = carried.where(F.coalesce("before", F.lit(0)) != F.col("segment") * 4)
    assert carried.count() == 1024 and wrong.isEmpty()
    plan = carried._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if re.search(r"\bWindow \[", x)]
    over_source = [x for x in windows if re.search(r", \[file#\d+\], ", x)]
    # Over the whole source only the totals of groups are folded.
    assert over_source and all("_all0" in x for x in over_source)
