"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from timeloom.operators.clip import TimeRange
from timeloom.operators.merge import merge_wide
from timeloom.operators.order import flag_disorder, forward_fill, number_rows, with_segments
from timeloom.operators.records import collapse_records, fill_records, parse_timestamps
from timeloom.plans.session import release_staged, scratch_dir, small_side, stage

LINES = "file string, block_start bigint, seq bigint, ts timestamp_ntz, body string"


@pytest.fixture
def lines(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("file"),
        F.lit(0).cast("bigint").alias("block_start"), F.col("id").alias("seq"),
        F.when(F.col("id") % 4 < 3, F.timestamp_seconds("id").cast("timestamp_ntz")).alias("ts"),
        F.concat(F.lit("line "), F.col("id")).alias("body"),
    )
    return stage(df, "plan-lines")


@pytest.fixture
def fixed_plan(spark):
    """Plans as for large inputs: nothing small enough to broadcast, no re-planning."""
    settings = {"spark.sql.adaptive.enabled": "false",
                "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def plan_of(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def depth(line: str) -> int:
    return re.search(r"[A-Za-z*]", line).start()


def path_to_body(plan: list[str]) -> list[str]:
    """The operators above the scan that reads the text (the large side)."""
    at = next(i for i, x in enumerate(plan) if "FileScan" in x and "body" in x)
    path, level = [], depth(plan[at])
    for line in reversed(plan[: at + 1]):
        if re.search(r"[A-Za-z*]", line) and depth(line) < level:
            level = depth(line)
            path.append(line)
    return path


def test_text_is_shuffled_twice_for_a_wide_merge(lines, fixed_plan):
    """By segment for the fill, by time for both groupings; the joins add none."""
    wide = merge_wide(collapse_records(lines), ["a", "b"])
    shuffles = [x for x in path_to_body(plan_of(wide)) if "Exchange" in x]
    assert len(shuffles) == 2
    assert "hashpartitioning(ts" in shuffles[1] or "hashpartitioning(ts" in shuffles[0]
    # The same where cells are cut into parts, and numbering adds none.
    cut = merge_wide(collapse_records(lines, limit=50), ["a", "b"])
    assert len([x for x in path_to_body(plan_of(cut)) if "Exchange" in x]) == 2
    assert "part" in "".join(plan_of(cut))
    numbered = number_rows(wide)
    assert len([x for x in path_to_body(plan_of(numbered)) if "Exchange" in x]) == 2


def test_side_passes_do_not_read_the_text(lines, fixed_plan):
    plan = plan_of(number_rows(merge_wide(collapse_records(lines, limit=None), ["a", "b"])))
    scans = [x for x in plan if "FileScan" in x]
    assert len(scans) > 2
    assert sum("body" in x.split("Batched")[0] for x in scans) == 1
    assert all("value" not in x for x in scans)


def test_clip_stands_between_the_scan_and_the_shuffle(lines, fixed_plan):
    within = TimeRange.between("1970-01-01 00:10:00", "1970-01-01 00:20:00")
    clipped = fill_records(with_segments(lines, 5), within=within)
    path = path_to_body(plan_of(clipped))
    semi = next(i for i, x in enumerate(path) if "LeftSemi" in x)
    shuffle = next(i for i, x in enumerate(path) if "Exchange" in x)
    assert "BroadcastHashJoin" in path[semi] and semi < shuffle
    assert len([x for x in path if "Exchange" in x]) == 1


@pytest.mark.parametrize("build", [
    lambda df: forward_fill(with_segments(df)),
    lambda df: flag_disorder(with_segments(df)),
    lambda df: collapse_records(df),
    lambda df: merge_wide(collapse_records(df), ["a", "b"]),
])
def test_no_single_task_and_no_cross_join(lines, fixed_plan, build):
    plan = "\n".join(plan_of(build(lines)))
    assert "SinglePartition" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_numbering_gathers_only_one_row_per_day(lines, fixed_plan):
    plan = plan_of(number_rows(merge_wide(collapse_records(lines), ["a", "b"])))
    single = [i for i, x in enumerate(plan) if "SinglePartition" in x]
    for i in single:
        assert "HashAggregate(keys=[_day" in plan[i + 1]
    assert single
    assert sum("ReusedExchange" in x for x in plan) >= 2


def test_no_python_in_the_parse(spark, lines):
    raw = lines.withColumn("raw", F.col("body")).drop("ts", "body")
    for fmt in ("iso_space_comma_zone", "access_log", "epoch_float", "syslog"):
        plan = "\n".join(plan_of(parse_timestamps(raw, fmt, reference_date="2024-01-01")))
        assert "Python" not in plan and "ArrowEval" not in plan


def test_lookup_tables_are_broadcast_only_when_small(spark):
    df = spark.range(50).selectExpr("id", "id * 2 as twice")
    small, proven = small_side(df, 50)
    assert proven and small.count() == 50
    large, proven = small_side(df, 49)
    assert not proven and large.count() == 50
    probe = spark.range(10).join(large, "id")
    assert "ResolvedHint" not in probe._jdf.queryExecution().analyzed().toString()


def test_staged_tables_can_be_released(spark):
    release_staged(spark)
    one, two = stage(spark.range(3).toDF("id")), stage(spark.range(4).toDF("id"))
    assert one.count() + two.count() == 7
    assert release_staged(spark) == 2
    assert release_staged(spark) == 0


def test_scratch_folder_is_the_session_setting(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert scratch_dir(spark) == named
    else:
        assert "timeloom-" in scratch_dir(spark)
