"""Looking around, against a cursor that walks a list row by row."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timeloom.functions.literals import Jump
from timeloom.operators.explore import (
    file_stats,
    find_next,
    find_previous,
    goto_line,
    goto_timestamp,
    info_table,
    jump,
    jump_lines,
    search,
)

BASE = datetime(2024, 1, 1)
# Gaps, equal milliseconds, and a first row without a time.
TIMES = [None, *[BASE + timedelta(milliseconds=ms, microseconds=us) for ms, us in
                 [(0, 0), (5, 1), (5, 700), (6, 0), (2000, 0), (2000, 1), (9000, 0), (60000, 0)]]]
TEXTS = ["start", "Alpha", "beta", "ALPHA beta", "", "gamma", "alphabet", "delta", "end"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i + 1, t, x, x[::-1]) for i, (t, x) in enumerate(zip(TIMES, TEXTS, strict=True))]
    return spark.createDataFrame(
        data, "line bigint, ts timestamp_ntz, a string, `b.log` string").repartition(3).cache()


def lines(df):
    return [r.line for r in df.collect()]


def shown(ts):
    return ts.strftime("%Y-%m-%d %H:%M:%S.%f")[:23] if ts else ""


def test_search_and_find(rows):
    files = ["a", "b.log"]
    assert sorted(lines(search(rows, "ALPHA", files))) == [2, 4, 7]
    assert sorted(lines(search(rows, "atEB", files))) == [3, 4]
    assert lines(find_next(rows, "alpha", 2, files)) == [4]
    assert lines(find_next(rows, "alpha", 7, files)) == []
    assert lines(find_previous(rows, "alpha", 7, files)) == [4]
    assert lines(find_previous(rows, "alpha", 2, files)) == []


def test_goto_line(rows):
    assert [lines(goto_line(rows, n))[0] for n in (0, 1, 5, 9, 10, 10**12)] == [1, 1, 5, 9, 9, 9]
    assert [lines(jump_lines(rows, 4, n))[0] for n in (-9, -2, 0, 3, 99)] == [1, 2, 4, 7, 9]
    assert lines(jump(rows, 4, "2l")) == [6]
    assert lines(jump(rows, 4, -Jump(2, "l"))) == [2]


def walk(cursor: int, target: str) -> int:
    """Move row by row towards the target time."""
    at, here = cursor - 1, shown(TIMES[cursor - 1])
    if here == target:
        return cursor
    if here < target:
        while at < len(TIMES) - 1 and shown(TIMES[at]) < target:
            at += 1
    else:
        while at > 0 and shown(TIMES[at]) > target:
            at -= 1
    return at + 1


@pytest.mark.parametrize("cursor", [1, 2, 4, 6, 9])
@pytest.mark.parametrize("offset", [-1000, 5, 100, 2000, 8999, 60000, 99999])
def test_goto_timestamp(rows, cursor, offset):
    target = BASE + timedelta(milliseconds=offset)
    assert lines(goto_timestamp(rows, target, cursor)) == [walk(cursor, shown(target))]


@pytest.mark.parametrize(("cursor", "distance"), [
    (2, "5ms"), (4, "2s"), (8, "1h"), (9, "-51s"), (7, "-1d"), (3, "1us"),
])
def test_jump_by_time(rows, cursor, distance):
    step = -Jump.parse(distance[1:]) if distance[0] == "-" else Jump.parse(distance)
    start = TIMES[cursor - 1].replace(
        microsecond=TIMES[cursor - 1].microsecond // 1000 * 1000)
    assert lines(jump(rows, cursor, step)) == [walk(cursor, shown(start + step.distance))]


def test_jump_needs_a_time(rows):
    assert lines(jump(rows, 1, "5s")) == []
    with pytest.raises(ValueError):
        jump(rows, 1, "soon")


def test_statistics(spark):
    entries = spark.createDataFrame(
        [("a", None, 0, " x"), ("a", BASE, 0, "y"), ("a", BASE, 1, "y2"),
         ("b", BASE, 0, "z"), ("b", BASE + timedelta(1), 0, ""),
         ("b", BASE + timedelta(2), 0, "w")],
        "file string, ts timestamp_ntz, part int, body string")
    got = {r.file: (r.n_entries, r.first_ts, r.last_ts)
           for r in file_stats(entries, ["b", "a", "c"]).collect()}
    assert got == {
        "a": (2, None, BASE), "b": (2, BASE, BASE + timedelta(2)), "c": (0, None, None),
        "Overall (merged)": (4, None, BASE + timedelta(2)),
    }
    shown_rows = {r.file: r.row for r in info_table(file_stats(entries, ["a"])).collect()}
    assert shown_rows["a"] == "| a | 2 |  2024-01-01 00:00:00.000 |"
    assert file_stats(entries).where(F.col("file") == "b").first().n_entries == 2


def test_find_next_visits_every_source_of_a_line(spark):
    rows = spark.createDataFrame(
        [(1, "a", "hit"), (1, "b", "hit"), (1, "c", "miss"), (2, "a", "hit")], "line long, file string, log string")
    seen, cursor = [], 0
    while found := find_next(rows, "HIT", cursor).collect():
        cursor = found[0]
        seen.append((cursor.line, cursor.file))
    assert seen == [(1, "a"), (1, "b"), (2, "a")]
    back = find_previous(rows, "hit", cursor).collect()[0]
    assert (back.line, back.file) == (1, "b")
    assert not find_previous(rows, "hit", 1).collect()
