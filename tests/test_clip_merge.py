from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timeloom.operators.asof import asof_join, nearest_times
from timeloom.operators.clip import TimeRange, autoclip, clip
from timeloom.operators.merge import merge_long, merge_two, merge_wide, unpivot
from timeloom.operators.order import LineOrder, with_segments
from timeloom.operators.records import collapse_records, fill_records, segments_within
from timeloom.plans.align import align

from logs import MULTILINE, TEN

BASE = datetime(2024, 1, 1)


def times(spark, values):
    return spark.createDataFrame([(v,) for v in values], "ts timestamp_ntz")


def test_clip_bounds_are_inclusive(spark):
    df = times(spark, [None, *[BASE + timedelta(hours=h) for h in range(5)]])
    def kept(**options):
        return sorted(r.ts.hour if r.ts else -1 for r in clip(df, **options).collect())
    assert kept(start="2024-01-01 01:00", end="2024-01-01T03:00") == [1, 2, 3]
    assert kept(start="2024-01-01 03:00") == [3, 4]
    assert kept(end="2024-01-01 01:00") == [-1, 0, 1]
    assert kept() == [-1, 0, 1, 2, 3, 4]
    assert kept(start="2h", now=BASE + timedelta(hours=4)) == [2, 3, 4]
    with pytest.raises(ValueError):
        clip(df, "2024-01-02", "2024-01-01")


def test_records_live_or_die_whole(spark, write):
    path = write("a.log", MULTILINE)
    rows = align(spark, [path], start="2023-07-14 08:00:12").wide().collect()
    assert sorted(r.timestamp[17:19] for r in rows) == ["14", "16", "19", "22"]
    assert not any("Traceback" in r[path] for r in rows)


def test_autoclip(spark, write):
    a, b = write("a.log", [TEN[2], "more", TEN[1], TEN[3]]), write("b.log", ["early", *TEN])
    rows = align(spark, [a, b], autoclip_to_first=True).wide().collect()
    assert sorted(r.timestamp[17:19] for r in rows) == ["04", "06", "08"]
    df = times(spark, [BASE])
    with pytest.raises(Exception, match="no timestamps"):
        autoclip(df, times(spark, [None])).collect()


def log_lines(spark, seed: int, n: int = 400):
    """Two sources roughly in time order, with records of many lines and untimed heads."""
    rng = random.Random(seed)
    rows = []
    for file in "ab":
        for seq in range(n):
            ts = BASE + timedelta(seconds=seq + rng.randrange(-9, 9))
            timed = rng.random() < 0.4 and seq > 20 and not 120 < seq < 180
            rows.append((file, 0, seq, ts if timed else None, f"{file}{seq}"))
    return spark.createDataFrame(
        rows, "file string, block_start bigint, seq bigint, ts timestamp_ntz, body string")


@pytest.mark.parametrize("lo, hi", [(100, 200), (None, 130), (350, None), (9000, None)])
def test_clip_before_the_shuffle_keeps_the_same_lines(spark, lo, hi):
    def at(s):
        return None if s is None else BASE + timedelta(seconds=s)
    lines = with_segments(log_lines(spark, 7), 3)
    order, within = LineOrder(group_bits=2), TimeRange.between(at(lo), at(hi))
    expected = clip(fill_records(lines, order=order), at(lo), at(hi), ts="rec_ts")
    got = fill_records(lines, order=order, within=within)
    assert got.columns == expected.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    cut = fill_records(lines, order=order, limit=40, within=within)
    whole = clip(fill_records(lines, order=order, limit=40), at(lo), at(hi), ts="rec_ts")
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
    timed = fill_records(lines, True, order, within=within)
    assert timed.count() == clip(lines.where("ts IS NOT NULL"), at(lo), at(hi)).count()


def test_fewer_segments_for_a_narrower_range(spark):
    lines = with_segments(log_lines(spark, 8), 3)
    def kept(lo, hi):
        within = TimeRange.between(BASE + timedelta(seconds=lo), BASE + timedelta(seconds=hi))
        return segments_within(lines, within).count()
    timed = fill_records(lines).where("rec_ts IS NOT NULL").select("file", "segment").distinct()
    assert kept(-9, 999) == timed.count() < 2 * 50  # all but the untimed heads of both sources
    assert 0 < kept(300, 310) <= 8 < kept(200, 310) < kept(50, 310)
    assert kept(5000, 6000) == 0


def entries_of(spark, seed=0, n=300):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), 0, i, BASE + timedelta(seconds=rng.randrange(60)), f"t{i}")
            for i in range(n)]
    rows += [("a", 0, -5, None, " lost"), ("b", 0, -5, None, " also lost")]
    df = spark.createDataFrame(
        rows, "file string, block_start bigint, seq bigint, ts timestamp_ntz, body string")
    want: dict = {}
    for file, _, _, ts, body in sorted(rows, key=lambda r: r[2]):
        want.setdefault(ts, {}).setdefault(file, []).append(body)
    return collapse_records(df), {
        ts: {f: "\n".join(x) for f, x in cells.items()} for ts, cells in want.items()
    }


def test_wide_long_and_unpivot_agree(spark):
    entries, want = entries_of(spark)
    files = ["c", "a", "b"]
    wide = merge_wide(entries, files)
    assert wide.columns == ["ts", "part", *files]
    got = {r.ts: {f: r[f] for f in files if r[f]} for r in wide.collect()}
    assert got == want
    long = merge_long(entries, files).collect()
    order = [None, *sorted(t for t in want if t)]
    assert {(r.line, r.file): r.log for r in long} == {
        (order.index(ts) + 1, f): text for ts, cells in want.items() for f, text in cells.items()
    }
    back = unpivot(wide, files).collect()
    assert {(r.ts, r.file_no): r.log for r in back} == {
        (ts, files.index(f)): text for ts, cells in want.items() for f, text in cells.items()
    }
    assert merge_wide(entries, ["a"]).columns == ["ts", "part", "a"]


def test_two_sources_as_outer_join(spark):
    entries, want = entries_of(spark, 1)
    two = merge_two(entries.where("file = 'a'"), entries.where("file = 'b'"), "a", "b")
    got = {r.ts: (r.a, r.b) for r in two.collect()}
    assert got == {ts: (c.get("a", ""), c.get("b", "")) for ts, c in want.items()
                   if "a" in c or "b" in c}


def test_too_many_sources_for_columns(spark):
    entries, _ = entries_of(spark, 2, 5)
    with pytest.raises(ValueError, match="merge_long"):
        merge_wide(entries, [str(i) for i in range(1001)])


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_against_brute_force(spark, direction):
    rng = random.Random(5)
    def draw(n):
        return [BASE + timedelta(days=rng.randrange(0, 40, 7), seconds=rng.randrange(3),
                                 microseconds=rng.randrange(5)) for _ in range(n)]
    rows, probes = sorted(set(draw(60))), draw(200)
    right = spark.createDataFrame([(t, str(t)) for t in rows], "ts timestamp_ntz, body string")
    left = spark.createDataFrame([(i, t) for i, t in enumerate(probes)],
                                 "id int, ts timestamp_ntz")
    def best(t):
        fits = [r for r in rows if (r <= t if direction == "backward" else r >= t)]
        return (max(fits) if direction == "backward" else min(fits)) if fits else None
    got = {r.id: (r.match_ts, r.match_body) for r in asof_join(left, right, direction).collect()}
    assert got == {i: (best(t), str(best(t)) if best(t) else None) for i, t in enumerate(probes)}
    edge = rows[0] if direction == "backward" else rows[-1]
    clamped = asof_join(left, right, direction, clamp=True).collect()
    assert {r.id: r.match_ts for r in clamped} == {
        i: best(t) or edge for i, t in enumerate(probes)}


def test_asof_hot_probe(spark):
    """A third of all probes at one time."""
    left = spark.range(3000).select(
        F.col("id"), (F.lit(BASE.isoformat(" ")).cast("timestamp_ntz") + F.make_dt_interval(
            secs=F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id") % 100)
            .cast("decimal(18,6)"))).alias("ts"))
    right = times(spark, [BASE + timedelta(seconds=s) for s in range(10, 100, 20)])
    got = asof_join(left, right).where("ts = timestamp_ntz'2024-01-01 00:00:50'")
    assert got.select("match_ts").distinct().collect() == [(BASE + timedelta(seconds=50),)]
    assert got.count() > 1000
    with pytest.raises(ValueError):
        nearest_times(left, right, "sideways")


def test_sources_that_are_not_listed_fail(spark):
    entries = spark.sql("SELECT 'a' AS file, timestamp_ntz'2024-01-01' AS ts, 0 AS part, 'x' AS body "
                        "UNION ALL SELECT 'b', timestamp_ntz'2024-01-02', 0, 'y'")
    assert merge_wide(entries, ["a", "b"]).count() == 2
    with pytest.raises(Exception, match="not in the list of files: b"):
        merge_wide(entries, ["a"]).collect()
    with pytest.raises(Exception, match="not in the list of files: b"):
        merge_long(entries, ["a"]).collect()
    with pytest.raises(ValueError, match="columns of the result"):
        merge_wide(entries, ["a", "ts"])
