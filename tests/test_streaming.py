from __future__ import annotations

import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from timeloom.operators.records import parse_timestamps
from timeloom.streaming.assemble import (
    HELD, RecordProcessor, assemble_stream, pieces, read_log_stream, run_to_end,
)
from timeloom.streaming.timeline import CHUNK, CHUNK_CHARS, MergeProcessor, merge_stream, merge_with_late

from logs import MULTILINE, TRACEBACK

BASE = datetime(2024, 1, 1)
LINES = "file string, block_start bigint, seq bigint, ts timestamp_ntz, body string, ends boolean"


def feed(spark, folder, batches, schema):
    """Files in the order of the batches, one per micro-batch."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def assemble(spark, tmp_path, batches, idle=None):
    """All records of some batches; rows without an end mark get one that says no."""
    full = [[(*r, False)[:6] for r in batch] for batch in batches]
    stream = feed(spark, f"{tmp_path}/in", full, LINES)
    return run_to_end(assemble_stream(stream, idle), f"{tmp_path}/out", f"{tmp_path}/checkpoint",
                      timers=idle is not None)


def end_of(*files):
    return [(f, 9, 0, None, None, True) for f in files]


def expected(rows):
    last, found = {}, []
    for file, _, _, ts, body in rows:
        if ts or file not in last:
            last[file] = [file, ts, []]
            found.append(last[file])
        last[file][2].append(body)
    return sorted((f, str(t), "\n".join(b)) for f, t, b in found)


def random_batches(seed, n=120, batches=4):
    """Two sources, times rising, records cut anywhere between the batches."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        file = rng.choice(["a", "a", "b"])
        stamped = rng.random() < 0.3
        rows.append((file, 0, i, BASE + timedelta(seconds=i) if stamped else None, f"{file}{i}"))
    cuts = sorted(rng.sample(range(1, n), batches - 1))
    return rows, [rows[i:j] for i, j in zip([0, *cuts], [*cuts, n], strict=True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_records_over_batches_equal_the_whole(spark, tmp_path, seed):
    rows, batches = random_batches(seed)
    out = assemble(spark, tmp_path, [*batches, end_of("a", "b")])
    got = sorted((r.file, str(r.ts), r.body) for r in out.collect())
    assert got == expected(rows)
    assert {r.piece for r in out.collect()} == {0}


def test_last_record_stays_open_until_something_ends_it(spark, tmp_path):
    out = assemble(spark, tmp_path, [[("a", 0, 0, BASE, "x"), ("a", 0, 1, None, "y")]])
    assert out.collect() == []
    later = [("a", 0, 2, None, "z"), ("a", 0, 3, BASE + timedelta(1), "next")]
    assert [tuple(r) for r in assemble(spark, tmp_path, [later]).collect()] == [("a", BASE, 0, 3, "x\ny\nz")]
    out = assemble(spark, tmp_path, [end_of("a")])
    assert sorted((r.ts, r.body) for r in out.collect()) == [(BASE, "x\ny\nz"), (BASE + timedelta(1), "next")]


def test_idle_records_are_written_and_continue_as_pieces(spark, tmp_path):
    idle = timedelta(seconds=1)
    assemble(spark, tmp_path, [[("a", 0, 0, BASE, "x"), ("a", 0, 1, None, "y"), ("b", 0, 0, None, "no time")]], idle)
    time.sleep(1.2)
    # Timers run with any batch, whatever its source.
    out = assemble(spark, tmp_path, [[("c", 0, 0, BASE, "other")]], idle)
    written = [("a", BASE, 0, 2, "x\ny"), ("b", None, 0, 1, "no time")]
    assert sorted(tuple(r) for r in out.collect() if r.file != "c") == written
    more = [("a", 0, 2, None, "z"), ("a", 0, 3, BASE, "same time"), ("a", 0, 4, BASE + timedelta(1), "next"),
            ("b", 0, 1, None, "still none")]
    out = assemble(spark, tmp_path, [more, end_of("a", "b", "c")], idle)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([
        *written, ("a", BASE, 1, 2, "z\nsame time"), ("a", BASE + timedelta(1), 0, 1, "next"),
        ("b", None, 1, 1, "still none"), ("c", BASE, 0, 1, "other")], key=str)


def test_a_batch_that_a_run_broke_off_hides_no_later_files(spark, tmp_path):
    idle = timedelta(minutes=5)
    assemble(spark, tmp_path, [[("a", 0, 0, BASE, "x")]], idle)
    # The last batch without input was planned but did not end.
    planned = max(int(f.name) for f in (tmp_path / "checkpoint/offsets").iterdir() if f.name.isdigit())
    for name in (f"{planned}", f".{planned}.crc"):
        (tmp_path / "checkpoint/commits" / name).unlink(missing_ok=True)
    out = assemble(spark, tmp_path, [[("a", 0, 1, None, "y")], end_of("a")], idle)
    assert [tuple(r) for r in out.collect()] == [("a", BASE, 0, 2, "x\ny")]


def test_equal_times_meet_across_batches(spark, tmp_path):
    def at(s):
        return BASE + timedelta(seconds=s)
    batches = [[("a", 0, 0, at(0), "0"), ("a", 0, 1, at(1), "1"), ("a", 0, 2, at(1), "1 again")],
               [("a", 0, 3, at(1), "1 once more"), ("a", 0, 4, None, "with a line")],
               [("a", 0, 5, at(1), "1 still"), ("a", 0, 6, at(2), "2"), ("a", 0, 7, at(1), "late 1"),
                ("a", 0, 8, at(3), "3"), ("a", 0, 9, at(1), "late again")],
               end_of("a")]
    out = assemble(spark, tmp_path, batches)
    assert sorted((r.ts, r.body) for r in out.collect()) == [
        (at(0), "0"), (at(1), "1\n1 again\n1 once more\nwith a line\n1 still"), (at(1), "late 1"),
        (at(1), "late again"), (at(2), "2"), (at(3), "3")]


def test_only_edges_of_a_busy_source_meet(spark):
    rows = [("a", 0, i, BASE + timedelta(seconds=i) if i % 3 == 1 else None, str(i), False) for i in range(3000)]
    found = pieces(spark.createDataFrame(rows, LINES).coalesce(1)).collect()
    assert sum(r.slot == 0 for r in found) == 3 and len({r.slot for r in found}) > 10
    assert sum(r.n_lines for r in found) == 3000
    # A block that is read later but stands earlier begins a run of its own.
    swapped = spark.createDataFrame(rows[1500:] + rows[:1500], LINES).coalesce(1)
    assert sum(r.slot == 0 for r in pieces(swapped).collect()) == 6


def test_text_files_as_a_stream(spark, tmp_path):
    """A rolled log: two files of one source, the second starting inside a record."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "app.log.2").write_text("\n".join(MULTILINE[:8]) + "\n")
    os.utime(folder / "app.log.2", (1, 1))
    (folder / "app.log.1").write_text("\n".join(MULTILINE[8:]) + "\n")
    source = F.regexp_extract("_metadata.file_name", r"^(.*)\.\d+$", 1)
    stream = read_log_stream(spark, str(folder), source, maxFilesPerTrigger="1")
    lines = parse_timestamps(stream, "iso_space_whole")
    out = run_to_end(assemble_stream(lines), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert {r.file for r in out.collect()} == {"app.log"}
    eleven = [r.body for r in out.collect() if r.ts.second == 11]
    assert "\n".join([MULTILINE[4][20:], *[" " + x for x in TRACEBACK]]) in "\n".join(eleven)
    # The last line of the log is still open.
    assert out.agg(F.sum("n_lines")).first()[0] == len(MULTILINE) - 1


ENTRIES = "file string, ts timestamp_ntz, seq bigint, body string"


def run_merge(spark, tmp_path, batches, **options):
    stream = feed(spark, f"{tmp_path}/in", batches, ENTRIES)
    merged = merge_stream(stream, ["a", "b"], **options)
    query = (merged.writeStream.format("parquet").outputMode("append")
             .option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.schema(merged.schema).parquet(f"{tmp_path}/out").collect()
    return sorted((r.ts, r.part, r.a, r.b) for r in rows)


def test_merge_by_time_with_watermark(spark, tmp_path):
    def at(s):
        return BASE + timedelta(seconds=s)
    batches = [
        [("a", at(1), 1, "a1"), ("b", at(1), 2, "b1"), ("a", at(1), 0, "a0")],
        [("b", at(2), 3, "b2"), ("a", at(1), 4, "a4")],
        [("a", at(500), 5, "far")],
        # Late lines are judged by the watermark the batch before them ended with.
        [("a", at(501), 8, "further")],
        [("a", at(3), 6, "too late")],
        [("a", at(900), 7, "end")],
    ]
    assert run_merge(spark, tmp_path, batches, delay="1 minute") == [
        (at(1), 0, "a0\na1\na4", "b1"), (at(2), 0, "", "b2"), (at(500), 0, "far", ""),
        (at(501), 0, "further", ""),
    ]


def test_merge_by_window_in_slices(spark, tmp_path):
    def at(m):
        return BASE + timedelta(minutes=m)
    batches = [[("a", at(m), m, f"a{m}") for m in (0, 20, 40, 59, 61)],
               [("a", at(9999), 1, "end")]]
    got = run_merge(spark, tmp_path, batches, window=timedelta(hours=1), slices=3)
    assert got == [(BASE, 0, "a0", ""), (BASE, 1, "a20", ""), (BASE, 2, "a40\na59", ""),
                   (at(60), 0, "a61", "")]
    with pytest.raises(ValueError, match="slices"):
        merge_stream(spark.createDataFrame([], ENTRIES), ["a"],
                     window=timedelta(microseconds=10), slices=3)


def test_late_entries_are_rows_of_their_own(spark, tmp_path):
    def at(s):
        return BASE + timedelta(seconds=s)
    batches = [
        [("a", at(1), 1, "a1"), ("b", at(1), 2, "b1"), ("a", at(100), 3, "a100")],
        [("a", at(1), 4, "late a"), ("b", at(59), 5, "in time"), ("b", at(300), 6, "b300")],
        [("a", at(59), 7, "late again"), ("a", at(100), 8, "late too"), ("b", at(300), 9, "more")],
    ]
    stream = feed(spark, f"{tmp_path}/in", batches, ENTRIES)
    merged = merge_with_late(stream, ["a", "b"], delay="50 seconds", window=timedelta(seconds=10))
    rows = run_to_end(merged, f"{tmp_path}/out", f"{tmp_path}/checkpoint", partition="late").collect()
    assert sorted((r.late, r.ts, r.a, r.b) for r in rows) == [
        (False, at(0), "a1", "b1"), (False, at(50), "", "in time"), (False, at(100), "a100", ""),
        (True, at(1), "late a", ""), (True, at(59), "late again", ""), (True, at(100), "late too", "")]
    assert sorted(os.listdir(f"{tmp_path}/out"))[-2:] == ["late=false", "late=true"]
    with pytest.raises(ValueError, match="late"):
        merge_with_late(stream, ["late"])


class CountedState:
    """Handle, value and list of one key that counts the messages they would take."""

    def __init__(self):
        self.items, self.timers, self.calls = [], [], 0

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        return CountedValue(self)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def exists(self):
        self.calls += 1
        return bool(self.items)

    def appendValue(self, item):
        self.calls += 1
        self.items.append(item)

    def get(self):
        self.calls += 1
        return iter(self.items)

    def clear(self):
        self.calls += 1
        self.items = []


class CountedValue:
    def __init__(self, held):
        self.held, self.value = held, None

    def get(self):
        self.held.calls += 1
        return self.value

    def exists(self):
        self.held.calls += 1
        return self.value is not None

    def update(self, value):
        self.held.calls += 1
        self.value = value

    def clear(self):
        self.update(None)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getCurrentProcessingTimeInMs = getCurrentWatermarkInMs


def edge(number, us, body, ends=False, arrived=0):
    return Row(arrived=arrived, path="", block_start=0, seq=number, number=number, us=us, stamped=us is not None,
               n_lines=0 if ends else body.count("\n") + 1, body=body, ends=ends)


def test_a_source_takes_few_messages_a_batch():
    held, processor = CountedState(), RecordProcessor(500)
    processor.init(held)

    def calls(*rows, at):
        before = held.calls
        found = list(processor.handleInputRows(("a", 0), iter(rows), Clock(at)))
        return held.calls - before, [(r.ts, r.piece, r.n_lines, r.body) for r in found]

    # Read, write and a timer; the old one goes.
    assert calls(edge(0, None, "none"), edge(1, 1, "x"), edge(2, 2, "y\nz"), at=0) == (
        3, [(None, 0, 1, "none"), (datetime(1970, 1, 1, 0, 0, 0, 1), 0, 1, "x")])
    second = datetime(1970, 1, 1, 0, 0, 0, 2)
    assert calls(edge(0, None, "more"), edge(1, 2, "same time"), at=100) == (4, [])
    assert held.timers == [600]
    before = held.calls
    (row,) = processor.handleExpiredTimer(("a", 0), Clock(600), None)
    assert (row.ts, row.piece, row.n_lines, row.body) == (second, 0, 4, "y\nz\nmore\nsame time")
    assert held.calls - before == 2
    held.timers.clear()
    # Long lines go to the list, in order with what comes before and after.
    long = "l" * (HELD + 1)
    assert calls(edge(0, None, "next"), at=700)[1] == []
    assert calls(edge(0, None, long), at=800)[1] == [] and len(held.items) == 1
    assert calls(edge(0, None, "last"), at=900)[1] == [] and len(held.items) == 1
    n, found = calls(edge(0, None, "", ends=True), at=1000)
    assert found == [(second, 1, 3, f"next\n{long}\nlast")] and not held.items and not held.timers
    # After an end mark a source begins anew.
    assert calls(edge(0, None, "fresh"), edge(1, None, "", ends=True), at=1100)[1] == [(None, 0, 1, "fresh")]


def test_entries_of_a_window_are_held_in_chunks():
    held, processor = CountedState(), MergeProcessor(["a", "b"])
    processor.init(held)
    n = 2 * CHUNK + 5
    rows = [Row(us=i % 7, seq=i, number=i % 2, body=str(i)) for i in range(n)]
    key, early = (0, 3_600_000_000), Clock(0)
    assert list(processor.handleInputRows(key, iter(rows[5:]), early)) == []
    assert list(processor.handleInputRows(key, iter(rows[:5]), early)) == []
    # Chunks, a look whether there are any, and one timer.
    assert held.calls == 2 + 1 + 2 + 1 and len(held.timers) == 1
    (row,) = processor.handleExpiredTimer(key, Clock(3_600_000), None)
    order = sorted(range(n), key=lambda i: (i % 7, i))
    assert (row.late, row.ts) == (False, datetime(1970, 1, 1))
    assert row.a == "\n".join(str(i) for i in order if i % 2 == 0)
    assert row.b == "\n".join(str(i) for i in order if i % 2)
    # Long texts fill a chunk on their own.
    long = [Row(us=0, seq=i, number=0, body="x" * CHUNK_CHARS) for i in range(3)]
    assert list(processor.handleInputRows(key, iter(long), early)) == []
    assert len(held.items) == 3


def test_merge_keeps_hours_that_the_zone_skips(spark, tmp_path, zone):
    zone("America/Chicago")
    gap = datetime(2024, 3, 10, 2, 30)
    batches = [[("a", gap, 1, "gap"), ("b", gap + timedelta(hours=1), 2, "real"), ("a", gap + timedelta(1), 3, "end")]]
    assert run_merge(spark, tmp_path, batches, delay="1 hour") == [
        (gap, 0, "gap", ""), (gap + timedelta(hours=1), 0, "", "real")]
