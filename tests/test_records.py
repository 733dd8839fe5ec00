from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timeloom.functions.text import floor_ts
from timeloom.operators.merge import in_time_order, merge_wide
from timeloom.operators.order import with_segments
from timeloom.operators.records import (
    cell_lines,
    collapse_records,
    detect_formats,
    fill_records,
    parse_timestamps,
)
from timeloom.plans.align import align

from logs import JSON_ROWS, LATE_DUPLICATE, LATE_UNIQUE, MULTILINE, TEN, TRACEBACK, plain

BASE = datetime(2024, 1, 1)


def cells(spark, path, **options):
    """(timestamp, cell) rows of one merged file in order."""
    merged = align(spark, [path], **options)
    rows = in_time_order(merged.wide()).collect()
    return [(r.timestamp, r[path]) for r in rows]


def one_cell(rows, second):
    return dict(rows)[f"2023-07-14 08:00:{second}.000"]


TEN_CELLS = [*plain(TEN[:4]),
             ("2023-07-14 08:00:11.000", TEN[4][20:] + "\n" + TEN[5][20:]), *plain(TEN[6:])]


def test_equal_times_share_a_cell(spark, write):
    assert cells(spark, write("a.log", TEN)) == TEN_CELLS


def test_late_duplicate_is_appended(spark, write):
    rows = cells(spark, write("a.log", LATE_DUPLICATE))
    assert one_cell(rows, "11") == "\n".join(
        [TEN[4][20:], TEN[5][20:], "ERROR  Failed to connect to remote server (OOO ++)"])
    assert len(rows) == 8


def test_late_unique_moves_to_its_place(spark, write):
    rows = cells(spark, write("a.log", LATE_UNIQUE))
    assert [t[17:19] for t, _ in rows] == "01 04 06 08 11 12 14 16 22".split()
    assert one_cell(rows, "12") == "ERROR  Failed to connect to remote server (OOO)"


def test_multiline_with_late_duplicate(spark, write):
    rows = cells(spark, write("a.log", MULTILINE))
    assert one_cell(rows, "11") == "\n".join([
        TEN[4][20:], *[" " + line for line in TRACEBACK], TEN[5][20:],
        "INFO   Processing incoming request (a little more...) (OOO)"])


def test_untimestamped_lines_can_be_dropped(spark, write):
    rows = cells(spark, write("a.log", ["no time yet", *MULTILINE[1:]]), detect="first_match",
                 ignore_untimestamped=True)
    assert one_cell(rows, "11") == "\n".join([
        TEN[4][20:], TEN[5][20:], "INFO   Processing incoming request (a little more...) (OOO)"])
    assert "" not in dict(rows)


def test_json_rows(spark, write):
    rows = cells(spark, write("a.jsonl", JSON_ROWS))
    assert [t for t, _ in rows] == [f"2023-07-14 08:00:0{s}.000" for s in (1, 4, 6)]
    assert one_cell(rows, "01") == "order: 17\nurgent: true"
    assert one_cell(rows, "04") == ('order: 18\nparts: ["bolt","nut"]\nnote: first shelf empty\n'
                                    "  try the second\nor call")
    assert one_cell(rows, "06") == "order: 19\nweight: 2.5\n  order: 19\ncustomer: None"


def test_two_files_side_by_side(spark, write):
    a, b = write("a.log", MULTILINE), write("b.log", [TEN[0], TEN[2].replace(":06", ":07")])
    merged = align(spark, [a, b])
    rows = in_time_order(merged.wide(line_numbers=True)).collect()
    assert [r.line for r in rows] == list(range(1, 11))
    by_time = {r.timestamp[17:19]: (r[a], r[b]) for r in rows}
    assert by_time["01"] == (TEN[0][20:], TEN[0][20:])
    assert by_time["07"] == ("", TEN[2][20:])
    assert by_time["06"] == (TEN[2][20:], "")
    long = merged.long(line_numbers=True).orderBy("line", "file_no").collect()
    assert [(r.line, r.file) for r in long[:4]] == [(1, a), (1, b), (2, a), (3, a)]
    assert len(long) == 11
    stats = {r.file: (r.n_entries, r.first_ts.second, r.last_ts.second)
             for r in merged.stats().collect()}
    assert stats == {a: (9, 1, 22), b: (2, 1, 7), "Overall (merged)": (10, 1, 22)}


def test_no_timestamp_at_all_and_empty_file(spark, write):
    lines = ["DEBUG  Start trace", "DEBUG  End trace"]
    a, b, c = write("a.log", lines), write("b.log", ""), write("c.log", [lines[0], TEN[0]])
    rows = in_time_order(align(spark, [a, b, c]).wide()).collect()
    assert [(r.timestamp, r[a], r[b], r[c]) for r in rows] == [
        ("", " DEBUG  Start trace\n DEBUG  End trace", "", f" {lines[0]}\n {TEN[0]}")]
    later = in_time_order(align(spark, [a, b, c], detect="first_match").wide()).collect()
    assert [(r.timestamp, r[c]) for r in later] == [
        ("", f" {lines[0]}"), ("2023-07-14 08:00:01.000", TEN[0][20:])]
    stats = {r.file: (r.n_entries, r.first_ts) for r in align(spark, [a, b]).stats().collect()}
    assert stats[b] == (0, None)


def test_detection_is_per_file(spark, write):
    mine = {"a": "2023-07-14 08:00:01,5 x", "b": "Jul 14 08:00:02 x", "c": "1689339601 x",
            "d": "x"}
    rows = [(f, 0, i, raw) for f, first in mine.items()
            for i, raw in enumerate([first, "2023-07-14 08:00:01 y"])]
    df = spark.createDataFrame(rows, "file string, block_start bigint, seq bigint, raw string")
    found = dict(detect_formats(df).collect())
    assert found == {"a": "iso_space_comma", "b": "syslog", "c": "epoch_seconds", "d": None}
    assert dict(detect_formats(df, scan="first_match").collect())["d"] == "iso_space_whole"
    parsed = parse_timestamps(df, found).where(F.col("seq") == 1)
    assert {r.body for r in parsed.collect()} == {" 2023-07-14 08:00:01 y"}


def many_lines(seed: int, n: int = 900):
    """Out of order, many equal times, long stretches without any, early lines without one."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        quiet = seq < 5 or 300 <= seq < 600
        ts = None if quiet or rng.random() < 0.5 else BASE + timedelta(seconds=rng.randrange(40))
        rows.append(("big" if rng.random() < 0.9 else "small", 0, seq, ts, f"line {seq}"))
    return rows


SCHEMA = "file string, block_start bigint, seq bigint, ts timestamp_ntz, body string"


def expected_cells(rows):
    last, found = {}, {}
    for file, _, seq, ts, body in sorted(rows, key=lambda r: r[2]):
        last[file] = ts or last.get(file)
        found.setdefault((file, last[file]), []).append(body)
    return {k: "\n".join(v) for k, v in found.items()}


@pytest.mark.parametrize("bits", [2, 5, 17])
@pytest.mark.parametrize("limit", [None, 60, 500, 10**9])
def test_nothing_is_lost_in_long_cells(spark, bits, limit):
    """However cells are cut, their parts in order give the whole cell."""
    rows = many_lines(bits)
    df = with_segments(spark.createDataFrame(rows, SCHEMA).repartition(3), bits)
    entries = collapse_records(df, limit=limit).collect()
    pieces: dict = {}
    for r in sorted(entries, key=lambda r: r.part):
        pieces.setdefault((r.file, r.ts), []).append(r.body)
    assert {k: "\n".join(v) for k, v in pieces.items()} == expected_cells(rows)
    assert sum(r.n_lines for r in entries) == len(rows)
    if limit is None or limit > 10**6:
        assert all(r.part == 0 for r in entries)
    if limit == 60 and bits == 2:
        # A part holds less than the limit plus one segment of four lines.
        assert max(len(r.body) for r in entries) < 60 + 4 * 10
        assert max(r.part for r in entries) > 10
    assert all(0 in {r.part for r in entries if (r.file, r.ts) == k} for k in pieces)


def test_dropping_untimestamped_keeps_parts_too(spark):
    rows = many_lines(8)
    df = with_segments(spark.createDataFrame(rows, SCHEMA), 2)
    entries = collapse_records(df, ignore_untimestamped=True, limit=30).collect()
    stamped = [r for r in rows if r[3]]
    assert sum(r.n_lines for r in entries) == len(stamped)
    assert max(r.part for r in entries) > 0
    pieces: dict = {}
    for r in sorted(entries, key=lambda r: r.part):
        pieces.setdefault((r.file, r.ts), []).append(r.body)
    assert {k: "\n".join(v) for k, v in pieces.items()} == expected_cells(stamped)


def test_one_time_holding_a_third_of_all_lines(spark):
    """A hot second in a hot source is spread over parts and merged whole."""
    n = 6000
    hot = F.col("id") % 3 == 0
    df = spark.range(n).select(
        F.when(F.col("id") % 10 < 8, "big").otherwise("other").alias("file"),
        F.lit(0).cast("bigint").alias("block_start"), F.col("id").alias("seq"),
        (F.lit("2024-01-01").cast("timestamp_ntz")
         + F.make_dt_interval(mins=F.when(hot, 0).otherwise(F.col("id").cast("int")))).alias("ts"),
        F.concat(F.lit("line "), F.col("id")).alias("body"),
    )
    entries = collapse_records(with_segments(df, 6), limit=1000)
    wide = merge_wide(entries, ["big", "other"])
    hot_rows = wide.where(F.col("ts") == F.lit("2024-01-01").cast("timestamp_ntz"))
    got = hot_rows.orderBy("part").collect()
    assert len(got) > 15
    text = "\n".join(r.big for r in got if r.big)
    assert text == "\n".join(f"line {i}" for i in range(0, n, 3) if i % 10 < 8)
    assert entries.agg(F.sum("n_lines")).first()[0] == n


def test_coarser_key(spark):
    rows = many_lines(4)
    df = spark.createDataFrame(rows, SCHEMA)
    got = collapse_records(df, key=lambda ts: floor_ts(ts, "minute")).collect()
    want: dict = {}
    last: dict = {}
    for file, _, _, ts, body in rows:
        last[file] = ts or last.get(file)
        minute = last[file] and last[file].replace(second=0)
        want.setdefault((file, minute), []).append(body)
    assert {(r.file, r.ts): r.body for r in got} == {k: "\n".join(v) for k, v in want.items()}


def test_more_groups_than_a_reorder_buffer(spark, write):
    """Sixty records, one time repeated early: all survive."""
    lines = [f"2023-07-14 08:{i:02d}:00 n{i}" for i in range(60)]
    lines[20] = "2023-07-14 08:05:00 again"
    rows = cells(spark, write("a.log", lines))
    assert len(rows) == 59
    assert dict(rows)["2023-07-14 08:05:00.000"] == "n5\nagain"


def test_input_order_does_not_matter(spark):
    rows = many_lines(6)
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    one = collapse_records(df).drop("first_line").collect()
    two = collapse_records(df.orderBy(F.rand(1))).drop("first_line").collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))


def test_filled_lines_keep_their_columns(spark):
    df = spark.createDataFrame(many_lines(1, 20), SCHEMA).withColumn("extra", F.col("seq"))
    filled = fill_records(df)
    assert set(filled.columns) == {"file", "block_start", "seq", "ts", "body", "extra", "segment",
                                   "rec_ts"}
    cut = fill_records(df, limit=3)
    assert "part" in cut.columns


def test_splits_do_not_matter(spark, write, small_splits):
    """A file read in many blocks, some of them without any time."""
    lines = MULTILINE[:5] + [f"    frame {i} of a long trace" for i in range(200)] + MULTILINE[12:]
    path = write("a.log", lines)
    whole = cells(spark, path)
    small_splits(150)
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    assert cells(spark, path) == whole
    assert one_cell(whole, "11").count("frame") == 200


def test_rows_do_not_depend_on_the_number_of_files(spark, write):
    """A log of two large cells is two entries alone and beside many other files."""
    big = [f"2024-01-01 00:00:0{s} " + f"{s}" * 100 if i == 0 else "x" * 99 for s in (1, 2) for i in range(30_000)]
    one = write("big.log", big)
    others = [write(f"f{i}.log", ["2024-01-01 00:00:05 small"]) for i in range(20)]
    for paths in ([one], [one, *others]):
        merged = align(spark, paths)
        mine = merged.entries.where(F.col("file") == one).select("ts", "n_lines", F.length("body").alias("size"))
        assert [tuple(r)[1:] for r in mine.orderBy("ts").collect()] == [(30_000, 30_000 * 100 + 29_999)] * 2
        in_lines = merged.lines(line_numbers=True).where(F.col("file") == one)
        facts = in_lines.groupBy("line", "ts").agg(F.count("*"), F.min("line_in_cell"), F.max("line_in_cell"),
                                                   F.countDistinct("line_in_cell")).orderBy("line").collect()
        assert [(r[0], *r[2:]) for r in facts] == [(n, 30_000, 1, 30_000, 30_000) for n in (1, 2)]


def test_cell_lines_give_the_cells(spark):
    rows = [("a" if i % 3 else "b", 0, i, None if i < 4 or i % 5 else BASE + timedelta(seconds=i % 4), f"l{i}")
            for i in range(400)]
    df = spark.createDataFrame(rows, "file string, block_start long, seq long, ts timestamp_ntz, body string")
    lines = with_segments(df, 4)
    found = {}
    for r in sorted(cell_lines(fill_records(lines)).collect(), key=lambda r: r.line_in_cell):
        found.setdefault((r.file, r.ts), []).append(r.body)
    cells = {(r.file, r.ts): r.body.split("\n") for r in collapse_records(lines).collect()}
    assert found == cells and (None in {ts for _, ts in cells})
