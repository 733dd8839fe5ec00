from __future__ import annotations

import csv
import errno
import gzip
import io
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timeloom.operators.order import flag_disorder, with_segments
from timeloom.operators.records import detect_formats, parse_timestamps
from timeloom.functions.formats import FormatRegistry
from timeloom.plans.align import align, detect_file_formats
from timeloom.sources import csv_records, packets, synthetic
from timeloom.sources.csv_records import leaves_quote_open, opens_quote, read_csv_lines
from timeloom.sources.files import expand_paths, file_heads, read_logs, read_text, register_reader

from logs import JSON_ROWS, TEN


def raw_lines(df):
    return [r.raw for r in df.orderBy("block_start", "seq").collect()]


# --- text, gzip, dispatch ---------------------------------------------------------------

def test_universal_line_ends(spark, write):
    path = write("a.log", "one\ntwo\r\nthree\rfour")
    assert raw_lines(read_text(spark, [path])) == ["one", "two", "three", "four"]


def test_gzip_is_text_whatever_it_is_called(spark, tmp_path):
    path = tmp_path / "x.csv.gz"
    path.write_bytes(gzip.compress("\n".join(TEN).encode()))
    lines, names = read_logs(spark, [str(path)])
    assert names == [str(path)]
    assert raw_lines(lines) == TEN


def test_order_over_many_blocks(spark, write, small_splits):
    lines = [f"line {i}" for i in range(2000)]
    path = write("a.log", lines)
    small_splits(1000)
    df = read_text(spark, [path])
    assert df.select("block_start").distinct().count() > 15
    assert raw_lines(df) == lines


def test_names_folders_and_globs(spark, write, tmp_path):
    a, b = write("b.log", TEN[:1]), write("a.log", TEN[1:2])
    lines, names = read_logs(spark, [a, b, a])
    assert names == [a, b]
    assert {(r.file, r.raw) for r in lines.collect()} == {(a, TEN[0]), (b, TEN[1])}
    assert [f.name.rsplit("/", 1)[1] for f in expand_paths(spark, [str(tmp_path)])] == [
        "a.log", "b.log"]
    assert len(expand_paths(spark, [str(tmp_path / "*.log")])) == 2
    # One file under two names is two sources.
    lines, names = read_logs(spark, [a, f"file:{a}"])
    assert {r.file for r in lines.collect()} == set(names) == {a, f"file:{a}"}
    with pytest.raises(FileNotFoundError):
        read_logs(spark, [str(tmp_path / "nothing.log")])


def test_odd_file_names(spark, write):
    paths = [write("my log.txt", TEN[:1]), write("100%20é.log", TEN[1:2]),
             write("a+b#c.jsonl", JSON_ROWS[:1])]
    merged = align(spark, paths)
    assert list(merged.files) == paths
    rows = merged.wide().orderBy("ts").collect()
    assert [bool(rows[0][p]) for p in paths] == [True, False, True]
    assert [bool(rows[1][p]) for p in paths] == [False, True, False]


def test_unreadable_suffixes(spark, write):
    for name in ("x.zip", "x.pcap"):
        with pytest.raises(ValueError, match=name):
            read_logs(spark, [write(name, "x")])


def test_registered_reader(spark, write):
    def shout(session, paths, encoding):
        return read_text(session, paths, encoding).withColumn("raw", F.upper("raw"))

    register_reader(".shout", shout)
    lines, _ = read_logs(spark, [write("a.shout", ["hello"]), write("b.log", ["hello"])])
    assert {r.raw for r in lines.collect()} == {"HELLO", "hello"}


@pytest.mark.parametrize("encoding", [
    "utf-8", "latin-1", "windows-1252", "cp037", "utf-16", "utf-16-le", "utf-16-be", "utf-32",
    "utf-32-le",
])
def test_encodings(spark, write, small_splits, encoding):
    lines = [f"2023-07-14 08:00:{i % 60:02d} Größe café {i}" for i in range(50)]
    if encoding == "cp037":
        # A line feed is another byte in this charset: only text without one is whole lines.
        lines = lines[:1]
        path = write("a.log", lines[0], encoding)
    else:
        path = write("a.log", lines, encoding)
    if encoding not in ("utf-8", "cp037"):
        small_splits(700)
    found = align(spark, [path], encoding=encoding).entries.agg(
        F.sum("n_lines"), F.min("ts")).first()
    assert tuple(found) == (len(lines), datetime(2023, 7, 14, 8, 0, 0))
    got = [r.rstrip() for r in raw_lines(read_text(spark, [path], encoding))]
    assert got == lines


# --- JSON lines ---------------------------------------------------------------------------

def test_json_time_key_is_the_first_that_fits(spark, write):
    rows = ['{"id": 7, "x": "1689339601", "at": "2023-07-14 08:00:01", "b": [1, {"c": null}]}',
            '{"id": 8, "at": "2023-07-14 08:00:02"}', "not json",
            '{"x": "1689339602", "z": null, "t": true, "x2": 1.5}']
    lines, _ = read_logs(spark, [write("a.jsonl", rows)])
    assert raw_lines(lines) == [
        '1689339601 id: 7\nat: 2023-07-14 08:00:01\nb: [1,{"c":null}]',
        " id: 8\nat: 2023-07-14 08:00:02",
        "not json",
        "1689339602 z: None\nt: true\nx2: 1.5",
    ]


def test_json_repeated_key_takes_the_last_value(spark, write):
    rows = ['{"at": "2023-07-14 08:00:01", "a": 1, "b": 2, "a": 3}']
    lines, _ = read_logs(spark, [write("a.jsonl", rows)])
    assert raw_lines(lines) == ["2023-07-14 08:00:01 a: 3\nb: 2"]


def test_json_keys_are_per_file(spark, write):
    a = write("a.jsonl", JSON_ROWS)
    b = write("b.jsonl", ['{"when": "2023-07-14T08:00:01.5", "x": 1}'])
    rows = align(spark, [a, b]).wide().orderBy("ts").collect()
    assert [(r.timestamp[17:], r[b]) for r in rows][:2] == [("01.000", ""), ("01.500", "x: 1")]


# --- CSV ------------------------------------------------------------------------------------

def python_csv(text: str) -> list[str]:
    """What the standard csv reader makes of the same text."""
    rows = csv.reader(io.StringIO(text, newline=""))
    headers = next(rows)[1:]
    return [f"{time} " + " ".join(f"{h}={v}" for h, v in zip(headers, values, strict=False))
            for time, *values in (r for r in rows if r)]


def test_csv_short_long_blank_and_empty(spark, write):
    text = 'time,h1,h2\n1,a,b\n2,,x\n3,5\n4,1,2,3\n\n5,,\n6\n7,"q, ""r""",y"z\n'
    got = raw_lines(read_csv_lines(spark, [write("a.csv", text)]))
    assert got == python_csv(text)
    assert got[:4] == ["1 h1=a h2=b", "2 h1= h2=x", "3 h1=5", "4 h1=1 h2=2"]


def random_csv(seed: int) -> str:
    rng = random.Random(seed)
    pieces = ["a", "bc", " ", ",", '"', '""', "\n", "\n\n", "x=y", "", "é", 'q"q']
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["time", "one", "two", "three"])
    for i in range(rng.randrange(1, 120)):
        if rng.random() < 0.2:  # hand-written rows with odd quotes that stay in their line
            out.write(f't{i},5" disk,"a"b,{rng.choice(["", "x", chr(34) * 2])}\n')
        else:
            writer.writerow([f"t{i}", *["".join(rng.choices(pieces, k=rng.randrange(6)))
                                        for _ in range(rng.randrange(5))]])
    return out.getvalue()


@pytest.mark.parametrize("seed", range(6))
def test_csv_equals_the_standard_reader(spark, write, small_splits, seed):
    """Quoted cells over many lines, read in many blocks."""
    texts = [random_csv(seed * 10 + i) for i in range(3)]
    paths = [write(f"{i}.csv", t) for i, t in enumerate(texts)]
    small_splits([60, 200, 10**6][seed % 3])
    found: dict[str, list[str]] = {p: [] for p in paths}
    for r in read_csv_lines(spark, paths).orderBy("path", "block_start", "seq").collect():
        found[r.path.removeprefix("file:")].append(r.raw)
    assert found == {p: python_csv(t) for p, t in zip(paths, texts, strict=True)}


def test_quote_state_of_a_line(spark):
    cases = ["", "a,b", '"a', 'a,"b', 'a,"b""', 'a,"b"', 'a"b', '"a"b,"', '""', '"""', '"a","b',
             'x",y', 'x","y', 'x""', 'x"""', '"', ',"', '","']
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = df.select("c", opens_quote(F.col("c")), leaves_quote_open(F.col("c"))).collect()

    def ends_open(line: str, inside: bool) -> bool:
        """The state machine of the csv reader, one character at a time."""
        state = "quoted" if inside else "start"
        for ch in line:
            if state == "quoted":
                state = "quote" if ch == '"' else "quoted"
            elif state == "quote":
                state = "quoted" if ch == '"' else "start" if ch == "," else "field"
            elif ch == ",":
                state = "start"
            else:
                state = "quoted" if state == "start" and ch == '"' else "field"
        return state == "quoted"

    assert [(c, ends_open(c, False), ends_open(c, True)) for c in cases] == [tuple(r) for r in got]


@pytest.mark.parametrize("record_end", ["\n", "\r\n", "\r"])
def test_csv_line_ends_inside_cells_stay(spark, write, small_splits, record_end):
    rng = random.Random(len(record_end))
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=record_end)
    writer.writerow(["time", "one", "two"])
    for i in range(80):
        writer.writerow([f"t{i}", *["".join(rng.choices(["a", "\r\n", "\r", "\n", '"', ","], k=rng.randrange(6)))
                                    for _ in range(2)]])
    path = write("a.csv", out.getvalue())
    small_splits(150)
    assert raw_lines(read_csv_lines(spark, [path])) == python_csv(out.getvalue())


@pytest.mark.parametrize("closes", [True, False])
def test_csv_records_over_segments(spark, write, monkeypatch, closes):
    """Segments of two lines: records of one line, of some segments, and a last one left open."""
    monkeypatch.setattr(csv_records, "with_segments", lambda lines: with_segments(lines, bits=1))
    rng = random.Random(5)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["time", "one", "two"])
    for i in range(60):
        ends = rng.choices(["\r\n", "\r", "\n", "", '"'], k=rng.choice([0, 1, 12]))
        writer.writerow([f"t{i}", "x" + "y".join(ends), i])
    text = out.getvalue()
    want = python_csv(text)
    if not closes:
        text += 'u1,"open\nu2,\n\nu3,b,c\n'
        want += ['>>> csv error: one=unexpected end of data: u1,"open two=<<<', "u2 one=", "u3 one=b two=c"]
    assert raw_lines(read_csv_lines(spark, [write("a.csv", text)])) == want


def test_csv_hot_file(spark, write, small_splits):
    """One long quoted cell over most of the file still comes out whole, whatever its length."""
    cell = "\n".join(f"row {i}, part" for i in range(12_000))
    csv.field_size_limit(10**7)
    text = f'time,body,end\nt1,"{cell}",z\nt2,short,z\n'
    path = write("a.csv", text)
    small_splits(8000)
    assert raw_lines(read_csv_lines(spark, [path])) == python_csv(text)


def test_csv_quote_that_never_closes(spark, write, small_splits):
    """The marker row takes the place of the bad record; no other line is lost."""
    bad = 't1,"never closed,x'
    rows = [f"t{i},row {i},{'y' * 90}" for i in range(2, 4000)]
    path = write("a.csv", "\n".join(["time,h1,h2", "t0,a,b", bad, *rows]) + "\n")
    small_splits(20_000)
    got = raw_lines(read_csv_lines(spark, [path]))
    assert got[0] == "t0 h1=a h2=b"
    assert got[1] == f">>> csv error: h1=unexpected end of data: {bad} h2=<<<"
    assert got[2:] == [f"t{i} h1=row {i} h2={'y' * 90}" for i in range(2, 4000)]


def test_csv_two_long_cells_are_no_error(spark, write):
    long = "\n".join(["z" * 99] * 1200)
    text = f'time,h1,h2\nt1,"{long}","{long}"\nt2,a,b\n'
    csv.field_size_limit(10**7)
    assert raw_lines(read_csv_lines(spark, [write("a.csv", text)])) == python_csv(text)


# --- packets ------------------------------------------------------------------------------

PACKET = ("ts timestamp_ntz, layer string, src string, sport int, dst string, dport int, "
          "seq bigint, ack bigint, flags int, payload string, len int, nfs_proc string, "
          "nfs_name string, nfs_status string, http_chat string")


def test_packet_branches(spark):
    t = datetime(2023, 9, 21, 8, 6, 15, 215999)
    a = (t, "TCP", "1.1.1.1", 10, "2.2.2.2", 20, 1, 2)

    def packet(layer, *more):
        return (t, layer, *a[2:], *more)

    rows = [
        packet("TCP", 18, "61:62", 16, None, None, None, None),
        packet("DATA", 63, "x" * 60, 17, None, None, None, None),
        packet("TCP", 0, None, 0, None, None, None, None),
        packet("NFS", 24, None, 0, "3", "it's", None, None),
        packet("NFS", 24, None, 0, "17", None, "0", None),
        packet("NFS", 24, None, 0, "99", "f", "2", None),
        packet("NFS", 24, None, 0, "1", "", "4711", None),
        packet("HTTP", 24, None, 0, None, None, None, "GET / HTTP/1.1\\r\\n"),
        packet("JSON", 24, None, 0, None, None, None, "it's 'x' \"y\" "),
        (t, "DNS", "1.1.1.1", None, "2.2.2.2", None, *[None] * 9),
        (t, "ARP", *[None] * 13),
    ]
    got = packets.format_packets(spark.createDataFrame(rows, PACKET)).collect()
    there, back, numbers = "1.1.1.1:10 -> 2.2.2.2:20", "2.2.2.2:20 <- 1.1.1.1:10", "seq:1 ack:2"
    assert [(r.proto, r.message) for r in got] == [
        ("TCP", f"TCP {there} {numbers} SYN,ACK 61:62"),
        ("DATA", f"DATA {there} {numbers} FIN,SYN,RST,PSH,ACK,URG " + "x" * 48 + "..."),
        ("TCP", f"TCP {there} {numbers} "),
        ("NFS", f"NFS {there} {numbers} LOOKUP \"it's\" "),
        ("NFS", f"NFS {back} {numbers} READDIR+ OK"),
        ("NFS", f"NFS {back} {numbers} ??? 'f' {errno.errorcode[2]}"),
        ("NFS", f"NFS {back} {numbers} GETATTR UNKERR:4711"),
        ("HTTP", f"HTTP {there} {numbers} 'GET / HTTP/1.1'"),
        ("HTTP", f"HTTP/JSON {there} {numbers} " + repr("it's 'x' \"y\"")),
        ("DNS", "DNS 1.1.1.1 -> 2.2.2.2 "),
    ]
    assert {r.timestamp for r in got} == {"2023-09-21 08:06:15.215"}


def test_packets_join_other_logs(spark):
    rows = [(datetime(2023, 9, 21, 8, 6, i), "TCP", "1.1.1.1", 1, "2.2.2.2", 2, 1, 2, 16, None, 0,
             None, None, None, None) for i in range(3)]
    lines = packets.packets_to_lines(spark.createDataFrame(rows, PACKET), "net", F.col("ts").cast(
        "timestamp").cast("bigint"))
    parsed = parse_timestamps(lines, "iso_space_dot").orderBy("seq").collect()
    assert [r.ts for r in parsed] == [r[0] for r in rows]
    assert parsed[0].body.startswith("TCP 1.1.1.1:1 -> ")


# --- synthetic logs -------------------------------------------------------------------------

def test_synthetic_log(spark):
    made = synthetic.synthetic_log(spark, "x", 3000, seed=4)
    parsed = parse_timestamps(made.withColumnRenamed("ts", "clock"), "iso_space_whole")
    rows = parsed.orderBy("seq").collect()
    assert [r.ts for r in rows] == [r.clock for r in rows]
    steps = {(b.ts - a.ts) // timedelta(seconds=1) for a, b in zip(rows, rows[1:], strict=False)}
    assert steps == set(range(11))
    assert len({r.body for r in rows}) == len(synthetic.MESSAGES)
    assert {r.body for r in rows} == {f"{level:<6} {text}" for level, text in synthetic.MESSAGES}
    again = synthetic.synthetic_log(spark, "x", 3000, seed=4).repartition(7)
    assert made.exceptAll(again).isEmpty()


def test_synthetic_file_reads_back_in_order(spark, tmp_path):
    folder = str(tmp_path / "log")
    count = synthetic.write_synthetic_log(spark, folder, megabytes=1)
    assert count == synthetic.lines_for_megabytes(1)
    mean = sum(len(text) for _, text in synthetic.MESSAGES) // len(synthetic.MESSAGES)
    assert synthetic.lines_for_megabytes(50) == 52_428_800 // (27 + mean)
    lines = read_text(spark, [folder])
    parsed = parse_timestamps(lines.withColumnRenamed("path", "file"), "iso_space_whole")
    late = flag_disorder(with_segments(parsed)).agg(
        F.count("*"), F.sum(F.col("is_out_of_order").cast("int"))).first()
    assert tuple(late) == (count, 0)


# --- results do not follow the splits -------------------------------------------------------

def test_late_first_timestamp_is_found_in_any_block(spark, write, small_splits):
    text = "# preamble\n" * 3000 + "2024-01-01 10:00:00 one\n2024-01-01 10:00:01 two\n"
    path = write("late.log", text)
    for size in (10_000_000, 4000):
        small_splits(size)
        entries = align(spark, [path], detect="first_match").entries
        found = {(r.ts, r.n_lines, r.body[-3:]) for r in entries.collect()}
        assert found == {(None, 3000, "ble"), (datetime(2024, 1, 1, 10), 1, "one"),
                         (datetime(2024, 1, 1, 10, 0, 1), 1, "two")}


def test_detection_reads_the_heads_of_files(spark, write, tmp_path):
    """The same formats as a scan finds; only files that the heads do not settle are scanned."""
    late = ["no time", *TEN]
    paths = [write("first.log", TEN), write("late.log", late), write("empty.log", ""),
             write("long.log", ["x" * 70_000, *TEN]), write("blank.log", ["", *TEN]),
             write("mark.log", "\ufeff" + TEN[0] + "\r\nmore"), write("none.log", ["a", "b"]),
             write("x.csv", ["time,a", TEN[0] + ",1"])]
    packed = tmp_path / "packed.log.gz"
    packed.write_bytes(gzip.compress("\n".join(TEN).encode()))
    files = expand_paths(spark, [*paths, str(packed)])
    heads, left = file_heads(spark, files)
    assert [f.name for f in left] == [paths[3], paths[7]]
    assert {r.file for r in heads.collect()} == {f.name for f in files} - {
        paths[2], paths[3], paths[7]}
    whole, _ = read_logs(spark, [f.name for f in files])
    for scan in ("first_line", "first_match"):
        got = detect_file_formats(spark, files, "utf-8", FormatRegistry(), scan)
        assert sorted(map(str, got.collect())) == sorted(
            map(str, detect_formats(whole, scan=scan).collect()))
    with pytest.raises(ValueError, match="unknown scan"):
        detect_file_formats(spark, files, "utf-8", FormatRegistry(), "other")


def test_detection_without_a_block_zero(spark):
    lines = spark.createDataFrame([("f", 7, 1, "2024-01-01 10:00:00 a"), ("f", 9, 0, "x")],
                                  "file string, block_start long, seq long, raw string")
    assert [r.fmt is not None for r in detect_formats(lines).collect()] == [True]


def test_folders_in_folders(spark, tmp_path):
    (tmp_path / "logs" / "sub").mkdir(parents=True)
    (tmp_path / "logs" / "a.log").write_text("2024-01-01 10:00:00 a\n")
    (tmp_path / "logs" / "sub" / "b.log").write_text("2024-01-01 10:00:01 b\n")
    lines, files = read_logs(spark, [str(tmp_path / "logs")])
    assert [f.rsplit("/", 1)[1] for f in files] == ["a.log", "b.log"] and lines.count() == 2
