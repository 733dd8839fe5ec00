from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from timeloom.functions import text as tx
from timeloom.functions.formats import (
    BUILTIN_FORMATS,
    FormatRegistry,
    TimestampFormat,
    custom_formats,
)
from timeloom.operators.records import parse_timestamps

ZONE = "America/Chicago"
UTC = timezone.utc
PLUS2 = timezone(timedelta(hours=2))


def local(instant: datetime) -> datetime:
    from zoneinfo import ZoneInfo
    return instant.astimezone(ZoneInfo(ZONE)).replace(tzinfo=None)


def iso_cases():
    """All ISO shapes: separator, fraction of 0 to 6 digits, and zone."""
    base = datetime(2023, 7, 14, 8, 0, 1)
    for sep, sep_name in ((" ", "space"), ("T", "t")):
        for mark, mark_name in ((",", "comma"), (".", "dot"), ("", "whole")):
            for digits in ["1", "12", "123", "1234", "12345", "123456"] if mark else [""]:
                micros = int(digits.ljust(6, "0")) if digits else 0
                for zone_text, offset in (("", None), ("Z", UTC), ("+0200", PLUS2)):
                    wall = base.replace(microsecond=micros)
                    want = wall if offset is None else local(wall.replace(tzinfo=offset))
                    name = f"iso_{sep_name}_{mark_name}" + ("_zone" if zone_text else "")
                    yield name, f"2023-07-14{sep}08:00:01{mark}{digits}{zone_text} Log", want, "Log"


EXPLICIT = [
    ("iso_space_comma_zone", "2023-07-14 08:00:01,000Z Log",
     local(datetime(2023, 7, 14, 8, 0, 1, tzinfo=UTC)), "Log"),
    ("iso_space_comma_zone", "2023-07-14 08:00:01,123 +0200 Log",
     local(datetime(2023, 7, 14, 8, 0, 1, 123000, PLUS2)), "Log"),
    ("iso_t_dot_zone", "2023-07-14T08:00:01.000+0000Z Log",
     local(datetime(2023, 7, 14, 8, 0, 1, tzinfo=UTC)), "Log"),
    ("syslog", "Jul 14 08:00:01 host x", datetime(2022, 7, 14, 8, 0, 1), "host x"),
    ("syslog", "Jul  4 08:00:01 host x", datetime(2022, 7, 4, 8, 0, 1), "host x"),
    ("time_of_day", "08:00:01.5 Log", datetime(2022, 3, 4, 8, 0, 1, 500000), "Log"),
    ("http_server", '::1 - - [22/Sep/2023 21:58:40] "GET /a HTTP/1.1" 200 -',
     datetime(2023, 9, 22, 21, 58, 40), '::1 - "GET /a HTTP/1.1" 200 -'),
    ("http_server", 'h - - [22/SEP/2023 21:58:40] x - [23/Sep/2023 01:02:03] "GET /"',
     datetime(2023, 9, 23, 1, 2, 3), 'h - - [22/SEP/2023 21:58:40] x "GET /"'),
    ("access_log", '91.194.60.14 - - [16/Sep/2023:19:05:06 +0000] "GET /s HTTP/1.1" 200',
     local(datetime(2023, 9, 16, 19, 5, 6, tzinfo=UTC)), '91.194.60.14 - "GET /s HTTP/1.1" 200'),
    ("epoch_float", "1694561169.550987 Log",
     local(datetime.fromtimestamp(1694561169.550987, UTC)), "Log"),
    ("epoch_float", "1689339790.262003500 Log",
     local(datetime.fromtimestamp(1689339790.262003500, UTC)), "Log"),
    ("epoch_millis", "1694561169550 Log",
     local(datetime.fromtimestamp(1694561169.55, UTC)), "Log"),
    ("epoch_seconds", "1694561169 Log", local(datetime.fromtimestamp(1694561169, UTC)), "Log"),
    ("apache_error", "[Fri Dec 01 00:00:25.933177 2023] Log",
     datetime(2023, 12, 1, 0, 0, 25, 933177), "Log"),
    ("apache_error", "[Fri Dec 01 00:00:25.9 2023] Log",
     datetime(2023, 12, 1, 0, 0, 25, 900000), "Log"),
    ("apache_error", "[Fri Dec 01 00:00:25. 2023] Log", datetime(2023, 12, 1, 0, 0, 25), "Log"),
    ("iso_space_whole", "2023-07-14 08:00:01", datetime(2023, 7, 14, 8, 0, 1), ""),
]


def test_every_shape_is_detected_and_parsed(spark, zone):
    zone(ZONE)
    cases = [*iso_cases(), *EXPLICIT]
    assert {c[0] for c in cases} == {f.name for f in BUILTIN_FORMATS}
    registry = FormatRegistry()
    lines = spark.createDataFrame(
        [(str(i), i, c[1]) for i, c in enumerate(cases)], "file string, seq bigint, raw string"
    ).withColumn("fmt", registry.detect(F.col("raw")))
    found = {r.seq: r.fmt for r in lines.collect()}
    assert {i: c[0] for i, c in enumerate(cases)} == found
    formats = lines.select("file", "fmt")
    parsed = parse_timestamps(lines.drop("fmt"), formats, registry, "2022-03-04")
    got = {r.seq: (r.ts, r.body, r.parse_error) for r in parsed.collect()}
    assert got == {i: (c[2], c[3], False) for i, c in enumerate(cases)}


def parse(spark, lines, fmt, **more):
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)],
                               "file string, seq bigint, raw string")
    return parse_timestamps(df, fmt, **more).orderBy("seq").collect()


def test_leap_day_without_a_year(spark):
    rows = parse(spark, ["Feb 29 01:02:03 host"], "syslog", reference_date="2024-05-01")
    assert rows[0].ts == datetime(2024, 2, 29, 1, 2, 3)


def test_impossible_time_is_flagged_and_kept(spark):
    row, = parse(spark, ["2023-13-41 08:00:01 x"], "iso_space_whole")
    assert (row.ts, row.parse_error, row.body) == (None, True, " 2023-13-41 08:00:01 x")


RENDER = {
    "iso_space_comma": "%Y-%m-%d %H:%M:%S,%f", "iso_space_dot": "%Y-%m-%d %H:%M:%S.%f",
    "iso_t_comma": "%Y-%m-%dT%H:%M:%S,%f", "iso_t_dot": "%Y-%m-%dT%H:%M:%S.%f",
    "iso_space_whole": "%Y-%m-%d %H:%M:%S", "iso_t_whole": "%Y-%m-%dT%H:%M:%S",
    "syslog": "%b %e %H:%M:%S", "http_server": "h - - [%d/%b/%Y %H:%M:%S]",
    "access_log": "h - - [%d/%b/%Y:%H:%M:%S +0000]", "iso_t_dot_zone": "%Y-%m-%dT%H:%M:%S.%f+0000",
    "apache_error": "[%a %b %d %H:%M:%S.%f %Y]", "time_of_day": "%H:%M:%S.%f",
}


@pytest.mark.parametrize("name", RENDER)
def test_written_times_read_back(spark, name):
    rng = random.Random(name)
    times = [datetime(2024, 1, 1) + timedelta(microseconds=rng.randrange(366 * 86400 * 10**6))
             for _ in range(300)]
    shape = RENDER[name]
    rows = parse(spark, [t.strftime(shape) + " text of the line" for t in times], name,
                 reference_date="2024-03-04")

    def kept(t: datetime) -> datetime:
        t = t if "%f" in shape else t.replace(microsecond=0)
        return t if "%d" in shape or "%e" in shape else t.replace(month=3, day=4)

    assert [r.ts for r in rows] == [kept(t) for t in times]
    assert {r.body for r in rows} <= {"text of the line", "h - text of the line"}


def test_instants_where_clocks_are_set_back(spark, zone):
    """01:30 happens twice; the wall clock is the same, the instant is not."""
    zone(ZONE)
    lines = ["2023-11-05T01:30:00-0500 x", "2023-11-05T01:30:00-0600 x"]
    rows = parse(spark, lines, "iso_t_whole_zone", keep_instant=True)
    assert [r.ts for r in rows] == [datetime(2023, 11, 5, 1, 30)] * 2
    seconds = [r.instant.timestamp() for r in rows]
    assert seconds[1] - seconds[0] == 3600
    plain = parse(spark, ["2023-11-05T01:30:00 x"], "iso_t_whole", keep_instant=True)
    assert plain[0].instant is None


def test_no_time_is_lost_where_clocks_are_set_forward(spark, zone):
    """02:30 does not exist in this zone that day, but it may stand in a log."""
    zone(ZONE)
    for fmt, line in (("iso_space_whole", "2024-03-10 02:30:00 x"), ("syslog", "Mar 10 02:30:00 x"),
                      ("http_server", "h - - [10/Mar/2024 02:30:00] x")):
        row, = parse(spark, [line], fmt, reference_date="2024-01-01")
        assert row.ts == datetime(2024, 3, 10, 2, 30)


def test_strict_needs_a_separator_behind_the_time(spark):
    lines = ["2023-07-14 08:00:01  ", "2023-07-14 08:00:01 x"]
    loose = parse(spark, lines, "iso_space_whole")
    assert [r.body for r in loose] == ["", "x"]
    strict = parse(spark, lines, "iso_space_whole", strict=True)
    assert [(r.ts is None, r.body) for r in strict] == [(True, " 2023-07-14 08:00:01"),
                                                        (False, "x")]


def test_continuation_colour_and_blanks(spark):
    lines = ["2023-07-14 08:00:01 \x1b[1;31mred\x1b[0m \t ", "  more \x1b[0m", "", "\x1b[38;5;1m"]
    rows = parse(spark, lines, "iso_space_whole")
    assert [r.body for r in rows] == ["red", "   more", "", ""]


@pytest.mark.parametrize(("template", "line", "body"), [
    (r"((...)\|)", "2023-07-14 08:00:01|rest", "rest"),
    (r"(\w+ - )((...) )", "INFO - 2023-07-14 08:00:01 rest", "INFO - rest"),
    (r"(\[\w+\] )((...) )", "[INFO] 2023-07-14T08:00:01.000 rest", "[INFO] rest"),
    (r"(?P<who>\w+)((...) )", "me2023-07-14 08:00:01,000 rest", "merest"),
    ("STRACE", "123 2023-07-14 08:00:01 open()", "123 open()"),
    (r"(.*m\[)((...)\|)", "\x1b[1;31m[1689321601.000|INFO](p) \x1b[0mok", "[INFO](p) ok"),
])
def test_templates(spark, template, line, body):
    registry = FormatRegistry([template, r"(never)((...)x)"])
    df = spark.createDataFrame([("f", 0, line)], "file string, seq bigint, raw string")
    name = df.select(registry.detect(F.col("raw")).alias("n")).first().n
    assert name.startswith(f"custom:{template}:")
    row = parse_timestamps(df, name, registry).first()
    assert (row.ts, row.body) == (datetime(2023, 7, 14, 8, 0, 1), body)


def test_many_templates_and_a_bad_one():
    registry = FormatRegistry([rf"(x{i} )((...) )" for i in range(5)])
    assert len(registry.names()) == 20 * 6
    with pytest.raises(ValueError, match="placeholder"):
        custom_formats("no place")


def test_registered_format(spark):
    fmt = TimestampFormat(
        "compact", r"\d{8}T\d{6}",
        lambda text, _: F.to_timestamp(text, "yyyyMMdd'T'HHmmss").cast("timestamp_ntz"),
    )
    registry = FormatRegistry().register(fmt)
    df = spark.createDataFrame([("f", 0, "20230714T080001 hi")],
                               "file string, seq bigint, raw string")
    assert df.select(registry.detect(F.col("raw"))).first()[0] == "compact"
    row = parse_timestamps(df, "compact", registry).first()
    assert (row.ts, row.body) == (datetime(2023, 7, 14, 8, 0, 1), "hi")


def test_text_helpers(spark):
    df = spark.createDataFrame(
        [("a 　 \t\r\n\x1c", "it's", datetime(2024, 1, 2, 3, 4, 5, 123999))],
        "a string, b string, t timestamp_ntz",
    )
    row = df.select(
        tx.rtrim_ws(F.col("a")).alias("a"),
        tx.quoted(F.col("b")).alias("b"),
        tx.display_ts(F.col("t")).alias("t"),
        tx.display_ts(F.lit(None).cast("timestamp_ntz")).alias("none"),
        *[tx.floor_ts(F.col("t"), u).alias(u) for u in ("second", "hour", "month")],
    ).first()
    assert (row.a, row.b, row.t, row.none) == ("a", '"it\'s"', "2024-01-02 03:04:05.123", "")
    assert (row.second, row.hour, row.month) == (
        datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3), datetime(2024, 1, 1))


@pytest.mark.parametrize("text", ["plain", "it's", 'say "x"', "both ' and \"", "back\\slash",
                                  "tab\tand\nnewline\r"])
def test_quoted_equals_repr(spark, text):
    df = spark.createDataFrame([(text,)], "a string")
    assert df.select(tx.quoted(F.col("a"))).first()[0] == repr(text)


def test_white_space_is_pythons():
    blanks = {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert set(tx.WHITESPACE) == blanks
