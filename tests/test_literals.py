from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timeloom.functions.literals import (
    TIME_SHAPES,
    Jump,
    parse_absolute,
    parse_absolute_column,
    parse_range,
    parse_relative,
    parse_time,
)

NOW = datetime(2024, 1, 20, 12)


def test_absolute_shapes(spark):
    when = datetime(2024, 1, 2, 3, 4, 5, 600000)
    texts = [when.strftime(shape) for shape in TIME_SHAPES]
    assert [parse_absolute(t) for t in texts] == [
        datetime.strptime(t, s) for t, s in zip(texts, TIME_SHAPES, strict=True)
    ]
    df = spark.createDataFrame([(t,) for t in [*texts, "24-1-2", "2024-01-02 03", "x", ""]],
                               "t string")
    got = [r[0] for r in df.select(parse_absolute_column(F.col("t"))).collect()]
    assert got == [parse_absolute(t) for t in texts] + [None] * 4


@pytest.mark.parametrize(("text", "seconds"), [
    ("5s", 5), ("15m", 900), ("2h", 7200), ("3d", 259200), ("15M", 900),
])
def test_relative(text, seconds):
    assert parse_relative(text, NOW) == NOW - timedelta(seconds=seconds)
    assert parse_time(text, NOW) == NOW - timedelta(seconds=seconds)


def test_bad_literals():
    for bad in ("m", "5x", "yesterday", "2024-01-02 03:04:05.1234567"):
        with pytest.raises(ValueError):
            parse_time(bad, NOW)
    with pytest.raises(ValueError, match="before"):
        parse_range("1h", "2h", NOW)
    assert parse_range(None, "2024-01-02") == (None, datetime(2024, 1, 2))


@pytest.mark.parametrize(("text", "jump", "distance"), [
    ("10l", Jump(10, "l"), None),
    ("5 us", Jump(5, "us"), timedelta(microseconds=5)),
    ("5ms", Jump(5, "ms"), timedelta(milliseconds=5)),
    ("30S", Jump(30, "s"), timedelta(seconds=30)),
    ("2minutes", Jump(2, "m"), timedelta(minutes=2)),
    ("1h", Jump(1, "h"), timedelta(hours=1)),
    ("4 days", Jump(4, "d"), timedelta(days=4)),
])
def test_jumps(text, jump, distance):
    assert Jump.parse(text) == jump
    assert jump.distance == distance
    assert (-jump).quantity == -jump.quantity


def test_no_jump():
    assert Jump.parse("0m") is None
    assert Jump.parse("x") is None
    assert str(Jump(5, "ms")) == "5m"
