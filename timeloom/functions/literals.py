"""Time literals typed by a user: absolute, relative, and jump distances (driver side)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted shapes of an absolute time.
TIME_SHAPES = [
    "%Y-%m-%d %H:%M:%S.%f",
    "%Y-%m-%d %H:%M:%S,%f",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%d %H:%M",
    "%Y-%m-%dT%H:%M:%S.%f",
    "%Y-%m-%dT%H:%M:%S,%f",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%dT%H:%M",
    "%Y-%m-%d",
]

# Seconds per unit of a relative time.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}

# Units of a jump in microseconds ("l" counts lines instead).
JUMP_MICROS = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "m": 60_000_000,
    "h": 3_600_000_000,
    "d": 86_400_000_000,
}


def parse_absolute(text: str) -> datetime:
    for shape in TIME_SHAPES:
        try:
            return datetime.strptime(text, shape)
        except ValueError:
            continue
    raise ValueError(f"not a time: {text!r}")


def parse_relative(text: str, now: datetime) -> datetime:
    """``15m`` means fifteen minutes before ``now``; the unit's case does not matter."""
    found = re.fullmatch(r"(\d+)([smhd])", text.lower())
    if not found:
        raise ValueError(f"not a relative time: {text!r}")
    return now - timedelta(seconds=int(found[1]) * UNIT_SECONDS[found[2]])


def parse_time(value: str | datetime | None, now: datetime | None = None) -> datetime | None:
    if value is None or isinstance(value, datetime):
        return value
    if value[-1:].lower() in UNIT_SECONDS:
        return parse_relative(value, now or datetime.now())
    return parse_absolute(value)


def parse_range(start: str | datetime | None, end: str | datetime | None,
                now: datetime | None = None) -> tuple[datetime | None, datetime | None]:
    lo, hi = parse_time(start, now), parse_time(end, now)
    if lo is not None and hi is not None and hi <= lo:
        raise ValueError("start must be before end")
    return lo, hi


def parse_absolute_column(text: Column) -> Column:
    """The accepted absolute shapes for a column of text; NULL for anything else."""
    # Fixed value: digits as strptime takes them, one or two per field.
    field = r"\d{1,2}"
    shape = rf"^\d{{4}}-{field}-{field}(?:[ T]{field}:{field}(?::{field}(?:[.,]\d{{1,6}})?)?)?$"
    return F.when(
        text.rlike(shape), F.translate(text, ",", ".").try_cast("timestamp_ntz")
    )


@dataclass(frozen=True)
class Jump:
    """A distance to move: by lines (``unit == 'l'``) or by time."""

    quantity: int
    unit: str

    @classmethod
    def parse(cls, text: str) -> Jump | None:
        units = "|".join([*JUMP_MICROS, "l"])
        found = re.match(rf"([1-9]\d*)\s*({units})", text.lower())
        return cls(int(found[1]), found[2]) if found else None

    def __neg__(self) -> Jump:
        return Jump(-self.quantity, self.unit)

    @property
    def by_lines(self) -> bool:
        return self.unit == "l"

    @property
    def distance(self) -> timedelta | None:
        if self.by_lines:
            return None
        return timedelta(microseconds=self.quantity * JUMP_MICROS[self.unit])

    def __str__(self) -> str:
        return f"{self.quantity}{self.unit[:1]}"
