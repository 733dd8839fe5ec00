"""Time range selection."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.functions.literals import parse_range


def _stamp(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


@dataclass(frozen=True)
class TimeRange:
    """An inclusive range of times; a missing end is open.

    What precedes all timestamps (a NULL time) counts as earlier than any start.
    """

    lo: Column | None = None
    hi: Column | None = None

    @classmethod
    def between(cls, start: str | datetime | None = None, end: str | datetime | None = None,
                now: datetime | None = None) -> TimeRange:
        """From absolute text, ``15m``-like text or datetimes."""
        lo, hi = parse_range(start, end, now)
        return cls(None if lo is None else _stamp(lo), None if hi is None else _stamp(hi))

    @classmethod
    def of(cls, first: DataFrame, ts: str = "ts") -> TimeRange:
        """The span of another table, as scalar subqueries over one min/max aggregate.

        A table without any timestamp is an error, raised when the query runs.
        """
        missing = F.raise_error(F.lit("no timestamps in the first source")).cast("timestamp_ntz")
        bounds = span(first, ts).select(*[F.coalesce(c, missing).alias(c) for c in ("lo", "hi")])
        return cls(bounds.select("lo").scalar(), bounds.select("hi").scalar())

    @property
    def is_open(self) -> bool:
        return self.lo is None and self.hi is None

    def holds(self, ts: Column) -> Column:
        return self.meets(ts, ts)

    def meets(self, lowest: Column, highest: Column) -> Column:
        """Whether a span of times, NULL for what precedes all of them, may reach into the range."""
        keep = F.lit(True)
        if self.lo is not None:
            keep = highest >= self.lo
        if self.hi is not None:
            upto = lowest <= self.hi
            keep = keep & upto if self.lo is not None else lowest.isNull() | upto
        return keep


def clip(rows: DataFrame, start: str | datetime | None = None,
         end: str | datetime | None = None, now: datetime | None = None,
         ts: str = "ts") -> DataFrame:
    """Keep rows between ``start`` and ``end``: absolute text, ``15m``-like text or datetime.

    Use it on entries, so that a record is kept or dropped as a whole; lines are clipped by
    :func:`~timeloom.operators.records.fill_records` before they are shuffled.
    """
    within = TimeRange.between(start, end, now)
    return rows if within.is_open else rows.where(within.holds(F.col(ts)))


def span(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """One row with the bounds ``(lo, hi)`` of a table."""
    return rows.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))


def autoclip(rows: DataFrame, first: DataFrame, ts: str = "ts") -> DataFrame:
    """Keep rows inside the time span of another table, in one plan."""
    return rows.where(TimeRange.of(first).holds(F.col(ts)))
