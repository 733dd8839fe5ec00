"""From file names to a merged table in one call."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions.formats import FormatRegistry
from timeloom.operators.clip import TimeRange
from timeloom.operators.explore import file_stats
from timeloom.operators.merge import merge_long, merge_wide, present
from timeloom.operators.order import number_rows, with_segments
from timeloom.operators.records import (
    cell_lines,
    collapse_filled,
    detect_formats,
    fill_records,
    parse_timestamps,
)
from timeloom.plans.session import collect_small, stage
from timeloom.sources.files import LogFile, expand_paths, file_heads, lines_of


@dataclass(frozen=True)
class Alignment:
    """Lines of several sources that know their record, and the views on them."""

    filled: DataFrame
    files: Sequence[str]

    @property
    def entries(self) -> DataFrame:
        """One row per source and time."""
        return collapse_filled(self.filled, together=False)

    def wide(self, line_numbers: bool = False) -> DataFrame:
        """One row per time, the sources side by side."""
        merged = merge_wide(collapse_filled(self.filled), self.files)
        return present(merged, self.files, line_numbers)

    def long(self, line_numbers: bool = False) -> DataFrame:
        """One row per source and time, for any number of sources."""
        return merge_long(self.entries, self.files, line_numbers)

    def lines(self, line_numbers: bool = False) -> DataFrame:
        """One row per log line, in no cell gathered: ``(line?, ts, file, line_in_cell, body)``."""
        rows = cell_lines(self.filled).withColumn("part", F.lit(0))
        if line_numbers:
            rows = number_rows(rows, spread="file")
        return rows.drop("part")

    def stats(self) -> DataFrame:
        return file_stats(self.entries, self.files)


def detect_file_formats(spark: SparkSession, files: Sequence[LogFile], encoding: str,
                        registry: FormatRegistry, scan: str = "first_line") -> DataFrame:
    """``(file, fmt)`` as :func:`detect_formats` gives it, from the heads of the files where they do.

    Only the other files are scanned: for ``first_line`` those whose first line the head does not
    hold, for ``first_match`` also those whose first line has no known timestamp.
    """
    if scan not in ("first_line", "first_match"):
        raise ValueError(f"unknown scan {scan!r}")
    heads, left = file_heads(spark, files, encoding)
    formats = detect_formats(heads, registry)
    if scan == "first_match":
        formats = formats.where(F.col("fmt").isNotNull())
        done = {r.file for r in formats.collect()}  # one row per head
        left = [f for f in files if f.name not in done]
    if left:
        lines = lines_of(spark, left, encoding)
        formats = formats.unionByName(detect_formats(lines, registry, scan))
    return formats


def align(spark: SparkSession, paths: Iterable[str], *, encoding: str = "utf-8",
          timestamp_formats: Iterable[str] = (), start: str | datetime | None = None,
          end: str | datetime | None = None, autoclip_to_first: bool = False,
          ignore_untimestamped: bool = False, reference_date: str | None = None,
          strict: bool = False, detect: str = "first_line", now: datetime | None = None,
          registry: FormatRegistry | None = None,
          max_cell_bytes: int | None = None) -> Alignment:
    """Read, detect, parse, assemble, clip and key the given log files.

    The parsed lines are written once to the shared folder.  Everything after that reads the
    columnar copy, so each pass sees the same line numbers and reads only what it needs.  A cell
    is one row; ``max_cell_bytes`` cuts larger ones into parts, and :meth:`Alignment.lines` gives them
    line by line.  A range of times is cut out before any text is shuffled.
    """
    registry = registry or FormatRegistry()
    for template in timestamp_formats:
        registry.add_template(template)
    found = expand_paths(spark, paths)
    raw, files = lines_of(spark, found, encoding), [f.name for f in found]
    formats = detect_file_formats(spark, found, encoding, registry, detect)
    known = collect_small(formats)
    if known is not None:
        formats = {r.file: r.fmt for r in known}
        names = set(formats.values())
        if len(names) == 1 and None not in names:
            formats = names.pop()  # one format for all: no lookup per line
    else:
        formats = stage(formats, "formats")
    parsed = parse_timestamps(raw, formats, registry, reference_date, strict)
    kept = ("file", "block_start", "seq", "ts", "body", "parse_error")
    lines = with_segments(stage(parsed.select(*kept), "lines"))
    if autoclip_to_first:
        within = TimeRange.of(lines.where(F.col("file") == files[0]))
    else:
        within = TimeRange.between(start, end, now)
    filled = fill_records(lines, ignore_untimestamped, limit=max_cell_bytes, within=within)
    return Alignment(filled, files)
