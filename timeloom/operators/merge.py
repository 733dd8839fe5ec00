"""Aligning many sources on one time axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.text import display_ts, trim_ws
from timeloom.operators.order import number_rows
from timeloom.plans.session import lookup, stage

# One column per source is for people to read; beyond this use merge_long.
MAX_WIDE_FILES = 1000
# Columns that stand beside the sources of a wide merge.
RESERVED = frozenset({"line", "timestamp", "ts", "part"})


def merge_wide(entries: DataFrame, files: Sequence[str]) -> DataFrame:
    """One row per timestamp with one text column per source, ``''`` where it has nothing.

    ``files`` gives the columns and their order, so no pass over the data looks for them.  An
    entry of a source that is not listed is an error when the query runs.
    Entries from :func:`collapse_records` already lie by ``(ts, part)``: no further shuffle.
    """
    names = list(dict.fromkeys(files))
    if len(names) > MAX_WIDE_FILES:
        raise ValueError(f"{len(names)} sources do not fit side by side; use merge_long")
    if taken := sorted(RESERVED.intersection(names)):
        raise ValueError(f"sources named like columns of the result: {taken}; use merge_long")
    cells = [
        F.coalesce(
            F.first(F.when(F.col("file") == name, F.col("body")), ignorenulls=True), F.lit("")
        ).alias(name)
        for name in names
    ]
    listed = F.coalesce(F.col("file").isin(names), F.lit(False)) | _unlisted().cast("boolean")
    return entries.where(listed).groupBy("ts", "part").agg(*cells)


def _unlisted() -> Column:
    """Fails at the first row of a source that no column or number was given for."""
    name = F.coalesce("file", F.lit("NULL"))
    return F.raise_error(F.concat(F.lit("source not in the list of files: "), name))


def merge_two(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Two sources side by side as a full outer join on the timestamp."""
    a = left.select(F.col("ts").alias("_lt"), F.col("part").alias("_lp"),
                    F.col("body").alias(left_name))
    b = right.select(F.col("ts").alias("_rt"), F.col("part").alias("_rp"),
                     F.col("body").alias(right_name))
    same = F.col("_lt").eqNullSafe(F.col("_rt")) & (F.col("_lp") == F.col("_rp"))
    return a.join(b, same, "full_outer").select(
        F.coalesce("_lt", "_rt").alias("ts"),
        F.coalesce("_lp", "_rp").alias("part"),
        F.coalesce(left_name, F.lit("")).alias(left_name),
        F.coalesce(right_name, F.lit("")).alias(right_name),
    )


def merge_long(entries: DataFrame, files: Sequence[str] | None = None,
               line_numbers: bool = True) -> DataFrame:
    """One row per source and timestamp: ``(line?, timestamp, ts, part, file_no?, file, log)``.

    ``line`` is the number of the merged row, shared by all sources at that timestamp.  Blank
    cells are left out, but they still count as merged rows.
    """
    rows = entries
    if files is not None:
        names = [(f, i) for i, f in enumerate(dict.fromkeys(files))]
        names = lookup(rows.sparkSession, names, "file string, file_no int")
        number = F.coalesce("file_no", _unlisted().cast("int"))
        rows = rows.join(names, "file", "left").withColumn("file_no", number)
    if line_numbers:
        rows = number_rows(rows, spread="file")
    kept = rows.where(trim_ws(F.col("body")) != "")
    return kept.select(
        *(["line"] if line_numbers else []),
        display_ts(F.col("ts")).alias("timestamp"), "ts", "part",
        *(["file_no"] if files is not None else []),
        "file", F.col("body").alias("log"),
    )


def unpivot(wide: DataFrame, files: Sequence[str]) -> DataFrame:
    """The long form of a wide merge, without blank cells."""
    others = [c for c in wide.columns if c not in set(files)]
    cells = F.array(*[
        F.struct(F.lit(i).alias("file_no"), F.lit(f).alias("file"), F.col(f"`{f}`").alias("log"))
        for i, f in enumerate(files)
    ])
    rows = wide.select(*others, F.inline(cells).alias("file_no", "file", "log"))
    return rows.where(trim_ws(F.col("log")) != "")


def present(wide: DataFrame, files: Sequence[str], line_numbers: bool = False) -> DataFrame:
    """Display form ``(line?, timestamp, <sources>)``; ``ts`` and ``part`` are kept for sorting."""
    rows = number_rows(wide) if line_numbers else wide
    return rows.select(
        *(["line"] if line_numbers else []),
        display_ts(F.col("ts")).alias("timestamp"), "ts", "part",
        *[F.col(f"`{f}`") for f in dict.fromkeys(files)],
    )


def in_time_order(rows: DataFrame, *more: str) -> DataFrame:
    """Global order: records before any timestamp first, then time, then the parts.

    Range partitioning plus a local sort; parts spread one over-long timestamp.
    """
    keys = [F.col("ts").asc_nulls_first()]
    keys += [F.col(c) for c in ("part", *more) if c in rows.columns]
    return rows.orderBy(*keys)


def number_in_order(rows: DataFrame, *more: str, out: str = "position") -> DataFrame:
    """The rows of :func:`in_time_order` with their place in it, from 1.

    Rows are sorted within ranges of the key and written, so that their number inside a range holds;
    the rows of earlier ranges are added, one count per range.
    """
    ordered = in_time_order(rows, *more).withColumns(
        {"_range": F.spark_partition_id(), "_here": F.monotonically_increasing_id()})
    kept = stage(ordered, "in_order")
    first = F.shiftleft(F.col("_range").cast("bigint"), 33)
    counts = kept.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row per range.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return kept.join(offsets, "_range").withColumn(
        out, F.col("_before") + F.col("_here") - first + 1).drop("_range", "_here", "_before")
