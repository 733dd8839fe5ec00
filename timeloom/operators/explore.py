"""Looking around in a merged table: search, go to, jump, statistics.

The functions take a numbered table (``line``, ``ts`` and text columns, see
:func:`timeloom.operators.merge.present` and ``merge_long``).  Each answer is an aggregate or
a top-1, never a full sort.  Write the numbered table once (``plans.session.stage``) when
asking more than one question.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from timeloom.functions.literals import Jump, parse_time
from timeloom.functions.text import display_ts


def contains_text(columns: Sequence[str], text: str) -> Column:
    """Case-insensitive substring in any of the columns."""
    needle = F.lit(text.lower())
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(f"`{name}`"), F.lit(""))), needle)
    return hit


def search(rows: DataFrame, text: str, columns: Sequence[str] = ("log",)) -> DataFrame:
    return rows.where(contains_text(columns, text))


# Rows of one line are told apart by these, as far as a table has them.
PLACE = ("line", "file_no", "file", "part")


def _beyond(rows: DataFrame, cursor: int | Row, back: bool) -> DataFrame:
    """Rows after (before) a line, or after (before) a row found earlier, nearest first."""
    place = [name for name in PLACE if name in rows.columns]
    if isinstance(cursor, Row):
        here, there = F.struct(*place), F.struct(
            *[F.lit(cursor[name]).cast(rows.schema[name].dataType).alias(name) for name in place])
    else:
        here, there = F.col("line"), F.lit(cursor)
    ordered = [F.col(name).desc() if back else F.col(name).asc() for name in place]
    return rows.where(here < there if back else here > there).orderBy(*ordered)


def find_next(rows: DataFrame, text: str, cursor: int | Row,
              columns: Sequence[str] = ("log",)) -> DataFrame:
    """The first matching row after the cursor; empty when there is none.

    The cursor is a line number, or the row found before: several sources may match on one line.
    """
    return _beyond(search(rows, text, columns), cursor, back=False).limit(1)


def find_previous(rows: DataFrame, text: str, cursor: int | Row,
                  columns: Sequence[str] = ("log",)) -> DataFrame:
    return _beyond(search(rows, text, columns), cursor, back=True).limit(1)


def goto_line(rows: DataFrame, number: int) -> DataFrame:
    """Row ``number``; below the first (0 too) the first, beyond the last the last."""
    last = rows.agg(F.max("line").alias("n")).scalar()
    wanted = F.lit(max(number, 1)).cast("bigint")
    return rows.where(F.col("line") == F.least(wanted, last))


def jump_lines(rows: DataFrame, cursor: int, by: int) -> DataFrame:
    return goto_line(rows, max(cursor, 1) + by)


def _millis(ts: Column) -> Column:
    """One time cut to milliseconds, as it is shown."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS").cast("timestamp_ntz")


def _seek(rows: DataFrame, target: Column, cursor: int) -> DataFrame:
    """Row reached when moving from ``cursor`` towards ``target``, a time in whole milliseconds.

    Rows are compared as they are shown, cut to milliseconds: a row shows the target when its exact
    time is less than a millisecond behind it.  So the times of the rows are compared as they are.
    """
    ts, here, beyond = F.col("ts"), F.col("line"), target + F.expr("interval 0.001 second")
    at = F.lit(cursor).cast("bigint")
    place = rows.where(here == at).agg(F.max("ts").alias("m")).scalar()
    answer = rows.agg(
        F.min(F.when((here >= at) & (ts >= target), here)).alias("ahead"),
        F.max(F.when((here <= at) & F.coalesce(ts < beyond, F.lit(True)), here)).alias("back"),
        F.max(here).alias("last"),
        F.min(here).alias("first"),
    ).select(
        F.when((place >= target) & (place < beyond), at)
        .when(place.isNull() | (place < target), F.coalesce("ahead", "last"))
        .otherwise(F.coalesce("back", "first"))
        .alias("line")
    )
    return rows.where(here == answer.scalar())


def goto_timestamp(rows: DataFrame, target: str | datetime, cursor: int = 1) -> DataFrame:
    """First row at or after ``target`` when it lies ahead of the cursor, else the last row
    at or before it; the last (first) row when there is none."""
    when = parse_time(target)
    whole = when.replace(microsecond=when.microsecond // 1000 * 1000)
    return _seek(rows, F.lit(whole.isoformat(sep=" ")).cast("timestamp_ntz"), cursor)


def jump_time(rows: DataFrame, cursor: int, jump: Jump) -> DataFrame:
    """Move by a time distance from the cursor row; no rows if that row has no timestamp."""
    start = rows.where(F.col("line") == cursor).agg(F.max("ts").alias("t")).scalar()
    # The cursor's time is the one shown, cut to milliseconds.
    return _seek(rows, _millis(_millis(start) + F.lit(jump.distance)), cursor).where(start.isNotNull())


def jump(rows: DataFrame, cursor: int, by: Jump | str) -> DataFrame:
    distance = Jump.parse(by) if isinstance(by, str) else by
    if distance is None:
        raise ValueError(f"not a jump distance: {by!r}")
    if distance.by_lines:
        return jump_lines(rows, cursor, distance.quantity)
    return jump_time(rows, cursor, distance)


OVERALL = "Overall (merged)"


def file_stats(entries: DataFrame, files: Sequence[str] | None = None) -> DataFrame:
    """Per source: number of merged rows with text in them, first and last timestamp; and the
    same for the merged table.  Sources without rows count 0."""
    # A cell may continue in further parts: only its first part counts.
    filled = entries.where((F.col("part") == 0) & (F.col("body") != ""))

    def edges(df: DataFrame) -> DataFrame:
        unstamped = F.max(F.col("ts").isNull())
        return df.agg(
            F.count("*").alias("n_entries"),
            F.when(~unstamped, F.min("ts")).alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )

    per_file = edges(filled.groupBy("file"))
    if files is not None:
        spark = entries.sparkSession
        named = spark.createDataFrame([(i, f) for i, f in enumerate(dict.fromkeys(files))],
                                      "file_no int, file string")
        per_file = named.join(per_file, "file", "left").select(
            "file", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), "first_ts", "last_ts"
        )
    merged = edges(entries.select("ts").distinct().groupBy())
    return per_file.unionByName(merged.withColumn("file", F.lit(OVERALL)))


def info_table(stats: DataFrame) -> DataFrame:
    """Statistics as Markdown rows."""
    return stats.select(
        "file",
        F.format_string(
            "| %s | %s | %s %s |", F.col("file"), F.format_number("n_entries", 0),
            display_ts(F.col("first_ts")), display_ts(F.col("last_ts")),
        ).alias("row"),
    )
