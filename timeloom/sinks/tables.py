"""CSV, Markdown and text output of a merged table, written by many tasks.

The output is a folder of part files in time order.  Each writer takes the display form of
:func:`timeloom.operators.merge.present` (or the long form) and drops the sort columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.text import rtrim_ws
from timeloom.operators.merge import in_time_order

_SORT_ONLY = ("ts", "part", "file_no")


def _shown(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in _SORT_ONLY]


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def write_csv(rows: DataFrame, path: str) -> None:
    """All cells quoted, header in each part file; read back with ``multiLine``."""
    ordered = in_time_order(rows, "file_no").select(*[F.col(f"`{c}`") for c in _shown(rows)])
    ordered.write.options(
        header=True, quoteAll=True, escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def markdown_row(names: Sequence[str]) -> Column:
    """One Markdown table row; line breaks become ``<br />`` and bars are escaped."""
    cells = [
        F.replace(F.replace(_text(n), F.lit("\n"), F.lit("<br />")), F.lit("|"), F.lit("\\|"))
        for n in names
    ]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_rows(rows: DataFrame) -> DataFrame:
    """The table body as ``(ts, part, row)``; the time of a row is blank where it shows the same as the
    row before.

    Rows that show the same time are at most a millisecond's, so they are compared among themselves;
    rows without a time show none and are spread.
    """
    names = _shown(rows)
    keep = [c for c in _SORT_ONLY if c in rows.columns]
    cells = rows
    if "timestamp" in names and keep:
        order = [c for c in (*keep, "line") if c in rows.columns]
        lost = F.coalesce(F.col("timestamp") == "", F.lit(True))
        spread = F.when(lost, F.xxhash64(*[F.col(f"`{n}`") for n in names])).otherwise(F.lit(0))
        shown = Window.partitionBy("timestamp", "_spread").orderBy(*order)
        cells = rows.withColumn("_spread", spread).withColumn("_again", F.row_number().over(shown) > 1)
        again = F.when(F.col("_again"), F.lit("")).otherwise(F.col("timestamp"))
        cells = cells.withColumn("timestamp", again)
    return cells.select(*keep, markdown_row(names).alias("row"))


def markdown_header(names: Sequence[str]) -> list[str]:
    # Line numbers are right-aligned.
    rule = ["---:" if n == "line" else "---" for n in names]
    return ["| " + " | ".join(names) + " |", "|" + "|".join(rule) + "|"]


def _write_lines(rows: DataFrame, header: list[str], path: str, *more: str) -> None:
    """One folder of text files: the header in front of the first, then ``row`` in time order."""
    top = rows.sparkSession.createDataFrame([(i - len(header), h) for i, h in enumerate(header)],
                                            "_top int, row string")
    body = rows.withColumn("_top", F.lit(0))
    keys = [c for c in ("part", *more) if c in rows.columns]
    ordered = body.unionByName(top, allowMissingColumns=True).orderBy(
        "_top", F.col("ts").asc_nulls_first(), *keys)
    ordered.select(F.col("row").alias("value")).write.text(path)


def write_markdown(rows: DataFrame, path: str) -> None:
    _write_lines(markdown_rows(rows), markdown_header(_shown(rows)), path, "file_no")


def column_widths(rows: DataFrame) -> DataFrame:
    """One row: the widest text line of each shown column (at least its header)."""
    def widest(name: str) -> Column:
        lines = F.transform(F.split(_text(name), "\n"), F.length)
        return F.greatest(F.coalesce(F.max(F.array_max(lines)), F.lit(0)), F.lit(len(name)))

    return rows.agg(*[widest(n).alias(n) for n in _shown(rows)])


def text_rows(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Aligned text, one output line per text line of a row: ``(ts, part, line_no, row)``."""
    names = _shown(rows)
    cells = F.arrays_zip(*[F.split(_text(n), "\n").alias(f"c{i}") for i, n in enumerate(names)])
    keep = [c for c in _SORT_ONLY if c in rows.columns]
    exploded = rows.select(*keep, F.posexplode(cells).alias("line_no", "cell"))

    def pad(i: int, name: str) -> Column:
        value = F.coalesce(F.col("cell")[f"c{i}"], F.lit(""))
        if name == "line":
            return F.lpad(value, max(widths[name], 4), " ")
        return F.rpad(value, widths[name], " ")

    row = F.concat_ws(" | ", *[pad(i, n) for i, n in enumerate(names)])
    return exploded.select(*keep, "line_no", rtrim_ws(row).alias("row"))


def write_text(rows: DataFrame, path: str) -> None:
    """Aligned columns; the widths come from one aggregate."""
    names = _shown(rows)
    widths = column_widths(rows).first().asDict()
    header = " | ".join(
        n.rjust(max(widths[n], 4)) if n == "line" else n.ljust(widths[n]) for n in names
    )
    _write_lines(text_rows(rows, widths), [header.rstrip()], path, "file_no", "line_no")


def show(rows: DataFrame, n: int = 20) -> None:
    """The first rows in time order on the console."""
    in_time_order(rows, "file_no").select(*[F.col(f"`{c}`") for c in _shown(rows)]).show(
        n, truncate=False
    )
