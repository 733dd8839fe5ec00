"""CSV: first cell is the time, the others are shown as ``header=value``.

A quoted cell may run over several physical lines.  Instead of giving a whole file to one
task, each line says what it does to the quote state (open or closed) and the states are
chained over segments like any other running value.  Records are then cut where a line
starts in the closed state.  Line ends inside a cell stay as they are in the file: each line
knows the end that follows it, and lines of one record are put together with theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.operators.order import (
    LATEST,
    TOTAL,
    LineOrder,
    carry_segments,
    with_segments,
)
from timeloom.plans.session import release, small_side, stage
from timeloom.sources.files import read_text

# Possessive quantifiers: long cells do not grow the regex stack.
_QUOTED = r'"(?:[^"]++|"")*+"'
_CELL = rf'(?s)({_QUOTED}[^,]*+|[^,]*+),'
_OPEN_FROM_CLOSED = rf'(?s)^(?:{_QUOTED}[^,]*+,|(?!")[^,]*+,)*+"(?:[^"]++|"")*+$'
_CLOSING = r'(?s)^(?:[^"]++|"")*+"[^,]*+(?:,|$)'

# What stands for a record whose quote is still open at the end of its file (the
# line that opened it is quoted in the message).
_ERROR_CELLS = (">>> csv error:", "<<<")
_ERROR_TEXT = "unexpected end of data: "

_ORDER = LineOrder(file="path")


def opens_quote(line: Column) -> Column:
    """Whether a line that starts outside quotes ends inside an open quoted cell."""
    return line.rlike(_OPEN_FROM_CLOSED)


def leaves_quote_open(line: Column) -> Column:
    """Whether a line that starts inside a quoted cell ends inside one."""
    after = F.regexp_replace(line, _CLOSING, "")
    return ~line.rlike(_CLOSING) | opens_quote(after)


def split_cells(record: Column) -> Column:
    """Cells of one record: quotes removed, doubled quotes made single."""
    cells = F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(_CELL), F.lit(1))

    def plain(cell: Column) -> Column:
        inner = F.regexp_extract(cell, r'(?s)^"((?:[^"]++|"")*+)"?(.*)$', 1)
        tail = F.regexp_extract(cell, r'(?s)^"((?:[^"]++|"")*+)"?(.*)$', 2)
        unquoted = F.concat(F.replace(inner, F.lit('""'), F.lit('"')), tail)
        return F.when(F.startswith(cell, F.lit('"')), unquoted).otherwise(cell)

    return F.transform(cells, plain)


def render_record(cells: Column, headers: Column) -> Column:
    """``time h1=v1 h2=v2``; surplus cells and surplus headers are left out."""
    pairs = F.slice(
        F.zip_with(headers, cells, lambda h, v: F.concat(h, F.lit("="), v)),
        F.lit(2),
        F.greatest(F.least(F.size(headers), F.size(cells)) - 1, F.lit(0)),
    )
    return F.concat(cells[0], F.lit(" "), F.array_join(pairs, " "))


def with_quote_marks(lines: DataFrame) -> DataFrame:
    """Add what each line does to the quote state: ``_closed`` and ``_open`` tell whether a quoted
    cell is open behind it (1) or not (0) when the line starts outside or inside of one."""
    quoted = F.contains("raw", F.lit('"'))
    return lines.withColumn("_closed", (quoted & opens_quote(F.col("raw"))).cast("int")).withColumn(
        "_open", (~quoted | leaves_quote_open(F.col("raw"))).cast("int")
    )


def _chained(lines: DataFrame, order: LineOrder) -> DataFrame:
    """Add ``_swaps`` and ``_set``, the quote state inside a segment whatever it starts with."""
    here = order.up_to_here()
    swap = F.when((F.col("_closed") == 1) & (F.col("_open") == 0), 1).otherwise(0)
    return lines.withColumn(
        "_swaps", F.pmod(F.sum(swap).over(here), F.lit(2)).cast("int")
    ).withColumn(
        "_set", F.when(F.col("_closed") == F.col("_open"),
                       F.col("_closed").bitwiseXOR(F.col("_swaps")))
    ).withColumn("_set", F.last("_set", ignorenulls=True).over(here))


def _entry_states(lines: DataFrame, order: LineOrder) -> DataFrame:
    """The quote state with which every segment starts, ``_entry``; no text is read."""
    narrow = lines.select(*order.keys, *order.by, "_closed", "_open")
    ends = _chained(narrow, order).groupBy(*order.keys).agg(
        F.max_by("_set", order.place()).alias("_set"),
        F.max_by("_swaps", order.place()).alias("_swaps"),
    )
    # Seen from the start of the source: first the swaps before a segment, then the last setting.
    swapped = carry_segments(ends, order, {"_before": ("_swaps", TOTAL)}).withColumn(
        "_before", F.pmod(F.coalesce("_before", F.lit(0)), F.lit(2)).cast("int")
    ).withColumn("_seen", F.col("_set").bitwiseXOR(F.col("_before")))
    return carry_segments(swapped, order, {"_last": ("_seen", LATEST)}).select(
        *order.keys,
        F.coalesce("_last", F.lit(0)).bitwiseXOR(F.col("_before")).alias("_entry"),
    )


def _without_end(text: str, end: str) -> Column:
    """A text without the line end it closes with."""
    return F.expr(f"left({text}, char_length({text}) - char_length({end}))")


def join_open_quotes(lines: DataFrame, order: LineOrder = _ORDER) -> DataFrame:
    """Glue the physical lines of each record; ``seq`` becomes that of its first line.

    ``lines`` are staged, with segments, the marks of :func:`with_quote_marks`, and ``line_end``,
    what follows each line in the file.

    Each line closes, opens, keeps or swaps the quote state.  With ``swaps`` counting the
    swaps so far, the state is the last closing or opening seen through the swaps since then.
    The same holds for whole segments, so their few rows carry the state from one to the next.
    A first pass over the marks tells the state with which each segment starts.  A second one
    shuffles the text by segment, once, and glues the lines of a record that lie in one segment.
    Only pieces that touch a bound of their segment, two at most in each, meet others after that.

    A cell may be of any length.  A quote still open at the end of its file was never meant to
    open a cell: its record becomes an error marker, and the lines after it are records of their
    own.
    """
    position = ", ".join(order.position)
    by = ", ".join(order.by)
    stated = _chained(lines, order).join(_entry_states(lines, order), order.keys, "left").withColumn(
        "_after", F.coalesce("_set", "_entry").bitwiseXOR(F.col("_swaps"))
    )
    before = F.coalesce(F.lag("_after").over(order.inside()), F.col("_entry"))
    numbered = stated.withColumn("_starts", (before == 0).cast("int")).withColumn(
        "_piece", F.sum("_starts").over(order.up_to_here())
    )
    place = F.struct("block_start", "seq")
    pieces = stage(
        numbered.groupBy(*order.keys, "_piece").agg(
            F.expr(f"listagg(raw || line_end, '') within group (order by {by})").alias("raw"),
            F.max_by("line_end", order.place()).alias("_end"),
            F.max_by("_after", order.place()).alias("_after"),
            F.min("seq").alias("seq"), F.first("file_date").alias("file_date"),
        ).withColumn("raw", _without_end("raw", "_end"))
        # Piece 0 goes on with a record of an earlier segment.
        .withColumn("_first", F.when(F.col("_piece") > 0, place)),
        "csv-pieces",
    )
    whole = pieces.where("_piece > 0 AND _after = 0")
    starts = pieces.groupBy(*order.keys).agg(F.max("_first").alias("_start"))
    carried = carry_segments(starts, order, {"_carried": ("_start", LATEST)}).drop("_start")
    unclosed, _ = small_side(_unclosed_records(pieces, order))
    parts = (
        pieces.where("_piece = 0 OR _after = 1").join(carried, order.keys)
        .withColumn("_record", F.coalesce("_first", "_carried"))
        .join(unclosed, order.file, "left")
        .withColumn("_given_up", F.coalesce(F.col("_record") == F.col("_bad"), F.lit(False)))
    )
    glued = parts.where(~F.col("_given_up")).groupBy(order.file, "_record").agg(
        F.expr(f"listagg(raw || _end, '') within group (order by {position})").alias("raw"),
        F.max_by("_end", F.struct(*order.position)).alias("_end"),
        F.first("file_date").alias("file_date"),
    ).select(
        order.file, F.col("_record.block_start").alias("block_start"),
        F.col("_record.seq").alias("seq"), _without_end("raw", "_end").alias("raw"), "file_date",
    )
    # Lines hold no line ends, and their numbers rise by one inside a segment.
    lone = parts.where("_given_up").select(
        order.file, "block_start", "seq", "_piece", "file_date",
        F.posexplode(F.split("raw", r"\r\n|\r|\n", -1)).alias("_at", "_line"),
    )
    message = F.concat(F.lit(_ERROR_TEXT), F.replace("_line", F.lit('"'), F.lit('""')))
    marker = F.concat(F.lit(_ERROR_CELLS[0] + ',"'), message, F.lit('",' + _ERROR_CELLS[1]))
    alone = lone.select(
        order.file, "block_start", (F.col("seq") + F.col("_at")).alias("seq"),
        F.when((F.col("_at") == 0) & (F.col("_piece") > 0), marker).otherwise(F.col("_line"))
        .alias("raw"), "file_date",
    )
    return whole.select(*alone.columns).union(glued.select(*alone.columns)).union(alone)


def _unclosed_records(pieces: DataFrame, order: LineOrder) -> DataFrame:
    """``(file, _bad)``: the last record of each file that ends inside a quoted cell.

    First per segment, then per file: map-side combined, one narrow row per segment.
    """
    ends = pieces.groupBy(*order.keys).agg(
        F.max_by("_after", order.place()).alias("_after"),
        F.max(F.col("_first.seq")).alias("_seq"),
    )
    last = F.when(F.col("_seq").isNotNull(), F.struct("block_start", F.col("_seq").alias("seq")))
    return (
        ends.groupBy(order.file)
        .agg(F.max_by("_after", F.struct(*order.segments)).alias("_after"),
             F.max(last).alias("_bad"))
        .where(F.col("_after") == 1).select(order.file, "_bad")
    )


def csv_to_lines(records: DataFrame, source: str = "path") -> DataFrame:
    """Records with their header row to raw lines; the header row itself goes away."""
    # The records are staged: their line numbers are the same in each pass.
    per_block = records.groupBy(source, "block_start").agg(F.min("seq").alias("_seq"))
    starts = per_block.groupBy(source).agg(
        F.min("block_start").alias("_header_block"),
        F.min_by("_seq", "block_start").alias("_header_seq"),
    )
    is_header = (F.col("block_start") == F.col("_header_block")) & (
        F.col("seq") == F.col("_header_seq")
    )
    starts, _ = small_side(starts)
    headers = records.join(starts, source).where(is_header).select(
        source, split_cells(F.col("raw")).alias("_headers"), "_header_block", "_header_seq"
    )
    headers, _ = small_side(headers)
    joined = records.join(headers, source)
    body = joined.where(~is_header & (F.col("raw") != ""))
    return (
        body.withColumn("_cells", split_cells(F.col("raw")))
        .withColumn("raw", render_record(F.col("_cells"), F.col("_headers")))
        .drop("_cells", "_headers", "_header_block", "_header_seq")
    )


def lines_with_ends(lines: DataFrame) -> DataFrame:
    """Lines cut at line feeds, cut at carriage returns too; ``line_end`` tells what followed each.

    They are numbered anew in the task that reads them, so numbers still rise along the file.
    """
    returned = F.endswith("raw", F.lit("\r"))
    pieces = F.split(F.regexp_replace("raw", r"\r\z", ""), "\r", -1)
    cut = lines.withColumn("_last_end", F.when(returned, "\r\n").otherwise("\n")).select(
        "*", F.posexplode(pieces).alias("_at", "_piece"), F.size(pieces).alias("_pieces")
    )
    end = F.when(F.col("_at") + 1 < F.col("_pieces"), "\r").otherwise(F.col("_last_end"))
    return cut.select(
        "path", "block_start", F.monotonically_increasing_id().alias("seq"),
        F.col("_piece").alias("raw"), "file_date", end.alias("line_end"),
    )


def read_csv_lines(spark: SparkSession, paths: Sequence[str], encoding: str = "utf-8",
                   quoted_newlines: bool | None = None) -> DataFrame:
    """CSV files as raw lines.

    ``quoted_newlines=None`` looks whether any line ends inside an open quote, and stops at the
    first; files without one (the normal case) need no gluing.  The lines are staged once,
    because records and headers must see the same line numbers.
    """
    if quoted_newlines is None:
        seen = read_text(spark, paths, encoding)
        quoted_newlines = not seen.where(opens_quote(F.col("raw"))).isEmpty()
    if not quoted_newlines:
        return csv_to_lines(stage(read_text(spark, paths, encoding), "csv"))
    exact = lines_with_ends(read_text(spark, paths, encoding, line_feed_only=True))
    lines = stage(with_quote_marks(with_segments(exact)), "csv")
    records = join_open_quotes(lines)
    release(lines)  # the pieces of records are staged by now, and nothing else is read
    return csv_to_lines(records)
