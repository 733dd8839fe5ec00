"""The registered workload: every operator on the test tables, over all their rows.

Three logs are made from the tables: ``event_lines`` (one source per event type),
``shipping_lines`` (one source per return flag, out of time order, many equal times) and
``conversation_lines`` (multi-line records: only the user's turns carry a time).
``document_lines`` are the text lines of the documents, one source per language.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions import text as tx
from timeloom.functions.formats import FormatRegistry
from timeloom.functions.literals import Jump
from timeloom.operators.asof import asof_join
from timeloom.operators.clip import TimeRange, autoclip, clip
from timeloom.operators.explore import (
    OVERALL,
    file_stats,
    find_next,
    find_previous,
    goto_line,
    goto_timestamp,
    info_table,
    jump,
    search,
)
from timeloom.operators.merge import (
    merge_long,
    merge_two,
    merge_wide,
    number_in_order,
    present,
    unpivot,
)
from timeloom.operators.order import (
    LineOrder,
    flag_disorder,
    forward_fill,
    number_rows,
    number_runs,
    with_segments,
)
from timeloom.operators.records import (
    cell_lines,
    collapse_records,
    detect_formats,
    fill_records,
    parse_timestamps,
)
from timeloom.plans.align import align
from timeloom.plans.session import collect_small, fresh_path, stage
from timeloom.sinks.tables import column_widths, markdown_rows, text_rows, write_csv
from timeloom.sources import csv_records, jsonl, packets, synthetic
from timeloom.sources.files import read_text, register_reader
from timeloom.streaming.assemble import assemble_stream, run_to_end
from timeloom.streaming.timeline import merge_stream, merge_with_late

EVENT_FILES = ["click", "error", "purchase", "signup", "view"]
SHIP_ORDER = LineOrder(
    segments=("bucket",),
    by=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ts"),
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("file"),
        F.lit(0).cast("bigint").alias("block_start"),
        F.col("event_id").alias("seq"),
        "ts", "user_id",
        F.concat(F.lit("user="), F.col("user_id"), F.lit(" "), F.col("props")).alias("body"),
    )


def shipping_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("file"),
        F.shiftright("l_orderkey", 14).alias("bucket"),
        F.col("l_shipdate").alias("ts"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("body"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = base + F.make_dt_interval(
        F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("int")
    )
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("file"),
        F.lit(0).cast("bigint").alias("block_start"),
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "user", at).alias("ts"),
        F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("body"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines; the first line of each document starts with a time."""
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = base + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.col("doc_id").cast("decimal(18,6)")
    )
    lines = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("file"), F.col("doc_id").alias("block_start"), "doc_id",
        at.alias("_at"), F.posexplode(F.split("text", "\n")).alias("seq", "_line"),
    )
    stamped = F.concat(F.date_format("_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.col("_line"))
    return lines.select(
        "file", "block_start", F.col("seq").cast("bigint").alias("seq"), "doc_id",
        F.when(F.col("seq") == 0, stamped).otherwise(F.col("_line")).alias("raw"),
    )


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_records(event_lines(spark, sf_dir))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered long form that the exploring queries look at."""
    return merge_long(event_entries(spark, sf_dir), EVENT_FILES)


def kept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once: a question takes several looks at the table."""
    return stage(event_rows(spark, sf_dir), "rows")


# --- timestamp formats ----------------------------------------------------------------

def _at(pattern: str) -> Callable[[Column], Column]:
    return lambda ts: F.date_format(ts, pattern)


def _zoned(pattern: str) -> Callable[[Column], Column]:
    # The offset of the session time zone, so that parsing gives the same wall clock.
    return lambda ts: F.date_format(ts.cast("timestamp"), pattern)


def _syslog_text(ts: Column) -> Column:
    return F.concat_ws(
        " ", F.date_format(ts, "MMM"),
        F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), F.date_format(ts, "HH:mm:ss"),
    )


def _epoch_text(ts: Column) -> Column:
    micros = F.unix_micros(ts.cast("timestamp"))
    whole = F.floor(micros / F.lit(1_000_000)).cast("bigint")
    return F.concat(whole, F.lit("."), F.lpad((micros - whole * 1_000_000).cast("string"), 6, "0"))


# Format name -> how the event log is written for it.
RENDERED: dict[str, Callable[[Column], Column]] = {
    "iso_space_comma_zone": _zoned("yyyy-MM-dd HH:mm:ss,SSSSSSXX"),
    "iso_space_comma": _at("yyyy-MM-dd HH:mm:ss,SSSSSS"),
    "iso_space_dot_zone": _zoned("yyyy-MM-dd HH:mm:ss.SSS xx"),
    "iso_space_dot": _at("yyyy-MM-dd HH:mm:ss.SSS"),
    "iso_space_whole_zone": _zoned("yyyy-MM-dd HH:mm:ssXX"),
    "iso_space_whole": _at("yyyy-MM-dd HH:mm:ss"),
    "iso_t_comma_zone": _zoned("yyyy-MM-dd'T'HH:mm:ss,SSSSSSxx"),
    "iso_t_comma": _at("yyyy-MM-dd'T'HH:mm:ss,SSSSSS"),
    "iso_t_dot_zone": _zoned("yyyy-MM-dd'T'HH:mm:ss.SSSxx'Z'"),
    "iso_t_dot": _at("yyyy-MM-dd'T'HH:mm:ss.SSS"),
    "iso_t_whole_zone": _zoned("yyyy-MM-dd'T'HH:mm:ssxx"),
    "iso_t_whole": _at("yyyy-MM-dd'T'HH:mm:ss"),
    "syslog": _syslog_text,
    "time_of_day": _at("HH:mm:ss.SSSSSS"),
    "http_server": _at("dd/MMM/yyyy HH:mm:ss"),
    "access_log": _zoned("dd/MMM/yyyy:HH:mm:ss xx"),
    "epoch_float": _epoch_text,
    "epoch_millis": lambda ts: F.unix_millis(ts.cast("timestamp")).cast("string"),
    "epoch_seconds": lambda ts: F.unix_seconds(ts.cast("timestamp")).cast("string"),
    "apache_error": _at("'['EEE MMM dd HH:mm:ss.SSSSSS yyyy']'"),
}
BRACKETED = ("http_server", "access_log")
REFERENCE_DATE = "2024-01-01"


def rendered_events(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The event log as raw text in one of the formats."""
    stamp = RENDERED[name](F.col("ts"))
    if name in BRACKETED:
        host = F.concat(F.lit("10.0.0."), F.col("user_id"), F.lit(" - - ["))
        raw = F.concat(host, stamp, F.lit("] "), F.col("body"))
    else:
        raw = F.concat(stamp, F.lit(" "), F.col("body"))
    return event_lines(spark, sf_dir).select("file", "block_start", "seq", raw.alias("raw"))


def _parsed(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("seq").alias("event_id"), "ts", "body")


def _format_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = rendered_events(spark, sf_dir, name)
        return _parsed(parse_timestamps(raw, name, reference_date=REFERENCE_DATE))
    return run


def _template_query(template: str, raw: Callable[[Column, Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        registry = FormatRegistry([template])
        lines = event_lines(spark, sf_dir).select(
            "file", "block_start", "seq", raw(F.col("ts"), F.col("body")).alias("raw")
        )
        formats = dict(collect_small(detect_formats(lines, registry)))
        return _parsed(parse_timestamps(lines, formats, registry, REFERENCE_DATE))
    return run


def _mixed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source of the event log in a format of its own."""
    chosen = dict(zip(EVENT_FILES, ["syslog", "iso_t_dot_zone", "epoch_float", "access_log",
                                    "apache_error"], strict=True))
    host = F.lit("10.0.0.1 - - [")
    raw = F.coalesce(*[
        F.when(
            F.col("file") == file,
            F.concat(host, RENDERED[name](F.col("ts")), F.lit("] "), F.col("body"))
            if name in BRACKETED
            else F.concat(RENDERED[name](F.col("ts")), F.lit(" "), F.col("body")),
        )
        for file, name in chosen.items()
    ])
    return event_lines(spark, sf_dir).select("file", "block_start", "seq", raw.alias("raw"))


def q_detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_formats(_mixed_formats(spark, sf_dir))


def q_parse_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _mixed_formats(spark, sf_dir)
    formats = dict(collect_small(detect_formats(lines)))
    return _parsed(parse_timestamps(lines, formats, reference_date=REFERENCE_DATE))


# --- lines and records ------------------------------------------------------------------

def q_ts_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).select(
        F.col("seq").alias("event_id"), tx.display_ts(F.col("ts")).alias("timestamp")
    )


def q_ansi_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    colour = F.concat(F.lit("\x1b[1;"), F.pmod("user_id", F.lit(8)) + 30, F.lit("m"))
    painted = F.concat(colour, F.col("file"), F.lit("\x1b[0m "), F.col("body"))
    return event_lines(spark, sf_dir).select(
        F.col("seq").alias("event_id"), tx.strip_sgr(painted).alias("body")
    )


def q_rtrim(spark: SparkSession, sf_dir: str) -> DataFrame:
    blanks = F.lit(" \t\r\n\u2003\u3000 ")
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.rtrim_ws(F.concat("text", blanks)).alias("text")
    )


def q_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_timestamps(document_lines(spark, sf_dir), "iso_space_whole")
    return parsed.select("doc_id", F.col("seq").alias("line_no"), "ts", "body")


def q_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = forward_fill(with_segments(conversation_lines(spark, sf_dir)))
    return filled.select(F.col("file").alias("conv_id"), F.col("seq").alias("turn"), "rec_ts")


def q_run_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = forward_fill(with_segments(conversation_lines(spark, sf_dir)))
    return number_runs(filled).select(
        F.col("file").alias("conv_id"), F.col("seq").alias("turn"), "run_id"
    )


def _entries(entries: DataFrame) -> DataFrame:
    return entries.select("file", "ts", "n_lines", "body")


def q_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(collapse_records(conversation_lines(spark, sf_dir)))


def q_collapse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_timestamps(document_lines(spark, sf_dir), "iso_space_whole")
    return _entries(collapse_records(parsed))


def q_drop_untimestamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = conversation_lines(spark, sf_dir)
    return _entries(collapse_records(lines, ignore_untimestamped=True))


def q_merge_equal_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(collapse_records(shipping_lines(spark, sf_dir), order=SHIP_ORDER))


def q_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = flag_disorder(shipping_lines(spark, sf_dir), order=SHIP_ORDER)
    return flagged.select("file", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ts",
                          "is_out_of_order", "lateness_us")


def q_long_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping lines by year, line by line: a few cells hold all lines and none is gathered."""
    filled = fill_records(shipping_lines(spark, sf_dir), order=SHIP_ORDER,
                          key=lambda ts: F.date_trunc("year", ts).cast("timestamp_ntz"))
    rows = cell_lines(filled, SHIP_ORDER).withColumn("part", F.lit(0))
    return number_rows(rows, spread="file").select("line", "ts", "file", "line_in_cell", "body")


def q_merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping entries in merged order, with their place in it; ties in the order of the files."""
    entries = collapse_records(shipping_lines(spark, sf_dir), order=SHIP_ORDER)
    rows = merge_long(entries, ["R", "A", "N"], line_numbers=False)
    return number_in_order(rows, "file_no").select("position", "ts", "file_no", "file")


# --- merging ------------------------------------------------------------------------------

def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_wide(
        collapse_records(event_lines(spark, sf_dir), key=lambda ts: tx.floor_ts(ts, "hour")),
        EVENT_FILES,
    )


def q_merge_wide_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).drop("part")


def q_merge_wide_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read as text, detect, assemble and merge on the second."""
    raw = rendered_events(spark, sf_dir, "iso_space_comma")
    lines = stage(with_segments(parse_timestamps(raw, "iso_space_comma")), "lines")
    keyed = collapse_records(lines, key=lambda ts: tx.floor_ts(ts, "second"))
    return merge_wide(keyed, EVENT_FILES).drop("part")


def q_merge_wide_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_wide(event_entries(spark, sf_dir), EVENT_FILES).drop("part")


def q_merge_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("file"), F.lit(0).cast("bigint").alias("block_start"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("ts"),
        F.concat_ws(" ", "o_orderkey", "o_orderstatus").alias("body"),
    )
    shipped = shipping_lines(spark, sf_dir).withColumn("file", F.lit("shipped"))
    return merge_two(
        collapse_records(orders), collapse_records(shipped, order=SHIP_ORDER),
        "ordered", "shipped",
    ).drop("part")


def q_merge_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).select("line", "timestamp", "file", "log")


def q_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpivot(hourly(spark, sf_dir), EVENT_FILES).select("ts", "file_no", "file", "log")


def q_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = merge_wide(event_entries(spark, sf_dir), EVENT_FILES)
    return present(wide, EVENT_FILES, line_numbers=True).drop("ts", "part")


def q_number_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = collapse_records(shipping_lines(spark, sf_dir), order=SHIP_ORDER)
    return number_rows(entries).select("line", "ts", "file", "n_lines")


# --- clipping -----------------------------------------------------------------------------

def _event_times(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("seq").alias("event_id"), "ts", "file")


def q_clip_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(spark, sf_dir)
    return _event_times(clip(lines, "2024-01-05T06:30", "2024-01-20 12:00:00,500"))


def q_clip_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_times(clip(event_lines(spark, sf_dir), start="2024-01-10"))


def q_clip_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_times(clip(event_lines(spark, sf_dir), end="2024-01-10T00:00:00"))


def q_clip_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = datetime(2024, 1, 20, 12)
    return _event_times(clip(event_lines(spark, sf_dir), "10d", "36h", now=now))


def q_clip_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = fill_records(conversation_lines(spark, sf_dir),
                        within=TimeRange.between(end="2024-01-02 06:02"))
    return kept.select(F.col("file").alias("conv_id"), F.col("seq").alias("turn"), "rec_ts")


def q_autoclip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(spark, sf_dir)
    first = lines.where(F.col("user_id") == 8).select("ts")
    return _event_times(autoclip(lines, first))


# --- exploring ----------------------------------------------------------------------------

def q_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_stats(event_entries(spark, sf_dir), EVENT_FILES)


def q_info_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return info_table(file_stats(event_entries(spark, sf_dir), EVENT_FILES))


def q_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(event_rows(spark, sf_dir), '"K": 7').select("line", "timestamp", "file", "log")


def _row(rows: DataFrame) -> DataFrame:
    return rows.select("line", "timestamp", "file", "log")


def _row_query(pick: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _row(pick(kept_rows(spark, sf_dir)))


def q_asof(direction: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = event_lines(spark, sf_dir)
        probes = lines.where(F.col("file") == "error").select(
            F.col("seq").alias("event_id"), "ts"
        )
        clicks = collapse_records(lines.where(F.col("file") == "click")).select("ts", "body")
        return asof_join(probes, clicks, direction)
    return run


# --- end to end ---------------------------------------------------------------------------

ALIGN_PARTS = 4


def _in_parts(rows: DataFrame) -> DataFrame:
    """Rows as they go to log files: the order of the files is that of the lines."""
    return rows.repartitionByRange(ALIGN_PARTS, "seq").sortWithinPartitions("file", "seq")


def _written_events(spark: SparkSession, sf_dir: str) -> str:
    """The event log as text files, a folder per event type."""
    folder = fresh_path(spark, "logs")
    raw = _in_parts(rendered_events(spark, sf_dir, "iso_space_comma"))
    raw.select(F.col("file").alias("kind"), F.col("raw").alias("value")).write.partitionBy(
        "kind").text(folder)
    return folder


def _kind() -> Column:
    """The event type in the name of a file."""
    return F.regexp_extract("file", "/kind=([a-z]+)/", 1)


def _line_by_line(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, "timestamp", _kind().alias("kind"),
                       F.explode(F.split("log", "\n")).alias("log"))


def q_align_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of a folder side by side; the files of one event type are then put together."""
    merged = align(spark, [_written_events(spark, sf_dir)])

    def cell(kind: str) -> Column:
        parts = [F.col(f"`{f}`") for f in merged.files if f"/kind={kind}/" in f]
        return F.concat_ws("\n", *[F.when(p != "", p) for p in parts]).alias(kind)

    return merged.wide(line_numbers=True).select("line", "timestamp", *map(cell, EVENT_FILES))


def q_align_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = align(spark, [_written_events(spark, sf_dir)])
    return _line_by_line(merged.long(line_numbers=True), "line")


def q_align_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = align(spark, [_written_events(spark, sf_dir)]).stats()
    overall = F.col("file") == OVERALL
    return stats.groupBy(F.when(overall, F.col("file")).otherwise(_kind()).alias("kind")).agg(
        F.max(F.when(overall, F.col("n_entries"))).alias("n_merged"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )


def q_align_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = align(spark, [_written_events(spark, sf_dir)], start="2024-01-05 06:30",
                   end="2024-01-20 12:00:00.500")
    return _line_by_line(merged.long())


def q_detect_late_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that begin with a line without a time; the format is found further down."""
    folder = fresh_path(spark, "late")
    raw = _in_parts(rendered_events(spark, sf_dir, "iso_space_comma"))
    raw.select(F.col("file").alias("kind"),
               F.concat(F.lit("-- event\n"), F.col("raw")).alias("value")
               ).write.partitionBy("kind").text(folder)
    rows = _line_by_line(align(spark, [folder], detect="first_match").long())
    return rows.where(F.trim("log") != "-- event")


def q_align_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, gzip, CSV and JSON lines in one folder, each read by its suffix."""
    folder = fresh_path(spark, "mixed")
    register_reader(".json", jsonl.read_jsonl_lines)  # the suffix that Spark gives to JSON lines
    raw = rendered_events(spark, sf_dir, "iso_space_comma")
    events = event_lines(spark, sf_dir)
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    for kind in EVENT_FILES:
        mine, path = F.col("file") == kind, f"{folder}/kind={kind}"
        cells = _in_parts(events.where(mine)).select(time.alias("time"),
                                                     F.col("body").alias("entry"))
        lines = _in_parts(raw.where(mine)).select(F.col("raw").alias("value"))
        if kind == "purchase":
            cells.write.option("header", True).option("escape", '"').csv(path)
        elif kind == "signup":
            cells.write.json(path)
        elif kind == "error":
            lines.write.option("compression", "gzip").text(path)
        else:
            lines.write.text(path)
    return _line_by_line(align(spark, [folder]).long())


# --- sources ------------------------------------------------------------------------------

def q_text_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log written as gzip text and read back."""
    folder = fresh_path(spark, "gzip")
    raw = rendered_events(spark, sf_dir, "iso_space_comma")
    raw.select(F.concat_ws(" ", "raw", "seq").alias("value")).write.option(
        "compression", "gzip"
    ).text(folder)
    lines = read_text(spark, [folder]).withColumnRenamed("path", "file")
    return parse_timestamps(lines, "iso_space_comma").select("ts", "body")


def q_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "csv")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = base + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.col("c_custkey").cast("decimal(18,6)")
    )
    table(spark, sf_dir, "customer").select(
        F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")).alias("nation"),
        F.concat(
            F.lit('segment "'), F.col("c_mktsegment"), F.lit('", key '), F.col("c_custkey")
        ).alias("segment"),
    ).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)
    return csv_records.read_csv_lines(spark, [folder]).select("raw")


def q_csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as quoted cells that run over many physical lines."""
    folder = fresh_path(spark, "csv-quoted")
    table(spark, sf_dir, "documents").select(
        F.concat(F.lit("at "), F.col("doc_id")).alias("time"), "lang", "text", "source"
    ).write.options(
        header=True, quoteAll=True, escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(folder)
    return csv_records.read_csv_lines(spark, [folder]).select("raw")


def q_csv_crlf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with all kinds of line ends in them come back as they are in the file."""
    folder = fresh_path(spark, "csv-crlf")
    text = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    table(spark, sf_dir, "documents").select(
        F.concat(F.lit("at "), F.col("doc_id")).alias("time"),
        F.replace(text, F.lit(". "), F.lit(".\r")).alias("text"), "source",
    ).write.options(
        header=True, quoteAll=True, escape='"', lineSep="\n",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(folder)
    return csv_records.read_csv_lines(spark, [folder]).select("raw")


def q_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "jsonl")
    events = event_lines(spark, sf_dir)
    events.select(
        F.to_json(F.struct(
            F.col("file").alias("kind"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"),
            F.col("user_id").alias("user"),
            F.col("body").alias("message"),
            F.struct(F.col("seq").alias("id")).alias("ref"),
        )).alias("value")
    ).write.text(folder)
    return jsonl.read_jsonl_lines(spark, [folder]).select("raw")


def packet_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets made from the integers of the line items; every branch occurs."""
    kind = F.pmod("l_orderkey", F.lit(5))
    nfs, http, udp = kind <= 1, kind == 2, kind == 4
    status = F.element_at(
        F.array(*[F.lit(s) for s in ("0", "2", "13", "9999")]),
        F.pmod(F.col("l_suppkey"), F.lit(4)).cast("int") + 1,
    )
    name = F.when(F.pmod("l_partkey", F.lit(3)) > 0, F.concat(F.lit("it's "), F.col("l_partkey")))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("ts"),
        F.when(nfs, "NFS").when(http, "JSON").when(udp, "DNS").otherwise("TCP").alias("layer"),
        F.when(F.pmod("l_orderkey", F.lit(17)) > 0,
               F.concat(F.lit("10.0.0."), F.pmod("l_partkey", F.lit(256)))).alias("src"),
        F.when(~udp, F.col("l_partkey") + 1024).alias("sport"),
        F.concat(F.lit("10.0.1."), F.pmod("l_suppkey", F.lit(256))).alias("dst"),
        F.when(~udp, F.lit(2049)).alias("dport"),
        F.col("l_orderkey").alias("seq"),
        F.col("l_partkey").alias("ack"),
        F.when(~udp, F.pmod("l_suppkey", F.lit(64)).cast("int")).alias("flags"),
        F.when(F.col("l_linenumber") > 1, F.expr("repeat('ab:', l_linenumber * 4)"))
        .alias("payload"),
        (F.col("l_linenumber") * 4).alias("len"),
        F.when(nfs, F.pmod("l_partkey", F.lit(25))).alias("nfs_proc"),
        F.when(nfs, name).alias("nfs_name"),
        F.when(kind == 1, status).alias("nfs_status"),
        F.when(http, F.concat(F.lit("GET /"), F.col("l_partkey"), F.lit(" HTTP/1.1\\r\\n")))
        .alias("http_chat"),
    )


def q_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = packets.format_packets(packet_table(spark, sf_dir))
    return formatted.select("timestamp", "proto", "message")


def q_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated log with one line per event; its clock must move by 0 to 10 seconds."""
    keys = event_lines(spark, sf_dir).select("file", "seq")
    made = synthetic.log_lines(keys)
    parsed = parse_timestamps(made.withColumnRenamed("ts", "clock"), "iso_space_whole")
    again = flag_disorder(with_segments(parsed))
    return again.groupBy("file").agg(
        F.count("*").alias("n_lines"),
        F.sum(F.col("is_out_of_order").cast("bigint")).alias("n_late"),
        F.sum((F.col("ts") != F.col("clock")).cast("bigint")).alias("n_wrong"),
    )


# --- cells and sinks ----------------------------------------------------------------------

def q_lines_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.lines_in(F.col("text")).alias("n_lines"),
        tx.row_height([F.col("text"), F.col("source")]).alias("height"),
    )


def q_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_rows(present(hourly(spark, sf_dir), EVENT_FILES)).select("row")


def q_markdown_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping entries in line, as Markdown rows: sources of one time stand under it."""
    entries = collapse_records(shipping_lines(spark, sf_dir), order=SHIP_ORDER)
    return markdown_rows(merge_long(entries, ["R", "A", "N"], line_numbers=False)).select("row")


def q_text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned text of the document cells: one output line per text line."""
    shown = table(spark, sf_dir, "documents").select(
        F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(0).alias("part"),
        F.col("doc_id").alias("timestamp"), "lang", "source",
    )
    widths = column_widths(shown).first().asDict()
    return text_rows(shown, widths).select("row")


def q_csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly merge written as CSV and read back."""
    folder = fresh_path(spark, "merged-csv")
    write_csv(present(hourly(spark, sf_dir), EVENT_FILES), folder)
    schema = ", ".join(f"{c} string" for c in ["timestamp", *EVENT_FILES])
    back = spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(folder)
    return back.select("timestamp", *[F.coalesce(f, F.lit("")).alias(f) for f in EVENT_FILES])


# --- streams ------------------------------------------------------------------------------

def _arriving(spark: SparkSession, batches: list[DataFrame], folder: str) -> DataFrame:
    """A stream of these tables, one per micro-batch."""
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _ends(lines: DataFrame) -> DataFrame:
    """An end mark for every source, in the columns of its lines."""
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in lines.schema if f.name not in ("file", "ends")]
    return lines.select("file").distinct().select("file", F.lit(True).alias("ends"), *missing).select(lines.columns)


def _marked_lines(lines: DataFrame) -> DataFrame:
    """Staged lines ``(file, seq, ts, body, ends)``, in order."""
    columns = [F.col("file").cast("string").alias("file"), "seq", "ts", "body", F.lit(False).alias("ends")]
    return stage(lines.select(*columns), "lines").orderBy("file", "seq")


def q_stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations arriving in several batches, cut in the middle of records."""
    root = fresh_path(spark, "stream")
    lines = _marked_lines(conversation_lines(spark, sf_dir))
    pieces = [lines.where(p) for p in (F.col("seq") < 2, F.col("seq").between(2, 4), F.col("seq") > 4)]
    stream = _arriving(spark, [*pieces, _ends(lines)], f"{root}/in")
    return _entries(run_to_end(assemble_stream(stream), f"{root}/out", f"{root}/checkpoint"))


def q_stream_equal_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event logs by the hour: records of equal times arrive in three batches, cut inside an hour."""
    root = fresh_path(spark, "stream-equal")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    exact = event_lines(spark, sf_dir).withColumn("hour", hour)
    exact = stage(exact.select("file", "seq", "ts", "hour", "body"), "lines")
    place = F.expr("unix_micros(cast(ts as timestamp))")
    lines = exact.select("file", place.alias("seq"), F.col("hour").alias("ts"), "body", F.lit(False).alias("ends"),
                         F.col("seq").alias("event"), F.dayofmonth("ts").alias("_day"), F.minute("ts").alias("_minute"))
    # Twice the first half of an hour ends a batch.
    early = (F.col("_day") < 11) | ((F.col("_day") == 11) & (F.hour("ts") == 0) & (F.col("_minute") < 30))
    middle = (F.col("_day") < 21) | ((F.col("_day") == 21) & (F.hour("ts") == 0) & (F.col("_minute") < 30))
    batches = [lines.where(p).orderBy("seq", "event").drop("event", "_day", "_minute")
               for p in (early, ~early & middle, ~early & ~middle)]
    stream = _arriving(spark, [*batches, _ends(batches[0].union(batches[1]).union(batches[2]))], f"{root}/in")
    return _entries(run_to_end(assemble_stream(stream), f"{root}/out", f"{root}/checkpoint"))


def q_stream_idle_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that pause after three turns for longer than the idle time, then go on.

    What is open at the pause is written by the timer, its rest as the next piece.
    """
    root, idle = fresh_path(spark, "stream-idle"), timedelta(milliseconds=500)
    lines = _marked_lines(conversation_lines(spark, sf_dir))

    def arrive(*batches: DataFrame) -> DataFrame:
        stream = _arriving(spark, list(batches), f"{root}/in")
        return run_to_end(assemble_stream(stream, idle), f"{root}/out", f"{root}/checkpoint", timers=True)

    arrive(lines.where("seq < 3"))
    time.sleep(1)
    # Another source makes a batch, and with it the timers run.
    arrive(_ends(lines).limit(1).withColumn("file", F.lit("another source")))
    found = arrive(lines.where("seq >= 3"), _ends(lines))
    return found.select("file", "ts", "piece", "n_lines", "body")


def q_stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly merge with a tenth of the events arriving last: merged rows that the watermark
    has finished, and a row for each event that came too late for its hour."""
    root = fresh_path(spark, "stream-late")
    lines = stage(event_lines(spark, sf_dir).select("file", "ts", "seq", "body"), "lines")
    tardy = F.col("seq") % 10 == 0
    batches = [lines.where(~tardy & (F.dayofmonth("ts") <= 15)), lines.where(~tardy & (F.dayofmonth("ts") > 15)),
               lines.where(tardy)]
    stream = _arriving(spark, batches, f"{root}/in")
    merged = merge_with_late(stream, EVENT_FILES, delay="1 day", window=timedelta(hours=1))
    return run_to_end(merged, f"{root}/out", f"{root}/checkpoint", partition="late").select(
        "late", "ts", *EVENT_FILES)


def q_stream_dst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall clocks in a night in which the session's zone skips an hour: the merge keeps each as it is."""
    root = fresh_path(spark, "stream-dst")
    night = F.lit("2024-03-10 00:00:00").cast("timestamp_ntz")
    at = night + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("seq") % 240).cast("int"))
    lines = event_lines(spark, sf_dir).select("file", at.alias("ts"), "seq", "body")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
    try:
        merged = merge_stream(_arriving(spark, [lines], f"{root}/in"), EVENT_FILES, delay="0 seconds")
        return run_to_end(merged, f"{root}/out", f"{root}/checkpoint").drop("part")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def q_stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly merge as a stream with a watermark."""
    root = fresh_path(spark, "stream-merge")
    # A last entry far ahead moves the watermark past all others, which finishes their rows.
    lines = event_lines(spark, sf_dir).select("file", "ts", "seq", "body")
    end = lines.agg(F.max("ts").alias("ts")).select(
        F.lit(EVENT_FILES[0]).alias("file"),
        (F.col("ts") + F.expr("interval 400 days")).alias("ts"),
        F.lit(-1).cast("bigint").alias("seq"), F.lit("end").alias("body"),
    )
    lines.write.parquet(f"{root}/in")
    end.write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(lines.schema).parquet(f"{root}/in")
    merged = merge_stream(stream, EVENT_FILES, delay="1 day", window=timedelta(hours=1))
    query = (
        merged.writeStream.format("parquet").outputMode("append")
        .option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(merged.schema).parquet(f"{root}/out").drop("part")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {f"ts_fmt_{name}": _format_query(name) for name in RENDERED}
    day = "yyyy-MM-dd HH:mm:ss"
    found |= {
        "ts_custom_lead": _template_query(
            r"(\w+ - )((...) )",
            lambda ts, body: F.concat(F.lit("INFO - "), F.date_format(ts, day), F.lit(" "), body),
        ),
        "ts_custom_drop": _template_query(
            r"((...)\|)",
            lambda ts, body: F.concat(F.date_format(ts, day), F.lit("|"), body),
        ),
        "ts_custom_colour": _template_query(
            r"(.*m\[)((...)\|)",
            lambda ts, body: F.concat(F.lit("\x1b[1;31m["), _epoch_text(ts), F.lit("|E] "), body),
        ),
        "ts_strace": _template_query(
            "strace",
            lambda ts, body: F.concat(
                F.lit("4711 "), F.date_format(ts, "HH:mm:ss.SSSSSS"), F.lit(" "), body
            ),
        ),
        "detect_format": q_detect_format,
        "parse_mixed_formats": q_parse_mixed,
        "ts_display_ms": q_ts_display,
        "ansi_strip": q_ansi_strip,
        "rtrim_ws": q_rtrim,
        "continuation_indent": q_continuation,
        "forward_fill": q_forward_fill,
        "run_groups": q_run_groups,
        "collapse_multiline": q_collapse,
        "collapse_lines_doc": q_collapse_documents,
        "drop_untimestamped": q_drop_untimestamped,
        "merge_dup_ts": q_merge_equal_times,
        "out_of_order": q_out_of_order,
        "merge_wide_hour": q_merge_wide_hour,
        "merge_wide_second": q_merge_wide_second,
        "merge_wide_exact": q_merge_wide_exact,
        "merge_two_full_outer": q_merge_two,
        "merge_inline": q_merge_inline,
        "unpivot_wide": q_unpivot,
        "line_numbers": q_line_numbers,
        "number_rows": q_number_rows,
        "clip_absolute": q_clip_absolute,
        "clip_start_only": q_clip_start,
        "clip_end_only": q_clip_end,
        "clip_relative": q_clip_relative,
        "clip_multiline": q_clip_records,
        "autoclip": q_autoclip,
        "file_stats": q_file_stats,
        "info_table": q_info_table,
        "search": q_search,
        "find_next": _row_query(lambda rows: find_next(rows, '"k": 69', 500)),
        "find_prev": _row_query(lambda rows: find_previous(rows, '"k": 69', 500)),
        "goto_line": _row_query(lambda rows: goto_line(rows, 321)),
        "goto_line_clamped": _row_query(lambda rows: goto_line(rows, 10**9)),
        "jump_lines": _row_query(lambda rows: jump(rows, 321, Jump(-121, "l"))),
        "goto_ts_fwd": _row_query(lambda rows: goto_timestamp(rows, "2024-01-15 12:00")),
        "goto_ts_back": _row_query(
            lambda rows: goto_timestamp(rows, "2024-01-02T03:04:05.5", cursor=900)
        ),
        "jump_time": _row_query(lambda rows: jump(rows, 100, "90m")),
        "asof_probe_table": q_asof("backward"),
        "asof_probe_forward": q_asof("forward"),
        "align_wide": q_align_wide,
        "align_long": q_align_long,
        "align_stats": q_align_stats,
        "align_clip": q_align_clip,
        "detect_late_line": q_detect_late_line,
        "align_mixed_suffixes": q_align_mixed,
        "text_gzip_lines": q_text_gzip,
        "csv_lines": q_csv,
        "csv_quoted_lines": q_csv_quoted,
        "csv_crlf_cells": q_csv_crlf,
        "jsonl_lines": q_jsonl,
        "packet_format": q_packets,
        "synthetic_log": q_synthetic,
        "lines_per_cell": q_lines_per_cell,
        "markdown_rows": q_markdown,
        "text_table": q_text_table,
        "csv_sink": q_csv_sink,
        "stream_records": q_stream_records,
        "stream_merge_hour": q_stream_merge,
        "long_cell": q_long_cell,
        "markdown_long": q_markdown_long,
        "merge_order": q_merge_order,
        "stream_equal_times": q_stream_equal_times,
        "stream_idle_flush": q_stream_idle_flush,
        "stream_late": q_stream_late,
        "stream_dst": q_stream_dst,
    }
    return found
