"""Merging entries of several sources on a stream, with a watermark for late ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from timeloom.streaming.assemble import EPOCH, STORE, micros, wall_clock

#: Entries that go into the state as one value, and characters of text after which a value is full.
CHUNK, CHUNK_CHARS = 4096, 1 << 20


def merge_stream(entries: DataFrame, files: Sequence[str], delay: str = "1 minute",
                 window: timedelta | None = None, slices: int = 1) -> DataFrame:
    """Wide rows ``(ts, part, <files>)`` per timestamp, or per tumbling ``window``.

    ``entries`` has ``file, ts, seq, body``.  A row is final once the watermark, ``delay``
    behind the newest entry, has passed it; later entries are dropped (:func:`merge_with_late` keeps them).  A busy window can be
    cut into ``slices`` of equal length: each is a row of its own, ``part`` tells its place.
    Watermarks need an instant: the wall clock counts as UTC, so that hours that a time zone skips or
    repeats stay what the log says.
    """
    instant = F.timestamp_micros(micros(F.col("ts")))
    timed = entries.withColumn("at", instant).withWatermark("at", delay)
    key = F.col("at")
    if window is not None:
        whole = window // timedelta(microseconds=1)
        length = whole // slices
        if length * slices != whole:
            raise ValueError("the window must be a multiple of its slices")
        key = F.window("at", f"{length} microseconds")

    def cell(name: str) -> Column:
        lines = F.collect_list(
            F.when(F.col("file") == name, F.struct(F.col("ts"), F.col("seq"), F.col("body")))
        )
        text = F.transform(F.array_sort(lines), lambda line: line["body"])
        return F.array_join(text, "\n").alias(name)

    names = list(dict.fromkeys(files))
    merged = timed.where(F.col("file").isin(names)).groupBy(key.alias("key")).agg(
        *[cell(n) for n in names]
    )
    start, part = F.col("key"), F.lit(0)
    if window is not None:
        begin = F.unix_micros("key.start")
        into = F.pmod(begin, F.lit(whole))
        start = F.timestamp_micros(begin - into)
        part = F.floor(into / length).cast("int")
    return merged.select(
        wall_clock(F.unix_micros(start)).alias("ts"), part.alias("part"),
        *[F.col(f"`{n}`") for n in names],
    )


class MergeProcessor(StatefulProcessor):
    """Holds the entries of one time until the watermark has passed it; later ones come out as late.

    Each call to the state is a message to the JVM, so entries are put there in chunks.
    """

    def __init__(self, files: Sequence[str]):
        self.files = list(files)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = Row("late", "ts", *self.files)
        # One value is a chunk of entries, column by column.
        self.entries = handle.getListState(
            "entries", "us array<bigint>, seq array<bigint>, file array<int>, body array<string>")

    def close(self) -> None:
        pass

    def _row(self, late: bool, us: int, found: list[tuple]) -> Row:
        cells: list[list[str]] = [[] for _ in self.files]
        for _, _, file, body in found:
            cells[file].append(body)
        return self.row(late, EPOCH + timedelta(microseconds=us), *map("\n".join, cells))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        start, end = key
        found = ((row.us, row.seq, row.number, row.body) for row in rows)
        if -(-end // 1000) <= timerValues.getCurrentWatermarkInMs():
            for entry in found:
                yield self._row(True, entry[0], [entry])
            return
        if not self.entries.exists():
            self.handle.registerTimer(-(-end // 1000))
        chunk, chars = [], 0
        for entry in found:
            chunk.append(entry)
            chars += len(entry[3])
            if len(chunk) >= CHUNK or chars >= CHUNK_CHARS:
                self.entries.appendValue(tuple(map(list, zip(*chunk, strict=True))))
                chunk, chars = [], 0
        if chunk:
            self.entries.appendValue(tuple(map(list, zip(*chunk, strict=True))))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        found = sorted(entry for chunk in self.entries.get() for entry in zip(*chunk, strict=True))
        self.entries.clear()
        if found:
            yield self._row(False, key[0], found)


def merge_with_late(entries: DataFrame, files: Sequence[str], delay: str = "1 minute",
                    window: timedelta = timedelta(microseconds=1)) -> DataFrame:
    """One stream with two kinds of rows ``(late, ts, <files>)``: merged ones and late ones.

    A merged row (``late`` false) holds all entries of a ``window``, or of one timestamp, that came before the
    watermark had passed it; it is written once that has happened.  An entry that comes after is a
    row of its own with its own time (``late`` true), so no entry is lost.  Write it with
    ``run_to_end(..., partition="late")`` to have both as folders of their own.  Entries of files that are
    not listed are an error.  The entries of a window meet in one task, as its row does.
    """
    spark = entries.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    names = list(dict.fromkeys(files))
    if taken := sorted({"late", "ts"}.intersection(names)):
        raise ValueError(f"sources named like columns of the result: {taken}")
    length = window // timedelta(microseconds=1)
    timed = entries.withColumn("at", F.timestamp_micros(micros(F.col("ts")))).withWatermark("at", delay)
    # The plain number carries no watermark: Spark leaves late rows to the processor.
    us = micros(F.col("ts"))
    start = us - F.pmod(us, F.lit(length))
    number = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("file")), F.lit(0)).cast("int") - 1
    unknown = F.raise_error(F.concat(F.lit("source not in the list of files: "), F.coalesce("file", F.lit("NULL"))))
    rows = timed.select(
        start.alias("start"), (start + length).alias("end"), us.alias("us"), F.col("seq").cast("bigint").alias("seq"),
        F.when(number < 0, unknown.cast("int")).otherwise(number).alias("number"),
        F.coalesce("body", F.lit("")).alias("body"))
    schema = "late boolean, ts timestamp_ntz, " + ", ".join(f"`{n}` string" for n in names)
    return rows.groupBy("start", "end").transformWithState(MergeProcessor(names), schema, "append", "eventTime")
