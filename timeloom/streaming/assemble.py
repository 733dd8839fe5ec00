"""Record assembly on a stream, with the open records in Spark's own keyed state.

Two steps.  Where lines are read, each task puts the lines it reads into *pieces*: a line with a time and
the lines without one behind it; neighbours of equal times are one piece.  Nearly all pieces are whole
records by then.  Only at the ends of what a task has read of a source something may be missing: lines
before its first time, and whatever follows its last one.  So only these *edges* -- three at most for each
source and split -- go through the state of their source.  All other pieces of a busy source are spread
over slots and handed on.

The state of a source is the time of its last record and the pieces of it that are still open.  A later
time, an end marker or an idle timer closes it.  Spark keeps, versions and recovers that state with the
checkpoint of the query; a batch that is repeated gives the same rows.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Tasks over which the whole records of a source are spread.
SLOTS = 16
#: The state store that user-defined state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = datetime(1970, 1, 1)
#: Characters of open lines that are kept beside the time of their record.
HELD = 1 << 14
ENTRY = "file string, ts timestamp_ntz, piece int, n_lines int, body string"
_PLACE = ("arrived", "path", "block_start", "seq")
_PIECE = ("file string, slot int, arrived bigint, path string, block_start bigint, seq bigint, number bigint, "
          "us bigint, stamped boolean, n_lines int, body string, ends boolean")


def read_log_stream(spark: SparkSession, path: str, source: Column | None = None,
                    **options: str) -> DataFrame:
    """New files of a folder as raw lines; ``source`` names the log a file belongs to (e.g.
    taken from ``path`` for rolled files), by default each file is its own source."""
    lines = spark.readStream.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("arrived"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("value").alias("raw"),
        F.to_date(F.col("_metadata.file_modification_time")).alias("file_date"),
    )
    return lines.withColumn("file", F.col("path") if source is None else source)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall clock, whatever the session time zone."""
    since = ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("bigint")


def wall_clock(us: Column) -> Column:
    """The wall clock so many microseconds after 1970, the reverse of :func:`micros`."""
    seconds = us.cast("decimal(25,6)") / F.lit(1_000_000).cast("decimal(7,0)")
    interval = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + interval


def pieces(lines: DataFrame) -> DataFrame:
    """Lines of a stream or table put together as far as each task sees them.

    ``lines`` has file, ts and body, and what orders the lines of a source: ``arrived``, ``path``,
    ``block_start`` and ``seq``, as far as there are such columns; the order in which a task reads
    them comes last.  ``ends`` (optional) marks a row that closes the open record of its source.
    """
    have = set(lines.columns)

    def given(name: str, value: Column) -> Column:
        return (value if name in have else F.lit(None)).alias(name)

    # A missing place is 0 or empty, a missing seq the position in the task.
    source = lines.select(
        F.col("file").cast("string").alias("file"), given("arrived", F.unix_micros(F.col("arrived").cast("timestamp"))),
        given("path", F.col("path")).cast("string").alias("path"), given("block_start", F.col("block_start")).cast(
            "bigint").alias("block_start"), given("seq", F.col("seq")).cast("bigint").alias("seq"),
        micros(F.col("ts")).alias("us"), F.col("body").alias("body"),
        F.coalesce(given("ends", F.col("ends")).cast("boolean"), F.lit(False)).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str | None, _Run] = {}
        position = 0
        for batch in batches:
            done: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for file, arrived, path, block, seq, us, body, ends in zip(*columns, strict=True):
                position += 1
                place = (arrived or 0, path or "", block or 0, position if seq is None else seq)
                here = runs.get(file)
                if here is None or place < here.place:
                    if here is not None:
                        done += here.finish()
                    here = runs[file] = _Run(file)
                done += here.add(place, us, body, ends)
            if done:
                yield _batch(done)
        done = [piece for run in runs.values() for piece in run.finish()]
        if done:
            yield _batch(done)

    return source.mapInArrow(run, _PIECE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    names, types = zip(*(column.split() for column in _PIECE.split(", ")), strict=True)
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


class _Run:
    """Consecutive lines of one source in one task."""

    def __init__(self, file: str | None):
        self.file, self.number, self.stamps = file, -1, 0
        self.start = self.place = (0, "", 0, 0)
        self.us, self.stamped, self.ends, self.lines = None, False, False, []

    def add(self, place: tuple, us: int | None, body: str | None, ends: bool) -> list[tuple]:
        done = []
        self.place = place
        if ends or self.ends or self.number < 0 or (us is not None and (not self.stamped or us != self.us)):
            done = self._piece(last=False)
            self.number += 1
            self.start, self.us, self.stamped, self.ends = place, us, us is not None, ends
            self.stamps += self.stamped
        if not ends:
            self.lines.append(body or "")
        return done

    def _piece(self, last: bool) -> list[tuple]:
        if self.number < 0:
            return []
        # Whole: behind the first time of the run, and not its last piece.
        whole = self.stamped and self.stamps > 1 and not last
        slot = 1 + self.number % SLOTS if whole else 0
        row = (self.file, slot, *self.start, self.number, self.us, self.stamped, len(self.lines),
               "\n".join(self.lines), self.ends)
        self.lines = []
        return [row]

    def finish(self) -> list[tuple]:
        return self._piece(last=True)


def _entry(file: str | None, us: int | None, piece: int, found: list) -> Row:
    ts = None if us is None else EPOCH + timedelta(microseconds=us)
    return Row(file=file, ts=ts, piece=piece, n_lines=sum(p.n_lines for p in found),
               body="\n".join(p.body for p in found))


class RecordProcessor(StatefulProcessor):
    """Closes records; ``idle`` in milliseconds writes an open record that gets no more lines.

    Each call to the state is a message to the JVM, and most sources have few lines in a batch.  So the
    state of a source is read and written once a batch: its last record with the lines that are still
    open.  Only lines of more than ``HELD`` characters go to a list, which is not written anew when more come.
    """

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Of the last record: its time, how many pieces of it an idle timer has written, when the timer
        # runs, whether the list has open lines, and the open lines after those.
        self.record = handle.getValueState(
            "record", "us bigint, written int, timer bigint, listed boolean, n_lines int, body string")
        self.open = handle.getListState("open", "n_lines int, body string")

    def close(self) -> None:
        pass

    def _write(self, file: str | None, last: _Last) -> Iterator[Row]:
        found = [Row(n_lines=n, body=body) for n, body in self.open.get()] if last.listed else []
        found += [Row(n_lines=n, body=body) for n, body in last.lines]
        if found:
            yield _entry(file, last.us, last.written, found)
            last.written += 1
        if last.listed:
            self.open.clear()
        last.listed, last.lines = False, []

    def _keep(self, last: _Last) -> None:
        n_lines, body = sum(n for n, _ in last.lines), "\n".join(body for _, body in last.lines)
        if len(body) > HELD:
            self.open.appendValue((n_lines, body))
            last.listed, n_lines, body = True, 0, ""
        self.record.update((last.us, last.written, last.timer, last.listed, n_lines, body))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[1]:
            for row in rows:
                yield _entry(key[0], row.us, 0, [row])
            return
        # Edges: a few for each split.
        edges = sorted(rows, key=lambda r: (r.arrived, r.path, r.block_start, r.seq, r.number))
        before = self.record.get()
        last = _Last() if before is None else _Last.of(before)
        number, known = None, before is not None
        for row in edges:
            follows = row.number == 0 or row.number - 1 == number
            number = row.number
            if row.ends:
                yield from self._write(key[0], last)
                known = False
                continue
            again = known and last.us == row.us and follows
            if not known or (row.stamped and not again):
                yield from self._write(key[0], last)
                last.us, last.written, known = row.us, 0, True
            last.lines.append((row.n_lines, row.body))
        if self.idle is not None:
            if last.timer is not None:
                self.handle.deleteTimer(last.timer)
                last.timer = None
            if last.listed or last.lines:
                last.timer = timerValues.getCurrentProcessingTimeInMs() + self.idle
                self.handle.registerTimer(last.timer)
        if known:
            self._keep(last)
        elif before is not None:
            self.record.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = _Last.of(self.record.get())
        last.timer = None
        yield from self._write(key[0], last)
        self._keep(last)


@dataclass
class _Last:
    """The last record of a source; ``lines`` are open pieces (n_lines, body), ``listed`` tells of earlier ones."""

    us: int | None = None
    written: int = 0
    timer: int | None = None
    listed: bool = False
    lines: list[tuple[int, str]] = field(default_factory=list)

    @classmethod
    def of(cls, state: tuple) -> _Last:
        us, written, timer, listed, n_lines, body = state
        return cls(us, written, timer, listed, [(n_lines, body)] if n_lines else [])


def assemble_stream(lines: DataFrame, idle: timedelta | None = None) -> DataFrame:
    """Records ``(file, ts, piece, n_lines, body)`` of a stream of parsed lines, see :func:`pieces`.

    Lines without a time join the record before them, in whatever batch it came; neighbouring records of
    equal times are one.  ``ts`` is NULL for what stands before the first time of a source.  The last
    record of a source stays open until a later time, an end marker, or ``idle`` after its last line
    when a batch runs; what arrives for a record already written is its next ``piece``.  A record is
    one row, so it must fit in one task.
    """
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    wait = None if idle is None else int(idle / timedelta(milliseconds=1))
    mode = "none" if idle is None else "processingTime"
    return pieces(lines).groupBy("file", "slot").transformWithState(RecordProcessor(wait), ENTRY, "append", mode)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, partition: str | None = None,
               timers: bool = False) -> DataFrame:
    """Process what is there, add the rows to the folder ``path``, and read it.

    With ``timers`` the run ends with the first batch that had no input, since timers always ask for
    another batch; what they have written by then is in the folder.  The first batch of a run does not
    count: it may be one that the end of the run before broke off, which knows nothing of newer files.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    if partition is not None:
        writer = writer.partitionBy(partition)
    writer = writer.option("checkpointLocation", checkpoint)
    if not timers:
        writer.trigger(availableNow=True).start().awaitTermination()
    else:
        query = writer.trigger(processingTime="0 seconds").start()
        while query.isActive and all(p["numInputRows"] for p in query.recentProgress[1:]):
            time.sleep(0.05)
        problem = query.exception()
        query.stop()
        if problem is not None:
            raise problem
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
