"""Made-up logs of any size for load tests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.operators.order import LineOrder, running_sum, with_segments

# A made-up warehouse: every machine may report every state of every level.
MACHINES = ("conveyor", "picking arm", "label printer", "gate sensor", "pallet lift", "cold room door")
STATES = {
    "DEBUG": ("passed its self-test", "sent its position"),
    "INFO": ("started", "finished its round", "was handed over to the night shift"),
    "WARN": ("runs slower than planned", "has little battery left"),
    "ERROR": ("stopped", "does not answer"),
}
MESSAGES = [(level, f"{machine} {state}")
            for level, states in STATES.items() for state in states for machine in MACHINES]

# Fixed value: the clock advances by 0 to 10 seconds per line.
MAX_STEP_SECONDS = 10

# Time, level and the blanks between them in front of a message.
FIXED_WIDTH = len("2025-01-01 00:00:00 DEBUG  ")


def lines_for_megabytes(megabytes: int) -> int:
    """Line count that gives about this size."""
    mean = sum(len(m) for _, m in MESSAGES) // len(MESSAGES)
    return megabytes * 1024 * 1024 // (FIXED_WIDTH + mean)


def _draw(key: Column, seed: int, choices: int) -> Column:
    # A hash of the line number: the same line is drawn again wherever it is recomputed.
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(choices)).cast("int")


def log_lines(keys: DataFrame, start: datetime = datetime(2025, 1, 1), seed: int = 0) -> DataFrame:
    """One generated line per ``(file, seq)``: ``file, block_start, seq, ts, raw``."""
    order = LineOrder()
    numbered = with_segments(keys).withColumn(
        "_step", _draw(F.concat_ws("/", "file", "seq"), seed, MAX_STEP_SECONDS + 1)
    )
    clocked = running_sum(numbered, "_step", "_elapsed", order)
    ts = F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.col("_elapsed").cast("decimal(18,6)")
    )
    pool = F.array(*[F.lit(f"{level:<6} {message}") for level, message in MESSAGES])
    pick = _draw(F.concat_ws("/", "file", "seq"), seed + 1, len(MESSAGES))
    text = F.concat(
        F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.get(pool, pick)
    )
    return clocked.withColumn("ts", ts).select("file", "block_start", "seq", "ts",
                                               text.alias("raw"))


def synthetic_log(spark: SparkSession, name: str, lines: int,
                  start: datetime = datetime(2025, 1, 1), seed: int = 0) -> DataFrame:
    keys = spark.range(lines).select(F.lit(name).alias("file"), F.col("id").alias("seq"))
    return log_lines(keys, start, seed)


def write_synthetic_log(spark: SparkSession, path: str, megabytes: int = 50,
                        start: datetime = datetime(2025, 1, 1), seed: int = 0) -> int:
    """Write a log of about this size as a folder of text files; the part files are in time
    order.  Returns the number of lines."""
    count = lines_for_megabytes(megabytes)
    log = synthetic_log(spark, path, count, start, seed)
    ordered = log.repartitionByRange("seq").sortWithinPartitions("seq")
    ordered.select("raw").write.text(path)
    return count
