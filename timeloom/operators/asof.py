"""As-of lookup: the nearest row at or before (at or after) a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.operators.order import clock_prefix, with_clock


def nearest_times(probes: DataFrame, rows: DataFrame, direction: str = "backward",
                  ts: str = "ts") -> DataFrame:
    """``(ts, match_ts)`` for every distinct probe time.

    Only timestamps move.  Inside one second a running max (min) answers; where a second has
    no answer, the last one of an earlier (later) second does, carried per day and then over
    days.  So no task sees more than the distinct times of one second.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    back = direction == "backward"
    best = F.max if back else F.min
    times = rows.select(F.col(ts).alias("ts")).where(F.col("ts").isNotNull()).distinct()
    asked = probes.select(F.col(ts).alias("ts")).where(F.col("ts").isNotNull()).distinct()
    both = with_clock(
        times.withColumn("_hit", F.col("ts")).unionByName(
            asked.withColumn("_hit", F.lit(None).cast("timestamp_ntz"))
        )
    )
    per_second = both.groupBy("_day", "_second").agg(best("_hit").alias("_best"))
    carried = clock_prefix(
        per_second,
        fold=lambda w: best("_best").over(w),
        reduce_day=best("_best"),
        merge=(lambda a, b: F.coalesce(b, a)),
        value="_best", out="_carry", descending=not back,
    )
    order = F.col("ts").asc() if back else F.col("ts").desc()
    inside = Window.partitionBy("_day", "_second").orderBy(order).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        both.withColumn("_here", best("_hit").over(inside))
        .where(F.col("_hit").isNull())
        .join(carried, ["_day", "_second"])
        .select("ts", F.coalesce("_here", "_carry").alias("match_ts"))
    )


def asof_join(probes: DataFrame, rows: DataFrame, direction: str = "backward",
              ts: str = "ts", prefix: str = "match_", clamp: bool = False) -> DataFrame:
    """Each probe with the row nearest in time; NULL where there is none.

    ``rows`` should have one row per time (a merged table); with several, all are returned.
    ``clamp`` answers probes outside the span with the first (last) row instead of NULL.
    """
    found = nearest_times(probes, rows, direction, ts).withColumnRenamed("ts", "_probe_ts")
    if clamp:
        edge = F.min(ts) if direction == "backward" else F.max(ts)
        found = found.withColumn(
            "match_ts", F.coalesce("match_ts", rows.agg(edge.alias("e")).scalar())
        )
    found = found.withColumnRenamed("match_ts", "_match_ts")
    renamed = rows.withColumnsRenamed({c: f"{prefix}{c}" for c in rows.columns})
    return (
        probes.join(found, F.col(ts) == F.col("_probe_ts"), "left")
        .join(renamed, F.col("_match_ts") == F.col(f"{prefix}{ts}"), "left")
        .drop("_probe_ts", "_match_ts")
    )
