"""Line order, and running values over it without one task per source.

A source may hold most of all lines, so no window is ever partitioned by source alone.
Lines are cut into segments of bounded size.  A running value is computed inside each
segment; what a segment hands on is one row, and only those rows meet per source.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# 2**15 lines per segment: a few MB of log text, and some ten million segments in a source
# of tens of TB.
SEGMENT_BITS = 15
# 2**12 segments of a block are folded together before blocks meet: what meets per source is one
# row per block of a file, or per 2**27 lines of a block that cannot be split.
GROUP_BITS = 12


@dataclass(frozen=True)
class LineOrder:
    """Where a line stands: its source, its segment, and its place in the segment.

    Segments order the blocks of a source, ``by`` orders lines inside a segment.  The last of
    ``segments`` is a whole number; ``2**group_bits`` of them are folded as one.
    """

    file: str = "file"
    segments: tuple[str, ...] = ("block_start", "segment")
    by: tuple[str, ...] = ("seq",)
    group_bits: int = GROUP_BITS

    @property
    def keys(self) -> list[str]:
        return [self.file, *self.segments]

    @property
    def position(self) -> list[str]:
        """What orders the lines of a source; ``segment`` only repeats the high bits of ``seq``."""
        return [*(s for s in self.segments if s != "segment"), *self.by]

    def inside(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.by)

    def up_to_here(self) -> WindowSpec:
        return self.inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def before_here(self) -> WindowSpec:
        return self.inside().rowsBetween(Window.unboundedPreceding, -1)

    def place(self) -> Column:
        return F.col(self.by[0]) if len(self.by) == 1 else F.struct(*self.by)


DEFAULT_ORDER = LineOrder()


def with_segments(lines: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """Add ``segment`` from ``seq``: at most ``2**bits`` consecutive line numbers each."""
    if "block_start" not in lines.columns:
        lines = lines.withColumn("block_start", F.lit(0).cast("bigint"))
    return lines.withColumn("segment", F.shiftright(F.col("seq").cast("bigint"), bits))


@dataclass(frozen=True)
class Fold:
    """How what segments hand on adds up: over the rows of a window, and of two spans in order."""

    over: Callable[[Column, WindowSpec], Column]
    both: Callable[[Column, Column], Column]


def _plus(early: Column, late: Column) -> Column:
    return F.coalesce(early + late, early, late)


LATEST = Fold(lambda c, w: F.last(c, ignorenulls=True).over(w), lambda a, b: F.coalesce(b, a))
TOTAL = Fold(lambda c, w: F.sum(c).over(w), _plus)
HIGHEST = Fold(lambda c, w: F.max(c).over(w), lambda a, b: F.greatest(a, b))


def carry_segments(reduced: DataFrame, order: LineOrder,
                   carries: dict[str, tuple[str, Fold]]) -> DataFrame:
    """Add to a table of segments what the earlier segments of their source hand on.

    ``carries`` maps a new column to the folded one; it is NULL where nothing comes before.  A
    tree of prefixes: segments meet per group of segments, groups meet per source, and what a
    group inherits goes back to its segments.  So no task holds all segments of a source.
    """
    *outer, last = order.segments
    group = [order.file, *outer, "_group"]
    start, here = Window.unboundedPreceding, Window.currentRow
    inside = Window.partitionBy(*group).orderBy(last)
    folded = reduced.withColumn("_group", F.shiftright(F.col(last), order.group_bits)).select(
        "*",
        *[f.over(F.col(c), inside.rowsBetween(start, -1)).alias(out)
          for out, (c, f) in carries.items()],
        *[f.over(F.col(c), inside.rowsBetween(start, here)).alias(f"_with{i}")
          for i, (c, f) in enumerate(carries.values())],
    )
    totals = folded.groupBy(*group).agg(
        *[F.max_by(f"_with{i}", last).alias(f"_all{i}") for i in range(len(carries))]
    )
    earlier = Window.partitionBy(order.file).orderBy(*group[1:]).rowsBetween(start, -1)
    before = totals.select(*group, *[
        f.over(F.col(f"_all{i}"), earlier).alias(f"_early{i}")
        for i, (_, f) in enumerate(carries.values())
    ])
    return folded.join(before, group).select(*reduced.columns, *[
        f.both(F.col(f"_early{i}"), F.col(out)).alias(out)
        for i, (out, (_, f)) in enumerate(carries.items())
    ])


def segment_prefix(lines: DataFrame, order: LineOrder, summaries: dict[str, Column],
                   carries: dict[str, tuple[str, Fold]], keep: Sequence[str] = ()) -> DataFrame:
    """One row per segment with what the earlier segments of its source hand on.

    ``summaries`` reduce a segment (map-side combined); ``carries`` fold the summaries of all
    earlier segments, see :func:`carry_segments`.  ``keep`` names summaries to be returned too.
    """
    reduced = lines.groupBy(*order.keys).agg(*[c.alias(n) for n, c in summaries.items()])
    return carry_segments(reduced, order, carries).select(*order.keys, *keep, *carries)


def join_segments(lines: DataFrame, per_segment: DataFrame, order: LineOrder) -> DataFrame:
    """Bring a per-segment table to the lines.

    Same keys as the windows over segments, so the lines are shuffled and sorted once for both.
    """
    return lines.join(per_segment, order.keys, "left")


def fill_steps(lines: DataFrame, values: Sequence[str], order: LineOrder
               ) -> tuple[DataFrame, DataFrame, list[Column]]:
    """The pieces of a forward fill: lines filled inside their segment, the table of what each
    segment inherits, and the filled values once both are joined (then drop ``fill_columns``)."""
    summaries, carries, filled = {}, {}, []
    inside = lines
    for i, value in enumerate(values):
        present = F.when(F.col(value).isNotNull(), order.place())
        summaries[f"_end{i}"] = F.max_by(F.col(value), present)
        carries[f"_carry{i}"] = (f"_end{i}", LATEST)
        inside = inside.withColumn(
            f"_here{i}", F.last(value, ignorenulls=True).over(order.up_to_here())
        )
        filled.append(F.coalesce(f"_here{i}", f"_carry{i}"))
    return inside, segment_prefix(lines, order, summaries, carries), filled


def fill_columns(count: int = 1) -> list[str]:
    """Helper columns of :func:`fill_steps`, to be dropped."""
    return [f"{kind}{i}" for i in range(count) for kind in ("_here", "_carry")]


def forward_fill_all(lines: DataFrame, values: dict[str, str],
                     order: LineOrder = DEFAULT_ORDER) -> DataFrame:
    """Forward fill several columns in one pass; ``values`` maps column to result."""
    inside, inherited, filled = fill_steps(lines, list(values), order)
    return join_segments(inside, inherited, order).withColumns(
        dict(zip(values.values(), filled, strict=True))
    ).drop(*fill_columns(len(values)))


def forward_fill(lines: DataFrame, value: str = "ts", out: str = "rec_ts",
                 order: LineOrder = DEFAULT_ORDER) -> DataFrame:
    """Give each line the latest non-null ``value`` at or before it in its source."""
    return forward_fill_all(lines, {value: out}, order)


def running_sum(lines: DataFrame, value: str, out: str,
                order: LineOrder = DEFAULT_ORDER) -> DataFrame:
    """Inclusive running sum of ``value`` in source order."""
    prefix = segment_prefix(
        lines, order,
        {"_total": F.sum(value)},
        {"_carry": ("_total", TOTAL)},
    )
    inner = lines.withColumn("_here", F.sum(value).over(order.up_to_here()))
    return (
        join_segments(inner, prefix, order)
        .withColumn(out, F.coalesce("_here", F.lit(0)) + F.coalesce("_carry", F.lit(0)))
        .drop("_here", "_carry")
    )


def flag_disorder(lines: DataFrame, ts: str = "ts",
                  order: LineOrder = DEFAULT_ORDER) -> DataFrame:
    """Mark lines whose timestamp is below an earlier one of the same source.

    Adds ``is_out_of_order`` and ``lateness_us``, how far behind the latest earlier one.
    """
    prefix = segment_prefix(
        lines, order,
        {"_top": F.max(ts)},
        {"_carry": ("_top", HIGHEST)},
    )
    inner = lines.withColumn("_here", F.max(ts).over(order.before_here()))
    latest = F.greatest("_here", "_carry")
    late = F.coalesce(F.col(ts) < latest, F.lit(False))
    seconds = F.expr(f"cast(cast(_latest - `{ts}` as interval second) as decimal(20,6))")
    return (
        join_segments(inner, prefix, order)
        .withColumn("_latest", latest)
        .withColumn("is_out_of_order", late)
        .withColumn("lateness_us", F.when(late, seconds * 1_000_000).cast("bigint"))
        .drop("_here", "_carry", "_latest")
    )


def number_runs(lines: DataFrame, value: str = "rec_ts", out: str = "run_id",
                order: LineOrder = DEFAULT_ORDER) -> DataFrame:
    """Number the maximal runs of consecutive lines with equal ``value`` from 1 per source."""
    prefix = segment_prefix(
        lines, order,
        # A struct is there even where its value is NULL.
        {"_end": F.max_by(F.struct(F.col(value).alias("v")), order.place())},
        {"_carry": ("_end", LATEST)},
    )
    inner = lines.withColumn("_here", F.lag(value).over(order.inside())).withColumn(
        "_inner", F.coalesce(F.lag(F.lit(True)).over(order.inside()), F.lit(False))
    )
    before = F.when(F.col("_inner"), F.col("_here")).otherwise(F.col("_carry.v"))
    follows = F.col("_inner") | F.col("_carry").isNotNull()
    starts = F.when(follows & before.eqNullSafe(F.col(value)), 0).otherwise(1)
    marked = join_segments(inner, prefix, order).withColumn("_starts", starts)
    marked = marked.drop("_here", "_inner", "_carry")
    return running_sum(marked, "_starts", out, order).drop("_starts")


def _clock(ts: Column) -> tuple[Column, Column]:
    """Day number and second of day; rows without a timestamp come first."""
    day = F.coalesce(F.datediff(ts, F.lit("1970-01-01").cast("date")), F.lit(-(2**31)))
    second = F.coalesce(F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts), F.lit(0))
    return day, second


def with_clock(df: DataFrame, ts: str = "ts") -> DataFrame:
    day, second = _clock(F.col(ts))
    return df.withColumn("_day", day).withColumn("_second", second)


def clock_prefix(per_second: DataFrame, fold: Callable[[WindowSpec], Column],
                 reduce_day: Column, merge: Callable[[Column, Column], Column],
                 value: str, out: str, descending: bool = False) -> DataFrame:
    """Fold ``value`` over all earlier seconds (later ones when ``descending``).

    ``per_second`` has one row per ``(_day, _second)``.  Seconds meet per day (at most
    86,400 rows) and days meet once (one row per calendar day), so both steps are bounded.
    """
    day_key = F.col("_day").desc() if descending else F.col("_day").asc()
    second_key = F.col("_second").desc() if descending else F.col("_second").asc()
    earlier = (Window.unboundedPreceding, -1)
    days = per_second.groupBy("_day").agg(reduce_day.alias(value))
    days = days.select(
        "_day", fold(Window.orderBy(day_key).rowsBetween(*earlier)).alias("_day_carry")
    )
    seconds = per_second.withColumn(
        "_second_carry",
        fold(Window.partitionBy("_day").orderBy(second_key).rowsBetween(*earlier)),
    )
    return seconds.join(days, "_day", "left").select(
        "_day", "_second", merge(F.col("_day_carry"), F.col("_second_carry")).alias(out)
    )


def number_rows(rows: DataFrame, keys: tuple[str, str] = ("ts", "part"),
                out: str = "line", spread: str | None = None) -> DataFrame:
    """Number timestamps from 1 in time order, without a global window.

    ``keys`` are the timestamp, then the part of an over-long row (part 0 is always there).
    All rows of one timestamp share its number.  Counts per second and per day give each second
    its offset; the rank inside a second has at most a million distinct timestamps.  Only
    the narrow keys are numbered, then joined to the rows.  Rows without a timestamp match
    nothing in that join; ``spread`` names a column that keeps them from meeting in one task.
    """
    ts, part = keys
    narrow = with_clock(rows.select(*keys).distinct(), ts)
    inside = Window.partitionBy("_day", "_second").orderBy(ts, part).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # Counting first parts gives the rank of the timestamp; the counts per second are read
    # off the same shuffled rows.
    ranked = narrow.withColumn("_rank", F.sum((F.col(part) == 0).cast("bigint")).over(inside))
    per_second = ranked.groupBy("_day", "_second").agg(F.max("_rank").alias("_n"))
    offsets = clock_prefix(
        per_second,
        fold=lambda w: F.sum("_n").over(w),
        reduce_day=F.sum("_n"),
        merge=lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        value="_n", out="_offset",
    )
    numbered = (
        ranked.join(offsets, ["_day", "_second"])
        .select(*keys, (F.col("_offset") + F.col("_rank")).cast("bigint").alias(out))
    )
    # Rows without a timestamp are the first merged row: they need no partner here.
    known = numbered.where(F.col(ts).isNotNull())
    on = list(keys)
    if spread is not None:
        lost = F.col(ts).isNull()
        rows = rows.withColumn("_spread", F.when(lost, F.xxhash64(spread)).otherwise(F.lit(0)))
        known = known.withColumn("_spread", F.lit(0).cast("bigint"))
        on.append("_spread")
    return rows.join(known, on, "left").drop("_spread").withColumn(
        out, F.coalesce(out, F.lit(1).cast("bigint"))
    )
