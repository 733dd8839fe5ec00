"""From raw lines to records: detect, split, fill, collapse."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.formats import FormatRegistry
from timeloom.functions.text import after_prefix, indent_continuation, rtrim_ws, strip_sgr
from timeloom.operators.clip import TimeRange
from timeloom.operators.order import (
    DEFAULT_ORDER,
    LATEST,
    LineOrder,
    fill_columns,
    fill_steps,
    join_segments,
    segment_prefix,
    with_segments,
)
from timeloom.plans.session import collect_small, lookup, small_side

def detect_formats(lines: DataFrame, registry: FormatRegistry | None = None,
                   scan: str = "first_line") -> DataFrame:
    """``(file, fmt)``: the format of each source, NULL when none fits.

    ``first_line`` looks at the first line only; ``first_match`` takes the first line that has
    any known timestamp.  Both hold for the whole source, however its blocks are cut.
    """
    registry = registry or FormatRegistry()
    names = F.array(*[F.lit(n) for n in registry.names()])
    # The formats are tried only where a line becomes the smallest so far: once or twice per
    # block and task.  A number as the result keeps the aggregate free of sorting.
    which = registry.detect_index(F.col("raw"))
    if scan == "first_match":
        place = F.when(which.isNotNull(), F.col("seq"))
    elif scan == "first_line":
        place = F.col("seq")
    else:
        raise ValueError(f"unknown scan {scan!r}")
    first = _first_of(lines, "file", which, place)
    return first.select("file", F.get(names, F.col("_first")).alias("fmt"))


def _first_of(lines: DataFrame, source: str, value: Column, place: Column) -> DataFrame:
    """``(source, _first)``: ``value`` at the smallest ``place`` of the first block that has one.

    First per block, then over the blocks: both are map-side combined numbers.
    """
    if "block_start" not in lines.columns:
        lines = lines.withColumn("block_start", F.lit(0).cast("bigint"))
    per_block = lines.groupBy(source, "block_start").agg(
        F.min_by(value, place).alias("_first"), F.min(place).alias("_at")
    )
    block = F.when(F.col("_at").isNotNull(), F.col("block_start"))
    return per_block.groupBy(source).agg(F.min_by("_first", block).alias("_first"))


def first_lines(lines: DataFrame, source: str = "file") -> DataFrame:
    """``(source, raw)``: the first raw line of each source.

    First its hash is found -- numbers only, so no sorting -- then the line with that hash.
    """
    marked = lines.withColumn("_hash", F.xxhash64("raw"))
    wanted = _first_of(marked, source, F.col("_hash"), F.col("seq"))
    wanted = wanted.withColumnRenamed("_first", "_hash")
    same = marked.join(small_side(wanted)[0], [source, "_hash"])
    place = [F.col(c) for c in ("block_start", "seq") if c in lines.columns]
    return same.groupBy(source).agg(F.min_by("raw", F.struct(*place)).alias("raw"))


def _by_format(names: Sequence[str | None], build) -> Column:
    """One branch per used format; a single format needs no CASE at all."""
    used = [n for n in names if n is not None]
    if not used:
        return F.lit(None)
    if len(names) == 1:
        return build(used[0])
    chain = None
    for name in used:
        hit = F.col("fmt") == name
        chain = F.when(hit, build(name)) if chain is None else chain.when(hit, build(name))
    return chain


def parse_timestamps(lines: DataFrame, fmt: str | Mapping[str, str | None] | DataFrame,
                     registry: FormatRegistry | None = None,
                     reference_date: Column | str | None = None,
                     strict: bool = False, used: Sequence[str] | None = None,
                     keep_instant: bool = False) -> DataFrame:
    """Split ``raw`` into ``ts`` and ``body``; adds ``parse_error``.

    ``fmt`` is one format name for all lines, or ``(file, fmt)`` as a table or mapping.
    Lines without a timestamp get a NULL ``ts`` and one leading space.  ``reference_date``
    completes partial timestamps (default: the ``file_date`` column if there is one, else
    today).  ``used`` names the formats that can occur, to keep the expression short.
    ``keep_instant`` adds ``instant`` for zoned and epoch formats: where clocks are set back,
    two instants share a wall clock.
    """
    registry = registry or FormatRegistry()
    spark = lines.sparkSession
    if reference_date is None:
        has_date = "file_date" in lines.columns
        reference_date = F.col("file_date") if has_date else F.current_date()
    elif isinstance(reference_date, str):
        reference_date = F.lit(reference_date).cast("date")

    if isinstance(fmt, str):
        names: Sequence[str | None] = [fmt]
        tagged = lines
    else:
        if isinstance(fmt, Mapping):
            used = used or sorted({n for n in fmt.values() if n})
            fmt = lookup(spark, list(fmt.items()), "file string, fmt string")
        names = [*(used if used is not None else registry.names()), None]
        tagged = lines.join(fmt, "file", "left")

    prefix = _by_format(names, lambda n: registry[n].prefix(F.col("_line"), strict))
    # Each step is a column of its own, so that a regex runs once per line.
    split = tagged.withColumn("_line", rtrim_ws(F.col("raw"))).withColumn(
        "_prefix", F.coalesce(prefix.cast("string"), F.lit(""))
    )
    stamp = _by_format(names, lambda n: registry[n].stamp_text(F.col("_prefix"), strict))
    split = split.withColumn("_stamp", stamp.cast("string"))
    ts = _by_format(names, lambda n: registry[n].wall_clock(F.col("_stamp"), reference_date))
    found = F.col("_prefix") != ""
    split = split.withColumn("ts", F.when(found, ts.cast("timestamp_ntz")))
    if keep_instant:
        instant = _by_format(names, lambda n: registry[n].instant(F.col("_stamp"), reference_date))
        split = split.withColumn("instant", F.when(found, instant.cast("timestamp")))

    lead = _by_format(names, lambda n: registry[n].lead(F.col("_prefix"), strict))
    rest = after_prefix(F.col("_line"), F.col("_prefix"))
    kept = F.concat(F.coalesce(lead.cast("string"), F.lit("")), rest)
    stamped = F.col("ts").isNotNull()
    body = F.when(stamped, kept).otherwise(indent_continuation(F.col("_line")))
    dropped = ["raw", "_line", "_prefix", "_stamp"]
    return (
        split.withColumn("body", body)
        .withColumn("body", strip_sgr(F.col("body")))
        .withColumn("body", rtrim_ws(F.col("body")))
        .withColumn("parse_error", found & ~stamped)
        .drop(*dropped, *([] if isinstance(fmt, str) else ["fmt"]))
    )


def _crowded_sources(lines: DataFrame, order: LineOrder, limit: int,
                     key: Callable[[Column], Column], inherits: bool) -> DataFrame:
    """``(file)``: sources that may have a cell beyond the limit.

    A cell lies in segments whose time span holds its time, so it is no larger than those
    segments together.  Per segment only span and size are needed; a sweep over the spans of
    a source finds the largest sum.  In a log that is roughly in time order that is the size
    of a few segments, and nothing more needs to be looked at.
    """
    spans = lines.groupBy(*order.keys).agg(
        F.min("ts").alias("_lo"), F.max("ts").alias("_hi"), F.sum("_bytes").alias("_size")
    )
    if inherits:
        # The first lines of a segment may belong to a record of the last segment before it
        # that has any time; so its span counts for this one too.
        earlier = Window.partitionBy(order.file).orderBy(*order.segments).rowsBetween(
            Window.unboundedPreceding, -1
        )
        spans = spans.withColumns({
            f"{edge}_before": F.last(edge, ignorenulls=True).over(earlier)
            for edge in ("_lo", "_hi")
        }).withColumns({
            # NULL is the time of what precedes all timestamps, and sorts first.
            "_lo": F.when(F.col("_lo_before").isNotNull(), F.least("_lo", "_lo_before")),
            "_hi": F.greatest("_hi", "_hi_before"),
        })

    def edge(at: str, kind: int, change: Column) -> Column:
        return F.struct(key(F.col(at)).alias("_at"), F.lit(kind).alias("_kind"),
                        change.alias("_change"))

    edges = spans.select(
        order.file,
        F.inline(F.array(edge("_lo", 0, F.col("_size")), edge("_hi", 1, -F.col("_size")))),
    )
    sweep = Window.partitionBy(order.file).orderBy(F.col("_at").asc_nulls_first(), "_kind")
    so_far = F.sum("_change").over(sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        edges.withColumn("_sum", so_far).groupBy(order.file)
        .agg(F.max("_sum").alias("_sum")).where(F.col("_sum") > limit).select(order.file)
    )


def _long_cells(filled: DataFrame, order: LineOrder, limit: int) -> DataFrame:
    """Per segment, the over-long cells it takes part in: ``(cell_ts, part)`` pairs.

    Works on byte counts only.  They are summed inside the segments, then one narrow row per
    segment and cell is compared per cell.
    """
    cell = Window.partitionBy(order.file, "rec_ts").orderBy(*order.segments)
    sizes = filled.groupBy(*order.keys, "rec_ts").agg(F.sum("_bytes").alias("_bytes"))
    measured = sizes.withColumn(
        "_before", F.sum("_bytes").over(cell.rowsBetween(Window.unboundedPreceding, -1))
    ).withColumn(
        "_total",
        F.sum("_bytes").over(
            cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ),
    )
    part = F.floor(F.coalesce("_before", F.lit(0)) / limit).cast("int")
    return (
        measured.where(F.col("_total") > limit)
        .groupBy(*order.keys)
        .agg(F.collect_list(F.struct(F.col("rec_ts").alias("cell_ts"), part.alias("part")))
             .alias("_long"))
    )


def segments_within(lines: DataFrame, within: TimeRange, order: LineOrder = DEFAULT_ORDER,
                    key: Callable[[Column], Column] | None = None) -> DataFrame:
    """The keys of the segments that may hold a line of a record in the range.

    An index of the filled times, made from times and numbers only: the span of the times in a
    segment, and, where its first line has none, the time handed on by the segments before it.
    """
    key = key or (lambda ts: ts)
    timed = F.when(F.col("ts").isNotNull(), order.place())
    index = segment_prefix(
        lines, order,
        {"_end": F.max_by("ts", timed), "_lo": F.min("ts"), "_hi": F.max("ts"),
         "_head": F.min_by(F.col("ts").isNull(), order.place())},
        {"_carry": ("_end", LATEST)}, keep=("_lo", "_hi", "_head"),
    )
    own = F.col("_hi").isNotNull() & within.meets(key(F.col("_lo")), key(F.col("_hi")))
    handed_on = F.col("_head") & within.holds(key(F.col("_carry")))
    return index.where(
        F.coalesce(own, F.lit(False)) | F.coalesce(handed_on, F.lit(False))
    ).select(*order.keys)


def fill_records(lines: DataFrame, ignore_untimestamped: bool = False,
                 order: LineOrder = DEFAULT_ORDER, limit: int | None = None,
                 key: Callable[[Column], Column] | None = None,
                 within: TimeRange | None = None) -> DataFrame:
    """Lines with ``rec_ts``, the time of the record they belong to.

    A cell of a source and a time is one cell, however large.  Only a caller who sets ``limit``
    (bytes) has cells beyond it cut: then there is also ``part``, the running number of a cell's
    piece.  Pieces are whole segments in line order, so the parts of a cell put together give
    the cell.  Whether any source can have such cells is checked first, by a small job over
    times and sizes.  ``key`` must not decrease with time.  Cells too large for one task can be
    taken line by line, see :func:`cell_lines`.

    ``within`` keeps the lines of records in a range of times.  Segments that cannot hold any are
    found first, by a small job over times, and their text is never shuffled.
    """
    if order == DEFAULT_ORDER and "segment" not in lines.columns:
        lines = with_segments(lines)
    key = key or (lambda ts: ts)
    lines = lines.withColumn("_bytes", F.octet_length("body") + 1)
    if ignore_untimestamped:
        lines = lines.where(F.col("ts").isNotNull())
    clipped = within is not None and not within.is_open

    def steps(some: DataFrame) -> tuple[DataFrame, DataFrame | None, Column]:
        if ignore_untimestamped:
            return some, None, key(F.col("ts"))
        inside, inherited, (rec_ts,) = fill_steps(some, ["ts"], order)
        return inside, inherited, key(rec_ts)

    inside, per_segment, rec_ts = steps(lines)
    part = None
    if limit is not None:
        crowded = _crowded_sources(lines, order, limit, key, not ignore_untimestamped)
        names = collect_small(crowded)
        if names is None or names:
            crowded = lookup(lines.sparkSession, names, crowded.schema) if names else crowded
            some, inherited, some_ts = steps(lines.join(crowded, order.file, "left_semi"))
            if inherited is not None:
                some = join_segments(some, inherited, order)
            long_cells = _long_cells(some.withColumn("rec_ts", some_ts), order, limit)
            per_segment = long_cells if per_segment is None else per_segment.join(
                long_cells, order.keys, "left"
            )
            mine = F.filter("_long", lambda c: c["cell_ts"].eqNullSafe(F.col("rec_ts")))
            part = F.coalesce(F.get(mine, F.lit(0))["part"], F.lit(0))
    if clipped and not ignore_untimestamped:
        # What segments hand on comes from all lines; only the text is read from the kept ones.
        kept, _ = small_side(segments_within(lines, within, order, key))
        inside, _, _ = steps(lines.join(kept, order.keys, "left_semi"))
    joined = inside if per_segment is None else join_segments(inside, per_segment, order)
    joined = joined.withColumn("rec_ts", rec_ts)
    if part is not None:
        joined = joined.withColumn("part", part)
    if clipped:
        joined = joined.where(within.holds(F.col("rec_ts")))
    return joined.drop(*fill_columns(), "_long", "_bytes")


def collapse_filled(filled: DataFrame, order: LineOrder = DEFAULT_ORDER,
                    together: bool = True) -> DataFrame:
    """One row per source, time and part from lines with ``rec_ts``.

    Gathers the lines of multi-line records and of repeated timestamps in line order.
    ``together`` places the rows by ``(ts, part)``, which serves the merge over sources that
    follows without another shuffle; otherwise each source goes its own way.
    """
    # Own names: the position may use the line's own time.
    position = {f"_p{i}": c for i, c in enumerate(order.position)}
    lines = F.sort_array(F.collect_list(F.struct(*position, "body")))
    # A constant must not become a partitioning key: no grouping would match it.
    cell = ["ts", "part"] if "part" in filled.columns else ["ts"]
    chosen = filled.select(
        F.col(order.file).alias("file"), F.col("rec_ts").alias("ts"), *cell[1:], "body",
        *[F.col(c).alias(p) for p, c in position.items()],
    )
    if together:
        chosen = chosen.repartition(*cell)
    return (
        chosen.groupBy(*cell, "file")
        .agg(lines.alias("_lines"))
        .select(
            "file", "ts", (F.col("part") if len(cell) > 1 else F.lit(0)).alias("part"),
            F.struct(*[F.col("_lines")[0][p].alias(c) for p, c in position.items()])
            .alias("first_line"),
            F.size("_lines").alias("n_lines"),
            F.array_join(F.col("_lines.body"), "\n").alias("body"),
        )
    )


def cell_lines(filled: DataFrame, order: LineOrder = DEFAULT_ORDER) -> DataFrame:
    """The cells of :func:`collapse_filled` line by line: ``(file, ts, line_in_cell, body)``.

    Nothing is gathered, so a cell may hold most of all lines.  A line's number in its cell is
    its rank inside the segment plus what earlier segments of the source have of that cell; only
    one narrow row per segment and cell meets for that.
    """
    lines = filled.withColumn("_cell", F.coalesce(F.col("rec_ts").cast("string"), F.lit("")))
    keys = [*order.keys, "_cell"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order.by))
    earlier = Window.partitionBy(order.file, "_cell").orderBy(*order.segments).rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = lines.groupBy(*keys).agg(F.count("*").alias("_n")).select(
        *keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return lines.withColumn("_rank", rank).join(before, keys).select(
        F.col(order.file).alias("file"), F.col("rec_ts").alias("ts"),
        (F.col("_before") + F.col("_rank")).alias("line_in_cell"), "body",
    )


def collapse_records(lines: DataFrame, ignore_untimestamped: bool = False,
                     order: LineOrder = DEFAULT_ORDER,
                     limit: int | None = None,
                     key: Callable[[Column], Column] | None = None) -> DataFrame:
    """Entries ``(file, ts, part, first_line, n_lines, body)`` from parsed lines.

    Lines without a timestamp join the record before them, or are dropped when
    ``ignore_untimestamped``.  Records of one source with equal timestamps become one entry.
    ``ts`` is NULL for what stands before the first timestamp of a source.  ``key`` merges on
    a coarser time, e.g. ``lambda ts: floor_ts(ts, 'second')``.
    """
    return collapse_filled(fill_records(lines, ignore_untimestamped, order, limit, key), order)
