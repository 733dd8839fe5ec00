"""JSON lines: one object per line, shown as ``key: value`` lines behind its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions.formats import FormatRegistry
from timeloom.operators.records import first_lines
from timeloom.plans.session import small_side
from timeloom.sources.files import read_text


def _fields(raw: Column) -> Column:
    """Key/value pairs in document order; of a repeated key the last value counts."""
    pairs = F.map_entries(F.from_json(raw, "map<string,string>"))
    keys = F.transform(pairs, lambda e: e["key"])
    unique = F.transform(
        F.array_distinct(keys),
        lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1),
    )
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), pairs).otherwise(unique)


def time_keys(lines: DataFrame, source: str = "file",
              registry: FormatRegistry | None = None) -> DataFrame:
    """``(source, time_key)``: the first key in a source's first row that holds a time."""
    registry = registry or FormatRegistry()
    first = first_lines(lines, source)
    pairs = first.select(source, F.posexplode(_fields(F.col("raw"))).alias("at", "pair"))
    shown = F.coalesce(F.col("pair.value"), F.lit("None"))
    known = F.when(registry.detect(shown).isNotNull(), F.col("at"))
    return pairs.groupBy(source).agg(F.min_by("pair.key", known).alias("time_key"))


def render_objects(lines: DataFrame, time_key: Column) -> DataFrame:
    """Replace ``raw`` by the time, a space, and the other fields, one per line.

    A row without the time key starts with a space, so it continues the record before it; a
    row that is no JSON object stays as it is and does the same.
    """
    pairs = F.col("_pairs")
    others = F.filter(pairs, lambda e: ~e["key"].eqNullSafe(F.col("_key")))
    shown = F.transform(
        others, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))
    )
    mine = F.filter(pairs, lambda e: e["key"] == F.col("_key"))
    time = F.when(F.size(mine) > 0, F.coalesce(mine[0]["value"], F.lit("None")))
    return (
        lines.withColumn("_pairs", _fields(F.col("raw")))
        .withColumn("_key", time_key)
        .withColumn(
            "raw",
            F.when(pairs.isNull(), F.col("raw")).otherwise(
                F.concat(F.coalesce(time, F.lit("")), F.lit(" "), F.array_join(shown, "\n"))
            ),
        )
        .drop("_pairs", "_key")
    )


def read_jsonl_lines(spark: SparkSession, paths: Sequence[str],
                     encoding: str = "utf-8") -> DataFrame:
    lines = read_text(spark, paths, encoding)
    keys, _ = small_side(time_keys(lines, "path"))
    tagged = lines.join(keys, "path", "left")
    return render_objects(tagged, F.col("time_key")).drop("time_key")
