"""Session, shared scratch folder, and the two ways an intermediate result is kept."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Lookup tables up to this many rows (one per source) are broadcast.
MAX_LOOKUP_ROWS = 100_000

_local_scratch: dict[str, str] = {}
_staged: list[str] = []
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def build_session(name: str = "timeloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster it would not be
    visible to the other machines.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _local_scratch:
        _local_scratch[context.applicationId] = tempfile.mkdtemp(prefix="timeloom-")
    return _local_scratch[context.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/timeloom/{uuid.uuid4().hex}/{label}"


def stage(df: DataFrame, label: str = "stage", path: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back.

    Used where several passes need the same rows: the columnar copy makes the narrow passes
    cheap, gives every pass the same line keys, and survives the loss of executors.
    """
    target = path or fresh_path(df.sparkSession, label)
    _staged.append(target)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(target)
    kept = df.sparkSession.read.schema(df.schema).parquet(target)
    _path_of[kept] = target
    return kept


def _delete(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(files.delete(folder, True))


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again: what was made of them is staged itself.

    The tables are those that :func:`stage` returned; others are left alone.
    """
    for table in tables:
        path = _path_of.pop(table, None)
        if path is not None:
            _staged.remove(path)
            _delete(table.sparkSession, path)


def release_staged(spark: SparkSession) -> int:
    """Delete the tables this process staged, once nothing reads them any more."""
    done = 0
    while _staged:
        done += _delete(spark, _staged.pop())
    _path_of.clear()
    return done


def lookup(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table from driver-side rows, marked for broadcast while it is small."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= MAX_LOOKUP_ROWS else df


def collect_small(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> list[Row] | None:
    """The rows of a table of per-source facts, or None when it has more than ``max_rows``."""
    rows = F.collect_list(F.struct(*df.columns)).alias("rows")
    found = df.limit(max_rows + 1).agg(rows).first()["rows"]
    return found if len(found) <= max_rows else None


def small_side(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> tuple[DataFrame, bool]:
    """A lookup table ready to be joined, and whether it is proven small.

    Up to ``max_rows`` rows it becomes a local relation marked for broadcast; a larger one
    is written to the shared folder and joined by shuffle.  Only for per-source facts (one
    row per file), never for lines.
    """
    found = collect_small(df, max_rows)
    if found is None:
        return stage(df, "lookup"), False
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema)), True
