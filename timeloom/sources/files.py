"""Log files: which reader takes which file, text and gzip, character sets."""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from timeloom.plans.session import lookup

# Character sets the JVM decode function takes; others go through an Arrow UDF.
JVM_CHARSETS = {"utf-8", "us-ascii", "iso-8859-1", "utf-16le", "utf-16be"}
# Charsets whose line feed takes several bytes.
_LINE_FEEDS = {"utf-16", "utf-16le", "utf-16be", "utf-32", "utf-32le", "utf-32be"}
_PYTHON_TO_JVM = {"ascii": "us-ascii", "iso8859-1": "iso-8859-1", "utf-16-le": "utf-16le",
                  "utf-16-be": "utf-16be", "utf-32-le": "utf-32le", "utf-32-be": "utf-32be"}

# An address without a host is written with one slash or with three.
_NO_HOST = re.compile("^([A-Za-z][A-Za-z0-9+.-]*):///")

# The first line of a file is looked for in this many bytes, and in this many files one by one.
HEAD_BYTES = 1 << 16
MAX_HEADS = 10_000

Reader = Callable[[SparkSession, Sequence[str], str], DataFrame]

_readers: dict[str, Reader] = {}


def register_reader(suffix: str, reader: Reader) -> None:
    """Use ``reader(spark, paths, encoding)`` for names ending in ``suffix``."""
    _readers[suffix] = reader


def _charset(encoding: str) -> str:
    name = codecs.lookup(encoding).name
    return _PYTHON_TO_JVM.get(name, name)


def _decode_column(value: Column, charset: str) -> Column:
    if charset in JVM_CHARSETS:
        return F.decode(value.cast("binary"), charset)

    @F.pandas_udf("string")
    def decode_batch(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else b.decode(charset))

    return decode_batch(value.cast("binary"))


@dataclass(frozen=True)
class LogFile:
    """A file by the name given for it, its path, and its address in the metadata column."""

    name: str
    path: str
    address: str


def expand_paths(spark: SparkSession, paths: Iterable[str]) -> list[LogFile]:
    """Files for names, folders (with all folders in them) and globs, in order.

    In a folder, names that start with ``_`` or ``.`` are left out, as Spark's readers do.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found: list[LogFile] = []
    for name in dict.fromkeys(paths):
        pattern = jvm.org.apache.hadoop.fs.Path(name)
        fs = pattern.getFileSystem(conf)
        hits = fs.globStatus(fs.makeQualified(pattern))
        if not hits:
            raise FileNotFoundError(name)
        files = []
        for status in hits:
            if status.isDirectory():
                files += _inside(fs, status.getPath())
            else:
                files.append(status.getPath())
        known = sorted((f.toString(), _NO_HOST.sub(r"\1:/", f.toUri().toString())) for f in files)
        found += [LogFile(name if len(known) == 1 else p, p, uri) for p, uri in known]
    return list(dict.fromkeys(found))


def _inside(fs, folder) -> list:
    found = []
    for status in fs.listStatus(folder):
        if not status.getPath().getName().startswith(("_", ".")):
            found += _inside(fs, status.getPath()) if status.isDirectory() else [status.getPath()]
    return found


def read_text(spark: SparkSession, paths: Sequence[str], encoding: str = "utf-8",
              line_feed_only: bool = False) -> DataFrame:
    """Lines of text files; ``.gz`` files are unpacked by the scan.

    A line ends at ``\\n``, ``\\r`` or both; with ``line_feed_only`` at ``\\n``, and ``\\r`` is kept.

    ``seq`` is taken on the scan itself: one task reads a block from front to back, so the
    id rises with the line, and ``block_start`` orders the blocks of a file.
    """
    charset = _charset(encoding)
    if charset in _LINE_FEEDS:
        parts = [
            _scan(spark.read.option("encoding", exact).option("lineSep", "\n"), members, exact)
            for exact, members in _by_byte_order(spark, paths, charset).items()
        ]
        return reduce(DataFrame.unionByName, parts)
    reader = spark.read.option("lineSep", "\n") if line_feed_only else spark.read
    return _scan(reader, paths, charset)


def _scan(reader: DataFrameReader, paths: Sequence[str], charset: str) -> DataFrame:
    lines = reader.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("raw"),
        F.to_date(F.col("_metadata.file_modification_time")).alias("file_date"),
    )
    if charset == "utf-8":
        return lines
    decoded = lines.withColumn("raw", _decode_column(F.col("raw"), charset))
    return decoded.withColumn("raw", F.ltrim(F.col("raw"), F.lit("\ufeff")))


def _by_byte_order(spark: SparkSession, paths: Sequence[str], charset: str
                   ) -> dict[str, list[str]]:
    """Paths per exact charset: where the name leaves the byte order open, the mark at the
    start of the file tells it."""
    if charset[-2:] in ("le", "be"):
        return {charset: list(paths)}
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found: dict[str, list[str]] = {}
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        stream = path.getFileSystem(conf).open(path)
        first = stream.read()
        stream.close()
        found.setdefault(charset + ("be" if first in (0xFE, 0x00) else "le"), []).append(name)
    return found


def _suffix_reader(name: str) -> tuple[str, Reader]:
    from timeloom.sources.csv_records import read_csv_lines
    from timeloom.sources.jsonl import read_jsonl_lines

    for suffix, reader in _readers.items():
        if name.endswith(suffix):
            return suffix, reader
    if name.endswith(".gz"):
        return ".gz", read_text
    if name.endswith(".pcap"):
        raise ValueError(f"{name}: decode packets first, then use sources.packets")
    if name.endswith(".csv"):
        return ".csv", read_csv_lines
    if name.endswith(".jsonl"):
        return ".jsonl", read_jsonl_lines
    if name.endswith(".zip"):
        raise ValueError(f"{name}: zip archives cannot be read")
    return "", read_text


def read_logs(spark: SparkSession, paths: Iterable[str],
              encoding: str = "utf-8") -> tuple[DataFrame, list[str]]:
    """Raw lines of all files, and the file names in argument order.

    Files are grouped by suffix and each group is one scan.  ``file`` is the name as given
    (the full path where a folder or glob stands for several files).
    """
    files = expand_paths(spark, paths)
    return lines_of(spark, files, encoding), [f.name for f in files]


def lines_of(spark: SparkSession, files: Sequence[LogFile],
             encoding: str = "utf-8") -> DataFrame:
    """Raw lines of files that :func:`expand_paths` found."""
    groups: dict[str, tuple[Reader, dict[str, None]]] = {}
    for file in files:
        suffix, reader = _suffix_reader(file.path)
        groups.setdefault(suffix, (reader, {}))[1][file.path] = None
    lines = None
    for reader, members in groups.values():
        part = reader(spark, list(members), encoding)
        lines = part if lines is None else lines.unionByName(part)
    if lines is None:
        raise ValueError("no files given")
    # The table of names is as long as the argument list, which the driver holds already.
    names = lookup(spark, [(f.address, f.name) for f in files], "path string, file string")
    address = F.regexp_replace("path", _NO_HOST.pattern, "$1:/")
    named = lines.withColumn("path", address).join(names, "path", "left")
    # Losing lines silently would be worse than failing.
    unknown = F.raise_error(F.concat(F.lit("no name for file "), F.col("path"))).cast("string")
    return named.withColumn("file", F.coalesce("file", unknown)).drop("path")


def file_heads(spark: SparkSession, files: Sequence[LogFile], encoding: str = "utf-8"
               ) -> tuple[DataFrame, list[LogFile]]:
    """``(file, block_start, seq, raw)`` with the first line of text files, and the files left over.

    At most ``HEAD_BYTES`` of a file are read, however large it is.  Left over are files whose
    first line is longer, those that are not plain or gzip text, and those beyond ``MAX_HEADS``:
    they take a scan.  An empty file has no row.
    """
    charset = _charset(encoding)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    codecs_of = hadoop.io.compress.CompressionCodecFactory(conf)
    heads, left = [], list(files[MAX_HEADS:])
    for file in files[:MAX_HEADS]:
        if charset in _LINE_FEEDS or _suffix_reader(file.path)[1] is not read_text:
            left.append(file)
            continue
        path = hadoop.fs.Path(file.path)
        stream = path.getFileSystem(conf).open(path)
        try:
            codec = codecs_of.getCodec(path)
            text = hadoop.io.Text()
            reader = hadoop.util.LineReader(codec.createInputStream(stream) if codec else stream)
            taken = reader.readLine(text, HEAD_BYTES, HEAD_BYTES)
        finally:
            stream.close()
        if taken >= HEAD_BYTES:
            left.append(file)
        elif taken:
            heads.append((file.name, bytes(text.copyBytes()).removeprefix(codecs.BOM_UTF8)))
    raw = F.col("raw").cast("string") if charset == "utf-8" else _decode_column(
        F.col("raw"), charset)
    table = spark.createDataFrame(heads, "file string, raw binary")
    zero = F.lit(0).cast("bigint")
    return table.select("file", zero.alias("block_start"), zero.alias("seq"),
                        raw.alias("raw")), left
