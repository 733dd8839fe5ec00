"""Decoded network packets as log lines.

Input is a table of decoded packets: ``ts, layer, src, sport, dst, dport, seq, ack, flags,
payload, len, is_tcp, nfs_proc, nfs_name, nfs_status, http_chat``.  All formatting is built-in
expressions.
"""

from __future__ import annotations

import errno

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.functions.text import DISPLAY_FORMAT, quoted, rtrim_ws

# NFS version 3 procedure names, by number.
NFS_PROCEDURES = [
    "NULL", "GETATTR", "SETATTR", "LOOKUP", "ACCESS", "READLINK", "READ", "WRITE", "CREATE",
    "MKDIR", "SYMLINK", "MKNOD", "REMOVE", "RMDIR", "RENAME", "LINK", "READDIR", "READDIR+",
    "FSSTAT", "FSINFO", "PATHCONF", "COMMIT",
]

# TCP flag bits.
TCP_FLAGS = [(1, "FIN"), (2, "SYN"), (4, "RST"), (8, "PSH"), (16, "ACK"), (32, "URG")]

# Characters of payload shown, and the payload length that adds dots.
PAYLOAD_SHOWN, PAYLOAD_DOTS = 48, 16


def _lookup(table: dict[str, str], key: Column, missing: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), missing)


def nfs_procedure(number: Column) -> Column:
    names = {str(i): name for i, name in enumerate(NFS_PROCEDURES)}
    return _lookup(names, number.cast("string"), F.lit("???"))


def nfs_status(status: Column) -> Column:
    codes = {str(number): name for number, name in errno.errorcode.items()}
    text = status.cast("string")
    named = _lookup(codes, text, F.concat(F.lit("UNKERR:"), text))
    return F.when(text == "0", F.lit("OK")).otherwise(named)


def tcp_flags(bits: Column) -> Column:
    """Names of the set bits, comma separated."""
    return F.concat_ws(",", *[
        F.when(bits.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in TCP_FLAGS
    ])


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def format_packets(packets: DataFrame) -> DataFrame:
    """Add ``timestamp`` (text), ``proto`` and ``message``; packets without IP are left out."""
    layer, chat, payload = F.col("layer"), F.col("http_chat"), F.col("payload")
    status, name = _column(packets, "nfs_status"), _column(packets, "nfs_name")
    is_tcp = F.col("sport").isNotNull() & F.col("flags").isNotNull()
    is_nfs = is_tcp & F.col("nfs_proc").isNotNull()
    is_http = is_tcp & F.col("nfs_proc").isNull() & chat.isNotNull()
    is_reply = is_nfs & status.isNotNull()

    def endpoint(host: str, port: str) -> Column:
        return F.concat_ws(":", host, F.when(is_tcp, F.col(port).cast("string")))

    # The decoder writes the line end as the four characters \r\n.
    said = F.when(F.endswith(chat, F.lit("\\r\\n")), F.left(chat, F.length(chat) - 4))
    dots = F.when(F.col("len") > PAYLOAD_DOTS, F.lit("...")).otherwise(F.lit(""))
    data = F.concat(F.lit(" "), F.substring(payload, 1, PAYLOAD_SHOWN), dots)
    # What a packet is about: one text to quote, words before it and words behind it.
    quotes = F.when(is_nfs, F.nullif(name, F.lit(""))).when(
        is_http, rtrim_ws(F.coalesce(said, chat))
    )
    before = F.when(is_nfs, F.concat(nfs_procedure(F.col("nfs_proc")), F.lit(" ")))
    behind = (
        F.when(is_reply, nfs_status(status))
        .when(is_tcp & ~is_nfs & ~is_http,
              F.concat(tcp_flags(F.col("flags")), F.coalesce(data, F.lit(""))))
    )
    label = F.when(is_http & (layer != "HTTP"), F.concat(F.lit("HTTP/"), layer)).otherwise(layer)
    numbers = F.when(
        is_tcp, F.concat(F.lit(" seq:"), F.col("seq"), F.lit(" ack:"), F.col("ack"))
    )

    def shown(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    # In steps, so that no expression is written out twice in the generated code.
    steps = (
        packets.where(F.col("src").isNotNull())
        .withColumn("_source", endpoint("src", "sport"))
        .withColumn("_target", endpoint("dst", "dport"))
        .withColumn("_quotes", quotes)
        .withColumn("_before", shown(before))
        .withColumn("_behind", shown(behind))
    )
    message = F.concat(
        label, F.lit(" "),
        F.when(is_reply, F.col("_target")).otherwise(F.col("_source")),
        F.when(is_reply, F.lit(" <- ")).otherwise(F.lit(" -> ")),
        F.when(is_reply, F.col("_source")).otherwise(F.col("_target")),
        shown(numbers), F.lit(" "), F.col("_before"), shown(quoted(F.col("_quotes"))),
        F.when(is_nfs & F.col("_quotes").isNotNull(), F.lit(" ")).otherwise(F.lit("")),
        F.col("_behind"),
    )
    return steps.select(
        *packets.columns,
        F.date_format("ts", DISPLAY_FORMAT).alias("timestamp"),
        F.when(is_http, F.lit("HTTP")).otherwise(layer).alias("proto"),
        message.alias("message"),
    )


def packets_to_lines(packets: DataFrame, file: str, seq: Column) -> DataFrame:
    """Packets as raw lines of one source, ready for ``parse_timestamps``."""
    return format_packets(packets.withColumn("_seq", seq)).select(
        F.lit(file).alias("file"),
        F.lit(0).cast("bigint").alias("block_start"),
        F.col("_seq").cast("bigint").alias("seq"),
        F.concat_ws(" ", "timestamp", "message").alias("raw"),
    )
