"""Small text expressions shared by all operators (built-in Spark functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.rstrip() and \s treat as white space.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as a Java character class.
SPACE = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

# Fixed value: terminal colour sequences (ESC [ n ; n ... m).
SGR_SEQUENCE = r"\x1b\[\d+(?:;\d+)*m"

DISPLAY_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"


def rtrim_ws(c: Column) -> Column:
    """Drop all trailing white space, not only spaces.

    Trimming by a set of characters walks the whole text; most texts end in a visible ASCII
    character and are left alone after a look at their last byte.
    """
    last = F.substring(c.cast("binary"), -1, 1)
    visible = last.between(F.lit(bytearray(b"\x21")), F.lit(bytearray(b"\x7f")))
    return F.when(visible, c).otherwise(F.rtrim(c, F.lit(WHITESPACE)))


def after_prefix(c: Column, prefix: Column) -> Column:
    """What follows ``prefix``, a known start of the text; cut by bytes, not characters."""
    rest = F.substring(c.cast("binary"), F.octet_length(prefix) + 1, F.octet_length(c))
    return rest.cast("string")


def trim_ws(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def strip_sgr(c: Column) -> Column:
    # Few lines have colours; a plain search for the escape character spares the others.
    return F.when(F.contains(c, F.lit("\x1b")), F.regexp_replace(c, SGR_SEQUENCE, "")).otherwise(c)


def indent_continuation(c: Column) -> Column:
    return F.concat(F.lit(" "), c)


def display_ts(ts: Column) -> Column:
    """Millisecond text by truncation; blank for the records before any timestamp."""
    return F.coalesce(F.date_format(ts, DISPLAY_FORMAT), F.lit(""))


def lines_in(c: Column) -> Column:
    """Number of text lines in one cell."""
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def row_height(cells: list[Column]) -> Column:
    """Number of text lines of the tallest cell of a merged row."""
    heights = [lines_in(F.coalesce(c, F.lit(""))) for c in cells]
    return heights[0] if len(heights) == 1 else F.greatest(*heights)


def quoted(c: Column) -> Column:
    """Text in quotes with escapes, as Python prints the repr of a str.

    Single quotes, unless the text holds a single quote and no double quote.
    """
    escaped = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    single, double = F.contains(c, F.lit("'")), F.contains(c, F.lit('"'))
    return F.when(
        single & ~double, F.concat(F.lit('"'), escaped, F.lit('"'))
    ).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def floor_ts(ts: Column, unit: str) -> Column:
    """``date_trunc`` that stays TIMESTAMP_NTZ and never passes through a time zone."""
    parts = [F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts)]
    first = [F.lit(1), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)]
    kept = ["year", "month", "day", "hour", "minute", "second"].index(unit) + 1
    return F.make_timestamp_ntz(*parts[:kept], *first[kept:])
