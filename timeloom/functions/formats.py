"""Timestamp formats as Column expressions.

A :class:`TimestampFormat` says what a timestamp looks like (a Java regex), how it sits in
the line (a layout) and how its text becomes a ``TIMESTAMP_NTZ`` wall clock in the session
time zone (and an instant, where zone or epoch fix one).  Everything compiles to built-in
expressions, so parsing stays inside whole-stage code generation and a bad value gives NULL
instead of failing the job.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeloom.functions.text import SPACE, WHITESPACE, rtrim_ws

# From the text of the timestamp, and the date that completes partial ones, to a wall clock
# (TIMESTAMP_NTZ) or, where zone or epoch fix it, an instant (TIMESTAMP).
Parser = Callable[[Column, Column], Column]

# The timestamp, then the separator that is dropped with it.
_LEADING = "(({stamp}){sep})"

# (?d): only \n ends a line, so "." also crosses \r and the Unicode separators.
_FLAGS = "(?d)"

# English month abbreviations.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _month(name: Column) -> Column:
    table = F.create_map(
        *[F.lit(x) for i, m in enumerate(MONTHS, start=1) for x in (m, f"{i:02d}")]
    )
    return F.try_element_at(table, F.lower(name))


def _wall_clock(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def _instant(text: Column) -> Column:
    """Text with an offset."""
    return text.try_cast("timestamp")


def parse_local(text: Column, _: Column) -> Column:
    return _wall_clock(F.translate(text, ",", "."))


def parse_zoned(text: Column, _: Column) -> Column:
    # Behind the date only white space before the offset is dropped and a comma replaced.
    time = F.translate(F.substring(text, 12, 40), "," + WHITESPACE, ".")
    after_offset = F.substring(time, -6, 1).isin("+", "-") & F.endswith(time, F.lit("Z"))
    time = F.when(after_offset, F.left(time, F.length(time) - 1)).otherwise(time)
    return _instant(F.concat(F.substring(text, 1, 10), F.lit("T"), time))


def parse_month_day(text: Column, reference_date: Column) -> Column:
    day = F.lpad(F.trim(F.substring(text, 5, 2)), 2, "0")
    return _wall_clock(
        F.concat(
            F.lpad(F.year(reference_date).cast("string"), 4, "0"), F.lit("-"),
            _month(F.substring(text, 1, 3)), F.lit("-"), day,
            F.lit(" "), F.substring(text, 8, 8),
        )
    )


def parse_time_of_day(text: Column, reference_date: Column) -> Column:
    return _wall_clock(F.concat(F.date_format(reference_date, "yyyy-MM-dd"), F.lit(" "), text))


def _day_month_year(text: Column) -> tuple[Column, Column]:
    """``dd/Mon/yyyy<sep>rest`` as (ISO date, rest)."""
    tail = F.substring_index(text, "/", -1)
    month = _month(F.element_at(F.split(text, "/"), 2))
    date = F.concat(
        F.substring(tail, 1, 4), F.lit("-"), month, F.lit("-"), F.substring(text, 1, 2)
    )
    return date, F.substring(tail, 6, 64)


def parse_http_server(text: Column, _: Column) -> Column:
    date, time = _day_month_year(text)
    return _wall_clock(F.concat(date, F.lit(" "), time))


def parse_access_log(text: Column, _: Column) -> Column:
    date, time = _day_month_year(text)
    return _instant(F.concat(date, F.lit(" "), F.translate(time, " ", "")))


def _epoch(seconds: Column, micros: Column) -> Column:
    return F.timestamp_micros(seconds * 1_000_000 + micros)


def parse_epoch_float(text: Column, _: Column) -> Column:
    # Through a double with half-even rounding: more than six digits are common in practice
    # and must give the same microsecond as a floating-point clock does.
    value = text.try_cast("double")
    whole = F.floor(value)
    return _epoch(whole, F.rint((value - whole) * 1_000_000).cast("bigint"))


def parse_epoch_millis(text: Column, _: Column) -> Column:
    return F.timestamp_millis(text.try_cast("bigint"))


def parse_epoch_seconds(text: Column, _: Column) -> Column:
    return _epoch(text.try_cast("bigint"), F.lit(0))


def parse_apache_error(text: Column, _: Column) -> Column:
    fraction = F.regexp_extract(text, r"\.(\d*) ", 1)
    return _wall_clock(
        F.concat(
            F.substring(text, -5, 4), F.lit("-"), _month(F.substring(text, 6, 3)), F.lit("-"),
            F.substring(text, 10, 2), F.lit(" "), F.substring(text, 13, 8), F.lit("."),
            F.rpad(fraction, 6, "0"),
        )
    )


@dataclass(frozen=True)
class TimestampFormat:
    """One recognised timestamp.

    ``template`` places the timestamp (``{stamp}``) and the separator (``{sep}``) in the
    line; ``stamp_group`` is the group holding the timestamp text and ``lead_group`` the
    group kept in front of the body (0: nothing is kept).  A ``fixed`` format names an
    instant, not only a wall clock.
    """

    name: str
    stamp: str
    parse: Parser
    template: str = _LEADING
    stamp_group: int = 2
    lead_group: int = 0
    custom: bool = False
    fixed: bool = False

    def regex(self, strict: bool = False) -> str:
        sep = SPACE if strict else f"(?:{SPACE}|$)"
        body = self.template.replace("{stamp}", self.stamp).replace("{sep}", sep)
        return f"{_FLAGS}^(?:{body})"

    def matches(self, line: Column) -> Column:
        return line.rlike(self.regex(strict=True))

    def prefix(self, line: Column, strict: bool = False) -> Column:
        """The matched start of the line, ``''`` when the line has no timestamp."""
        return F.regexp_extract(line, self.regex(strict), 0)

    def stamp_text(self, prefix: Column, strict: bool = False) -> Column:
        if self.template == _LEADING:
            return rtrim_ws(prefix)
        return F.regexp_extract(prefix, self.regex(strict), self.stamp_group)

    def wall_clock(self, stamp: Column, reference_date: Column) -> Column:
        """Time of day and date as shown in the session time zone."""
        return self.parse(stamp, reference_date).cast("timestamp_ntz")

    def instant(self, stamp: Column, reference_date: Column) -> Column:
        if self.fixed:
            return self.parse(stamp, reference_date)
        return F.lit(None).cast("timestamp")

    def lead(self, prefix: Column, strict: bool = False) -> Column:
        if not self.lead_group:
            return F.lit("")
        return F.regexp_extract(prefix, self.regex(strict), self.lead_group)


# The shapes below define which lines carry a timestamp, in priority order.
_DATE = r"\d{4}-\d{2}-\d{2}"
_TIME = r"\d{2}:\d{2}:\d{2}"
_ZONE = rf"{SPACE}?(?:Z|[+-]\d{{4}})"
_BRACKETED = r"(.*)(- \[({stamp})\]{sep})"


def _iso_formats() -> list[TimestampFormat]:
    """Dates and times of ISO shape: separator, then fraction, then zone or none."""
    found = []
    for sep_name, sep in (("space", " "), ("t", "T")):
        for frac_name, frac in (("comma", r",\d{1,6}"), ("dot", r"\.\d{1,6}"), ("whole", "")):
            for zoned in (True, False):
                zone = _ZONE
                if zoned and sep == "T" and frac_name == "dot":
                    zone = rf"{SPACE}?(?:Z|[+-]\d{{4}}Z?)"
                found.append(
                    TimestampFormat(
                        name=f"iso_{sep_name}_{frac_name}" + ("_zone" if zoned else ""),
                        stamp=_DATE + sep + _TIME + frac + (zone if zoned else ""),
                        parse=parse_zoned if zoned else parse_local,
                        fixed=zoned,
                    )
                )
    return found


BUILTIN_FORMATS: tuple[TimestampFormat, ...] = (
    *_iso_formats(),
    TimestampFormat(
        "syslog", rf"[JFMASOND][a-z]{{2}}{SPACE}(?:{SPACE}|\d)\d {_TIME}", parse_month_day
    ),
    TimestampFormat("time_of_day", _TIME + r"\.\d{1,6}", parse_time_of_day),
    TimestampFormat(
        "http_server", rf"\d{{2}}/\w+/\d{{4}} {_TIME}", parse_http_server, _BRACKETED, 3, 1
    ),
    TimestampFormat(
        "access_log", rf"\d{{2}}/\w+/\d{{4}}:{_TIME} [+-]\d{{4}}", parse_access_log,
        _BRACKETED, 3, 1, fixed=True,
    ),
    TimestampFormat("epoch_float", r"\d{10}\.\d+", parse_epoch_float, fixed=True),
    TimestampFormat("epoch_millis", r"\d{13}", parse_epoch_millis, fixed=True),
    TimestampFormat("epoch_seconds", r"\d{10}", parse_epoch_seconds, fixed=True),
    TimestampFormat(
        "apache_error", rf"\[\w{{3}} \w{{3}} \d{{2}} {_TIME}\.\d{{0,6}} \d{{4}}\]",
        parse_apache_error,
    ),
)

# Names for often used custom templates.
TEMPLATE_ALIASES = {"strace": r"(\d+) ((...))"}

_PLACEHOLDER = "(...)"


def custom_formats(template: str, base: Sequence[TimestampFormat] = BUILTIN_FORMATS
                   ) -> list[TimestampFormat]:
    """Expand a user template into one format per known timestamp.

    The template is a regex with ``(...)`` where the timestamp goes.  ``((...)x)`` drops
    timestamp and ``x`` from the body, ``(lead)((...)x)`` keeps ``lead``.
    """
    source = TEMPLATE_ALIASES.get(template.lower(), template)
    if _PLACEHOLDER not in source:
        raise ValueError(f"timestamp template {template!r} needs a '(...)' placeholder")
    keeps_lead = "..." not in source.split(")", 1)[0]
    layout = re.sub(r"\(\?P<", "(?<", source)
    return [
        replace(
            fmt,
            name=f"custom:{template}:{fmt.name}",
            template=layout.replace("...", "{stamp}"),
            stamp_group=3 if keeps_lead else 2,
            lead_group=1 if keeps_lead else 0,
            custom=True,
        )
        for fmt in base
    ]


class FormatRegistry:
    """Ordered set of formats: built-in ones, then registered ones, then templates."""

    def __init__(self, templates: Iterable[str] = (),
                 extra: Iterable[TimestampFormat] = ()) -> None:
        self._formats = {f.name: f for f in (*BUILTIN_FORMATS, *extra)}
        for template in templates:
            self.add_template(template)

    def add_template(self, template: str) -> FormatRegistry:
        base = [f for f in self._formats.values() if not f.custom]
        self._formats.update({f.name: f for f in custom_formats(template, base)})
        return self

    def register(self, fmt: TimestampFormat) -> FormatRegistry:
        self._formats[fmt.name] = fmt
        return self

    def __iter__(self):
        return iter(self._formats.values())

    def __getitem__(self, name: str) -> TimestampFormat:
        return self._formats[name]

    def names(self) -> list[str]:
        return list(self._formats)

    def detect_index(self, line: Column) -> Column:
        """Number of the first format that matches a whole raw line, NULL when none does."""
        # The end of the line counts as the separator here, hence the line feed.
        sample = F.concat(line, F.lit("\n"))
        return F.coalesce(*[F.when(f.matches(sample), F.lit(i)) for i, f in enumerate(self)])

    def detect(self, line: Column) -> Column:
        """Name of that format."""
        return F.get(F.array(*[F.lit(n) for n in self.names()]), self.detect_index(line))
