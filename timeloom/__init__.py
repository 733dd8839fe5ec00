"""Timestamp-aligned log analytics on Spark DataFrames."""

from timeloom.functions.formats import FormatRegistry, TimestampFormat
from timeloom.functions.literals import Jump
from timeloom.operators.asof import asof_join, nearest_times
from timeloom.operators.clip import TimeRange, autoclip, clip, span
from timeloom.operators.explore import (
    file_stats,
    find_next,
    find_previous,
    goto_line,
    goto_timestamp,
    jump,
    search,
)
from timeloom.operators.merge import in_time_order, merge_long, merge_two, merge_wide, present
from timeloom.operators.order import (
    LineOrder,
    flag_disorder,
    forward_fill,
    number_rows,
    number_runs,
    running_sum,
)
from timeloom.operators.records import collapse_records, detect_formats, parse_timestamps
from timeloom.plans.align import Alignment, align
from timeloom.plans.session import build_session, stage
from timeloom.sources.files import read_logs, register_reader

__all__ = [
    "Alignment", "FormatRegistry", "Jump", "LineOrder", "TimestampFormat", "align", "asof_join",
    "autoclip", "build_session", "clip", "collapse_records", "detect_formats", "file_stats",
    "find_next", "find_previous", "flag_disorder", "forward_fill", "goto_line",
    "goto_timestamp", "in_time_order", "jump", "merge_long", "merge_two", "merge_wide",
    "nearest_times", "number_rows", "number_runs", "parse_timestamps", "present", "read_logs",
    "register_reader", "running_sum", "search", "span", "stage",
]
