"""Readers: every reader gives raw lines ``(path, block_start, seq, raw, file_date)``.

``read_logs`` turns the path into ``file``, the name under which the log was given.
"""
