"""The registered workload in plain SQL, for checking results against another engine."""

from __future__ import annotations

from timeloom.functions.text import WHITESPACE
from timeloom.plans.workload import BRACKETED, EVENT_FILES, RENDERED

# --- the logs made from the tables -----------------------------------------------------

EVENTS = """
e AS (
  SELECT event_type AS file, event_id AS seq, ts, user_id,
         'user=' || user_id || ' ' || props AS body
  FROM events
)"""

SHIPPING = """
l AS (
  SELECT l_returnflag AS file, l_shipdate AS ts, l_orderkey || '-' || l_linenumber AS body,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem
)"""
SHIP_POSITION = "l_orderkey, l_linenumber, l_partkey, l_suppkey, ts"

CONVERSATIONS = """
c AS (
  SELECT conv_id AS file, turn AS seq, role || ': ' || text AS body,
         CASE WHEN role = 'user'
              THEN TIMESTAMP '2024-01-01' + conv_id * INTERVAL 1 HOUR + turn * INTERVAL 1 MINUTE
         END AS ts
  FROM conversations
), f AS (
  SELECT *, last_value(ts IGNORE NULLS) OVER (
    PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rec_ts
  FROM c
)"""

BLANKS = " || ".join(f"chr({ord(ch)})" for ch in WHITESPACE)

DOCUMENTS = f"""
d AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents
), p AS (
  SELECT doc_id, lang, line_no,
         TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 SECOND AS stamp,
         rtrim(CASE WHEN line_no = 0 THEN line ELSE ' ' || line END, {BLANKS}) AS body
  FROM d
)"""

DISPLAY = "strftime(ts, '%Y-%m-%d %H:%M:%S.%g')"

ROWS = f"""
g AS (
  SELECT ts, file, string_agg(body, chr(10) ORDER BY seq) AS log FROM e GROUP BY ts, file
), r AS (
  SELECT dense_rank() OVER (ORDER BY ts) AS line, {DISPLAY} AS timestamp, ts, file, log FROM g
)"""


def _cells(key: str, order: str = "seq") -> str:
    cells = ", ".join(
        f"coalesce(string_agg(body, chr(10) ORDER BY {order}) FILTER (WHERE file = '{f}'), '')"
        f" AS {f}"
        for f in EVENT_FILES
    )
    return f"SELECT {key} AS ts, {cells} FROM e GROUP BY 1"


# --- timestamp formats -----------------------------------------------------------------

_DAY_TIME = "TIMESTAMP '2024-01-01' + (ts - date_trunc('day', ts))"
_THIS_YEAR = (
    "make_timestamp(2024, month(ts), day(ts), hour(ts), minute(ts), second(ts)::DOUBLE)"
)
_MILLIS = "date_trunc('milliseconds', ts)"
_SECONDS = "date_trunc('second', ts)"
_EXACT = "ts"


def _kept(name: str) -> str:
    """What of the timestamp survives being written in a format."""
    special = {"syslog": _THIS_YEAR, "time_of_day": _DAY_TIME, "epoch_float": _EXACT,
               "epoch_millis": _MILLIS, "apache_error": _EXACT}
    if name in special:
        return special[name]
    if "comma" in name:
        return _EXACT
    return _MILLIS if "dot" in name else _SECONDS


def _format_sql(name: str) -> str:
    body = "'10.0.0.' || user_id || ' - ' || body" if name in BRACKETED else "body"
    return f"WITH {EVENTS} SELECT seq AS event_id, {_kept(name)} AS ts, {body} AS body FROM e"


def _seek_sql(cursor: int, target: str) -> str:
    return f"""
WITH {EVENTS}, {ROWS}, here AS (SELECT max(timestamp) AS t FROM r WHERE line = {cursor}),
goal AS (SELECT {target} AS t),
a AS (
  SELECT min(line) FILTER (WHERE line >= {cursor} AND timestamp >= (SELECT t FROM goal)) AS ahead,
         max(line) FILTER (WHERE line <= {cursor} AND timestamp <= (SELECT t FROM goal)) AS back,
         min(line) AS first, max(line) AS last
  FROM r
)
SELECT line, timestamp, file, log FROM r WHERE line = (
  SELECT CASE WHEN here.t = goal.t THEN {cursor}
              WHEN here.t < goal.t THEN coalesce(ahead, last)
              ELSE coalesce(back, first) END
  FROM a, here, goal)"""


_HOURLY = _cells("date_trunc('hour', ts)")

_PACKETS = """
WITH k AS (
  SELECT *, l_orderkey % 5 AS kind,
         '10.0.0.' || (l_partkey % 256) AS src, '10.0.1.' || (l_suppkey % 256) AS dst
  FROM lineitem WHERE l_orderkey % 17 > 0
), t AS (
  SELECT *, src || ':' || (l_partkey + 1024) AS a, dst || ':2049' AS b,
    ' seq:' || l_orderkey || ' ack:' || l_partkey || ' ' AS numbers,
    coalesce(['NULL','GETATTR','SETATTR','LOOKUP','ACCESS','READLINK','READ','WRITE','CREATE',
     'MKDIR','SYMLINK','MKNOD','REMOVE','RMDIR','RENAME','LINK','READDIR','READDIR+','FSSTAT',
     'FSINFO','PATHCONF','COMMIT'][l_partkey % 25 + 1], '???') AS proc,
    CASE WHEN l_partkey % 3 > 0 THEN ' "it''s ' || l_partkey || '"' ELSE '' END AS nfs_name,
    CASE WHEN kind = 1 THEN ['OK', 'ENOENT', 'EACCES', 'UNKERR:9999'][l_suppkey % 4 + 1]
         ELSE '' END AS status,
    concat_ws(',', CASE WHEN (l_suppkey % 64) & 1 > 0 THEN 'FIN' END,
      CASE WHEN (l_suppkey % 64) & 2 > 0 THEN 'SYN' END,
      CASE WHEN (l_suppkey % 64) & 4 > 0 THEN 'RST' END,
      CASE WHEN (l_suppkey % 64) & 8 > 0 THEN 'PSH' END,
      CASE WHEN (l_suppkey % 64) & 16 > 0 THEN 'ACK' END,
      CASE WHEN (l_suppkey % 64) & 32 > 0 THEN 'URG' END) AS flags,
    CASE WHEN l_linenumber > 1
         THEN ' ' || left(repeat('ab:', l_linenumber * 4), 48)
              || CASE WHEN l_linenumber * 4 > 16 THEN '...' ELSE '' END
         ELSE '' END AS payload
  FROM k
)
SELECT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%g') AS timestamp,
  CASE WHEN kind <= 1 THEN 'NFS' WHEN kind = 2 THEN 'HTTP' WHEN kind = 4 THEN 'DNS'
       ELSE 'TCP' END AS proto,
  CASE WHEN kind = 0 THEN 'NFS ' || a || ' -> ' || b || numbers || proc || nfs_name || ' '
       WHEN kind = 1 THEN 'NFS ' || b || ' <- ' || a || numbers || proc || nfs_name || ' ' || status
       WHEN kind = 2 THEN 'HTTP/JSON ' || a || ' -> ' || b || numbers || '''GET /' || l_partkey
                          || ' HTTP/1.1'''
       WHEN kind = 4 THEN 'DNS ' || src || ' -> ' || dst || ' '
       ELSE 'TCP ' || a || ' -> ' || b || numbers || flags || payload END AS message
FROM t"""


def oracle_sql() -> dict[str, str]:
    found = {f"ts_fmt_{name}": _format_sql(name) for name in RENDERED}
    seconds = f"WITH {EVENTS} SELECT seq AS event_id, {_SECONDS} AS ts"
    mixed = {"click": "syslog", "error": "iso_t_dot_zone", "purchase": "epoch_float",
             "signup": "access_log", "view": "apache_error"}
    mixed_ts = "CASE file " + " ".join(
        f"WHEN '{f}' THEN {_kept(n)}" for f, n in mixed.items()) + " END"
    asof = f"""WITH {EVENTS}, k AS (
      SELECT ts, string_agg(body, chr(10) ORDER BY seq) AS body FROM e
      WHERE file = 'click' GROUP BY ts)
    SELECT p.seq AS event_id, p.ts, k.ts AS match_ts, k.body AS match_body
    FROM (SELECT * FROM e WHERE file = 'error') p ASOF LEFT JOIN k ON p.ts {{op}} k.ts"""
    shipped = f"string_agg(body, chr(10) ORDER BY {SHIP_POSITION})"
    collapsed = ("SELECT file, rec_ts AS ts, count(*)::INTEGER AS n_lines, "
                 "string_agg(body, chr(10) ORDER BY seq) AS body FROM f GROUP BY file, rec_ts")
    markdown = " || ' | ' || ".join(
        [DISPLAY] + [f"replace(replace({f}, chr(10), '<br />'), '|', '\\|')" for f in EVENT_FILES])
    found |= {
        "ts_custom_lead": f"{seconds}, 'INFO - ' || body AS body FROM e",
        "ts_custom_drop": f"{seconds}, body FROM e",
        "ts_custom_colour": f"WITH {EVENTS} SELECT seq AS event_id, ts, '[E] ' || body AS body "
                            "FROM e",
        "ts_strace": f"WITH {EVENTS} SELECT seq AS event_id, {_DAY_TIME} AS ts, "
                     "'4711 ' || body AS body FROM e",
        "detect_format": "SELECT DISTINCT event_type AS file, CASE event_type " + " ".join(
            f"WHEN '{f}' THEN '{n}'" for f, n in mixed.items()) + " END AS fmt FROM events",
        "parse_mixed_formats": f"WITH {EVENTS} SELECT seq AS event_id, {mixed_ts} AS ts, "
                               "CASE file WHEN 'signup' THEN '10.0.0.1 - ' || body ELSE body END "
                               "AS body FROM e",
        "ts_display_ms": f"SELECT event_id, {DISPLAY} AS timestamp FROM events",
        "ansi_strip": f"WITH {EVENTS} SELECT seq AS event_id, file || ' ' || body AS body FROM e",
        "rtrim_ws": f"SELECT doc_id, rtrim(text, {BLANKS}) AS text FROM documents",
        "continuation_indent": f"WITH {DOCUMENTS} SELECT doc_id, line_no, "
                               "CASE WHEN line_no = 0 THEN stamp END AS ts, body FROM p",
        "forward_fill": f"WITH {CONVERSATIONS} SELECT file AS conv_id, seq AS turn, rec_ts FROM f",
        "run_groups": f"""WITH {CONVERSATIONS}, s AS (
            SELECT *, CASE WHEN row_number() OVER w > 1
              AND rec_ts IS NOT DISTINCT FROM lag(rec_ts) OVER w THEN 0 ELSE 1 END AS starts
            FROM f WINDOW w AS (PARTITION BY file ORDER BY seq))
          SELECT file AS conv_id, seq AS turn,
            (sum(starts) OVER (PARTITION BY file ORDER BY seq))::BIGINT AS run_id FROM s""",
        "collapse_multiline": f"WITH {CONVERSATIONS} {collapsed}",
        "collapse_lines_doc": f"WITH {DOCUMENTS} SELECT lang AS file, stamp AS ts, "
                              "count(*)::INTEGER AS n_lines, "
                              "string_agg(body, chr(10) ORDER BY line_no) AS body "
                              "FROM p GROUP BY lang, stamp, doc_id",
        "drop_untimestamped": f"WITH {CONVERSATIONS} {collapsed}".replace(
            "FROM f GROUP", "FROM f WHERE ts IS NOT NULL GROUP"),
        "merge_dup_ts": f"WITH {SHIPPING} SELECT file, ts, count(*)::INTEGER AS n_lines, "
                        f"{shipped} AS body FROM l GROUP BY file, ts",
        "out_of_order": f"""WITH {SHIPPING}, m AS (SELECT *, max(ts) OVER (
            PARTITION BY file ORDER BY {SHIP_POSITION}
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM l)
          SELECT file, l_orderkey, l_linenumber, l_partkey, l_suppkey, ts,
            coalesce(ts < top, false) AS is_out_of_order,
            CASE WHEN ts < top THEN date_diff('microsecond', ts, top) END AS lateness_us
          FROM m""",
        "merge_wide_hour": f"WITH {EVENTS} {_HOURLY}",
        "merge_wide_second": f"WITH {EVENTS} {_cells(_SECONDS)}",
        "merge_wide_exact": f"WITH {EVENTS} {_cells('ts')}",
        "merge_two_full_outer": f"""WITH {SHIPPING}, o AS (
            SELECT o_orderdate AS ts, string_agg(o_orderkey || ' ' || o_orderstatus, chr(10)
              ORDER BY o_orderkey) AS ordered FROM orders GROUP BY 1),
          s AS (SELECT ts, {shipped} AS shipped FROM l GROUP BY ts)
          SELECT coalesce(o.ts, s.ts) AS ts, coalesce(ordered, '') AS ordered,
            coalesce(shipped, '') AS shipped FROM o FULL JOIN s ON o.ts = s.ts""",
        "merge_inline": f"WITH {EVENTS}, {ROWS} SELECT line, timestamp, file, log FROM r",
        "unpivot_wide": f"""WITH {EVENTS} SELECT date_trunc('hour', ts) AS ts,
            (list_position([{', '.join(f"'{f}'" for f in EVENT_FILES)}], file) - 1)::INTEGER
              AS file_no,
            file, string_agg(body, chr(10) ORDER BY seq) AS log FROM e GROUP BY 1, 2, 3""",
        "line_numbers": f"WITH {EVENTS}, w AS ({_cells('ts')}) "
                        f"SELECT row_number() OVER (ORDER BY ts) AS line, {DISPLAY} AS timestamp, "
                        f"{', '.join(EVENT_FILES)} FROM w",
        "number_rows": f"WITH {SHIPPING} SELECT dense_rank() OVER (ORDER BY ts) AS line, ts, file, "
                       "count(*)::INTEGER AS n_lines FROM l GROUP BY ts, file",
        "clip_absolute": f"WITH {EVENTS} SELECT seq AS event_id, ts, file FROM e WHERE ts BETWEEN "
                         "TIMESTAMP '2024-01-05 06:30:00' AND TIMESTAMP '2024-01-20 12:00:00.5'",
        "clip_start_only": f"WITH {EVENTS} SELECT seq AS event_id, ts, file FROM e "
                           "WHERE ts >= TIMESTAMP '2024-01-10'",
        "clip_end_only": f"WITH {EVENTS} SELECT seq AS event_id, ts, file FROM e "
                         "WHERE ts <= TIMESTAMP '2024-01-10'",
        "clip_relative": f"WITH {EVENTS} SELECT seq AS event_id, ts, file FROM e WHERE ts BETWEEN "
                         "TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-19 00:00:00'",
        "clip_multiline": f"WITH {CONVERSATIONS} SELECT file AS conv_id, seq AS turn, rec_ts "
                          "FROM f WHERE rec_ts IS NULL OR "
                          "rec_ts <= TIMESTAMP '2024-01-02 06:02:00'",
        "autoclip": f"WITH {EVENTS} SELECT seq AS event_id, ts, file FROM e WHERE ts BETWEEN "
                    "(SELECT min(ts) FROM e WHERE user_id = 8) "
                    "AND (SELECT max(ts) FROM e WHERE user_id = 8)",
        "file_stats": f"""WITH {EVENTS}
          SELECT file, count(DISTINCT ts) AS n_entries, min(ts) AS first_ts, max(ts) AS last_ts
          FROM e GROUP BY file UNION ALL
          SELECT 'Overall (merged)', count(DISTINCT ts), min(ts), max(ts) FROM e""",
        "info_table": f"""WITH {EVENTS}, s AS (
            SELECT file, count(DISTINCT ts) AS n, min(ts) AS lo, max(ts) AS hi FROM e
            GROUP BY file UNION ALL
            SELECT 'Overall (merged)', count(DISTINCT ts), min(ts), max(ts) FROM e)
          SELECT file, '| ' || file || ' | ' || format('{{:,}}', n) || ' | ' ||
            strftime(lo, '%Y-%m-%d %H:%M:%S.%g') || ' ' ||
            strftime(hi, '%Y-%m-%d %H:%M:%S.%g') || ' |' AS row FROM s""",
        "search": f"WITH {EVENTS}, {ROWS} SELECT line, timestamp, file, log FROM r "
                  "WHERE contains(lower(log), '\"k\": 7')",
        "find_next": f"WITH {EVENTS}, {ROWS} SELECT line, timestamp, file, log FROM r WHERE "
                     "line = (SELECT min(line) FROM r WHERE line > 500 "
                     "AND contains(lower(log), '\"k\": 69'))",
        "find_prev": f"WITH {EVENTS}, {ROWS} SELECT line, timestamp, file, log FROM r WHERE "
                     "line = (SELECT max(line) FROM r WHERE line < 500 "
                     "AND contains(lower(log), '\"k\": 69'))",
        "goto_line": f"WITH {EVENTS}, {ROWS} SELECT line, timestamp, file, log FROM r WHERE "
                     "line = least(321, (SELECT max(line) FROM r))",
        "goto_line_clamped": f"WITH {EVENTS}, {ROWS} SELECT line, timestamp, file, log FROM r "
                             "WHERE line = (SELECT max(line) FROM r)",
        "jump_lines": f"WITH {EVENTS}, {ROWS} SELECT line, timestamp, file, log FROM r WHERE "
                      "line = least(200, (SELECT max(line) FROM r))",
        "goto_ts_fwd": _seek_sql(1, "'2024-01-15 12:00:00.000'"),
        "goto_ts_back": _seek_sql(900, "'2024-01-02 03:04:05.500'"),
        "jump_time": _seek_sql(100, "(SELECT strftime(t::TIMESTAMP + INTERVAL 90 MINUTE, "
                                    "'%Y-%m-%d %H:%M:%S.%g') FROM here)"),
        "asof_probe_table": asof.format(op=">="),
        "asof_probe_forward": asof.format(op="<="),
        "text_gzip_lines": f"WITH {EVENTS} SELECT ts, body || ' ' || seq AS body FROM e",
        "csv_lines": """SELECT strftime(TIMESTAMP '2024-01-01' + c_custkey * INTERVAL 1 SECOND,
            '%Y-%m-%d %H:%M:%S') || ' name=' || c_name || ' nation=' ||
            CASE WHEN c_nationkey > 5 THEN c_nationkey::VARCHAR ELSE '' END ||
            ' segment=segment "' || c_mktsegment || '", key ' || c_custkey AS raw FROM customer""",
        "align_wide": f"WITH {EVENTS}, w AS ({_cells('ts')}) "
                      f"SELECT row_number() OVER (ORDER BY ts) AS line, {DISPLAY} AS timestamp, "
                      f"{', '.join(EVENT_FILES)} FROM w",
        "align_long": f"WITH {EVENTS} SELECT dense_rank() OVER (ORDER BY ts) AS line, "
                      f"{DISPLAY} AS timestamp, file AS kind, body AS log FROM e",
        "align_stats": f"""WITH {EVENTS}, m AS (SELECT file, ts FROM e)
          SELECT file AS kind, NULL::BIGINT AS n_merged, min(ts) AS first_ts, max(ts) AS last_ts
          FROM m GROUP BY file UNION ALL
          SELECT 'Overall (merged)', count(DISTINCT ts), min(ts), max(ts) FROM m""",
        "align_clip": f"WITH {EVENTS} SELECT {DISPLAY} AS timestamp, file AS kind, body AS log "
                      f"FROM e WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:30:00' "
                      "AND TIMESTAMP '2024-01-20 12:00:00.5'",
        "detect_late_line": f"WITH {EVENTS} SELECT {DISPLAY} AS timestamp, file AS kind, "
                            "body AS log FROM e",
        "align_mixed_suffixes": f"""WITH {EVENTS} SELECT {DISPLAY} AS timestamp, file AS kind,
            CASE file WHEN 'purchase' THEN 'entry=' WHEN 'signup' THEN 'entry: ' ELSE '' END
              || body AS log FROM e""",
        "csv_quoted_lines": "SELECT 'at ' || doc_id || ' lang=' || lang || ' text=' || text || "
                            "' source=' || source AS raw FROM documents",
        "csv_crlf_cells": "SELECT 'at ' || doc_id || ' text=' || replace(replace(text, chr(10), "
                          "chr(13) || chr(10)), '. ', '.' || chr(13)) || ' source=' || source "
                          "AS raw FROM documents",
        "jsonl_lines": f"""WITH {EVENTS} SELECT {DISPLAY} || ' kind: ' || file || chr(10) ||
            'user: ' || user_id || chr(10) || 'message: ' || body || chr(10) ||
            'ref: {{"id":' || seq || '}}' AS raw FROM e""",
        "packet_format": _PACKETS,
        "synthetic_log": f"WITH {EVENTS} SELECT file, count(*) AS n_lines, 0::BIGINT AS n_late, "
                         "0::BIGINT AS n_wrong FROM e GROUP BY file",
        "lines_per_cell": """SELECT doc_id,
            (length(text) - length(replace(text, chr(10), '')) + 1)::INTEGER AS n_lines,
            greatest(length(text) - length(replace(text, chr(10), '')) + 1,
              length(source) - length(replace(source, chr(10), '')) + 1)::INTEGER AS height
          FROM documents""",
        "markdown_rows": f"WITH {EVENTS}, w AS ({_HOURLY}) SELECT '| ' || {markdown} || ' |' "
                         "AS row FROM w",
        "text_table": f"""WITH w AS (SELECT greatest(max(length(doc_id::VARCHAR)), 9) AS a,
            greatest(max(length(lang)), 4) AS b, greatest(max(length(source)), 6) AS c
            FROM documents)
          SELECT rtrim(rpad(doc_id::VARCHAR, a::INTEGER, ' ') || ' | ' ||
            rpad(lang, b::INTEGER, ' ') || ' | ' || rpad(source, c::INTEGER, ' '), {BLANKS}) AS row
          FROM documents, w""",
        "csv_sink": f"WITH {EVENTS}, w AS ({_HOURLY}) SELECT {DISPLAY} AS timestamp, "
                    f"{', '.join(EVENT_FILES)} FROM w",
        "stream_records": f"WITH {CONVERSATIONS} " + collapsed.replace(
            "SELECT file,", "SELECT file::VARCHAR AS file,"),
        "stream_merge_hour": f"WITH {EVENTS} {_HOURLY}",
        "long_cell": f"""WITH {SHIPPING}, y AS (SELECT *, date_trunc('year', ts)::TIMESTAMP AS year FROM l)
          SELECT dense_rank() OVER (ORDER BY year) AS line, year AS ts, file,
            row_number() OVER (PARTITION BY file, year ORDER BY {SHIP_POSITION}) AS line_in_cell, body FROM y""",
        "markdown_long": f"""WITH {SHIPPING}, k AS (
          SELECT ts, file, replace(string_agg(body, chr(10) ORDER BY {SHIP_POSITION}), chr(10), '<br />') AS log
          FROM l GROUP BY ts, file), o AS (
          SELECT *, row_number() OVER (PARTITION BY ts ORDER BY list_position(['R', 'A', 'N'], file)) AS n FROM k)
        SELECT '| ' || CASE WHEN n = 1 THEN {DISPLAY} ELSE '' END || ' | ' || file || ' | ' || log || ' |' AS row
        FROM o""",
        "merge_order": f"""WITH {SHIPPING}, k AS (
          SELECT DISTINCT ts, file, list_position(['R', 'A', 'N'], file) - 1 AS file_no FROM l)
          SELECT row_number() OVER (ORDER BY ts, file_no) AS position, ts, file_no, file FROM k""",
        "stream_equal_times": f"""WITH {EVENTS} SELECT file, date_trunc('hour', e.ts) AS ts,
          count(*)::INTEGER AS n_lines, string_agg(body, chr(10) ORDER BY e.ts, seq) AS body
          FROM e GROUP BY file, date_trunc('hour', e.ts)""",
        "stream_idle_flush": f"""WITH {CONVERSATIONS}, p AS (
          SELECT f.*, seq >= 3 AND rec_ts IS NOT DISTINCT FROM (
            SELECT g.rec_ts FROM f g WHERE g.file = f.file AND g.seq < 3 ORDER BY g.seq DESC LIMIT 1) AS again
          FROM f)
        SELECT file::VARCHAR AS file, rec_ts AS ts, again::INTEGER AS piece, count(*)::INTEGER AS n_lines,
          string_agg(body, chr(10) ORDER BY seq) AS body FROM p GROUP BY file, rec_ts, again""",
        "stream_late": f"""WITH {EVENTS}, b AS (
          SELECT *, date_trunc('hour', ts) AS h,
            CASE WHEN seq % 10 = 0 THEN 3 WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS batch FROM e
        ), w AS (
          SELECT max(ts) FILTER (batch = 1) - INTERVAL 1 DAY AS w1,
            max(ts) FILTER (batch <= 2) - INTERVAL 1 DAY AS w2, max(ts) - INTERVAL 1 DAY AS w3 FROM b
        ), s AS (
          SELECT b.*, h + INTERVAL 1 HOUR <= w3 AS final, h + INTERVAL 1 HOUR <= CASE batch
            WHEN 1 THEN TIMESTAMP '1970-01-01' WHEN 2 THEN w1 ELSE w2 END AS late FROM b, w
        )
        SELECT false AS late, h AS ts, """ + ", ".join(
            f"coalesce(string_agg(body, chr(10) ORDER BY ts, seq) FILTER (file = '{f}'), '') AS {f}"
            for f in EVENT_FILES) + """ FROM s WHERE NOT late AND final GROUP BY h
        UNION ALL SELECT true, ts, """ + ", ".join(
            f"CASE WHEN file = '{f}' THEN body ELSE '' END" for f in EVENT_FILES) + " FROM s WHERE late",
        "stream_dst": f"""WITH {EVENTS}, n AS (
          SELECT file, seq, body, TIMESTAMP '2024-03-10' + (seq % 240)::INTEGER * INTERVAL 1 MINUTE AS t FROM e)
        SELECT t AS ts, """ + ", ".join(
            f"coalesce(string_agg(body, chr(10) ORDER BY seq) FILTER (file = '{f}'), '') AS {f}"
            for f in EVENT_FILES) + " FROM n GROUP BY t",
    }
    return found
