from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import functions as F

from timeloom.plans.align import align
from timeloom.sinks.tables import (
    column_widths,
    markdown_header,
    markdown_rows,
    show,
    text_rows,
    write_csv,
    write_markdown,
    write_text,
)

from logs import MULTILINE, TEN


def part_lines(folder: Path) -> list[str]:
    """Lines of all part files in the order of their names, the header first."""
    files = [*sorted(folder.glob("part-*")), *sorted(folder.glob("body/part-*"))]
    return [line for f in files for line in f.read_text().splitlines()]


def merged(spark, write, **options):
    a = write("a.log", [*MULTILINE, "2023-07-14 08:00:23 a | b  "])
    b = write("b.log", ["2023-07-14 08:00:05   <indented>", *TEN[:2]])
    found = align(spark, [a, b])
    wide = found.wide(**options)
    names = {a: "a", b: "b"}
    return wide.withColumnsRenamed(names), found


def expected(wide):
    rows = wide.orderBy(F.col("ts").asc_nulls_first(), "part").collect()
    return [{k: str(v) for k, v in r.asDict().items() if k not in ("ts", "part")} for r in rows]


def test_csv_round_trip(spark, write, tmp_path):
    wide, _ = merged(spark, write, line_numbers=True)
    folder = tmp_path / "csv"
    write_csv(wide, str(folder))
    rows = []
    for part in sorted(folder.glob("part-*")):
        with part.open(newline="") as f:
            rows += list(csv.DictReader(f))
    assert rows == expected(wide)
    assert any("\n" in r["a"] for r in rows) and any(r["b"].startswith("  <") for r in rows)


def test_markdown(spark, write, tmp_path):
    wide, found = merged(spark, write)
    folder = tmp_path / "md"
    write_markdown(wide, str(folder))
    lines = part_lines(folder)
    assert lines[:2] == ["| timestamp | a | b |", "|---|---|---|"]
    assert markdown_header(["line", "x"])[1] == "|---:|---|"

    def row(r):
        cells = [r[k].replace("\n", "<br />").replace("|", "\\|") for k in ("timestamp", "a", "b")]
        return "| " + " | ".join(cells) + " |"

    assert lines[2:] == [row(r) for r in expected(wide)]
    long = markdown_rows(found.long(line_numbers=True))
    assert long.count() == 13


def test_repeated_time_is_blank_in_markdown(spark):
    df = spark.sql("select '08:00' as timestamp, timestamp_ntz'2024-01-01' as ts, "
                   "id as part, cast(id as string) as a from range(2)")
    got = [r.row for r in markdown_rows(df).orderBy("part").collect()]
    assert got == ["| 08:00 | 0 |", "|  | 1 |"]


def test_times_that_show_the_same_are_blank_in_one_folder(spark, tmp_path):
    """Exact times a tenth of a millisecond apart, and several sources at one time."""
    df = spark.sql("""select date_format(t, 'yyyy-MM-dd HH:mm:ss.SSS') as timestamp, t as ts, 0 as part, n as file_no,
      f as file from values (timestamp_ntz'2024-01-01 00:00:00.0001', 0, 'x'), (timestamp_ntz'2024-01-01 00:00:00.0002',
      0, 'y'), (timestamp_ntz'2024-01-01 00:00:00.0002', 1, 'z'), (timestamp_ntz'2024-01-01 00:00:00.001', 0, 'w')
      as v(t, n, f)""")
    blank = spark.createDataFrame([("", None, 0, 0, "first"), ("", None, 0, 1, "second")],
                                  "timestamp string, ts timestamp_ntz, part int, file_no int, file string")
    write_markdown(df.union(blank).repartition(4), str(tmp_path / "md"))
    rows = [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert sorted(rows) == sorted([
        "| timestamp | file |", "|---|---|", "|  | first |", "|  | second |", "| 2024-01-01 00:00:00.000 | x |",
        "|  | y |", "|  | z |", "| 2024-01-01 00:00:00.001 | w |"])
    assert part_lines(tmp_path / "md") == [
        "| timestamp | file |", "|---|---|", "|  | first |", "|  | second |", "| 2024-01-01 00:00:00.000 | x |",
        "|  | y |", "|  | z |", "| 2024-01-01 00:00:00.001 | w |"]


def test_aligned_text(spark, write, tmp_path):
    wide, _ = merged(spark, write, line_numbers=True)
    folder = tmp_path / "txt"
    write_text(wide, str(folder))
    rows = expected(wide)
    names = ["line", "timestamp", "a", "b"]
    widths = {n: max(len(n), *(len(x) for r in rows for x in r[n].split("\n"))) for n in names}
    assert column_widths(wide).first().asDict() == widths

    def pad(name, text):
        return text.rjust(max(4, widths[name])) if name == "line" else text.ljust(widths[name])

    want = [" | ".join(pad(n, n) for n in names).rstrip()]
    for r in rows:
        cells = [r[n].split("\n") for n in names]
        for i in range(max(map(len, cells))):
            want.append(" | ".join(
                pad(n, c[i] if i < len(c) else "") for n, c in zip(names, cells, strict=True)
            ).rstrip())
    assert part_lines(folder) == want
    assert text_rows(wide, widths).count() == len(want) - 1


def test_show(spark, write, capsys):
    wide, _ = merged(spark, write)
    show(wide, 3)
    out = capsys.readouterr().out
    assert "2023-07-14 08:00:01.000" in out and "08:00:19" not in out
