"""CSV files read by byte ranges, against Python's reader of whole files."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dates
from tallyspark.operators import ingest
from tallyspark.plans.staging import setting
from tallyspark.schema import REQUIRED_COLUMNS, LedgerError
from tallyspark.sources import csv_records, ledger_files


SMALL = 64  # bytes of a range


@pytest.fixture
def small_ranges(monkeypatch):
    whole = csv_records.read
    monkeypatch.setattr(csv_records, "read", lambda spark, path: whole(spark, path, SMALL))


def written(rows, header=("a", "b c", "d"), end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([header, *rows])
    return out.getvalue()


def drawn(seed, n):
    draw = random.Random(seed)
    cell = lambda: "".join(draw.choice(["x", "yy", ",", '"', "\n", " ", "é", "\r\n", "\n\n", '""', "0"]) for _ in range(draw.randrange(0, 6)))
    return [(f"r{i}", cell(), cell()) for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_and_their_numbers(spark, tmp_path, small_ranges, end):
    files = {"a.csv": drawn(1, 120), "b.csv": [], "c.csv": drawn(2, 1), "d.csv": drawn(3, 60)}
    for name, rows in files.items():
        (tmp_path / name).write_bytes(written(rows, end=end).encode())
    read, place = csv_records.read(spark, str(tmp_path))
    with setting(spark, spark__sql__files__maxPartitionBytes=str(SMALL), spark__sql__files__openCostInBytes="1"):
        lines = csv_records.physical_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 20 and lines.select("file", "start").distinct().count() > 20
    got = read.orderBy("row_no").collect()
    want = [tuple(c or None for c in r) for rows in files.values() for r in rows]
    assert [tuple(r)[:3] for r in got] == want and [r["row_no"] for r in got] == list(range(1, 182))
    assert read.columns == ["a", "b c", "d", "row_no"]
    assert [place(n) for n in (1, 120, 121, 122, 181)] == ["data row 1 of a.csv", "data row 120 of a.csv", "data row 1 of c.csv", "data row 1 of d.csv", "data row 60 of d.csv"]


def test_blank_lines_and_marks(spark, tmp_path, small_ranges):
    (tmp_path / "f.csv").write_text('﻿\n\nid,t\n\n1,"a\n\n \n""b"""\n \t\n2,\n\n\n3,"x"\n4,"' + "long \n" * 100 + '"\n\n', encoding="utf-8")
    text = (tmp_path / "f.csv").read_text(encoding="utf-8").replace("﻿\n\n", "﻿")
    (tmp_path / "f.csv").write_text(text, encoding="utf-8")
    read, place = csv_records.read(spark, str(tmp_path / "f.csv"))
    assert [tuple(r) for r in read.orderBy("row_no").collect()] == [("1", 'a\n\n \n"b"', 1), ("2", None, 2), ("3", "x", 3), ("4", "long \n" * 100, 4)]
    assert place(3) == "data row 3"


def test_refusals(spark, tmp_path, small_ranges):
    def folder(name, **files):
        (tmp_path / name).mkdir()
        for k, text in files.items():
            (tmp_path / name / f"{k}.csv").write_text(text)
        return str(tmp_path / name)

    with pytest.raises(LedgerError, match="b.csv ends inside a quoted cell"):
        csv_records.read(spark, folder("open", a="x,y\n1,2\n", b='x,y\n1,"2\n'))
    with pytest.raises(LedgerError, match="the header of .*b.csv is not that of .*a.csv"):
        csv_records.read(spark, folder("head", a="x,y\n1,2\n", b="y,x\n1,2\n"))
    with pytest.raises(LedgerError, match="holds no header"):
        csv_records.read(spark, folder("none", a="\n"))
    with pytest.raises(Exception, match="(?i)malformed"):
        csv_records.read(spark, folder("wide", a="x,y\n1,2\n3,4,5\n"))[0].count()


def test_first_bad_cell_of_a_ledger(spark, tmp_path, small_ranges):
    def line(i, posted="2024-01-02", debit="5", text="t"):
        return (f"e{i}", "3000000000" if i == 7 else 1, posted, "2024-01-02 10:00", 2024, 1, "0100", "Cash", "Asset", text, debit, 0, "Manual", "ann")

    good = [line(i, text="two\nlines, \"quoted\"") for i in range(40)]
    (tmp_path / "a.csv").write_text(written(good, REQUIRED_COLUMNS))
    (tmp_path / "b.csv").write_text(written([*good[:30], line(30, debit="5 EUR"), line(31, posted="02/13/2024"), line(32, debit="x")], REQUIRED_COLUMNS))
    with pytest.raises(LedgerError) as said:
        ledger_files.load_csv(spark, str(tmp_path))
    assert "debit is not a number on 2 rows, the first is data row 31 of b.csv ('5 EUR')" in str(said.value)
    assert "posting_date is in a different date format on 1 row, the first is data row 32 of b.csv" in str(said.value)
    lines = ledger_files.load_csv(spark, str(tmp_path / "a.csv"))
    assert lines.count() == 40 and "row_no" not in lines.columns
    assert lines.where("entry_id = 'e7'").first()["line_no"] == 3_000_000_000 and lines.first()["account_code"] == "0100"
    assert ingest.ledger_digest(lines).first()["lines"] == 40


def test_labels_name_file_and_row(spark, tmp_path):
    head = ("entry_id", "is_anomaly", "anomaly_type")
    (tmp_path / "1.csv").write_text(written([("NA", "true", "a\nb"), ("0007", "0.0", "")], head))
    (tmp_path / "2.csv").write_text(written([("x", "1", ""), ("y", "maybe", "")], head))
    with pytest.raises(LedgerError, match="1 row.s. are blank or something else, the first is data row 2 of 2.csv"):
        ledger_files.load_labels(spark, str(tmp_path))
    read = ledger_files.load_labels(spark, str(tmp_path / "1.csv")).orderBy(F.desc("entry_id")).collect()
    assert [tuple(r) for r in read] == [("NA", True, "a\nb"), ("0007", False, "")]


def test_small_ranges_are_not_a_task_each(spark, tmp_path):
    rows = drawn(3, 4000)
    (tmp_path / "a.csv").write_bytes(written(rows).encode())
    with setting(spark, spark__sql__files__maxPartitionBytes=str(SMALL), spark__sql__files__openCostInBytes="1"):
        lines = csv_records.physical_lines(spark, str(tmp_path), 50)
        ranges, tasks = lines.select("start").distinct().count(), lines.select(F.spark_partition_id().alias("p")).distinct().count()
    assert ranges > 300 and tasks <= max(ranges // 50 + 1, 2 * spark.sparkContext.defaultParallelism)


def jobs_of(spark, what):
    """How many jobs it takes."""
    name = f"counted {random.random()}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        what()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_date_formats_are_found_in_one_scan(spark):
    df = spark.createDataFrame([(1, "soon", "1/2/2024"), (2, "2024-01-02 10:00:00", " "), (3, "2024-01-03", "x")], "row_no bigint, posting_date string, entered_at string")
    assert ingest.date_formats(df)[0] == {"posting_date": None, "entered_at": "M/d/yyyy"}
    assert ingest.date_formats(df.filter("row_no > 1"))[0] == {"posting_date": "yyyy-MM-dd HH:mm:ss", "entered_at": None}
    one = jobs_of(spark, lambda: ingest.column_format(df, "posting_date"))
    assert jobs_of(spark, lambda: ingest.date_formats(df.filter("row_no > 1"))) == one


def test_cells_written_out_in_full_are_read_as_the_formatter_reads_them(spark):
    said = {"2024-02-29 10:00:00": "2024-02-29 10:00:00", "2023-02-29 10:00:00": None, "2024-02-30 10:00:00": None, "2024-01-01 24:00:00": None,
            "2024-01-01 23:59:60": None, "0000-01-01 00:00:00": "0000-01-01 00:00:00", "9999-12-31 23:59:59": "9999-12-31 23:59:59", "2024-01-01 10:00:00\n": None,
            " 2024-01-01 10:00:00 ": "2024-01-01 10:00:00", "2024-01-01T10:00:00": None, "2024-01-01": None, "20240102": "2024-01-02 00:00:00", "2024-01-01 10:00:00Z": None}
    df = spark.createDataFrame([(c,) for c in said], "c string")
    fmt = "yyyy-MM-dd HH:mm:ss"
    got = df.select("c", ingest.date_cell(F.col("c"), fmt).cast("string").alias("v"), ingest.date_class(F.col("c"), fmt).alias("w")).collect()
    assert {r["c"]: r["v"] for r in got} == said
    assert {r["c"] for r in got if r["w"] is None} == {c for c, v in said.items() if v is not None}


def test_amounts_and_whole_numbers_written_plainly(spark):
    cells = {"1.00": ("1.00", 1), "-0.05": ("-0.05", None), "123456789012345.67": ("123456789012345.67", None), "1234567890123456.78": ("1234567890123456.78", None),
             "12345678901234567.89": (None, None), "1.005": ("1.01", None), "1.00\n": ("1.00", 1), "3": ("3.00", 3), "3.0": ("3.00", 3), " 7 ": ("7.00", 7), "": ("0.00", None), "1e2": ("100.00", 100)}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = df.select("c", ingest.amount_cell(F.col("c")).cast("string").alias("a"), ingest.whole_cell(F.col("c")).alias("w")).collect()
    assert {r["c"]: r["a"] for r in got} == {c: a for c, (a, _) in cells.items()}
    assert {r["c"]: r["w"] for r in got if r["w"] is not None} == {c: w for c, (_, w) in cells.items() if w is not None}


def problem_rows(spark, numbered=True):
    good = {c: "1" for c in REQUIRED_COLUMNS} | {"posting_date": "2024-01-02", "entered_at": "2024-01-02 10:00:00", "debit": "5.00", "credit": "0.00"}
    odd = [{}, {"debit": "x"}, {"posting_date": "02/13/2024", "debit": "b"}, {"posting_date": "soon"}, {"posting_date": "now", "entry_id": " "}, {"entered_at": ""}, {"posting_date": "today"}]
    rows = [tuple((good | o)[c] for c in REQUIRED_COLUMNS) + ((i,) if numbered else ()) for i, o in enumerate(odd, 1)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in REQUIRED_COLUMNS) + (", row_no bigint" if numbered else ""))


def test_date_problems_cost_no_scan_of_their_own(spark):
    df = problem_rows(spark)
    told = {"posting_date": "yyyy-MM-dd", "entered_at": "yyyy-MM-dd HH:mm:ss"}
    got = {tuple(r)[:2]: tuple(r)[3:] for r in ingest.cell_problems(df, told).collect()}
    assert got == {("debit", "is not a number"): (2, 2, "x"), ("posting_date", ingest.OTHER_FORMAT): (1, 3, "02/13/2024"), ("posting_date", ingest.UNREAD): (3, 4, "soon"),
                   ("entry_id", "is blank"): (1, 5, " "), ("entered_at", "is blank"): (1, 6, "")}
    none = {tuple(r)[:2]: tuple(r)[3:] for r in ingest.cell_problems(df).collect()}
    assert none[("posting_date", ingest.OTHER_FORMAT)] == (4, 1, "2024-01-02") and none[("entered_at", ingest.OTHER_FORMAT)] == (6, 1, "2024-01-02 10:00:00")
    unnumbered = {tuple(r)[:2]: tuple(r)[3:] for r in ingest.cell_problems(problem_rows(spark, False), told).collect()}
    assert unnumbered == {**{k: (v[0], None, v[2]) for k, v in got.items()}, ("debit", "is not a number"): (2, None, "b"), ("posting_date", ingest.UNREAD): (3, None, "now")}
    one = jobs_of(spark, lambda: ingest.cell_problems(df.filter("row_no <= 2"), told))
    assert jobs_of(spark, lambda: ingest.cell_problems(df)) == one


def test_the_format_of_a_cell_is_the_first_that_reads_it(spark):
    cells = {"2024-01-02": "yyyy-MM-dd", "2024-02-30": None, "2024-1-2": None, "+12024-01-02": "yyyy-MM-dd", "-2024-01-02": "yyyy-MM-dd", "2024-01-02 10:00:00": "yyyy-MM-dd HH:mm:ss",
             "2024-01-02t10:00": "yyyy-MM-dd'T'HH:mm", "2024-01-02 10:00:00.1": "yyyy-MM-dd HH:mm:ss.SSSSSS", "1/2/2024": "M/d/yyyy", "31/1/2024": "d/M/yyyy", "1/2/24": "M/d/yy",
             "1/2/2024 9:05 PM": "M/d/yyyy h:mm a", "1.2.2024 9:05": "d.M.yyyy H:mm", "2-JAN-24": "d-MMM-yy", "3 april 2024": "d MMMM yyyy", "April 3, 2024": "MMMM d, yyyy", "soon": None, "": None, None: None}
    df = spark.createDataFrame([(c,) for c in cells], "c string")

    def each(text):
        named = F.initcap(F.lower(text))
        return F.coalesce(*[F.when(F.try_to_timestamp(F.concat(named if "MMM" in f else text, F.lit(" +0000")), F.lit(f + " xx")).isNotNull(), f) for f in dates.FORMATS])

    got = df.select("c", dates.listed_format(F.col("c")).alias("f"), each(F.col("c")).alias("plain")).collect()
    assert {r["c"]: r["f"] for r in got} == {r["c"]: r["plain"] for r in got} == cells
