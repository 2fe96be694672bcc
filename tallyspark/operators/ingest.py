"""Strict reading of a ledger given as text: every problem is named, nothing is guessed."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import dates as D
from tallyspark.operators.entries import derive
from tallyspark.plans.staging import short_methods
from tallyspark.schema import (AMOUNT_COLUMNS, DATE_COLUMNS, KEYED_TEXT, LEDGER_SCHEMA, REQUIRED_COLUMNS,
                               WHOLE_COLUMNS, LedgerError)

ROW = "row_no"


def check_columns(columns: list[str]) -> None:
    missing = sorted(c for c in REQUIRED_COLUMNS if c not in columns)
    if missing:
        raise LedgerError("GL extract is missing required column(s): {}. Expected: {}".format(
            ", ".join(missing), ", ".join(REQUIRED_COLUMNS)))


def _is_text(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column] == "string"


# Cells as a ledger is written, told by their form alone; they are read without decimals of 38 digits.
_CENTS, _WHOLE = r"^-?[0-9]{1,15}[.][0-9]{2}\z", r"^[0-9]{1,18}\z"


def amount_cell(text: Column) -> Column:
    """A blank amount is 0; text, grouped digits and infinities are null."""
    plain = F.trim(text).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    exact = F.trim(text).try_cast("decimal(38,10)")
    usual = F.when(text.rlike(_CENTS), text.try_cast("decimal(18,2)"))
    return usual.when(D.is_blank(text), F.lit(0).cast("decimal(18,2)")).when(plain, F.round(exact, 2).try_cast("decimal(18,2)"))


def whole_cell(text: Column) -> Column:
    """A whole number, also when written 3.0; null for a blank, a fraction or text."""
    exact = F.trim(text).try_cast("decimal(38,10)")
    return F.when(text.rlike(_WHOLE), text.try_cast("bigint")).when(exact % 1 == 0, exact.try_cast("bigint"))


def column_formats(df: DataFrame, columns: list[str]) -> list[tuple[str | None, str | None, int | None]]:
    """The format of each date column: the one its first text cell that could be a date is in, with that cell and its row. One scan."""
    if not columns:
        return []

    def usable(raw: Column) -> Column:
        dated = ~D.is_blank(raw) & ~D.is_digits(raw) & ~D.is_clock_word(raw) & ~D.has_zone(raw) & ~D.has_zone(D.plain_meridiem(raw))
        return D.written_out(raw, *D.WRITTEN_OUT) | dated

    first = df.agg(*[F.min(F.when(usable(F.col(c)), F.struct(F.col(ROW).alias("at"), F.col(c).alias("cell")))).alias(c) for c in columns])
    row = first.select(*[F.struct(F.col(c)["at"].alias("at"), F.col(c)["cell"].alias("cell"),
                                  D.listed_format(D.plain_meridiem(F.trim(F.col(c)["cell"]))).alias("fmt")).alias(c) for c in columns]).first()
    return [(row[c]["fmt"], row[c]["cell"], row[c]["at"]) for c in columns]


def column_format(df: DataFrame, column: str) -> tuple[str | None, str | None, int | None]:
    return column_formats(df, [column])[0]


def _as_written(raw: Column, fmt: str | None) -> Column:
    """The cell as its column is read: an am or pm is written plainly where the format has one."""
    return D.plain_meridiem(F.trim(raw)) if fmt and fmt.endswith("a") else F.trim(raw)


UNREAD = "is not a readable date"
OTHER_FORMAT = "is in a different date format"
DATE_PROBLEMS = ("is blank", "carries a time zone offset", OTHER_FORMAT, UNREAD, "is a number, not a date (write YYYY-MM-DD)")


def date_cell(raw: Column, fmt: str | None) -> Column:
    """One date cell read in its column's format, or as its digits spell."""
    def otherwise(raw: Column) -> Column:
        written = _as_written(raw, fmt)
        nothing = F.lit(None).cast("timestamp_ntz")
        return (F.when(D.is_blank(raw) | D.is_clock_word(raw) | D.has_zone(written), nothing)
                .when(D.is_digits(raw), D.spelled_date(raw)).otherwise(D.read(written, fmt) if fmt else nothing))

    # the many ways of an unusual cell are kept inside one small expression
    return F.when(D.written_out(raw, fmt), raw.try_cast("timestamp_ntz")).otherwise(F.get(F.transform(F.array(raw), otherwise), F.lit(0)))


def date_class(raw: Column, fmt: str | None) -> Column:
    """Why a date cell cannot be read, or null; an unread cell in another listed format is told apart."""
    def otherwise(raw: Column) -> Column:
        written = _as_written(raw, fmt)
        return (F.when(D.is_blank(raw), "is blank").when(D.has_zone(written), "carries a time zone offset")
                .when(D.is_clock_word(raw), UNREAD)
                .when(D.is_digits(raw), F.when(D.spelled_date(raw).isNull(), DATE_PROBLEMS[4]))
                .when((D.read(written, fmt) if fmt else F.lit(None)).isNull(), _unread(raw)))

    sound = F.lit(None).cast("string")
    usual = F.when(D.written_out(raw, fmt) & raw.try_cast("timestamp_ntz").isNotNull(), sound)
    if fmt is None:  # every cell is in another format or has a problem: one written out in full needs no more than its cast
        usual = F.when(D.written_out(raw, *D.WRITTEN_OUT) & raw.try_cast("timestamp_ntz").isNotNull(), OTHER_FORMAT)
    return usual.otherwise(F.get(F.transform(F.array(raw), otherwise), F.lit(0)))


def _unread(raw: Column) -> Column:
    """Which an unread cell is: in another listed format, or in none."""
    return F.when(D.listed_format(D.plain_meridiem(F.trim(raw))).isNotNull(), OTHER_FORMAT).otherwise(UNREAD)


PROBLEM_SCHEMA = "column string, problem string, place int, rows bigint, first_row bigint, example string"


def _count_problems(df: DataFrame, found: list[tuple[str, str, int, Column]]) -> list[tuple]:
    """Rows, first row and its cell of every problem that any row has. Rows are counted by all that is wrong with them, in one number, so that
    each cell is looked at once and no problem is sorted; cells are then read on the first rows alone."""
    row = F.col(ROW) if ROW in df.columns else F.lit(None).cast("bigint")
    wrong = reduce(lambda a, b: a.bitwiseOR(b), [F.when(rule, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for _, _, i, rule in found])
    kinds = df.select(row.alias("r"), wrong.alias("wrong")).groupBy("wrong").agg(
        F.count("*").alias("rows"), F.min("r").alias("first"), F.count_if(F.col("r").isNull()).alias("unplaced"))

    def of(i: int) -> Column:
        has = F.col("wrong").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0
        return F.struct(F.sum(F.when(has, F.col("rows"))).alias("rows"), F.min(F.when(has, F.col("first"))).alias("first"),
                        F.sum(F.when(has, F.col("unplaced"))).alias("unplaced"))

    with short_methods(df.sparkSession):
        counted = kinds.agg(*[of(i).alias(f"p{i}") for _, _, i, _ in found]).first()
    counts = {i: counted[f"p{i}"] for _, _, i, _ in found if counted[f"p{i}"]["rows"]}
    if not counts:
        return []

    def cells(rows: DataFrame) -> dict[int, tuple]:
        said = F.array(*[F.when(rule, F.struct(F.lit(i).alias("place"), F.col(c).cast("string").alias("cell"))) for c, _, i, rule in found if i in counts])
        each = rows.select(row.alias("r"), F.inline(F.filter(said, lambda x: x.isNotNull()))).groupBy("place").agg(F.min(F.struct("r", "cell")).alias("first"))
        with short_methods(df.sparkSession):
            return {r["place"]: r["first"] for r in each.collect()}  # at most one row per kind of problem

    at = row.isin(sorted({c["first"] for c in counts.values() if c["first"] is not None}))
    first = cells(df.filter(at | row.isNull() if any(c["unplaced"] for c in counts.values()) else at))
    if len(first) < len(counts):  # row numbers that are not the same in every scan
        first = cells(df)
    return [(c, w, i, counts[i]["rows"], *first[i]) for c, w, i, _ in found if i in counts]


def cell_problems(df: DataFrame, formats: dict[str, str | None] | None = None) -> DataFrame:
    """Every kind of unreadable cell, as ``column, problem, place, rows, first_row, example``: one
    scan over the raw cells, and one of the rows where a problem is first."""
    check_columns(df.columns)
    formats = formats or {}
    found: list[tuple[str, str, int, Column]] = []

    def add(column: str, what: str, rule: Column) -> None:
        found.append((column, what, len(found), F.coalesce(rule, F.lit(False))))

    dated = [c for c in DATE_COLUMNS if _is_text(df, c)]
    # each date cell is classed once, ahead of the counts
    df = df.withColumns({f"_class_{c}": date_class(F.col(c), formats.get(c)) for c in dated})
    for column in REQUIRED_COLUMNS:
        raw = F.col(column)
        if not _is_text(df, column):
            if column in KEYED_TEXT or column in DATE_COLUMNS or column in WHOLE_COLUMNS:
                add(column, "is blank", raw.isNull())
        elif column in dated:
            for what in DATE_PROBLEMS:
                add(column, what, F.col(f"_class_{column}") == what)
        elif column in WHOLE_COLUMNS:
            add(column, "is blank", D.is_blank(raw))
            add(column, "is not a whole number", ~raw.rlike(_WHOLE) & ~D.is_blank(raw) & whole_cell(raw).isNull())
        elif column in AMOUNT_COLUMNS:
            add(column, "is not a number", ~raw.rlike(_CENTS) & amount_cell(raw).isNull())
        elif column in KEYED_TEXT:
            add(column, "is blank", D.is_blank(raw))
    return df.sparkSession.createDataFrame(_count_problems(df, found), PROBLEM_SCHEMA)


def blank_profile(df: DataFrame) -> DataFrame:
    """Blank cells of the keyed text columns: count and first row of each, zeros included."""
    stats = [F.struct(F.lit(c).alias("column"), F.count_if(D.is_blank(F.col(c))).alias("blanks"),
                      F.min(F.when(D.is_blank(F.col(c)), F.col(ROW))).alias("first_row")).alias(c) for c in KEYED_TEXT]
    return df.agg(*stats).select(F.inline(F.array(*KEYED_TEXT)))


def date_formats(df: DataFrame, told: Callable[[int], str] = "data row {}".format) -> tuple[dict[str, str | None], list[str]]:
    """Each text date column's format, and the columns no listed format reads."""
    formats, problems = {}, []
    columns = [c for c in DATE_COLUMNS if _is_text(df, c)]
    for column, (fmt, cell, at) in zip(columns, column_formats(df, columns), strict=True):
        formats[column] = fmt
        if cell is not None and fmt is None:
            problems.append(f"{column} is in no date format that can be read from {told(at)} ({cell[:48]!a}): write dates as YYYY-MM-DD")
        day_first = D.DAY_FIRST.get(fmt)
        if day_first:
            raw = F.col(column)
            texts = ~D.is_blank(raw) & ~D.is_digits(raw)
            whole = df.filter(texts).agg(F.count_if(D.read(F.trim(raw), day_first).isNull()).alias("no"),
                                         F.count_if(D.read(F.trim(raw), fmt).isNull()).alias("bad")).first()
            if whole["bad"] and not whole["no"]:
                problems.append(f"{column}: every cell reads as {day_first} (day first): write dates as YYYY-MM-DD")
    return formats, problems


def prepare(df: DataFrame, place: Callable[[int], str] | None = None) -> DataFrame:
    """Validate, read every cell and derive the working columns. Two cheap scans check the cells;
    what is returned is lazy. Extra columns pass through. ``place`` says where a row of some ``row_no`` is."""
    check_columns(df.columns)
    if any(_is_text(df, c) for c in DATE_COLUMNS) and ROW not in df.columns:
        df = df.withColumn(ROW, F.monotonically_increasing_id() + 1)
        passing = False
    else:
        passing = ROW in df.columns
    told = place or (lambda n: f"data row {n}")
    formats, problems = date_formats(df, told)
    rows = cell_problems(df, formats).orderBy("place").collect()  # at most one row per kind of problem
    for r in rows:
        if formats.get(r["column"], "") is None and r["problem"] in ("is in a different date format", "is not a readable date"):
            continue  # the column's own format is the problem, named above
        where = f", the first is {told(r['first_row'])}" if r["first_row"] is not None and passing else ""
        shown = "" if r["problem"] == "is blank" or r["example"] is None else f" ({r['example'][:48]!a})"
        plural = "row" if r["rows"] == 1 else "rows"
        problems.append(f"{r['column']} {r['problem']} on {r['rows']:,} {plural}{where}{shown}")
    if problems:
        raise LedgerError("cells no test can read: " + "; ".join(problems))
    out = df if passing else df.drop(ROW) if ROW in df.columns else df
    return derive(typed(out, formats))


def typed(df: DataFrame, formats: dict[str, str | None]) -> DataFrame:
    """Cells read into the contract's types; columns that already have them pass as they are."""
    cells = {}
    for field in LEDGER_SCHEMA.fields:
        raw, text = F.col(field.name), _is_text(df, field.name)
        if field.name in DATE_COLUMNS:
            cells[field.name] = date_cell(raw, formats.get(field.name)) if text else raw.cast("timestamp_ntz")
        elif field.name in WHOLE_COLUMNS:
            cells[field.name] = whole_cell(raw) if text else raw.cast("bigint")
        elif field.name in AMOUNT_COLUMNS:
            cells[field.name] = amount_cell(raw) if text else F.coalesce(F.round(raw.cast("decimal(38,10)"), 2), F.lit(0)).cast("decimal(18,2)")
        else:
            cells[field.name] = raw.cast("string")
    return df.withColumns(cells)


# -- identity ---------------------------------------------------------------------

def canonical_row() -> Column:
    """A line's required columns as one JSON list: the same from memory and from a file."""
    parts = []
    for field in LEDGER_SCHEMA.fields:
        c = F.col(field.name)
        if field.name in DATE_COLUMNS:
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        parts.append(F.nullif(c.cast("string"), F.lit("")))
    return F.to_json(F.array(*parts), {"ignoreNullFields": "false"})


#: The set hash adds up this many limbs of 15 hex digits: 240 bits, each sum exact in DECIMAL(38,0).
LIMBS, LIMB_DIGITS = 4, 15


def ledger_digest(lines: DataFrame) -> DataFrame:
    """A digest of a ledger's content that no order of rows changes and repeated rows do.

    Each row's sha256 is added up limb by limb (an additive set hash, Bellare and Micciancio,
    1997) and the sums hashed with the row count: one map-side aggregate, no sort, no shuffle.
    """
    hashed = lines.select(F.sha2(canonical_row(), 256).alias("h"))
    limb = [F.sum(F.conv(F.substring("h", LIMB_DIGITS * i + 1, LIMB_DIGITS), 16, 10).cast("bigint").cast("decimal(20,0)")).alias(f"l{i}") for i in range(LIMBS)]
    total = hashed.agg(F.count("*").alias("n"), *limb)
    text = F.concat_ws(":", F.col("n").cast("string"), *[F.coalesce(F.col(f"l{i}"), F.lit(0)).cast("string") for i in range(LIMBS)])
    return total.select(F.col("n").alias("lines"), F.concat(F.lit("csv:"), F.sha2(text, 256)).alias("ledger_id"))


def ledger_identity(lines: DataFrame, sidecar: dict | None = None) -> str:
    """The key reviews are filed under: the sidecar's ``qbo:<realm>`` where there is one, else the digest."""
    if sidecar is not None:
        found = sidecar.get("ledger_id") if isinstance(sidecar, dict) else None
        if not isinstance(found, str) or not re.fullmatch(r"qbo:[A-Za-z0-9][A-Za-z0-9_.-]*", found):
            raise LedgerError(f'an identity sidecar must hold {{"ledger_id": "qbo:<realm_id>"}}, got {found!a}')
        return found
    return ledger_digest(lines).first()["ledger_id"]
