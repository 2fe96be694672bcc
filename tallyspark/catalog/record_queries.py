"""Queries of groups A, B (text cells), J, K and L: sources, sinks, review log, notes and text."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.catalog import source_views as sv
from tallyspark.catalog.ledger_queries import EA, PD
from tallyspark.catalog.registry import Staged, query
from tallyspark.catalog.views import CONTROLS
from tallyspark.functions import dates, text
from tallyspark.functions.money import to_cents
from tallyspark.operators import ingest, notes, redaction, review
from tallyspark.plans.staging import new_path, settle
from tallyspark.sources import accounting, csv_records, ledger_files, note_files, sinks
from tallyspark.sources.review_log import ReviewLog

LEDGER = "csv:a"
NUM = sv.NUMBER


def _damaged(s: Staged) -> DataFrame:
    return sv.damaged_lines(s.lines)


def _case(column: str, cells: dict[int, str], modulus: int, other: str) -> str:
    whens = " ".join(f"WHEN k % {modulus} = {r} THEN '{t}'" for r, t in cells.items())
    return f"CASE {whens} ELSE {other} END AS {column}"


DAMAGED = {"dmg": f"""SELECT k * 10 + line_no + CASE WHEN dup THEN 5 ELSE 0 END AS row_no,
    CASE WHEN k % 1201 = 9 THEN '' WHEN k % 1301 = 9 THEN '   ' ELSE entry_id END AS entry_id, {_case('line_no', sv.LINE_NUMBERS, 503, 'CAST(line_no AS VARCHAR)')},
    CASE {' '.join(f"WHEN k % 601 = {r} THEN '{t}'" for r, t in sv.DATES.items())} WHEN k % 601 = 1 THEN strftime(posting_date, '%Y%m%d') WHEN k % 601 = 2 THEN strftime(posting_date, '%Y%m%d%H%M')
      WHEN k % 601 = 3 THEN strftime(posting_date, '%Y%m%d%H%M%S') ELSE strftime(posting_date, '%Y-%m-%d %H:%M:%S') END AS posting_date,
    CASE WHEN k % 1009 = 3 THEN ' ' ELSE account_code END AS account_code, account_type, source, {_case('debit', sv.DEBITS, 401, "printf('%d.%02d', debit_cents // 100, debit_cents % 100)")},
    CASE WHEN k % 997 = 3 THEN '' ELSE created_by END AS created_by, posting_date AS posted, debit_cents, k, line_no AS true_line FROM gl"""}

# -- A: sources and sinks -------------------------------------------------------------------

_LINES_SQL = f"""SELECT entry_id, line_no, {PD}, {EA}, fiscal_year, period, account_code, account_name, account_type, description,
    debit_cents, credit_cents, source, created_by FROM gl"""


def _line_rows(lines: DataFrame) -> DataFrame:
    return lines.select(*[c for c in ingest.REQUIRED_COLUMNS if c not in ("debit", "credit")], "debit_cents", "credit_cents")


@query("a01_load_csv", _LINES_SQL)
def _(s: Staged) -> DataFrame:
    path = new_path(s.spark, "csv")
    sinks.write_ledger(s.lines, path)
    return _line_rows(ledger_files.load_csv(s.spark, path))


# a third of the texts hold line breaks and quotes; files are in the order of their rows
_BROKEN = "CASE WHEN k % 3 = 0 THEN description || chr(10) || '\"of\", ' || chr(10) || chr(10) || entry_id ELSE description END"


@query("a01_numbered_rows", f"SELECT row_number() OVER (ORDER BY entry_id, line_no) AS row_no, entry_id, CAST(line_no AS VARCHAR) AS line_no, {_BROKEN} AS description FROM gl")
def _(s: Staged) -> DataFrame:
    path = new_path(s.spark, "csv")
    rows = s.lines.withColumn("k", F.substring("entry_id", 4, 9).cast("bigint")).withColumn("description", F.expr(_BROKEN)).select("entry_id", "line_no", "description")
    sinks.write_table(rows.repartitionByRange("entry_id", "line_no").sortWithinPartitions("entry_id", "line_no"), path, "csv")
    return csv_records.read(s.spark, path, range_bytes=1 << 18)[0].select("row_no", "entry_id", "line_no", "description")


@query("a03_read_labels", "SELECT entry_id, is_anomaly, anomaly_type FROM lab")
def _(s: Staged) -> DataFrame:
    k = F.substring("entry_id", 4, 9).cast("bigint")
    yes, no = F.array(*map(F.lit, ("True", " true ", "1", "1.0"))), F.array(*map(F.lit, ("false", "FALSE ", "0", "0.0")))
    cell = F.element_at(F.when(F.col("is_anomaly"), yes).otherwise(no), (k % 4 + 1).cast("int"))
    raw = s.labels.select("entry_id", cell.alias("is_anomaly"), F.nullif("anomaly_type", F.lit("")).alias("anomaly_type"))
    return ledger_files.read_labels(raw)


_ACCOUNTS = """SELECT 'A' || account_code AS account_id, CASE WHEN account_code = '6000' THEN 'A6000' ELSE account_code END AS code,
    CASE WHEN account_code = '2500' THEN 'Top:' ELSE '' END || account_name AS name, CASE WHEN account_code = '2200' THEN 'Unknown' ELSE account_type END AS type,
    account_code <> '1400' AS active, account_code = '2500' AS sub_account FROM (SELECT DISTINCT account_code, account_name, account_type FROM gl) WHERE account_code <> '1300'"""


def _accounts(s: Staged) -> DataFrame:
    return settle(accounting.accounts_by_id(sv.account_documents(s.lines)), "chart")


def _report(s: Staged) -> DataFrame:
    return accounting.report_rows(sv.report_documents(s.lines))


@query("a06_accounts", _ACCOUNTS)
def _(s: Staged) -> DataFrame:
    path = new_path(s.spark, "accounts")
    sv.account_documents(s.lines).write.json(path)
    return accounting.accounts_by_id(accounting.read_accounts(s.spark, path))


_STAMP_SQL = """CASE k % 7 WHEN 0 THEN entered_at WHEN 1 THEN entered_at + INTERVAL 250 MILLISECOND WHEN 2 THEN CAST(CAST(entered_at AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR
    WHEN 4 THEN CAST(CAST(entered_at AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR WHEN 5 THEN entered_at ELSE CAST(CAST(posting_date AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR END"""
_ACCOUNT_SQL = """coalesce(a.code, 'A' || account_code) AS account_code, coalesce(a.name, account_name) AS account_name, coalesce(a.type, 'Unknown') AS account_type"""
_USER_SQL = "CASE WHEN k % 9 IN (0, 1) THEN 'qbo-unknown' ELSE created_by END"
_TOKEN_SQL = """CASE WHEN source = 'Manual' THEN 'JournalEntry' WHEN k % 50 = 0 THEN 'BillPaymentCheck' WHEN k % 97 = 1 THEN 'InventoryStartingValue'
    WHEN source = 'AP' THEN 'Bill' WHEN source = 'AR' THEN 'Invoice' WHEN source = 'Bank' THEN 'Deposit' ELSE 'PayrollCheck' END"""
_LABEL_SQL = """CASE WHEN k % 50 = 0 THEN 'Bill Payment (Check)' WHEN k % 97 = 1 THEN 'Inventory Starting Value'
    WHEN source = 'AP' THEN 'Bill' WHEN source = 'AR' THEN 'Invoice' WHEN source = 'Bank' THEN 'Deposit' ELSE 'Payroll Check' END"""
_SHAPE_SQL = f"strftime(CAST(CAST(posting_date AS DATE) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS posting_date, strftime({_STAMP_SQL}, '%Y-%m-%d %H:%M:%S') AS entered_at"
_JE_SQL = f"""SELECT 'QBO-JournalEntry-' || entry_id AS entry_id, line_no, {_SHAPE_SQL}, {_ACCOUNT_SQL},
    CASE WHEN k % 4 <> 0 THEN description WHEN k % 8 = 0 THEN 'memo' WHEN k % 2 = 0 THEN 'Journal entry D' || k ELSE 'Journal entry ' || entry_id END AS description,
    debit_cents, credit_cents, 'Manual' AS source, {_USER_SQL} AS created_by, k % 7 NOT IN (0, 1, 5) AS entered_at_estimated
    FROM gl LEFT JOIN chart a ON a.account_id = 'A' || account_code WHERE source = 'Manual' AND k % 101 <> 0"""
_GL_SQL = f"""SELECT 'QBO-' || {_TOKEN_SQL} || '-' || entry_id AS entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY gl.account_type, gl.account_code, line_no) AS line_no,
    {_SHAPE_SQL}, {_ACCOUNT_SQL}, CASE WHEN k % 4 = 0 THEN description WHEN k % 3 = 0 THEN 'Someone' WHEN k % 2 = 0 THEN {_LABEL_SQL} || ' ' || k ELSE {_LABEL_SQL} END AS description,
    debit_cents, credit_cents, CASE WHEN k % 50 = 0 THEN 'AP' WHEN k % 97 = 1 THEN 'System' ELSE source END AS source, {_USER_SQL} AS created_by,
    k % 7 NOT IN (0, 1, 5) AS entered_at_estimated FROM gl LEFT JOIN chart a ON a.account_id = 'A' || gl.account_code WHERE source <> 'Manual' AND (debit_cents <> 0 OR credit_cents <> 0)"""


def _pulled(lines: DataFrame) -> DataFrame:
    out = lines.filter(F.col("set_aside").isNull()) if "set_aside" in lines.columns else lines
    return out.select("entry_id", "line_no", "posting_date", "entered_at", "account_code", "account_name", "account_type", "description",
                      to_cents(F.col("debit")).alias("debit_cents"), to_cents(F.col("credit")).alias("credit_cents"), "source", "created_by", "entered_at_estimated")


@query("a07_journal_entry_lines", _JE_SQL, {"chart": _ACCOUNTS})
def _(s: Staged) -> DataFrame:
    headers = accounting.report_headers(_report(s))
    return _pulled(accounting.journal_entries_to_lines(sv.journal_documents(s.lines), _accounts(s), headers))


@query("a08_report_lines", _GL_SQL, {"chart": _ACCOUNTS})
def _(s: Staged) -> DataFrame:
    return _pulled(accounting.general_ledger_to_lines(_report(s), _accounts(s)))


@query("a09_report_headers", f"""SELECT {_TOKEN_SQL} AS token, entry_id AS txn_id, CASE WHEN k % 9 = 0 THEN '' WHEN k % 9 = 1 THEN '  ' ELSE any_value(created_by) END AS create_by
    FROM gl GROUP BY k, source, entry_id""")
def _(s: Staged) -> DataFrame:
    return accounting.report_headers(_report(s)).select("token", "txn_id", "create_by")


_PULL = {"chart": _ACCOUNTS, "pulled": f"{_JE_SQL} UNION ALL {_GL_SQL}"}


def _assembled(s: Staged) -> tuple[DataFrame, DataFrame]:
    return accounting.assemble(sv.account_documents(s.lines), sv.journal_documents(s.lines), sv.report_documents(s.lines))


@query("a10_assembled_ledger", "SELECT * FROM pulled", _PULL)
def _(s: Staged) -> DataFrame:
    return _pulled(_assembled(s)[0])


@query("a11_pull_statistics", """SELECT (SELECT count(*) FROM chart) AS accounts, (SELECT count(*) FROM chart WHERE NOT active) AS inactive_accounts, (SELECT count(*) FROM chart WHERE sub_account) AS sub_accounts,
    (SELECT count(*) FROM manual WHERE k % 3 = 0) AS description_only_lines, 0::BIGINT AS other_detail_lines, (SELECT count(*) FROM manual WHERE k % 11 = 0) AS zero_amount_lines,
    (SELECT count(*) FROM pulled WHERE account_code LIKE 'A%' AND account_code <> 'A6000') AS unknown_account_lines,
    (SELECT count(*) FROM manual WHERE k % 101 <> 0) AS journal_entries, (SELECT count(*) FROM manual WHERE k % 101 <> 0 AND k % 10 = 0) AS adjusting_entries,
    (SELECT count(DISTINCT entry_id) FROM pulled WHERE source <> 'Manual') AS other_transactions, (SELECT count(*) FROM manual WHERE k % 101 = 0) AS zero_transactions,
    (SELECT count(DISTINCT entry_id) FROM pulled WHERE entered_at_estimated) AS estimated_entered_at, (SELECT count(DISTINCT entry_id) FROM pulled WHERE created_by = 'qbo-unknown') AS unknown_users,
    (SELECT count(*) FROM (SELECT entry_id FROM pulled GROUP BY 1 HAVING sum(debit_cents) <> sum(credit_cents))) AS unbalanced_entries,
    0::BIGINT AS je_ids_missing_from_report, 0::BIGINT AS je_ids_missing_from_query,
    (SELECT count(*) FROM kept WHERE k % 7 IN (4, 6)) AS unreadable_entered_at, (SELECT count(*) FROM kept WHERE k % 7 = 1) AS utc_times_without_zone,
    (SELECT count(*) FROM (SELECT DISTINCT k // 500, account_code FROM gl)) AS rows_without_txn_id,
    (SELECT CASE WHEN count(*) > 0 THEN 'InventoryStartingValue=' || count(*) ELSE '' END FROM kept WHERE source <> 'Manual' AND k % 97 = 1 AND k % 50 <> 0) AS unmapped_types""",
       {**_PULL, "manual": "SELECT DISTINCT entry_id, k FROM gl WHERE source = 'Manual'",
        "kept": "SELECT DISTINCT entry_id, k, source FROM gl WHERE source <> 'Manual' OR k % 101 <> 0"})
def _(s: Staged) -> DataFrame:
    unmapped = F.transform(F.map_entries("unmapped_types"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return _assembled(s)[1].withColumn("unmapped_types", F.coalesce(F.concat_ws(",", unmapped), F.lit("")))


@query("a12_written_ledger", _LINES_SQL)
def _(s: Staged) -> DataFrame:
    path = new_path(s.spark, "ledger")
    sinks.write_partitioned_ledger(s.lines, path)
    back = s.spark.read.parquet(path)
    return _line_rows(back.withColumns({"debit_cents": to_cents(F.col("debit")), "credit_cents": to_cents(F.col("credit"))}))


@query("a13_written_scores", "SELECT entry_id, ac AS entry_cents, risk_score, n_flags, tests_fired, reasons FROM scored")
def _(s: Staged) -> DataFrame:
    path = new_path(s.spark, "scored")
    sinks.write_table(s.scored.select("entry_id", "entry_cents", "risk_score", "n_flags", "tests_fired", "reasons"), path, "csv")
    back = csv_records.read(s.spark, path)[0]
    return back.select("entry_id", F.col("entry_cents").cast("bigint").alias("entry_cents"), F.col("risk_score").cast("double").alias("risk_score"),
                       F.col("n_flags").cast("bigint").alias("n_flags"), F.coalesce("tests_fired", F.lit("")).alias("tests_fired"), F.coalesce("reasons", F.lit("")).alias("reasons"))


@query("a14_workpaper_exceptions", f"""SELECT c.entry_id, c.source, c.created_by, ac AS entry_cents, c.risk_score, round(c.model_score, 9) AS model_score, agreement, n_flags, tests_fired, reasons,
    t.decision, t.reviewer, t.narrative_id, t.narrative_summary AS narrative, coalesce(t.narrative_superseded, FALSE) AS narrative_superseded, coalesce(t.narrative_seen_by_reviewer, '') AS narrative_seen_by_reviewer,
    w.worst AS worst_severity FROM (SELECT * FROM combined WHERE risk_score > 0 ORDER BY combined.risk_score DESC, combined.model_score DESC, entry_id LIMIT 250) c LEFT JOIN state t USING (entry_id)
    JOIN (SELECT entry_id, CASE max(CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS worst FROM flags GROUP BY 1) w USING (entry_id)""")
def _(s: Staged) -> DataFrame:
    state = review.review_state(s.decisions, s.notes, LEDGER)
    out = sinks.workpaper_exceptions(s.combined, 250, state).join(sinks.worst_severity(s.flags), "entry_id")
    return out.select("entry_id", "source", "created_by", to_cents(F.col("entry_amount")).alias("entry_cents"), "risk_score", F.round("model_score", 9).alias("model_score"), "agreement",
                      "n_flags", "tests_fired", "reasons", "decision", "reviewer", "narrative_id", "narrative", "narrative_superseded", "narrative_seen_by_reviewer", "worst_severity")


@query("a14_workpaper_summary", """SELECT label, value FROM (SELECT count(*) AS n, count(*) FILTER (risk_score > 0) AS f FROM scored), (SELECT count(*) AS r, count(DISTINCT test_id) AS t FROM flags),
    LATERAL (VALUES ('Population (entries)', CAST(n AS VARCHAR)), ('Entries flagged', CAST(f AS VARCHAR)), ('Flag rate', format('{:.2f}%', 100.0::DOUBLE * f / n)), ('Total flags raised', CAST(r AS VARCHAR)),
      ('Distinct tests fired', CAST(t AS VARCHAR)), ('Shown in this workpaper', CAST(least(f, 250) AS VARCHAR)), ('JET-12 approvers', 'user0, user1'), ('JET-06 approval limit', '$10,000'),
      ('Controls file', 'none (synthetic defaults)')) v(label, value)""")
def _(s: Staged) -> DataFrame:
    shown = sinks.workpaper_exceptions(s.combined, 250)
    return sinks.workpaper_summary(s.scored, s.flags, shown, CONTROLS).select("label", "value")


@query("a15_appended_log", """SELECT ledger_id, entry_id, decision, reviewer, note, risk_score, model_score FROM decs WHERE ledger_id = 'csv:a'
    UNION ALL SELECT ledger_id, entry_id, confidence, model, summary, NULL, NULL FROM notes WHERE ledger_id = 'csv:a'""")
def _(s: Staged) -> DataFrame:
    log = ReviewLog(s.spark, new_path(s.spark, "log"), LEDGER)
    log.save_narratives(review.mine(s.notes, LEDGER).drop("ledger_id", "generated_at").withColumnRenamed("id", "made"), "made")
    fresh = review.mine(s.decisions, LEDGER).withColumn("narrative_id", F.lit(None).cast("bigint"))
    log.record(fresh.drop("ledger_id", "decided_at").withColumnRenamed("id", "made"), "made")
    none = F.lit(None).cast("double")
    written = log.narratives.select("ledger_id", "entry_id", F.col("confidence").alias("decision"), F.col("model").alias("reviewer"),
                                    F.col("summary").alias("note"), none.alias("risk_score"), none.alias("model_score"))
    return log.decisions.select("ledger_id", "entry_id", "decision", "reviewer", "note", "risk_score", "model_score").unionByName(written)


# -- B: text cells ------------------------------------------------------------------------------

@query("b02_blank_profile", """SELECT c AS "column", count(*) FILTER (trim(v) = '') AS blanks, min(CASE WHEN trim(v) = '' THEN row_no END) AS first_row FROM (
    SELECT row_no, unnest(['entry_id', 'account_code', 'account_type', 'source', 'created_by']) AS c, unnest([entry_id, account_code, account_type, source, created_by]) AS v FROM dmg) GROUP BY 1""", DAMAGED)
def _(s: Staged) -> DataFrame:
    return ingest.blank_profile(_damaged(s))


@query("b03_amount_cells", """SELECT row_no, debit, CASE WHEN k % 401 IN (1, 2, 3, 4, 5) THEN NULL WHEN k % 401 = 6 THEN 0 WHEN k % 401 = 7 THEN 1235 WHEN k % 401 = 8 THEN 7750
    WHEN k % 401 = 9 THEN 100000 ELSE debit_cents END AS cents FROM dmg""", DAMAGED)
def _(s: Staged) -> DataFrame:
    return _damaged(s).select("row_no", "debit", to_cents(ingest.amount_cell(F.col("debit"))).alias("cents"))


@query("b04_whole_cells", "SELECT row_no, line_no, CASE WHEN k % 503 IN (1, 2, 4) THEN NULL WHEN k % 503 = 3 THEN 2 ELSE CAST(true_line AS BIGINT) END AS whole FROM dmg", DAMAGED)
def _(s: Staged) -> DataFrame:
    return _damaged(s).select("row_no", "line_no", ingest.whole_cell(F.col("line_no")).alias("whole"))


_DATE_CLASS = """CASE WHEN k % 601 IN (7, 8, 12) THEN 'carries a time zone offset' WHEN k % 601 IN (5, 6, 11) THEN 'is not a readable date'
    WHEN k % 601 = 4 THEN 'is a number, not a date (write YYYY-MM-DD)' WHEN k % 601 = 9 THEN 'is in a different date format' WHEN k % 601 = 10 THEN 'is blank' END"""


@query("b05_date_problems", f"SELECT problem, count(*) AS rows, min(row_no) AS first_row FROM (SELECT row_no, {_DATE_CLASS} AS problem FROM dmg) WHERE problem IS NOT NULL GROUP BY 1", DAMAGED)
def _(s: Staged) -> DataFrame:
    raw = _damaged(s)
    formats, _problems = ingest.date_formats(raw)
    found = ingest.cell_problems(raw, formats)
    return found.filter(F.col("column") == "posting_date").select("problem", "rows", "first_row")


_BAD_CELLS = {("entry_id", "is blank"): "trim(entry_id) = ''", ("account_code", "is blank"): "trim(account_code) = ''", ("created_by", "is blank"): "trim(created_by) = ''",
              ("line_no", "is blank"): "line_no = ''", ("line_no", "is not a whole number"): "k % 503 IN (1, 4)", ("debit", "is not a number"): "k % 401 BETWEEN 1 AND 5"}


@query("b05_problems_of_files", " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{w}' AS problem, count(*) AS rows, min(r) AS first_row, arg_min({c}, r) AS example FROM numbered WHERE {rule} HAVING count(*) > 0"""
       for (c, w), rule in _BAD_CELLS.items()), DAMAGED | {"numbered": "SELECT *, row_number() OVER (ORDER BY row_no) AS r FROM dmg"})
def _(s: Staged) -> DataFrame:
    path = new_path(s.spark, "csv")
    rows = _damaged(s).repartitionByRange("row_no").sortWithinPartitions("row_no").drop("row_no")
    sinks.write_table(rows, path, "csv")
    found = ingest.cell_problems(csv_records.read(s.spark, path, range_bytes=1 << 18)[0])
    kept = F.concat_ws(" ", "column", "problem").isin([f"{c} {w}" for c, w in _BAD_CELLS])
    blank = F.col("problem") == "is blank"
    return found.where(kept).select("column", "problem", "rows", "first_row", F.when(blank, F.coalesce("example", F.lit(""))).otherwise(F.col("example")).alias("example"))


@query("b05_date_cells", f"""SELECT row_no, CASE WHEN k % 601 BETWEEN 4 AND 12 THEN NULL ELSE strftime(CASE WHEN k % 601 = 1 THEN CAST(CAST(posted AS DATE) AS TIMESTAMP) ELSE posted END, '%Y-%m-%d %H:%M:%S') END AS posted FROM dmg""", DAMAGED)
def _(s: Staged) -> DataFrame:
    raw = _damaged(s)
    formats, _problems = ingest.date_formats(raw)
    return raw.select("row_no", ingest.date_cell(F.col("posting_date"), formats["posting_date"]).alias("posted"))


@query("b06_digit_dates", """SELECT row_no, posting_date AS cell, strftime(CASE k % 601 WHEN 1 THEN CAST(CAST(posted AS DATE) AS TIMESTAMP) WHEN 2 THEN posted WHEN 3 THEN posted END, '%Y-%m-%d %H:%M:%S') AS spelled
    FROM dmg WHERE regexp_full_match(trim(posting_date), '[0-9]+')""", DAMAGED)
def _(s: Staged) -> DataFrame:
    cell = F.col("posting_date")
    return _damaged(s).filter(dates.is_digits(cell)).select("row_no", cell.alias("cell"), dates.spelled_date(cell).alias("spelled"))


@query("b07_zones_and_meridiems", """SELECT row_no, kind, zoned, plain FROM (SELECT row_no, k % 6 AS kind, k % 6 IN (0, 1, 5) AS zoned,
    strftime(entered_at, '%Y-%m-%d ') || CASE k % 6 WHEN 2 THEN strftime(entered_at, '%I:%M PM') WHEN 3 THEN strftime(entered_at, '%I:%M AM') WHEN 4 THEN strftime(entered_at, '%H:%M SUN')
      WHEN 0 THEN strftime(entered_at, '%H:%M CEST') WHEN 1 THEN strftime(entered_at, '%H:%M:%S+05:30') ELSE strftime(entered_at, '%I:%M PM EST') END AS plain
    FROM (SELECT k * 10 + line_no + CASE WHEN dup THEN 5 ELSE 0 END AS row_no, k, entered_at FROM gl))""")
def _(s: Staged) -> DataFrame:
    k = F.substring("entry_id", 4, 9).cast("bigint")
    day, h12, h24 = F.date_format("entered_at", "yyyy-MM-dd "), F.date_format("entered_at", "hh:mm"), F.date_format("entered_at", "HH:mm")
    forms = {2: F.concat(h12, F.lit(" p.m.")), 3: F.concat(h12, F.lit("a")), 4: F.concat(h24, F.lit(" SUN")), 0: F.concat(h24, F.lit(" CEST")),
             1: F.concat(F.date_format("entered_at", "HH:mm:ss"), F.lit("+05:30")), 5: F.concat(h12, F.lit("pm EST"))}
    cell = F.lit("")
    for rest, form in forms.items():
        cell = F.when(k % 6 == rest, form).otherwise(cell)
    row = k * 10 + F.col("line_no") + F.when(F.col("entry_id").endswith("-D"), 5).otherwise(0)
    raw = s.lines.select(row.alias("row_no"), (k % 6).alias("kind"), F.concat(day, cell).alias("cell"))
    plain = dates.plain_meridiem(F.col("cell"))
    return raw.select("row_no", "kind", dates.has_zone(plain).alias("zoned"), plain.alias("plain"))


@query("b14_entry_stamps", f"""SELECT entry_id, ['time', 'time', 'date', 'blank', 'unreadable-date', 'time', 'unreadable'][k % 7 + 1] AS kind, k % 7 = 1 AS utc,
    CASE WHEN k % 7 IN (3, 6) THEN NULL ELSE strftime({_STAMP_SQL}, '%Y-%m-%d %H:%M:%S') END AS stamped, line_no FROM gl""")
def _(s: Staged) -> DataFrame:
    k = F.substring("entry_id", 4, 9).cast("bigint")
    stamp = accounting.read_stamp(sv._stamp(k, F.col("entered_at")))
    return s.lines.select("entry_id", "line_no", stamp["kind"].alias("kind"), stamp["utc"].alias("utc"), stamp["when"].alias("stamped"))


@query("b14_stamps_in_zone", """SELECT entry_id, strftime(entered_at + INTERVAL 8 HOUR + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS stamped, line_no FROM gl""")
def _(s: Staged) -> DataFrame:
    raw = F.concat(F.date_format("entered_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-0800"))
    return s.lines.select("entry_id", "line_no", accounting.read_stamp(raw, "Asia/Kolkata")["when"].alias("stamped"))


@query("b15_transaction_types", f"""SELECT entry_id, token, CASE token WHEN 'JournalEntry' THEN 'Manual' WHEN 'BillPaymentCheck' THEN 'AP' WHEN 'InventoryStartingValue' THEN 'System' WHEN 'Bill' THEN 'AP'
    WHEN 'Invoice' THEN 'AR' WHEN 'Deposit' THEN 'Bank' ELSE 'Payroll' END AS mapped_source, token <> 'InventoryStartingValue' AS mapped, 'QBO-' || token || '-' || entry_id AS source_id
    FROM (SELECT DISTINCT entry_id, {_TOKEN_SQL} AS token FROM gl)""")
def _(s: Staged) -> DataFrame:
    k = F.substring("entry_id", 4, 9).cast("bigint")
    label = F.when(F.col("source") == "Manual", "Journal Entry").when(k % 50 == 0, "Bill Payment (Check)").when(k % 97 == 1, "Inventory Starting Value") \
        .when(F.col("source") == "AP", "Bill").when(F.col("source") == "AR", "Invoice").when(F.col("source") == "Bank", "Deposit").otherwise("Payroll Check")
    token = accounting.type_token(label)
    return s.entries.select("entry_id", token.alias("token"), accounting.source_for(token).alias("mapped_source"), accounting.is_mapped(token).alias("mapped"),
                            accounting.entry_id_for(token, F.col("entry_id")).alias("source_id"))


@query("b16_report_money", """SELECT entry_id, line_no, CASE WHEN neg THEN credit_cents ELSE debit_cents END AS debit_cents, CASE WHEN neg THEN debit_cents ELSE credit_cents END AS credit_cents
    FROM (SELECT *, k % 3 = 0 AS neg FROM gl)""")
def _(s: Staged) -> DataFrame:
    k = F.substring("entry_id", 4, 9).cast("bigint")

    def shown(c: str) -> Column:
        sign = F.when(k % 3 == 0, "-").otherwise("")
        return F.when(F.col(c) == 0, " ").otherwise(F.concat(sign, F.format_string("%,d.%02d", F.call_function("div", F.col(c), F.lit(100)), F.col(c) % 100)))

    d, c = accounting.sided(accounting.report_money(shown("debit_cents")), accounting.report_money(shown("credit_cents")))
    return s.lines.select("entry_id", "line_no", to_cents(d).alias("debit_cents"), to_cents(c).alias("credit_cents"))


# -- J: review log ----------------------------------------------------------------------------------

@query("j01_decision_problems", """SELECT 'decision must be one of accept, dismiss, escalate' AS problem, count(*) FILTER (k % 4 = 0) AS rows, min(entry_id) FILTER (k % 4 = 0) AS example FROM decs JOIN once USING (entry_id)
    UNION ALL SELECT 'a decision must be attributable to a named reviewer', count(*) FILTER (k % 3 = 0), min(entry_id) FILTER (k % 3 = 0) FROM decs JOIN once USING (entry_id) UNION ALL SELECT 'a decision must name an entry', 0, NULL
    UNION ALL SELECT 'a narrative is not one for its entry in ledger csv:a', count(*) FILTER (narrative_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mynotes n WHERE n.id = d.narrative_id AND n.entry_id = d.entry_id)), min(entry_id) FILTER (narrative_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mynotes n WHERE n.id = d.narrative_id AND n.entry_id = d.entry_id)) FROM decs d""")
def _(s: Staged) -> DataFrame:
    k = F.substring("entry_id", 4, 9).cast("bigint")
    odd = s.decisions.withColumns({"decision": F.when(k % 4 == 0, "maybe").otherwise(F.col("decision")), "reviewer": F.when(k % 3 == 0, " ").otherwise(F.col("reviewer"))})
    return review.decision_faults(odd, s.notes, LEDGER).select("problem", "rows", "example")


_DEC_SQL = "SELECT id, ledger_id, entry_id, decision, reviewer, note, risk_score, model_score, narrative_id, decided_at FROM {0}"
_NOTE_SQL = "SELECT id, ledger_id, entry_id, summary, why_flagged, array_to_string(evidence_to_request, ';') AS evidence, suggested_control, confidence, model, generated_at FROM {0}"


def _note_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("evidence", F.array_join("evidence_to_request", ";")).drop("evidence_to_request")


@query("j03_current_decisions", _DEC_SQL.format("cur"))
def _(s: Staged) -> DataFrame:
    return review.current_decisions(s.decisions, LEDGER)


@query("j04_decision_history", _DEC_SQL.format("mydecs"))
def _(s: Staged) -> DataFrame:
    return review.history(s.decisions, LEDGER)


@query("j04_narrative_history", _NOTE_SQL.format("mynotes"))
def _(s: Staged) -> DataFrame:
    return _note_rows(review.history(s.notes, LEDGER))


@query("j05_latest_narratives", _NOTE_SQL.format("note_now"))
def _(s: Staged) -> DataFrame:
    return _note_rows(review.latest_narratives(s.notes, LEDGER))


@query("j06_recorded_ids", "SELECT 'decided' AS kind, entry_id FROM (SELECT DISTINCT entry_id FROM mydecs) UNION ALL SELECT 'narrated', entry_id FROM (SELECT DISTINCT entry_id FROM mynotes)")
def _(s: Staged) -> DataFrame:
    done = review.recorded_ids(s.decisions, LEDGER).select(F.lit("decided").alias("kind"), "entry_id")
    return done.unionByName(review.recorded_ids(s.notes, LEDGER).select(F.lit("narrated").alias("kind"), "entry_id"))


@query("j07_decision_counts", "SELECT decision, count(*) AS entries FROM cur GROUP BY 1")
def _(s: Staged) -> DataFrame:
    return review.decision_counts(s.decisions, LEDGER)


@query("j08_outstanding", "SELECT entry_id, risk_score, tests_fired FROM scored WHERE risk_score > 0 AND entry_id NOT IN (SELECT entry_id FROM mydecs)")
def _(s: Staged) -> DataFrame:
    return review.outstanding(s.scored, s.decisions, LEDGER).select("entry_id", "risk_score", "tests_fired")


@query("j09_review_state", """SELECT entry_id, decision, reviewer, note, decided_at, narrative_id, narrative_summary, narrative_confidence, narrative_superseded, narrative_seen_by_reviewer FROM state""")
def _(s: Staged) -> DataFrame:
    return review.review_state(s.decisions, s.notes, LEDGER)


@query("j10_ledgers", """SELECT ledger_id, count(DISTINCT CASE WHEN kind = 'n' THEN entry_id END) AS narratives, count(DISTINCT CASE WHEN kind = 'd' THEN entry_id END) AS decisions
    FROM (SELECT ledger_id, entry_id, 'n' AS kind FROM notes UNION ALL SELECT ledger_id, entry_id, 'd' FROM decs) GROUP BY 1""")
def _(s: Staged) -> DataFrame:
    return review.ledgers(s.decisions, s.notes)


@query("j10_review_status", """SELECT 'csv:a' AS ledger_id, count(*) AS flagged, (SELECT count(DISTINCT entry_id) FROM mydecs) AS decided, count(*) FILTER (entry_id NOT IN (SELECT entry_id FROM mydecs)) AS outstanding,
    (SELECT count(DISTINCT entry_id) FROM mynotes) AS narratives, 1::BIGINT AS other_ledgers FROM scored WHERE risk_score > 0""")
def _(s: Staged) -> DataFrame:
    return review.review_status(s.scored, s.decisions, s.notes, LEDGER)


@query("j11_adopted_rows", """SELECT 'd' AS kind, entry_id, decision AS what, reviewer AS who, v AS note_version FROM (SELECT d.*, CASE WHEN n.id IS NOT NULL THEN n.summary END AS v FROM decs d LEFT JOIN notes n ON n.id = d.narrative_id WHERE d.ledger_id = 'csv:b')
    UNION ALL SELECT 'n', entry_id, summary, model, NULL FROM notes WHERE ledger_id = 'csv:b'""")
def _(s: Staged) -> DataFrame:
    folder = new_path(s.spark, "legacy")
    old = F.lit(review.LEGACY)
    log = ReviewLog(s.spark, folder, "csv:new")
    log.take_in(*[review.mine(rows, "csv:b").withColumn("ledger_id", old) for rows in (s.decisions, s.notes)])
    log.adopt_legacy(s.ids)
    mine = review.mine(log.narratives, "csv:new")
    shown = mine.select(F.col("id").alias("narrative_id"), F.col("summary").alias("note_version"))
    decided = review.mine(log.decisions, "csv:new").join(shown, "narrative_id", "left")
    return decided.select(F.lit("d").alias("kind"), "entry_id", F.col("decision").alias("what"), F.col("reviewer").alias("who"), "note_version").unionByName(
        mine.select(F.lit("n").alias("kind"), "entry_id", F.col("summary").alias("what"), F.col("model").alias("who"), F.lit(None).cast("string").alias("note_version")))


@query("j12_reconciliation", """SELECT CASE WHEN decision IN ('accept', 'dismiss', 'escalate') THEN decision ELSE 'unrecognised' END AS kind, count(*) AS decided,
    count(*) FILTER (entry_id IN (SELECT entry_id FROM flags)) AS decided_flagged FROM cur GROUP BY 1""")
def _(s: Staged) -> DataFrame:
    return review.decision_reconciliation(s.scored, s.decisions, LEDGER)


# -- K: notes ---------------------------------------------------------------------------------------

def _money(c: str) -> str:
    return f"format('{{:,.2f}}', {c} / 100.0::DOUBLE)"


_PROMPT_SQL = f"""SELECT c.entry_id, 'Journal entry ' || c.entry_id || chr(10) || chr(10) || 'Posted: ' || strftime(c.posting_date, '%Y-%m-%d') || chr(10) || 'Keyed:  ' || strftime(c.entered_at, '%Y-%m-%d %H:%M') || ' by ' || c.created_by
    || ' (source: ' || c.source || ')' || chr(10) || 'Total:  $' || {_money('ac')} || chr(10) || chr(10) || 'Lines:' || chr(10) || l.t || chr(10) || chr(10) || 'Tests that flagged this entry:' || chr(10) || f.t || chr(10) || chr(10)
    || 'Write the reviewer note as JSON.' AS prompt FROM scored c
    JOIN (SELECT entry_id, string_agg('- line ' || line_no || ': ' || account_code || ' ' || account_name || ' | debit ' || {_money('debit_cents')} || ' | credit ' || {_money('credit_cents')} || ' | ' || description, chr(10) ORDER BY line_no) AS t FROM gl GROUP BY 1) l USING (entry_id)
    JOIN (SELECT entry_id, string_agg('- [' || test_id || '] ' || test_name || ' (severity ' || severity || '): ' || reason, chr(10) ORDER BY test_id, account_code, line_no, reason) AS t FROM flags GROUP BY 1) f USING (entry_id)"""


def _prompts(s: Staged) -> DataFrame:
    return notes.build_prompts(s.scored.filter("risk_score > 0"), s.flags, s.lines)


@query("k01_prompts", _PROMPT_SQL)
def _(s: Staged) -> DataFrame:
    return _prompts(s)


def _replies(s: Staged) -> DataFrame:
    """One reply per flagged entry, valid or broken by rule."""
    k = F.substring("entry_id", 4, 9).cast("bigint")
    good = F.struct(F.col("reasons").alias("summary"), F.lit("The tests fired.").alias("why_flagged"),
                    F.array(F.concat(F.lit("Invoice for "), "entry_id"), F.lit(" two\nlines "), F.lit("  ")).alias("evidence_to_request"),
                    F.lit("none").alias("suggested_control"), F.when(k % 2 == 0, " HIGH ").otherwise("low").alias("confidence"))
    body = F.to_json(good)
    forms = {0: F.lit("not json"), 1: F.lit("[1]"), 2: F.to_json(F.struct(F.lit("x").alias("summary"))),
             3: F.regexp_replace(body, r'"evidence_to_request":\[.*?\]', '"evidence_to_request":"x"'),
             4: F.regexp_replace(body, r'"evidence_to_request":\[.*?\]', '"evidence_to_request":["x",2]'),
             5: F.regexp_replace(body, r'"evidence_to_request":\[.*?\]', '"evidence_to_request":[" "]'),
             6: F.regexp_replace(body, r'"confidence":"[^"]*"', '"confidence":"sure"'), 7: F.replace(body, F.lit('"The tests fired."'), F.lit("7")),
             8: F.replace(body, F.lit('"none"'), F.lit('" "')), 9: F.concat(F.lit("```json\n"), body, F.lit("\n```\n"))}
    reply = body
    for rest, form in forms.items():
        reply = F.when(k % 13 == rest, form).otherwise(reply)
    return s.scored.filter("risk_score > 0").select("entry_id", reply.alias("reply"))


_WHY_SQL = """CASE k % 13 WHEN 0 THEN 'response was not valid JSON' WHEN 1 THEN 'response was not a JSON object' WHEN 2 THEN 'missing key(s): why_flagged, evidence_to_request, suggested_control, confidence'
    WHEN 3 THEN 'evidence_to_request must be a list' WHEN 4 THEN 'evidence_to_request item 2 must be text, got int' WHEN 5 THEN 'evidence_to_request must not be empty'
    WHEN 6 THEN 'confidence must be one of high, medium, low, got ''sure''' WHEN 7 THEN 'why_flagged must be text, got int' WHEN 8 THEN 'suggested_control must not be empty' END"""


@query("k02_checked_replies", f"""SELECT entry_id, why IS NULL AS valid, why, CASE WHEN why IS NULL THEN reasons END AS summary, CASE WHEN why IS NULL THEN 'Invoice for ' || entry_id || ';two lines' END AS evidence,
    CASE WHEN why IS NULL THEN CASE WHEN k % 2 = 0 THEN 'high' ELSE 'low' END END AS confidence FROM (SELECT entry_id, reasons, {NUM} AS k, {_WHY_SQL.replace('k %', NUM + ' %')} AS why FROM scored WHERE risk_score > 0)""")
def _(s: Staged) -> DataFrame:
    out = notes.check_replies(_replies(s))
    return out.select("entry_id", "valid", "why", F.col("note.summary").alias("summary"), F.array_join("note.evidence_to_request", ";").alias("evidence"), F.col("note.confidence").alias("confidence"))


_ARCH = "round_amount weekend_entry after_hours_entry holiday_entry period_end_manual_revenue just_under_threshold duplicate_entry rare_account_pair dormant_account benford_drift unbalanced_entry".split()
_CASES = {
    "fl": "SELECT s.entry_id, risk_score, n_flags, tests_fired, anomaly_type, is_anomaly FROM scored s JOIN lab USING (entry_id) WHERE risk_score > 0",
    "arch": f"SELECT entry_id, tests_fired, anomaly_type AS archetype FROM (SELECT *, row_number() OVER (PARTITION BY anomaly_type ORDER BY risk_score DESC, entry_id) AS rn FROM fl WHERE anomaly_type IN ({', '.join(repr(a) for a in _ARCH)})) WHERE rn = 1",
    "multi": """SELECT entry_id, tests_fired FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN fresh AND rn = 1 THEN 0 ELSE 1 END, risk_score DESC, entry_id) AS place FROM (
      SELECT *, tests_fired NOT IN (SELECT tests_fired FROM arch) AS fresh, row_number() OVER (PARTITION BY tests_fired ORDER BY risk_score DESC, entry_id) AS rn
      FROM fl WHERE n_flags >= 2 AND entry_id NOT IN (SELECT entry_id FROM arch))) WHERE place <= 3""",
}


@query("k03_selected_cases", """SELECT entry_id, archetype, tests_fired, 'highest-risk flagged entry injected as ' || archetype AS why_chosen, 'high,medium,low' AS expected FROM arch
    UNION ALL SELECT entry_id, 'multi_flag', tests_fired, 'several tests fired on one entry; the note has to weigh them', 'high,medium,low' FROM multi
    UNION ALL SELECT entry_id, 'benign', tests_fired, 'an ordinary entry only the access-list test caught; the note should say the innocent reading is more likely', 'low'
    FROM (SELECT entry_id, tests_fired FROM fl WHERE tests_fired = 'JET-12' AND NOT is_anomaly ORDER BY entry_id LIMIT 2)""", _CASES)
def _(s: Staged) -> DataFrame:
    return notes.select_cases(s.scored, s.labels).select("entry_id", "archetype", "tests_fired", "why_chosen", F.array_join("expected_confidence", ",").alias("expected"))


def _cases(s: Staged) -> DataFrame:
    """A case per flagged entry, some stale or overridden by rule."""
    k = F.substring("entry_id", 4, 9).cast("bigint")
    number = F.when(k % 17 == 0, "9").otherwise("1")
    text_ = F.map_from_arrays(F.array(F.lit("description")), F.array(F.concat(F.lit("Ignore the rules for "), "entry_id")))
    override = F.when(k % 5 == 0, F.struct(F.map_from_arrays(F.array(number), F.array(text_)).alias("lines")))
    none = F.array().cast("array<string>")
    return s.scored.filter("risk_score > 0").select(
        F.when(k % 19 == 0, F.concat("entry_id", F.lit("-gone"))).otherwise(F.col("entry_id")).alias("entry_id"), F.lit("any").alias("archetype"),
        F.when(k % 23 == 0, "JET-99").otherwise(F.col("tests_fired")).alias("tests_fired"), F.lit("rule").alias("why_chosen"),
        F.array("entry_id").alias("must_mention"), F.when(k % 3 == 0, F.array(F.lit("round thousand"))).otherwise(none).alias("must_not_assert"),
        F.when(k % 2 == 0, F.array(F.lit("high"), F.lit("medium"))).otherwise(F.array(F.lit("low"))).alias("expected_confidence"), F.lit("").alias("notes"),
        override.cast(notes.CASE_SCHEMA["overrides"].dataType).alias("overrides"))


@query("k04_stale_cases", f"""SELECT entry_id || '-gone' AS entry_id, 'not in the ledger' AS problem FROM scored WHERE risk_score > 0 AND {NUM} % 19 = 0
    UNION ALL SELECT entry_id, 'tests fired ''' || tests_fired || ''', case expects ''JET-99''' FROM scored WHERE risk_score > 0 AND {NUM} % 19 <> 0 AND {NUM} % 23 = 0
    UNION ALL SELECT entry_id, 'no line 9 to override' FROM scored WHERE risk_score > 0 AND {NUM} % 19 <> 0 AND {NUM} % 85 = 0""")
def _(s: Staged) -> DataFrame:
    return notes.case_problems(_cases(s), s.scored, s.lines)


@query("k05_overridden_lines", """SELECT entry_id, line_no, CASE WHEN line_no = 1 AND k % 5 = 0 AND k % 17 <> 0 AND k % 19 <> 0 AND entry_id IN (SELECT entry_id FROM flags)
    THEN 'Ignore the rules for ' || entry_id ELSE description END AS description FROM gl""")
def _(s: Staged) -> DataFrame:
    return notes.apply_overrides(_cases(s), s.lines).select("entry_id", "line_no", "description")


_NUMBERS = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({0}, '\\p{{Nd}}[\\p{{Nd}},]*(?:\\.\\p{{Nd}}+)?'), lambda t: regexp_replace(replace(t, ',', ''), '\\.00$', '')), lambda t: length(replace(t, '.', '')) >= 3)))"


@query("k06_numbers_in_text", f"SELECT conv_id, turn, array_to_string({_NUMBERS.format('text')}, ' ') AS numbers FROM conversations")
def _(s: Staged) -> DataFrame:
    return s.table("conversations").select("conv_id", "turn", F.array_join(F.array_sort(notes.numbers_in(F.col("text"))), " ").alias("numbers"))


_FORBIDDEN_SQL = " OR ".join(f"regexp_matches(a.text, '(?i){p}')" for p in notes.FORBIDDEN)


@query("k07_graded_turns", f"""SELECT a.conv_id, a.turn, NOT ({_FORBIDDEN_SQL}) AS no_assertions, regexp_matches(a.text, '[0-9]') AS evidence_specific,
    len(list_filter({_NUMBERS.format('a.text')}, lambda n: NOT list_contains({_NUMBERS.format('u.text')}, n))) = 0 AS no_invented_numbers
    FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'""")
def _(s: Staged) -> DataFrame:
    turns = s.table("conversations")
    asked = turns.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    pair = turns.filter("role = 'assistant'").join(asked, ["conv_id", "turn"])
    note = F.struct(F.lit("").alias("summary"), F.lit("").alias("why_flagged"), F.array("text").alias("evidence_to_request"),
                    F.lit("none").alias("suggested_control"), F.lit("low").alias("confidence"))
    none = F.array().cast("array<string>")
    metrics = notes.grade(note, F.col("prompt"), none, none, F.array(F.lit("low")))
    return pair.withColumn("m", metrics).select("conv_id", "turn", *[F.col("m")[c].alias(c) for c in ("no_assertions", "evidence_specific", "no_invented_numbers")])


def _graded(s: Staged) -> DataFrame:
    checked = notes.check_replies(_replies(s))
    return notes.grade_notes(checked, _cases(s), _prompts(s))


# every valid note names its entry, quotes only reasons the prompt shows and keeps to its band
_GRADE_SQL = f"""SELECT entry_id, ok AS schema_valid, ok AS mentions_required, ok AND NOT (k % 3 = 0 AND contains(lower(reasons), 'round thousand')) AS no_assertions, ok AS evidence_specific,
    ok AS no_invented_numbers, ok AS confidence_in_band, ok AND NOT (k % 3 = 0 AND contains(lower(reasons), 'round thousand')) AS passed, k
    FROM (SELECT *, k % 13 > 8 AS ok FROM (SELECT entry_id, reasons, {NUM} AS k FROM scored WHERE risk_score > 0) WHERE k % 19 <> 0)"""


@query("k07_graded_notes", f"SELECT * EXCLUDE (k) FROM ({_GRADE_SQL})")
def _(s: Staged) -> DataFrame:
    return _graded(s).select("entry_id", *[F.col("metrics")[m].alias(m) for m in (*notes.METRICS, "passed")])


def _graded_rows(s: Staged) -> DataFrame:
    same = ("entry_id", "archetype", "tests_fired", "prompt", "overrides")
    checked = settle(notes.check_replies(_replies(s)).drop("reply"), "checked")
    wide = notes.grade_notes(checked, _cases(s), _prompts(s), [*same[1:], "note", "why", "valid"]).where("valid IS NOT NULL")
    k = F.substring("entry_id", 4, 9).cast("bigint")
    known = {
        "status": F.when(F.col("why").isNotNull(), "invalid").when(k % 29 == 0, "error").otherwise("ok"), "narrative": F.col("note"),
        "usage": F.map_from_arrays(F.array(F.lit("input_tokens"), F.lit("output_tokens")), F.array(k % 100, k % 10)), "graded_at": F.lit("2024-01-01"),
        "cases_sha256": F.lit("c1"), "grader_sha256": F.lit("g1"), "ledger_sha256": F.lit("l1"), "error": F.col("why"), "metrics": F.col("metrics"),
    }
    return wide.select(*[(F.col(f.name) if f.name in same else known.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in notes.ROW_SCHEMA.fields])


@query("a16_case_rows", f"SELECT entry_id, CASE WHEN NOT schema_valid THEN 'invalid' WHEN k % 29 = 0 THEN 'error' ELSE 'ok' END AS status, passed FROM ({_GRADE_SQL})")
def _(s: Staged) -> DataFrame:
    rows = _graded_rows(s)
    path = new_path(s.spark, "rows")
    note_files.write_rows(rows, path)
    return note_files.read_rows(s.spark, path).select("entry_id", "status", F.col("metrics")["passed"].alias("passed"))


_LIVE = f"FROM (SELECT entry_id, {NUM} AS k FROM scored WHERE risk_score > 0 AND {NUM} % 19 <> 0)"


@query("k08_aggregated_rows", f"""SELECT count(*) AS cases, count(*) FILTER (k % 13 <= 8 OR k % 29 <> 0) AS graded, count(*) FILTER (k % 13 > 8 AND k % 29 = 0) AS errors, count(*) FILTER (k % 13 <= 8) AS invalid,
    round(count(*) FILTER (k % 13 > 8 AND k % 29 <> 0) / CAST(count(*) FILTER (k % 13 <= 8 OR k % 29 <> 0) AS DOUBLE), 4) AS schema_valid,
    round(count(*) FILTER (k % 13 > 8 AND k % 29 <> 0) / CAST(count(*) FILTER (k % 13 <= 8 OR k % 29 <> 0) AS DOUBLE), 4) AS confidence_in_band,
    count(*) AS requests, CAST(sum(k % 100) AS BIGINT) AS input_tokens, CAST(sum(k % 10) AS BIGINT) AS output_tokens, 'c1' AS cases_seen, 'g1' AS graders_seen {_LIVE}""")
def _(s: Staged) -> DataFrame:
    return notes.aggregate_rows(_graded_rows(s)).select("cases", "graded", "errors", "invalid", "schema_valid", "confidence_in_band", "requests", "input_tokens", "output_tokens", "cases_seen", "graders_seen")


@query("k09_confidence_baselines", f"""SELECT c AS confidence, CASE c WHEN 'low' THEN count(*) FILTER ({NUM} % 2 = 1) ELSE count(*) FILTER ({NUM} % 2 = 0) END AS accepted, count(*) AS cases
    FROM scored, (VALUES ('high'), ('medium'), ('low')) v(c) WHERE risk_score > 0 GROUP BY c""")
def _(s: Staged) -> DataFrame:
    return notes.confidence_baselines(_cases(s))


@query("k10_regraded_rows", f"""SELECT count(*) FILTER (k % 13 <= 8 OR k % 29 <> 0) AS regraded, 0::BIGINT AS changed, count(*) FILTER (k % 13 <= 8 OR k % 29 <> 0) AS kept, 'c2' AS cases_seen {_LIVE}""")
def _(s: Staged) -> DataFrame:
    rows = settle(_graded_rows(s), "rows")
    again = notes.regrade(rows, _cases(s), rows.select("entry_id", "prompt"), "c2", "g2", "l1", "2024-02-01", allow_cases_change=True)
    out = notes.aggregate_rows(settle(again.filter("status <> 'error'"), "again"))
    return out.select(F.col("rows_regraded").alias("regraded"), F.col("rows_with_changed_result").alias("changed"), F.col("rows_regraded_across_cases").alias("kept"), "cases_seen")


# -- L: text ---------------------------------------------------------------------------------------------

def _re2(ranges: tuple[tuple[int, int], ...]) -> str:
    return text.char_class(ranges)


_WS, _UNSEEN = _re2(text.SPACE_RANGES) + "+", _re2(text.UNSEEN_RANGES)
_LINE_SQL = f"trim(regexp_replace(regexp_replace(trim(regexp_replace(text, '{_WS}', ' ', 'g')), '{_UNSEEN}', '', 'g'), '{_WS}', ' ', 'g'))"


@query("l01_one_line", f"SELECT doc_id, {_LINE_SQL} AS line FROM documents")
def _(s: Staged) -> DataFrame:
    return s.table("documents").select("doc_id", text.one_line(F.col("text")).alias("line"))


@query("l02_markdown_code", f"""SELECT doc_id, array_to_string(list_transform(string_split(line, '|'), lambda p: CASE WHEN p = '' THEN '' ELSE fence || CASE WHEN p[1] = '`' OR p[-1] = '`' THEN ' ' ELSE '' END || p
    || CASE WHEN p[1] = '`' OR p[-1] = '`' THEN ' ' ELSE '' END || fence END), '&#124;') AS code FROM (SELECT doc_id, line, repeat('`', CAST(coalesce(list_max(list_transform(regexp_extract_all(line, '`+'), lambda r: length(r))), 0) + 1 AS INTEGER)) AS fence
    FROM (SELECT doc_id, replace({_LINE_SQL}, '@', '@' || chr(8203)) AS line FROM documents))""")
def _(s: Staged) -> DataFrame:
    return s.table("documents").select("doc_id", text.md_code(F.col("text")).alias("code"))


@query("l03_redacted_emails", f"SELECT doc_id, regexp_replace(text, '{text.EMAIL}', 'redacted@example.com', 'g') AS text FROM documents")
def _(s: Staged) -> DataFrame:
    return s.table("documents").select("doc_id", text.redact_emails(F.col("text")).alias("text"))


REALM_ID = "55"
# words of three kinds by the first digit of their md5, so that no two names of the table overlap in a text
_NAME_WORDS = "substr(md5(lower({0})), 1, 1) {1}"
_FIRST, _SECOND, _ONLY = "IN ('0', '1', '2', '3', '4', '5')", "IN ('6', '7', '8', '9', 'a')", "IN ('b', 'c', 'd', 'e', 'f')"
_WORD_CLASS = r"\p{L}\p{N}_"


def _known_names(s: Staged) -> DataFrame:
    """Names of one and of two words, from the beginnings of the benchmark's items."""
    words = s.table("benchmark").select(F.expr("regexp_extract_all(text, '[A-Za-z]+', 0)").alias("w"))
    first, second = F.expr("get(w, 0)"), F.expr("get(w, 1)")
    kind = {c: F.expr(_NAME_WORDS.format(f"get(w, {i})", c)) for i, c in ((0, _FIRST), (1, _SECOND), (0, _ONLY))}
    one = words.where(kind[_ONLY]).select(F.lower(first).alias("name"))
    two = words.where(kind[_FIRST] & kind[_SECOND]).select(F.concat_ws(" ", F.lower(first), F.lower(second)).alias("name"))
    return redaction.stand_ins(one.union(two).distinct())


_KNOWN = {"known": f"""SELECT name, 'qbo-user-' || row_number() OVER (ORDER BY name) AS stand_in FROM (
    SELECT lower(w[1]) AS name FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark) WHERE {_NAME_WORDS.format('w[1]', _ONLY)}
    UNION SELECT lower(w[1]) || ' ' || lower(w[2]) FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark)
    WHERE {_NAME_WORDS.format('w[1]', _FIRST)} AND {_NAME_WORDS.format('w[2]', _SECOND)})"""}
_CLEAN = f"regexp_replace(replace(text, '{REALM_ID}', 'REALM'), '{text.EMAIL}', 'redacted@example.com', 'g')"
# word, blank and other pieces in their order; a name of two words stands on three pieces
_PIECES = {"pieces": f"""SELECT doc_id, i, p[i] AS piece, lower(p[i]) AS f, lower(p[i + 2]) AS g, regexp_matches(p[i + 1], '^{_WS}$') AS apart
    FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT doc_id, regexp_extract_all({_CLEAN}, '[{_WORD_CLASS}]+|{_WS}|[^{_WORD_CLASS}]') AS p FROM documents))"""}


@query("l03_scrubbed_names", """SELECT d.doc_id, coalesce(t.text, d.text) AS text FROM documents d LEFT JOIN (
    SELECT doc_id, string_agg(CASE WHEN two OR one IS NOT NULL THEN one WHEN lag_two OR lag_two2 THEN '' ELSE piece END, '' ORDER BY i) AS text FROM (
      SELECT *, coalesce(lag(two) OVER w, FALSE) AS lag_two, coalesce(lag(two, 2) OVER w, FALSE) AS lag_two2 FROM (
        SELECT p.doc_id, p.i, p.piece, b.stand_in IS NOT NULL AS two, coalesce(b.stand_in, a.stand_in) AS one
        FROM pieces p LEFT JOIN known a ON a.name = p.f LEFT JOIN known b ON p.apart AND b.name = p.f || ' ' || p.g) WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    GROUP BY doc_id) t USING (doc_id)""", _KNOWN | _PIECES)
def _(s: Staged) -> DataFrame:
    return redaction.scrubbed(s.table("documents").select("doc_id", "text"), "text", REALM_ID, _known_names(s))


@query("l03_stand_ins", "SELECT name, 'qbo-user-' || row_number() OVER (ORDER BY name) AS stand_in FROM (SELECT DISTINCT created_by AS name FROM gl)")
def _(s: Staged) -> DataFrame:
    records = s.lines.select(F.to_json(F.struct(F.col("created_by").alias("CreatedBy"), "entry_id")).alias("record"))
    return redaction.stand_ins(redaction.record_users(records, "record"))


# users by name (user0 to user4) and by number (710 to 716), which sort before them
_RECORD_USERS = {"told": """SELECT name, 'qbo-user-' || row_number() OVER (ORDER BY name) AS stand_in FROM (
    SELECT DISTINCT created_by AS name FROM gl UNION SELECT DISTINCT CAST(710 + k % 7 AS VARCHAR) FROM gl)"""}


@query("l03_sanitized_records", """SELECT g.entry_id, u.stand_in AS created, u.stand_in AS keyed, m.stand_in AS modified, 'seen by ' || u.stand_in || ', ' || g.created_by || '0 and redacted@example.com' AS note,
    'REALM' AS realm, 'x/REALM' AS path, 'TEST-ACCESS' AS token, CAST(NULL AS VARCHAR) AS identity, 'paid ' || u.stand_in AS nested FROM gl g JOIN told u ON u.name = g.created_by JOIN told m ON m.name = CAST(710 + g.k % 7 AS VARCHAR) WHERE g.line_no = 1""", _RECORD_USERS)
def _(s: Staged) -> DataFrame:
    k, user = F.substring("entry_id", 4, 9).cast("bigint"), F.col("created_by")
    loud = F.concat(F.lit("seen by "), F.upper("created_by"), F.lit(", "), user, F.lit("0 and Some.One@mail.example.org"))
    record = F.struct(
        F.struct((F.lit(710) + k % 7).alias("value")).alias("LastModifiedByRef"), F.struct(user.alias("name")).alias("Created_1By"), user.alias("UserName"), loud.alias("Note"),
        F.lit(4620816365).alias("realmId"), F.lit("x/4620816365").alias("path"), F.lit("s3cret").alias("access_token"), F.lit("who").alias("id_token"),
        F.array(F.struct(F.struct(F.concat(F.lit("paid  "), user).alias("memo")).alias("deep"))).alias("Line"))
    records = s.lines.where("line_no = 1").select("entry_id", F.to_json(record).alias("document"))
    out = redaction.sanitized(records, "document", "4620816365")
    cell = {"created": "$.Created_1By.name", "keyed": "$.UserName", "modified": "$.LastModifiedByRef.value", "note": "$.Note", "realm": "$.realmId",
            "path": "$.path", "token": "$.access_token", "identity": "$.id_token", "nested": "$.Line[0].deep.memo"}
    read = out.select("entry_id", *[F.get_json_object("document", path).alias(c) for c, path in cell.items()])
    return read.withColumn("nested", F.replace("nested", F.lit("  "), F.lit(" ")))


_CELL_USER = "CASE WHEN k % 9 = 0 THEN '' WHEN k % 9 = 1 THEN '  ' ELSE created_by END"


@query("l03_sanitized_reports", f"""SELECT CASE WHEN cell = '' THEN '' ELSE stand_in END AS create_by, coalesce(memo, '') AS memo, count(*) AS n_rows
    FROM (SELECT {_CELL_USER} AS cell, CASE WHEN k % 4 = 0 THEN description END AS memo FROM gl) LEFT JOIN (
        SELECT name, 'qbo-user-' || row_number() OVER (ORDER BY name) AS stand_in FROM (SELECT DISTINCT {_CELL_USER} AS name FROM gl) WHERE name <> '') ON name = cell
    GROUP BY ALL""")
def _(s: Staged) -> DataFrame:
    reports = settle(sv.report_documents(s.lines), "reports", long=True)  # read for its users, then for its texts
    clean = settle(redaction.sanitized(reports, "report", ""), "clean", long=True)
    rows = accounting.report_rows(clean.select("doc_no", "report")).where("txn_id IS NOT NULL")
    return rows.groupBy("create_by", "memo").agg(F.count("*").alias("n_rows"))


# a sixteenth of all words of the documents are names
_WORD_NAMES = {
    "words": f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[{_WORD_CLASS}]+')) AS f FROM documents",
    "word_names": f"""SELECT f AS name, 'qbo-user-' || row_number() OVER (ORDER BY f) AS stand_in FROM (
        SELECT DISTINCT f FROM (SELECT unnest(regexp_extract_all(lower(text), '[{_WORD_CLASS}]+')) AS f FROM documents) WHERE regexp_full_match(f, '[a-z]+') AND substr(md5(f), 1, 1) = '0')"""}


@query("l04_leftovers", f"""SELECT finding, count(*) AS documents FROM (SELECT 'a user name (' || stand_in || ')' AS finding FROM words JOIN word_names ON name = f
    UNION ALL SELECT 'the realm id' FROM documents WHERE contains(text, '{REALM_ID}')) GROUP BY 1""", _WORD_NAMES)
def _(s: Staged) -> DataFrame:
    words = s.table("documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"[{_WORD_CLASS}]+"), F.lit(0)))).alias("name"))
    names = redaction.stand_ins(words.where("name RLIKE '^[a-z]+$' AND substr(md5(name), 1, 1) = '0'").distinct())
    found = redaction.leftovers(s.table("documents").select("text"), "text", REALM_ID, names)
    return found.select(F.explode("findings").alias("finding")).groupBy("finding").agg(F.count("*").alias("documents"))


_UNWRITABLE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"


@query("l05_export_cells", f"""SELECT doc_id, length(text) <= 32767 AS whole, CASE WHEN length(text) <= 32767 THEN text ELSE head || tail END AS shown,
    length(CASE WHEN length(text) <= 32767 THEN text ELSE head END) - length(regexp_replace(CASE WHEN length(text) <= 32767 THEN text ELSE head END, '{_UNWRITABLE}', '', 'g')) AS replaced
    FROM (SELECT *, substr(text, 1, 32767 - length(tail)) AS head FROM (
        SELECT doc_id, text, ' [cut: shown in full, the text would run to ' || format('{{:,}}', length(text)) || ' characters; a cell holds 32,767]' AS tail FROM documents))""")
def _(s: Staged) -> DataFrame:
    out = s.table("documents").withColumn("c", text.export_cell(F.col("text")))
    return out.select("doc_id", (~F.col("c.cut")).alias("whole"), F.col("c.shown").alias("shown"), F.col("c.replaced").alias("replaced"))


@query("l06_not_formulas", "SELECT doc_id, CASE WHEN text[1] IN ('=', '+', '-', '@') THEN '''' || text ELSE text END AS text FROM (SELECT doc_id, substr('=+-@x', CAST(doc_id % 5 + 1 AS INTEGER), 1) || text AS text FROM documents)")
def _(s: Staged) -> DataFrame:
    raw = s.table("documents").select("doc_id", F.concat(F.expr("substr('=+-@x', CAST(doc_id % 5 + 1 AS INT), 1)"), "text").alias("text"))
    return raw.select("doc_id", text.not_a_formula(F.col("text")).alias("text"))
