"""Files, the accounting source, the review log, notes and text on hand-made inputs."""

from __future__ import annotations

import json
from datetime import datetime
from decimal import Decimal

import pytest
from conftest import entry
from pyspark.sql import functions as F

from tallyspark.catalog import registry, views
from tallyspark.catalog import source_views as sv
from tallyspark.functions import dates, text
from tallyspark.operators import ingest, notes, review
from tallyspark.plans.staging import settle
from tallyspark.schema import REQUIRED_COLUMNS, LedgerError
from tallyspark.sources import accounting, ledger_files, note_files, sinks
from tallyspark.sources.review_log import ReviewLog

GOOD = dict(entry_id="JE-1", line_no="1", posting_date="2024-01-15", entered_at="2024-01-15 09:30", fiscal_year="2024", period="1",
            account_code="0100", account_name="Cash", account_type="Asset", description="NA", debit="12.5", credit="", source="Manual", created_by="NA")


def raw(spark, *changes):
    rows = [tuple([i] + [{**GOOD, **c}[n] for n in REQUIRED_COLUMNS]) for i, c in enumerate(changes, 1)]
    return spark.createDataFrame(rows, "row_no bigint, " + ", ".join(f"{n} string" for n in REQUIRED_COLUMNS))


def test_sound_cells_are_read_as_written(spark):
    row = ingest.prepare(raw(spark, {}, {"posting_date": "20240115"}, {"posting_date": "20240115093000", "debit": "-3", "line_no": "2.0"})).orderBy("row_no").collect()
    assert (row[0]["account_code"], row[0]["created_by"], row[0]["description"], row[0]["credit"], row[0]["debit"]) == ("0100", "NA", "NA", Decimal("0.00"), Decimal("12.50"))
    assert row[0]["posting_date"] == row[1]["posting_date"] == datetime(2024, 1, 15) and row[2]["posting_date"] == datetime(2024, 1, 15, 9, 30)
    assert (row[0]["entered_hour"], row[0]["entered_dow"], row[0]["posting_lag_days"], row[2]["line_no"]) == (9, 0, 0, 2)


@pytest.mark.parametrize("change, said", [
    ({"entry_id": "  "}, "entry_id is blank on 1 row, the first is data row 2"), ({"debit": "1,234.00"}, "debit is not a number on 1 row.*'1,234.00'"),
    ({"debit": "inf"}, "debit is not a number"), ({"credit": "#N/A"}, "credit is not a number"), ({"period": "1.5"}, "period is not a whole number"),
    ({"fiscal_year": ""}, "fiscal_year is blank"), ({"posting_date": "240115"}, "posting_date is a number, not a date"), ({"posting_date": "today"}, "posting_date is not a readable date"),
    ({"posting_date": "2024-01-02 09:15 CET"}, "carries a time zone offset"), ({"posting_date": "2024-01-02T09:15Z"}, "carries a time zone offset"),
    ({"posting_date": "31/01/2024"}, "is in a different date format"), ({"entered_at": ""}, "entered_at is blank")])
def test_unreadable_cells_are_refused_by_class(spark, change, said):
    with pytest.raises(LedgerError, match="cells no test can read: .*" + said):
        ingest.prepare(raw(spark, {}, change))


def test_every_problem_is_named_at_once(spark):
    with pytest.raises(LedgerError, match="posting_date.*debit.*created_by"):
        ingest.prepare(raw(spark, {}, {"posting_date": "soon", "debit": "abc", "created_by": ""}))
    with pytest.raises(LedgerError, match="missing required column.*credit, debit"):
        ingest.prepare(raw(spark, {}).drop("debit", "credit"))


def test_a_column_has_one_format_and_day_first_is_suspected(spark):
    with pytest.raises(LedgerError, match="every cell reads as d/M/yyyy"):
        ingest.prepare(raw(spark, {"posting_date": "02/01/2024"}, {"posting_date": "31/01/2024"}))
    read = ingest.prepare(raw(spark, {"entered_at": "1/2/2024 2:05 p.m."}, {"entered_at": "1/2/2024 9:15a"})).orderBy("row_no").collect()
    assert [r["entered_at"] for r in read] == [datetime(2024, 1, 2, 14, 5), datetime(2024, 1, 2, 9, 15)]
    with pytest.raises(LedgerError, match="in no date format"):
        ingest.prepare(raw(spark, {"posting_date": "the ides of March"}))


def test_zone_words(spark):
    cells = ["2024-01-02 09:15 CEST", "2024-01-02 09:15:00+05:30", "2024-01-02 09:15 SUN", "2024-01-02 09:15 AM", "2024-01-02", "9:15 PM EST", "2024-01-02 09:15:00-08"]
    df = spark.createDataFrame([(c,) for c in cells], "c string").select(dates.has_zone(F.col("c")).alias("z"))
    assert [r["z"] for r in df.collect()] == [True, True, False, False, False, True, True]


def test_csv_keeps_text_and_round_trips(spark, ledger, tmp_path):
    lines = ledger(entry("0007", "1234.5", text='say "hi", then\nleave', user="NA"), entry("b", 3, text=None))
    sinks.write_ledger(lines, str(tmp_path / "l"))
    back = ledger_files.load_csv(spark, str(tmp_path / "l"))
    columns = list(REQUIRED_COLUMNS)
    assert sorted(map(tuple, back.select(columns).collect()), key=str) == sorted(map(tuple, lines.select(columns).collect()), key=str)
    assert ingest.ledger_digest(back).first() == ingest.ledger_digest(lines.repartition(3)).first() != ingest.ledger_digest(lines.union(lines)).first()


def test_labels_are_read_strictly(spark):
    def labels(*cells):
        return spark.createDataFrame([(i, f"e{i}", c, None) for i, c in enumerate(cells, 1)], "row_no bigint, entry_id string, is_anomaly string, anomaly_type string")

    read = ledger_files.read_labels(labels("True", " false ", "1", "0.0")).orderBy("entry_id").collect()
    assert [(r["is_anomaly"], r["anomaly_type"]) for r in read] == [(True, ""), (False, ""), (True, ""), (False, "")]
    with pytest.raises(LedgerError, match="3 row.s. are blank or something else, the first is data row 2"):
        ledger_files.read_labels(labels("true", "no", "", "maybe"))


def test_controls_file():
    good = {"version": 1, "manual_entry_approvers": ["b", "a"], "approval_limit": 9999.50}
    read = ledger_files.parse_controls(json.dumps(good))
    assert (read.approver_text, read.limit_text) == ("a, b", "$9,999.50")
    for bad, said in (({**good, "x": 1}, "unknown key"), ({**good, "version": 2}, "version must be 1"), ({**good, "approval_limit": 0}, "above 0"), ({"version": 1}, "missing key")):
        with pytest.raises(LedgerError, match=said):
            ledger_files.parse_controls(json.dumps(bad))
    with pytest.raises(LedgerError, match="unknown key 'x'; missing key 'version'; .* must be a list; .*above 0"):
        ledger_files.parse_controls('{"x": 1, "manual_entry_approvers": {"a": 1}, "approval_limit": -5}')
    with pytest.raises(LedgerError, match="approval_limit must be a number"):
        ledger_files.parse_controls('{"version": 1, "manual_entry_approvers": ["a"], "approval_limit": NaN}')
    with pytest.raises(LedgerError, match="given twice"):
        ledger_files.parse_controls('{"version": 1, "version": 1, "manual_entry_approvers": ["a"], "approval_limit": 5}')


# -- the accounting source -----------------------------------------------------------------

def report(*rows, columns=("tx_date", "txn_type", "doc_num", "name", "memo", "debt_amt", "credit_amt", "create_by", "create_date")):
    """One account section per (account id, name) with its data rows."""
    meta = [{"ColTitle": c, "ColType": "x", "MetaData": [{"Name": "ColKey", "Value": c}]} for c in columns]
    sections = [{"type": "Section", "Header": {"ColData": [{"value": name, "id": ident}]}, "Rows": {"Row": [{"ColData": r, "type": "Data"} for r in data]}} for ident, name, data in rows]
    return json.dumps({"Columns": {"Column": meta}, "Rows": {"Row": [{"type": "Section", "Header": {"ColData": [{"value": "Group"}]}, "Rows": {"Row": sections}}]}})


def cells(date, kind, ident, debit="", credit="", memo="", name="", num="", user="", created=""):
    return [{"value": date}, {"value": kind, "id": ident}, {"value": num}, {"value": name}, {"value": memo}, {"value": debit}, {"value": credit}, {"value": user}, {"value": created}]


def pull(spark, accounts, entries, reports):
    def read(schema, docs):
        return spark.createDataFrame([(json.dumps(d),) for d in docs], "j string").select(F.from_json("j", schema).alias("d")).select("d.*")
    return accounting.assemble(read(accounting.ACCOUNT_SCHEMA, accounts), read(accounting.JOURNAL_SCHEMA, entries),
                               spark.createDataFrame(list(enumerate(reports)), "doc_no bigint, report string"))


def test_a_pull_is_assembled_and_nothing_is_dropped_unsaid(spark):
    accounts = [{"Id": "35", "AcctNum": " ", "Name": "Checking", "Classification": "Asset"}, {"Id": "80", "AcctNum": "4000", "Name": "Sales", "Classification": "Revenue", "SubAccount": True, "FullyQualifiedName": "Income:Sales", "Active": False}]

    def posting(side, amount, ident, **more):
        return {"DetailType": "JournalEntryLineDetail", "Amount": amount, "JournalEntryLineDetail": {"PostingType": side, "AccountRef": {"value": ident, "name": "Ref"}}, **more}

    entries = [{"Id": "7", "TxnDate": "2024-03-01", "Adjustment": True, "DocNumber": "D7", "MetaData": {"CreateTime": "2024-03-02T08:30:00-08:00"},
                "Line": [posting("Debit", 100, "35", Description="cash"), {"DetailType": "DescriptionOnly", "Description": "x"}, posting("Debit", -100, "99"), posting("Credit", 0, "35")]},
               {"Id": "8", "TxnDate": "2024-03-05", "MetaData": {"CreateTime": "gibberish"}, "Line": [posting("Credit", 0, "35")]}]
    gl = report(("35", "Checking", [cells("2024-03-04", "Invoice", "21", debit="1,250.00", memo="m", user=" ", created="2024-03-06"), cells("Beginning Balance", "", ""),
                                    cells("2024-03-01", "Journal Entry", "7", debit="100.00", user="Ann", created="03/02/2024 08:30:00 AM")]),
                ("80", "Sales", [cells("2024-03-04", "Invoice", "21", credit="1250", user="Bob", created="2024-03-05T10:00:00Z"), cells("2024-03-07", "Odd Type", "5", debit="-3", num="N1"), cells("2024-03-07", "Odd Type", "5", debit="3")]))
    lines, stats = pull(spark, accounts, entries, [gl])
    got = [(r["entry_id"], r["line_no"], r["account_code"], r["account_name"], r["account_type"], r["description"], str(r["debit"]), str(r["credit"]), r["source"], r["created_by"], str(r["entered_at"]), r["entered_at_estimated"])
           for r in lines.orderBy("entry_id", "line_no").collect()]
    assert got == [
        ("QBO-Invoice-21", 1, "35", "Checking", "Asset", "m", "1250.00", "0.00", "AR", "Bob", "2024-03-05 10:00:00", False),
        ("QBO-Invoice-21", 2, "4000", "Income:Sales", "Revenue", "Invoice", "0.00", "1250.00", "AR", "Bob", "2024-03-05 10:00:00", False),
        ("QBO-JournalEntry-7", 1, "35", "Checking", "Asset", "cash", "100.00", "0.00", "Manual", "Ann", "2024-03-02 08:30:00", False),
        ("QBO-JournalEntry-7", 2, "99", "Ref", "Unknown", "Journal entry D7", "0.00", "100.00", "Manual", "Ann", "2024-03-02 08:30:00", False),
        ("QBO-OddType-5", 1, "4000", "Income:Sales", "Revenue", "Odd Type N1", "0.00", "3.00", "System", "qbo-unknown", "2024-03-07 12:00:00", True),
        ("QBO-OddType-5", 2, "4000", "Income:Sales", "Revenue", "Odd Type", "3.00", "0.00", "System", "qbo-unknown", "2024-03-07 12:00:00", True)]
    row = stats.first().asDict()
    want = dict(accounts=2, inactive_accounts=1, sub_accounts=1, journal_entries=1, adjusting_entries=1, other_transactions=2, description_only_lines=1, other_detail_lines=0, zero_amount_lines=2,
                zero_transactions=1, unknown_account_lines=1, rows_without_txn_id=1, estimated_entered_at=1, unreadable_entered_at=0, unknown_users=1, unbalanced_entries=0,
                je_ids_missing_from_report=1, je_ids_missing_from_query=0, utc_times_without_zone=1, unmapped_types={"OddType": 1})
    assert row == want


def test_reports_without_columns_are_refused_and_deep_ones_read(spark):
    def rows(doc):
        return accounting.report_rows(spark.createDataFrame([(0, doc)], "doc_no bigint, report string"), depth=2)

    with pytest.raises(LedgerError, match="no debt_amt, credit_amt column"):
        rows(report(("1", "x", []), columns=("tx_date", "txn_type")))
    def nested(levels):
        deep = json.loads(report(("1", "x", [])))
        inner = deep["Rows"]["Row"][0]
        found = []
        while inner.get("Rows", {}).get("Row"):
            found = inner["Rows"]["Row"]
            inner = found[0]
        for _ in range(levels):
            section = {"type": "Section", "Rows": {"Row": []}}
            found.append(section)
            found = section["Rows"]["Row"]
        found.append({"type": "Data", "ColData": [{"value": str(k)} for k in range(9)]})
        return json.dumps(deep)

    assert [rows(nested(k)).where("tx_date = '0'").count() for k in (0, 3, 9)] == [1, 1, 1]


def test_stamps(spark):
    cases = {"2025-12-28T10:15:00-0800": ("time", "2025-12-28 10:15:00", False), "2025-12-28 10:15": ("time", "2025-12-28 10:15:00", False), "2025-12-28T10:15:00.5+00:00": ("time", "2025-12-28 10:15:00.500000", True),
             "12/28/2025 01:15:00 PM": ("time", "2025-12-28 13:15:00", False), "12/28/2025": ("date", "2025-12-28 12:00:00", False), "2025-12-28-0800": ("unreadable-date", "2025-12-28 12:00:00", False),
             "2026-1-12345": ("unreadable", "None", False), " ": ("blank", "None", False)}
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", accounting.read_stamp(F.col("c")).alias("s"))
    assert {r["c"]: (r["s"]["kind"], str(r["s"]["when"]), r["s"]["utc"]) for r in df.collect()} == cases


# -- the review log --------------------------------------------------------------------------

def decisions(spark, *rows):
    return spark.createDataFrame([(e, d, r, "n", 1.0, 0.5, n) for e, d, r, n in rows], "entry_id string, decision string, reviewer string, note string, risk_score double, model_score double, narrative_id bigint")


def note_batch(spark, *entries):
    return spark.createDataFrame([(e, s, "w", ["a", "b"], "c", "low", "m") for e, s in entries],
                                 "entry_id string, summary string, why_flagged string, evidence_to_request array<string>, suggested_control string, confidence string, model string")


def test_the_log_appends_refuses_and_adopts(spark, tmp_path):
    log = ReviewLog(spark, str(tmp_path / "log"), "csv:a")
    assert log.decisions.count() == 0
    log.save_narratives(note_batch(spark, ("e1", "first"), ("e2", "other")))
    log.save_narratives(note_batch(spark, ("e1", "second")))
    ids = {(r["entry_id"], r["summary"]): r["id"] for r in log.narratives.collect()}
    assert sorted(ids.values()) == [1, 2, 3]
    log.record(decisions(spark, ("e1", "accept", " Ann ", ids[("e1", "first")]), ("e3", "dismiss", "Bob", None)))
    log.record(decisions(spark, ("e3", "escalate", "Bob", None)))
    with pytest.raises(LedgerError, match="must be one of.*named reviewer.*name an entry.*not one for its entry"):
        log.record(decisions(spark, ("e1", "maybe", "x", None), ("e1", "accept", " \t", None), ("", "accept", "x", None), ("e2", "accept", "x", ids[("e1", "first")])), "decision")
    with pytest.raises(LedgerError, match="not one for its entry"):
        ReviewLog(spark, str(tmp_path / "log"), "csv:b").record(decisions(spark, ("e1", "accept", "x", ids[("e1", "first")])))
    assert log.decisions.count() == 3 and log.decisions.agg(F.max("id")).first()[0] == 3
    state = {r["entry_id"]: r for r in review.review_state(log.decisions, log.narratives, "csv:a").collect()}
    assert (state["e1"]["narrative_summary"], state["e1"]["narrative_superseded"], state["e1"]["narrative_seen_by_reviewer"], state["e1"]["reviewer"]) == ("first", True, "yes", "Ann")
    assert (state["e2"]["decision"], state["e2"]["narrative_seen_by_reviewer"], state["e3"]["decision"], state["e3"]["narrative_id"]) == (None, "", "escalate", None)
    with pytest.raises(LedgerError, match="never bound to 'legacy'"):
        ReviewLog(spark, str(tmp_path / "log"), "legacy")
    with pytest.raises(LedgerError, match="already holds"):
        log.adopt_legacy()


@pytest.mark.parametrize("written, seen", [("2024-01-03", "no"), ("2024-01-02", "unknown"), ("2024-01-01", "unknown")])
def test_a_later_note_is_never_passed_off_as_read(spark, written, seen):
    d = spark.createDataFrame([(1, "L", "e", "accept", "r", "n", 1.0, 0.5, None, "2024-01-02")], review.DECISION_SCHEMA)
    n = spark.createDataFrame([(4, "L", "e", "s", "w", ["x"], "c", "low", "m", written)], review.NARRATIVE_SCHEMA)
    row = review.review_state(d, n, "L").first()
    assert (row["narrative_id"], row["narrative_seen_by_reviewer"], row["narrative_superseded"]) == (4, seen, False)


# -- notes -------------------------------------------------------------------------------------

NOTE = {"summary": "s", "why_flagged": "w", "evidence_to_request": [" two\r\nlines ", ""], "suggested_control": "none", "confidence": " High"}


@pytest.mark.parametrize("reply, why", [
    (json.dumps(NOTE), None), ("```json\n" + json.dumps(NOTE) + "\n```", None), ("nope", "response was not valid JSON"), ("[]", "response was not a JSON object"),
    (json.dumps({"summary": "s"}), "missing key(s): why_flagged, evidence_to_request, suggested_control, confidence"), (json.dumps({**NOTE, "evidence_to_request": "x"}), "evidence_to_request must be a list"),
    (json.dumps({**NOTE, "evidence_to_request": ["x", None]}), "evidence_to_request item 2 must be text, got null"), (json.dumps({**NOTE, "evidence_to_request": [{}]}), "evidence_to_request item 1 must be text, got dict"),
    (json.dumps({**NOTE, "evidence_to_request": [" "]}), "evidence_to_request must not be empty"), (json.dumps({**NOTE, "confidence": "sure"}), "confidence must be one of high, medium, low, got 'sure'"),
    (json.dumps({**NOTE, "summary": 1.5}), "summary must be text, got float"), (json.dumps({**NOTE, "why_flagged": None}), "why_flagged must be text, got null"),
    (json.dumps({**NOTE, "suggested_control": "  "}), "suggested_control must not be empty"), (json.dumps({**NOTE, "summary": "\ud800"}), "a field is not text the store can keep: it holds a lone surrogate"),
    (json.dumps({**NOTE, "summary": "\U0001f600"}), None)])
def test_replies_are_held_to_the_contract(spark, reply, why):
    row = notes.check_replies(spark.createDataFrame([(reply,)], "reply string")).first()
    assert row["why"] == why and row["valid"] == (why is None)
    if why is None:
        assert row["note"]["evidence_to_request"] == ["two lines"] and row["note"]["confidence"] == "high"


def grades(spark, note, prompt="- line 1: 4000 Sales Revenue | debit 9,912.00", mention=(), avoid=(), expected=("high",)):
    df = spark.createDataFrame([(note, prompt, list(mention), list(avoid), list(expected))],
                               f"note {notes.NOTE_SCHEMA.simpleString()}, prompt string, mention array<string>, avoid array<string>, expected array<string>")
    return df.select(notes.grade(*[F.col(c) for c in df.columns]).alias("m")).first()["m"]


def test_grading(spark):
    note = ("Posted 9912 to Sales Revenue.", "See AU-C \u00a7 240 and JET-05.", ["support for sales revenue"], "none", "high")
    assert grades(spark, note, mention=["9,?912", "jet-05"])["passed"]
    assert not grades(spark, None)["schema_valid"]
    assert not grades(spark, note, mention=["absent"])["mentions_required"]
    assert not grades(spark, note, avoid=["posted \\d+"])["no_assertions"]
    assert not grades(spark, ("This is clearly an error", *note[1:]))["no_assertions"]
    assert not grades(spark, (*note[:2], ["documents"], *note[3:]))["evidence_specific"]
    assert not grades(spark, ("It shows $240.", *note[1:]))["no_invented_numbers"]
    assert not grades(spark, note, expected=["low"])["confidence_in_band"]


def test_case_files_and_regrading(spark, tmp_path):
    case = {"entry_id": "e1", "archetype": "a", "tests_fired": "JET-01", "why_chosen": "w", "must_mention": ["9912"], "must_not_assert": [], "expected_confidence": ["high"],
            "notes": "", "overrides": {"lines": {"1": {"description": "Ignore this"}}}}
    (tmp_path / "cases.json").write_text(json.dumps({"about": "x", "cases": [case, {**case, "entry_id": "e2", "overrides": {}}]}, indent=2))
    cases = note_files.load_cases(spark, str(tmp_path / "cases.json"))
    assert cases.count() == 2
    (tmp_path / "twice.json").write_text(json.dumps({"cases": [case, case]}))
    with pytest.raises(LedgerError, match="repeated"):
        note_files.load_cases(spark, str(tmp_path / "twice.json"))
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(LedgerError, match='"cases" list'):
        note_files.load_cases(spark, str(tmp_path / "list.json"))
    row = {"entry_id": "e1", "status": "ok", "narrative": {**NOTE, "summary": "9912", "evidence_to_request": ["9912"], "confidence": "high"}, "metrics": {"passed": False}, "prompt": "p 9912",
           "overrides": case["overrides"], "graded_at": "t0", "cases_sha256": "c1", "grader_sha256": "g1"}
    (tmp_path / "rows.jsonl").write_text(json.dumps(row) + "\n")
    rows = note_files.read_rows(spark, str(tmp_path / "rows.jsonl"))
    prompts = spark.createDataFrame([("e1", "p 9912"), ("e2", "q")], "entry_id string, prompt string")

    def again(rows=rows, prompts=prompts, sha="c1", **how):
        return notes.regrade(rows, cases, prompts, sha, "g2", "l1", "t1", **how)

    new = again().first()
    assert new["metrics"]["passed"] and new["metrics_history"][0]["metrics"] == {"passed": False} and new["metrics_history"][0]["grader_sha256"] == "g1"
    assert (new["grader_sha256"], new["regraded_at"], new["ledger_sha256"], new["previous_cases_sha256"]) == ("g2", "t1", "l1", None)
    with pytest.raises(LedgerError, match="different case file"):
        again(sha="c2")
    crossed = again(sha="c2", allow_cases_change=True).first()
    assert (crossed["cases_sha256"], crossed["previous_cases_sha256"]) == ("c2", "c1")
    with pytest.raises(LedgerError, match="share an entry"):
        again(rows.union(rows))
    with pytest.raises(LedgerError, match="does not rebuild|do not rebuild"):
        again(prompts=prompts.withColumn("prompt", F.lit("other")))
    with pytest.raises(LedgerError, match="not in the case set"):
        again(rows.withColumn("entry_id", F.lit("zz")))
    with pytest.raises(LedgerError, match="overrides that changed"):
        again(rows.withColumn("overrides", F.lit(None).cast(rows.schema["overrides"].dataType)))
    with pytest.raises(LedgerError, match="record another ledger"):
        again(rows.withColumn("ledger_sha256", F.lit("l0")))
    assert notes.missing_rows(cases, rows, "c1").select("entry_id", "status").collect() == [("e2", "missing")]
    found = notes.aggregate_rows(again()).first()
    assert (found["graded"], found["passed"], found["rows_regraded"], found["rows_with_changed_result"], found["rows_with_unkept_grades"]) == (1, 1.0, 1, 1, 0)


# -- text ----------------------------------------------------------------------------------------

def shown(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", fn(F.col("t")).alias("x"))
    return [r["x"] for r in df.orderBy("i").collect()]


def test_visible_lines_and_code(spark):
    assert shown(spark, text.one_line, " a\u200b \n b\u00a0\u202ec ", None, "\ue000", "x \u200b y") == ["a b c", "", "", "x y"]
    assert shown(spark, text.md_code, "a|b`c``", "@me", "", "`x") == ["```a```&#124;``` b`c`` ```", "`@\u200bme`", "", "`` `x ``"]
    assert shown(spark, text.code_span, "a|b") == ["`a|b`"]


def test_cells(spark):
    long = "\U0001f600" * 20000
    rows = spark.createDataFrame([("a\x0bb\uffff", 1), ("plain", 2), (long, 3), ("\x01" * 5000, 4)], "t string, i int")
    fitted, changes = text.export_cells(rows, ["t"])
    got = {r["i"]: r["t"] for r in fitted.collect()}
    assert got[1] == "a[U+000B]b[U+FFFF]" and got[2] == "plain"
    tail = " [cut: shown in full, the text would run to 40,000 characters; a cell holds 32,767]"
    assert got[3] == "\U0001f600" * ((32767 - len(tail)) // 2) + tail
    tail = tail.replace("40,000", "40,000")
    assert got[4].startswith("[U+0001]") and got[4].endswith("]") and len(got[4]) <= 32767 and got[4].replace("[U+0001]", "") == tail
    row = changes.first()
    assert (row["cells"], row["cut"], row["replaced"]) == (2, 2, 2 + (32767 - len(tail)) // 8)
    assert shown(spark, text.not_a_formula, "=1", "-x", "a=") == ["'=1", "'-x", "a="]


def test_grades_come_with_what_they_were_graded_by(spark):
    cases = spark.createDataFrame([("a", ["rent"], [], ["high"], "x"), ("b", [], [], ["low"], "y"), ("c", [], [], ["low"], "z")],
                                  "entry_id string, must_mention array<string>, must_not_assert array<string>, expected_confidence array<string>, archetype string")
    prompts = spark.createDataFrame([("a", "- line 1: 6100 Rent | 500.00"), ("b", "none")], "entry_id string, prompt string")
    checked = spark.createDataFrame([("a", None, ("rent of 500", "", ["Rent 500"], "none", "high"))], "entry_id string, why string, note struct<summary:string,"
                                    "why_flagged:string,evidence_to_request:array<string>,suggested_control:string,confidence:string>")
    plain = {r["entry_id"]: r["metrics"] for r in notes.grade_notes(checked, cases, prompts).collect()}
    rows = {r["entry_id"]: r for r in notes.grade_notes(checked, cases, prompts, ["archetype", "prompt", "note", "why"]).collect()}
    assert {k: r["metrics"] for k, r in rows.items()} == plain and set(plain) == {"a", "b"}
    assert plain["a"]["passed"] and not plain["b"]["passed"]
    assert (rows["a"]["archetype"], rows["a"]["prompt"], rows["a"]["note"]["summary"], rows["b"]["note"]) == ("x", "- line 1: 6100 Rent | 500.00", "rent of 500", None)


def test_report_documents_are_brought_together_by_one_shuffle(spark):
    """Rows and sections are made where a document's lines are, not shuffled at each level."""
    lines = views.ledger(spark, "/root/testdata/sf0.001")
    made = sv.report_documents(settle(lines, "lines"))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert made.count() == made.select("doc_no").distinct().count() > 1


def test_review_rows_need_no_entry_facts(spark):
    staged = registry.Staged(spark, "/root/testdata/sf0.001")
    alone = sorted(map(tuple, staged.decisions.collect()))
    assert "entries" not in staged.__dict__
    other = registry.Staged(spark, "/root/testdata/sf0.001")
    assert other.entries.count() == other.ids.count() == staged.ids.count()
    assert sorted(map(tuple, other.decisions.collect())) == alone
