from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import entry, line
from pyspark.sql import functions as F

from tallyspark.operators import journal_tests as jt
from tallyspark.operators.entries import entry_level, entry_pairs
from tallyspark.operators.features import build_features
from tallyspark.plans import staging
from tallyspark.schema import Controls, LedgerError


def flags(lines, test, **how):
    rows = jt.run_tests(lines, [test], **how).orderBy("entry_id", "account_code", "line_no").collect()
    return [(r["entry_id"], r["reason"]) for r in rows]


def test_duplicate_goes_to_the_entry_keyed_later(ledger):
    two = ledger(entry("JE-1", "812.50", keyed="2024-03-15 10:00"), entry("JE-2", "812.50", keyed="2024-03-15 09:00"))
    assert flags(two, "JET-07") == [("JE-1", "Same amount ($812.50), accounts and description as JE-2 posted 0 day(s) earlier. Confirm this is not a double posting.")]
    tied = ledger(entry("JE-1", 5), entry("JE-2", 5))
    assert [i for i, _ in flags(tied, "JET-07")] == ["JE-2"]
    by_date = ledger(entry("JE-1", 5, posted="2024-03-16", keyed="2024-03-01 01:00"), entry("JE-2", 5))
    assert [i for i, _ in flags(by_date, "JET-07")] == ["JE-1"]


def test_duplicates_compare_with_the_first_and_match_null_descriptions(ledger):
    days = [entry(f"JE-{d}", 9, posted=f"2024-03-{d:02d}", text=None) for d in (1, 8, 9)]
    assert [i for i, _ in flags(ledger(*days), "JET-07")] == ["JE-8"]
    other = ledger(entry("JE-1", 9), entry("JE-2", 9, text="else"), entry("JE-3", 9, debit="6200"))
    assert flags(other, "JET-07") == []


def test_dormancy_flags_the_entry_keyed_first_that_day(ledger):
    def woken(late):
        return ledger(entry("JE-1", 5, debit="6900", posted="2024-01-02"), entry("JE-2", 5, debit="6900", posted="2024-09-02", keyed="2024-09-02 11:00"),
                      entry("JE-3", 5, debit="6900", posted="2024-09-02", keyed=f"2024-09-02 {late}"), entry("JE-4", 5, posted="2024-04-02"), entry("JE-6", 5, posted="2024-06-02"), entry("JE-5", 5, posted="2024-08-02"))
    assert flags(woken("08:00"), "JET-09") == [("JE-3", "Account 6900 (Account 6900) had no activity for 244 days before this entry.")]
    assert [i for i, _ in flags(woken("11:00"), "JET-09")] == ["JE-2"]


def test_threshold_edges(ledger):
    amounts = ("9699.99", "9700.00", "9999.99", "10000.00")
    hit = flags(ledger(*[entry(a, a) for a in amounts]), "JET-06")
    assert [i for i, _ in hit] == ["9700.00", "9999.99"]
    odd = jt.Settings(controls=Controls(("a",), Decimal("9999.50")))
    assert "beneath the $9,999.50 approval" in flags(ledger(entry("x", "9900")), "JET-06", settings=odd)[0][1]


def test_round_amounts_and_balance(ledger):
    lines = ledger(entry("a", 1000), entry("b", "1000.01"), entry("c", 500), entry("d", 25000))
    assert [i for i, _ in flags(lines, "JET-01")] == ["a", "d"]
    uneven = ledger([line("u", 1, "1", "10.00", 0), line("u", 2, "2", 0, "10.50")], entry("v", 3))
    assert flags(uneven, "JET-10") == [("u", "Debits $10.00 do not equal credits $10.50 (difference $-0.50). Resolve before relying on the population.")]


def test_period_end_revenue_names_its_first_line_once(ledger):
    rows = [line("r", 3, "4100", 0, 5, posted="2024-02-27", kind="Revenue", name="Late"), line("r", 2, "4000", 0, "1234.5", posted="2024-02-27", kind="Revenue", name="Sales"),
            line("r", 1, "1000", "1239.5", 0, posted="2024-02-27")]
    early = [line("s", 1, "4000", 0, 5, posted="2024-02-26", kind="Revenue")]
    assert flags(ledger(rows, early), "JET-05") == [("r", "Manual credit of $1,234.50 to Sales on 2024-02-27, within 3 days of period close. Obtain support and test cut-off.")]


def test_holiday_on_a_weekend_is_the_weekend_test_only(ledger):
    lines = ledger(entry("sat", 5, keyed="2026-07-04 10:00"), entry("fri", 5, keyed="2025-07-04 10:00"))
    assert [i for i, _ in flags(lines, "JET-04")] == ["fri"] and [i for i, _ in flags(lines, "JET-02")] == ["sat"]


def test_pairs_may_lack_a_side(ledger):
    lines = ledger([line("a", 1, "6", 5, 0), line("a", 2, "5", 5, 0)], [line("b", 1, "7", 0, 0)])
    assert [tuple(r) for r in entry_pairs(lines).collect()] == [("a", "5|6", None, "5|6>")]
    assert flags(lines, "JET-08") == [("a", "Debit 5|6 / credit <NA> occurs only 1 time(s) in the population. Understand the business purpose.")]


def test_score_sums_flags_and_counts_tests(ledger):
    quiet = [entry(f"q{m}", 7, debit="70", credit="80", posted=f"2024-{m:02d}-01", user="controller") for m in (1,)]
    woken = [line("w", 1, "70", 7, 0, posted="2024-12-02", keyed="2024-12-02 10:00", user="controller", text="x"),
             line("w", 2, "80", 0, 7, posted="2024-12-02", keyed="2024-12-02 10:00", user="controller", text="x")]
    lines = ledger(*quiet, woken)
    e = jt.staged_entries(lines)
    row = jt.score_entries(e, jt.run_tests(lines, ["JET-09"], entries=e)).filter("entry_id = 'w'").first()
    assert (row["risk_score"], row["n_flags"], row["tests_fired"]) == (4.0, 1, "JET-09")
    assert row["reasons"].split(" | ") == [f"Account {a} (Account {a}) had no activity for 336 days before this entry." for a in ("70", "80")]


def test_outlier_needs_thirty_amounts_and_spread(ledger):
    base = [entry(f"e{i:02d}", 100 + i, debit="61", credit="62") for i in range(30)]
    assert [i for i, _ in flags(ledger(*base, entry("big", 9_000_000, debit="61", credit="62")), "JET-11")] == ["big", "big"]
    assert flags(ledger(*base[:28], entry("big", 9_000_000, debit="61", credit="62")), "JET-11") == []
    same = [entry(f"e{i:02d}", 100, debit="61", credit="62") for i in range(40)]
    assert flags(ledger(*same, entry("big", 9_000_000, debit="61", credit="62")), "JET-11") == []


def test_header_is_the_first_line_and_first_known_description(ledger):
    rows = [line("h", 2, "2", 0, 5, text="second"), line("h", 1, "1", 5, 0, text=None), line("h", 3, "3", 0, 0, text="third")]
    row = entry_level(ledger(rows)).first()
    assert (row["description"], row["n_lines"], row["entry_amount"]) == ("second", 3, Decimal("5.00"))


def test_order_and_partitions_of_rows_do_not_matter(ledger, spark):
    lines = ledger(*[entry(f"JE-{i:03d}", 100 * (i % 7) + 1000, debit=str(60 + i % 3), posted=f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}",
                           keyed=f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d} {i % 24:02d}:00") for i in range(90)])
    shapes = [lines.repartition(1), lines.repartition(7), lines.orderBy(F.rand(4))]
    results = [sorted(map(tuple, jt.score_entries(jt.staged_entries(s), jt.run_tests(s)).select("entry_id", "risk_score", "tests_fired", "reasons").collect())) for s in shapes]
    assert results[0] == results[1] == results[2] and any(r[1] for r in results[0])


def test_lookups_too_large_to_broadcast_give_the_same_flags_and_features(ledger, monkeypatch):
    lines = ledger(*[entry(f"JE-{i:03d}", 100 + i % 40, debit="61" if i % 3 else "64", credit="62", posted=f"2024-03-{i % 9 + 1:02d}", text="t" if i % 5 else None) for i in range(120)],
                   entry("big", 9_000_000, debit="61", credit="62"), entry("odd", 77, debit="98", credit="99"))
    entries = jt.staged_entries(lines)

    def everything():
        flags = sorted(map(tuple, jt.run_tests(lines, entries=entries).collect()))
        return flags, sorted(map(tuple, build_features(lines, entries).collect()))

    usual = everything()
    monkeypatch.setattr(staging, "BROADCAST_BYTES", 0)
    assert everything() == usual and {f[1] for f in usual[0]} >= {"JET-07", "JET-08", "JET-11"}


def test_unknown_tests_are_refused_and_added_ones_run(ledger):
    lines = ledger(entry("a", 5), entry("b", 6))
    with pytest.raises(LedgerError, match="JET-99"):
        jt.run_tests(lines, ["JET-99"])
    jt.register_test("X-1", "Five", "Low", lambda d: d.filter("abs_cents = 500").select("entry_id", F.lit("five").alias("reason"), "account_code", "line_no"))
    try:
        got = jt.run_tests(lines, ["X-1"]).orderBy("line_no").collect()
        assert [(r["entry_id"], r["test_id"], r["severity"], r["line_no"]) for r in got] == [("a", "X-1", "Low", 1), ("a", "X-1", "Low", 2)]
        with pytest.raises(LedgerError):
            jt.register_test("JET-01", "x", "Low", lambda d: d)
    finally:
        jt.unregister_test("X-1")


def test_controls_move_only_their_tests(ledger):
    lines = ledger(entry("a", 9900), entry("b", 4900))
    by = {}
    for name, controls in (("one", Controls(("u1",), Decimal(5000))), ("two", Controls())):
        by[name] = {(r["test_id"], r["entry_id"]) for r in jt.run_tests(lines, controls=controls).collect()}
    assert {t for t, _ in by["one"] ^ by["two"]} == {"JET-06", "JET-12"}
    with pytest.raises(LedgerError, match="limit.*|approver"):
        Controls(("a", "a"), Decimal("0"))
