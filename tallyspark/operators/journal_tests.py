"""The rule tier: twelve journal-entry tests, their registry, and the score of an entry.

Entry-level tests are a condition and a reason over one table of entry facts, so any number of
them cost one pass. Line-level tests (dormant account, large value) read the lines.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import money_text
from tallyspark.operators.entries import account_amounts, entry_facts, with_money
from tallyspark.plans.staging import attach, settle
from tallyspark.schema import FLAG_COLUMNS, SEVERITIES, Controls, LedgerError

# Test names, severities and the wording of reasons, as readers know them.
TESTS = {
    "JET-01": ("Round-dollar amount", "Medium"),
    "JET-02": ("Weekend posting", "Medium"),
    "JET-03": ("After-hours posting", "Medium"),
    "JET-04": ("Holiday posting", "Medium"),
    "JET-05": ("Period-end manual revenue", "High"),
    "JET-06": ("Just under approval threshold", "High"),
    "JET-07": ("Possible duplicate entry", "High"),
    "JET-08": ("Rare account combination", "Medium"),
    "JET-09": ("Dormant account activity", "Medium"),
    "JET-10": ("Unbalanced entry", "High"),
    "JET-11": ("Large value outlier", "Medium"),
    "JET-12": ("Manual entry outside approver list", "Low"),
}
REASONS = {
    "JET-01": "Entry total is exactly $%s - a round thousand. Confirm the basis for the amount and whether it is an estimate or accrual.",
    "JET-02": "Keyed on %s (a weekend) by %s. Ask why the entry could not wait for a business day.",
    "JET-03": "Keyed at %s by %s, outside the %02d:00-%02d:00 window. Corroborate with the user's normal working pattern.",
    "JET-04": "Keyed on %s, a US federal holiday, by %s.",
    "JET-05": "Manual credit of $%s to %s on %s, within %d days of period close. Obtain support and test cut-off.",
    "JET-06": "$%s falls within %s beneath the %s approval threshold. Review for split or structured transactions.",
    "JET-07": "Same amount ($%s), accounts and description as %s posted %d day(s) earlier. Confirm this is not a double posting.",
    "JET-08": "Debit %s / credit %s occurs only %d time(s) in the population. Understand the business purpose.",
    "JET-09": "Account %s (%s) had no activity for %d days before this entry.",
    "JET-10": "Debits $%s do not equal credits $%s (difference $%s). Resolve before relying on the population.",
    "JET-11": "$%s in %s is %.1f robust standard deviations above the account median of $%s (measured on a log scale, since transaction values are lognormal).",
    "JET-12": "Manual entry keyed by %s, who is not in the approved list (%s). Confirm delegated authority.",
}
MISSING = "<NA>"
# End of fixed values.

#: What a flag carries besides FLAG_COLUMNS: where it stands among its entry's flags.
ORDER_COLUMNS = ("test_order", "account_code", "line_no")


@dataclass(frozen=True)
class Settings:
    """Every test's parameters, with the defaults the tests were tuned at."""

    min_round: Decimal = Decimal(1000)
    start_hour: int = 6
    end_hour: int = 20
    period_end_days: int = 3
    window: Decimal = Decimal("0.03")
    duplicate_days: int = 7
    max_occurrences: int = 3
    dormant_days: int = 120
    tolerance: Decimal = Decimal("0.005")
    z_threshold: float = 3.5
    min_amounts: int = 30
    controls: Controls = Controls()


def _shown(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(MISSING))


def _reason(test_id: str, *parts: Column) -> Column:
    return F.format_string(REASONS[test_id], *parts)


def near_limit(cents: Column, limit_cents: int, window: Decimal) -> Column:
    """At or above limit x (1 - window), and below the limit."""
    low = math.ceil(Decimal(limit_cents) * (1 - Decimal(str(window))))
    return (cents >= low) & (cents < limit_cents)


def entry_rules(s: Settings) -> dict[str, tuple[Column, Column]]:
    """Condition and reason of each entry-level test, over entry facts (and, for JET-07 and
    JET-08, the columns their lookups add)."""
    cents, keyed = F.col("entry_cents"), F.col("entered_at")
    user, closing = F.col("created_by"), F.col("closing_line")
    gap = F.timestamp_diff("DAY", F.col("original.posting_date"), F.col("posting_date"))
    return {
        "JET-01": ((cents >= int(s.min_round * 100)) & (cents % 100000 == 0),
                   _reason("JET-01", money_text(cents, whole=True))),
        "JET-02": (F.col("is_weekend"),
                   _reason("JET-02", F.date_format(keyed, "EEEE yyyy-MM-dd"), user)),
        "JET-03": ((F.hour(keyed) < s.start_hour) | (F.hour(keyed) >= s.end_hour),
                   _reason("JET-03", F.date_format(keyed, "HH:mm 'on' yyyy-MM-dd"), user,
                           F.lit(s.start_hour), F.lit(s.end_hour))),
        "JET-04": (F.col("is_holiday") & ~F.col("is_weekend"),
                   _reason("JET-04", F.date_format(keyed, "yyyy-MM-dd"), user)),
        "JET-05": (closing.isNotNull(),
                   _reason("JET-05", money_text(closing["credit_cents"]),
                           F.coalesce(closing["account_name"], F.lit(MISSING)),
                           F.date_format(closing["posting_date"], "yyyy-MM-dd"), F.lit(s.period_end_days))),
        "JET-06": (near_limit(cents, s.controls.limit_cents, s.window),
                   _reason("JET-06", money_text(cents), F.lit(f"{s.window:.0%}"), F.lit(s.controls.limit_text))),
        "JET-07": ((F.col("entry_id") != F.col("original.entry_id")) & gap.between(0, s.duplicate_days),
                   _reason("JET-07", money_text(cents), F.col("original.entry_id"), gap)),
        "JET-08": (F.col("pair_n").isNotNull(),
                   _reason("JET-08", F.coalesce("debit_accounts", F.lit(MISSING)),
                           F.coalesce("credit_accounts", F.lit(MISSING)), F.col("pair_n"))),
        "JET-10": (F.abs("imbalance_cents").cast("decimal(20,0)") > F.lit(s.tolerance * 100),
                   _reason("JET-10", money_text(F.col("total_debit_cents")),
                           money_text(F.col("total_credit_cents")), money_text(F.col("imbalance_cents")))),
        "JET-12": ((F.col("source") == "Manual") & ~user.isin(list(s.controls.approvers)),
                   _reason("JET-12", user, F.lit(s.controls.approver_text))),
    }


def duplicate_groups(entries: DataFrame) -> DataFrame:
    """The first entry of every group of two or more with one amount, pair and description."""
    first = F.min(F.struct("posting_date", "entered_at", "entry_id")).alias("original")
    return (entries.groupBy("entry_cents", "pair", "description").agg(first, F.count("*").alias("_n"))
            .filter("_n > 1").drop("_n"))


def rare_pairs(entries: DataFrame, max_occurrences: int) -> DataFrame:
    return (entries.filter(F.col("pair").isNotNull()).groupBy("pair").agg(F.count("*").alias("pair_n"))
            .filter(F.col("pair_n") <= max_occurrences))


def _entry_flags(entries: DataFrame, ids: Iterable[str], s: Settings, order: dict[str, int]) -> DataFrame:
    ids = list(ids)
    facts = entries
    if "JET-07" in ids:
        groups = settle(duplicate_groups(entries), "duplicates")
        facts = attach(facts, groups, ["entry_cents", "pair", "description"])
    if "JET-08" in ids:
        facts = attach(facts, settle(rare_pairs(entries, s.max_occurrences), "pairs"), ["pair"])
    rules = entry_rules(s)
    raised = F.array(*[
        F.when(rules[i][0], F.struct(
            F.lit(i).alias("test_id"), F.lit(TESTS[i][0]).alias("test_name"), F.lit(TESTS[i][1]).alias("severity"),
            rules[i][1].alias("reason"), F.lit(order[i]).alias("test_order"), F.lit("").alias("account_code"),
            F.lit(0).alias("line_no")))
        for i in ids])
    # most entries raise nothing: the conditions alone are tried before any reason is worded
    facts = facts.filter(reduce(lambda a, b: a | b, [rules[i][0] for i in ids]))
    kept = facts.select("entry_id", F.filter(raised, lambda f: f.isNotNull()).alias("raised"))
    return kept.select("entry_id", F.inline("raised"))


def _line_flags(hit: DataFrame, test_id: str, reason: Column, order: int) -> DataFrame:
    name, severity = TESTS[test_id]
    return hit.select("entry_id", F.lit(test_id).alias("test_id"), F.lit(name).alias("test_name"),
                      F.lit(severity).alias("severity"), reason.alias("reason"),
                      F.lit(order).alias("test_order"), F.col("account_code"), F.col("line_no"))


def dormancy_gaps(lines: DataFrame, over: float) -> DataFrame:
    """The first line of every account's day that ends a quiet of more than ``over`` whole days.

    Lines are first reduced to one row per account and calendar day by a hash aggregate over two
    columns, so an account's window is as long as its calendar, however many lines it has. The
    days that end a long quiet are few; only their lines are then looked at for the first one.
    """
    day = F.col("posting_date").cast("date")
    days = lines.groupBy("account_code", day.alias("day")).agg(
        F.min("posting_date").alias("first_posted"), F.max("posting_date").alias("last_posted"))
    w = Window.partitionBy("account_code").orderBy("day")
    gap = F.timestamp_diff("DAY", F.lag("last_posted").over(w), F.col("first_posted"))
    woken = settle(days.withColumn("gap", gap).filter(F.col("gap") > over).select("account_code", "day", "gap"), "woken")
    near = attach(lines.withColumn("day", day), woken, ["account_code", "day"], "inner")
    first = F.min(F.struct("posting_date", "entered_at", "entry_id", "line_no", "account_name")).alias("first")
    return near.groupBy("account_code", "day", "gap").agg(first).select("account_code", "gap", "first.entry_id", "first.line_no", "first.account_name")


def dormant_account(lines: DataFrame, days: int = 120, order: int = 8) -> DataFrame:
    if days < 0:
        raise LedgerError("dormant days must be 0 or more")
    reason = _reason("JET-09", F.col("account_code"), _shown("account_name"), F.col("gap"))
    return _line_flags(dormancy_gaps(lines, days), "JET-09", reason, order)


def robust_z(lines: DataFrame, stats: DataFrame, min_amounts: int = 30) -> DataFrame:
    """Lines with a positive amount and their robust z within their account, where defined."""
    usable = stats.filter((F.col("n") >= min_amounts) & (F.col("mad") != 0)).select("account_code", "median", "mad")
    joined = attach(lines.filter("abs_cents > 0"), usable, ["account_code"], "inner")
    logged = F.log10(F.col("abs_cents") / F.lit(100.0))
    return joined.withColumn("z", F.lit(0.6745) * (logged - F.col("median")) / F.col("mad"))


def large_value_outlier(lines: DataFrame, z_threshold: float = 3.5, min_amounts: int = 30,
                        stats: DataFrame | None = None, order: int = 10) -> DataFrame:
    stats = settle(account_amounts(lines), "accounts") if stats is None else stats
    hit = robust_z(lines, stats, min_amounts).filter(F.col("z") > z_threshold)
    centre = F.format_string("%,.2f", F.pow(F.lit(10.0), F.col("median")))
    reason = _reason("JET-11", money_text(F.col("abs_cents")), _shown("account_name"), F.bround("z", 1), centre)
    return _line_flags(hit, "JET-11", reason, order)


# -- registry -------------------------------------------------------------------

_ADDED: dict[str, tuple[str, str, Callable[[DataFrame], DataFrame]]] = {}


def register_test(test_id: str, name: str, severity: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Add a test: ``fn(lines)`` gives ``entry_id, reason`` and, for line-level tests,
    ``account_code`` and ``line_no``."""
    if test_id in TESTS:
        raise LedgerError(f"{test_id} is a built-in test")
    _ADDED[test_id] = (name, severity, fn)


def unregister_test(test_id: str) -> None:
    _ADDED.pop(test_id, None)


def registry() -> dict[str, str]:
    return {**{i: t[0] for i, t in TESTS.items()}, **{i: t[0] for i, t in _ADDED.items()}}


def _added_flags(lines: DataFrame, test_id: str, order: int) -> DataFrame:
    name, severity, fn = _ADDED[test_id]
    found = fn(lines)
    account = F.col("account_code") if "account_code" in found.columns else F.lit("")
    line = F.col("line_no") if "line_no" in found.columns else F.lit(0)
    return found.select("entry_id", F.lit(test_id).alias("test_id"), F.lit(name).alias("test_name"),
                        F.lit(severity).alias("severity"), "reason", F.lit(order).alias("test_order"),
                        account.alias("account_code"), line.alias("line_no"))


def run_tests(lines: DataFrame, only: Iterable[str] | None = None, controls: Controls | None = None,
              settings: Settings | None = None, entries: DataFrame | None = None,
              stats: DataFrame | None = None) -> DataFrame:
    """All registered tests (or ``only``), stacked in order: FLAG_COLUMNS and ORDER_COLUMNS.

    ``entries`` (from ``staged_entries``) and ``stats`` (from ``account_amounts``) are built once
    here unless the caller already has them.
    """
    s = settings or Settings(controls=controls or Controls())
    selected = list(only or registry())
    unknown = [i for i in selected if i not in registry()]
    if unknown:
        raise LedgerError("unknown test id(s): " + ", ".join(unknown))
    order = {i: n for n, i in enumerate(selected)}
    per_entry = [i for i in selected if i in TESTS and i not in ("JET-09", "JET-11")]
    parts = []
    if per_entry:
        entries = staged_entries(lines, s) if entries is None else entries
        parts.append(_entry_flags(entries, per_entry, s, order))
    if "JET-09" in order:
        parts.append(dormant_account(lines, s.dormant_days, order["JET-09"]))
    if "JET-11" in order:
        parts.append(large_value_outlier(lines, s.z_threshold, s.min_amounts, stats, order["JET-11"]))
    parts += [_added_flags(lines, i, order[i]) for i in selected if i in _ADDED]
    return reduce(DataFrame.unionByName, parts)


def staged_entries(lines: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Entry facts written once; every later operator reads only the columns it needs."""
    return settle(entry_facts(lines, (settings or Settings()).period_end_days), "entries", wide=True)


# -- score ------------------------------------------------------------------------

def score_entries(entries: DataFrame, flags: DataFrame, ordered: bool = True) -> DataFrame:
    """Every entry with its risk score (a severity-weighted sum over flags), the number of
    distinct tests, the tests and the reasons."""
    weight = F.lit(1.0)
    for name, value in SEVERITIES.items():
        weight = F.when(F.col("severity") == name, F.lit(value)).otherwise(weight)
    placed = F.array_sort(F.collect_list(F.struct(*ORDER_COLUMNS, "reason")))
    rolled = flags.groupBy("entry_id").agg(
        F.sum(weight).alias("risk_score"),
        F.array_sort(F.collect_set("test_id")).alias("_tests"),
        F.array_join(F.transform(placed, lambda f: f["reason"]), " | ").alias("reasons"))
    scored = with_money(entries).join(rolled, "entry_id", "left").withColumns({
        "risk_score": F.coalesce("risk_score", F.lit(0.0)),
        "n_flags": F.size(F.coalesce("_tests", F.array().cast("array<string>"))),
        "tests_fired": F.coalesce(F.array_join("_tests", ", "), F.lit("")),
        "reasons": F.coalesce("reasons", F.lit("")),
    }).drop("_tests")
    return risk_order(scored) if ordered else scored


def risk_order(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("risk_score"), F.desc("entry_cents"), "entry_id")


def flag_summary(flags: DataFrame) -> DataFrame:
    """Flags raised per test and severity."""
    return flags.groupBy("test_id", "test_name", "severity").agg(F.count("*").alias("flags"))


def public_flags(flags: DataFrame) -> DataFrame:
    return flags.select(*FLAG_COLUMNS)
