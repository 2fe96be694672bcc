"""Column contract and the closed value sets every operator shares."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

LEDGER_SCHEMA = T.StructType([
    T.StructField("entry_id", T.StringType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("posting_date", T.TimestampNTZType()),
    T.StructField("entered_at", T.TimestampNTZType()),
    T.StructField("fiscal_year", T.LongType()),
    T.StructField("period", T.LongType()),
    T.StructField("account_code", T.StringType()),
    T.StructField("account_name", T.StringType()),
    T.StructField("account_type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("debit", MONEY),
    T.StructField("credit", MONEY),
    T.StructField("source", T.StringType()),
    T.StructField("created_by", T.StringType()),
])
REQUIRED_COLUMNS = tuple(LEDGER_SCHEMA.fieldNames())
DATE_COLUMNS = ("posting_date", "entered_at")
WHOLE_COLUMNS = ("line_no", "fiscal_year", "period")
AMOUNT_COLUMNS = ("debit", "credit")
KEYED_TEXT = ("entry_id", "account_code", "account_type", "source", "created_by")
EXPORT_COLUMNS = (*REQUIRED_COLUMNS, "entered_at_estimated")

FLAG_COLUMNS = ("entry_id", "test_id", "test_name", "severity", "reason")
LABEL_SCHEMA = T.StructType([
    T.StructField("entry_id", T.StringType()),
    T.StructField("is_anomaly", T.BooleanType()),
    T.StructField("anomaly_type", T.StringType()),
])

# Names and codes that appear in results.
ACCOUNT_TYPES = ("Asset", "Liability", "Equity", "Revenue", "Expense")
SOURCES = ("Manual", "AP", "AR", "Payroll", "Bank", "System")
SEVERITIES = {"High": 3.0, "Medium": 2.0, "Low": 1.0}
AGREEMENTS = ("both", "rules only", "model only", "neither")
DECISIONS = ("accept", "dismiss", "escalate")
ARCHETYPES = (
    "round_amount",
    "weekend_entry",
    "after_hours_entry",
    "holiday_entry",
    "period_end_manual_revenue",
    "just_under_threshold",
    "duplicate_entry",
    "rare_account_pair",
    "dormant_account",
    "benford_drift",
    "unbalanced_entry",
)
HELD_OUT = (
    "token_amount",
    "unfamiliar_user",
    "split_purchase",
    "round_trip",
    "shell_vendor_drip",
)
# The test written for each archetype; benford_drift has none.
INTENDED_TEST = {
    "round_amount": "JET-01",
    "weekend_entry": "JET-02",
    "after_hours_entry": "JET-03",
    "holiday_entry": "JET-04",
    "period_end_manual_revenue": "JET-05",
    "just_under_threshold": "JET-06",
    "duplicate_entry": "JET-07",
    "rare_account_pair": "JET-08",
    "dormant_account": "JET-09",
    "unbalanced_entry": "JET-10",
}
NOT_DEFINITIONAL = ("benford_drift", "dormant_account", "rare_account_pair")
# End of fixed values.


class LedgerError(ValueError):
    """Input that no operator can use; the message names every problem at once."""


@dataclass(frozen=True)
class Controls:
    """A company's approver list (JET-12) and approval limit (JET-06)."""

    approvers: tuple[str, ...] = ("controller", "mchen")
    approval_limit: Decimal = Decimal("10000.00")
    origin: str | None = None

    def __post_init__(self) -> None:
        problems = []
        names = tuple(self.approvers)
        if not 1 <= len(names) <= 50:
            problems.append(f"approvers must list 1 to 50 names, got {len(names)}")
        if any(not isinstance(n, str) or not n.strip() or n != n.strip() for n in names):
            problems.append("every approver must be a name without surrounding spaces")
        if len(set(names)) != len(names):
            problems.append("an approver is listed more than once")
        limit = Decimal(str(self.approval_limit))
        if not limit.is_finite() or not 0 < limit < Decimal(10) ** 12:
            problems.append("the approval limit must be above 0 and below 1,000,000,000,000")
        elif limit != limit.quantize(Decimal("0.01")):
            problems.append("the approval limit must be a whole number of cents")
        if problems:
            raise LedgerError("; ".join(problems))
        object.__setattr__(self, "approvers", tuple(sorted(names)))
        object.__setattr__(self, "approval_limit", limit)

    @property
    def limit_cents(self) -> int:
        return int(self.approval_limit * 100)

    @property
    def limit_text(self) -> str:
        whole = self.approval_limit == self.approval_limit.to_integral_value()
        return f"${self.approval_limit:,.0f}" if whole else f"${self.approval_limit:,.2f}"

    @property
    def approver_text(self) -> str:
        return ", ".join(self.approvers)
