from __future__ import annotations

import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyspark.operators.entries import derive  # noqa: E402
from tallyspark.schema import LEDGER_SCHEMA  # noqa: E402
from tallyspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4)


def line(entry, no, account, debit, credit, posted="2024-03-15", keyed="2024-03-15 10:00", text="t", source="Manual",
         user="u1", name=None, kind="Asset"):
    posting, entered = datetime.fromisoformat(posted), datetime.fromisoformat(keyed)
    return (entry, no, posting, entered, posting.year, posting.month, account, name or f"Account {account}", kind, text,
            Decimal(str(debit)), Decimal(str(credit)), source, user)


def entry(name, amount, debit="6100", credit="1000", **how):
    """Two lines, debit first."""
    return [line(name, 1, debit, amount, 0, **how), line(name, 2, credit, 0, amount, **how)]


@pytest.fixture(scope="session")
def ledger(spark):
    def make(*entries):
        rows = [row for e in entries for row in e]
        return derive(spark.createDataFrame(rows, LEDGER_SCHEMA))
    return make
