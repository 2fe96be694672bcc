"""Money as whole cents inside and DECIMAL at the edges."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_cents(amount: Column) -> Column:
    """A DECIMAL amount as whole cents, rounded half up, never cut."""
    return F.round(amount * F.lit(100), 0).cast("bigint")


def double_to_cents(amount: Column) -> Column:
    """A DOUBLE amount as whole cents."""
    return F.floor(amount * F.lit(100.0) + F.lit(0.5)).cast("bigint")


def as_money(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("decimal(20,2)")


def _whole_hundreds(cents: Column) -> Column:
    return F.call_function("div", cents, F.lit(100))


def money_text(cents: Column, whole: bool = False) -> Column:
    """``1,234.50``; with ``whole``, ``1,234``. Built from integers, so no digit is rounded."""
    size = F.abs(cents)
    sign = F.when(cents < 0, "-").otherwise("")
    dollars = F.format_string("%s%,d", sign, _whole_hundreds(size))
    return dollars if whole else F.concat(dollars, F.format_string(".%02d", size % 100))
