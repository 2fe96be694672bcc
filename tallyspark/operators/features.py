"""Entry features for the model tier: numbers that encode no rule's answer."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.calendar import days_to_period_end
from tallyspark.operators.entries import account_amounts, frequencies
from tallyspark.operators.journal_tests import staged_entries
from tallyspark.plans.staging import attach, fits, settle
from tallyspark.schema import LedgerError

FEATURE_COLUMNS = (
    "log_amount", "n_lines", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "days_to_period_end",
    "posting_lag_days", "account_pair_freq", "user_freq", "source_freq", "debit_account_freq",
    "credit_account_freq", "amount_z_in_account", "round_1000_remainder", "digit_entropy",
)


def cyclical(value: Column, period: int) -> tuple[Column, Column]:
    """A clock or calendar value as a point on a circle (sine, cosine)."""
    angle = F.lit(2 * math.pi) * value.cast("double") / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def digit_entropy(cents: Column) -> Column:
    """Bits of entropy in an amount's digits, two decimals written out; ten counts, no UDF."""
    text = F.abs(cents).cast("string")
    text = F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)
    total = F.length(text).cast("double")
    bits = F.lit(0.0)
    for digit in "0123456789":
        share = (F.length(text) - F.length(F.replace(text, F.lit(digit), F.lit("")))) / total
        bits = bits + F.when(share > 0, -share * F.log2(share)).otherwise(0.0)
    return bits


def log_amount(cents: Column) -> Column:
    """log10 of dollars, floored at one cent."""
    return F.log10(F.greatest(cents, F.lit(1).cast("bigint")) / F.lit(100.0))


def account_z(cents: Column) -> Column:
    """Robust z of an entry's amount in its main account, 0 where it is not defined."""
    z = F.lit(0.6745) * (log_amount(cents) - F.col("median")) / F.nullif(F.col("mad"), F.lit(0.0))
    return F.coalesce(z, F.lit(0.0))


def category_shares(entries: DataFrame) -> DataFrame:
    """The share of entries each pair, user, source, debit set and credit set has."""
    return frequencies(entries, {
        "pair": F.col("pair"), "created_by": F.col("created_by"), "source": F.col("source"),
        "debit_side": F.coalesce("debit_accounts", F.lit("")),
        "credit_side": F.coalesce("credit_accounts", F.lit("")),
    })


def build_features(lines: DataFrame, entries: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """``entry_id`` and FEATURE_COLUMNS as doubles, no nulls.

    The five frequency tables are one aggregate; they and the account statistics are attached by
    measured broadcast, so at the usual sizes the entries are read once and never shuffled.
    """
    entries = staged_entries(lines) if entries is None else entries
    stats = settle(account_amounts(lines), "accounts") if stats is None else stats
    shares = settle(category_shares(entries), "shares")
    small = fits(shares)
    work = entries.withColumns({"debit_side": F.coalesce("debit_accounts", F.lit("")),
                                "credit_side": F.coalesce("credit_accounts", F.lit(""))})
    for key, name in (("pair", "account_pair_freq"), ("created_by", "user_freq"), ("source", "source_freq"),
                      ("debit_side", "debit_account_freq"), ("credit_side", "credit_account_freq")):
        lookup = shares.filter(F.col("dimension") == key).select(F.col("value").alias(key), F.col("share").alias(name))
        work = attach(work, lookup, [key], small=small)
    work = attach(work, stats.select(F.col("account_code").alias("main_account"), "median", "mad"), ["main_account"])
    hour_sin, hour_cos = cyclical(F.hour("entered_at"), 24)
    dow_sin, dow_cos = cyclical(F.weekday("entered_at"), 7)
    cents = F.col("entry_cents")
    lag = F.datediff(F.col("posting_date").cast("date"), F.col("entered_at").cast("date"))
    values = {
        "log_amount": log_amount(cents), "n_lines": F.col("n_lines"),
        "hour_sin": hour_sin, "hour_cos": hour_cos, "dow_sin": dow_sin, "dow_cos": dow_cos,
        "days_to_period_end": days_to_period_end(F.col("posting_date")), "posting_lag_days": lag,
        "account_pair_freq": F.col("account_pair_freq"), "user_freq": F.col("user_freq"),
        "source_freq": F.col("source_freq"), "debit_account_freq": F.col("debit_account_freq"),
        "credit_account_freq": F.col("credit_account_freq"), "amount_z_in_account": account_z(cents),
        "round_1000_remainder": F.pmod(cents, F.lit(100000)) / F.lit(100.0), "digit_entropy": digit_entropy(cents),
    }
    return work.select("entry_id", *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(c) for c, v in values.items()])


def feature_variances(features: DataFrame) -> DataFrame:
    """Entries and each feature's sample variance, one row."""
    return features.agg(F.count("*").alias("n_entries"), *[F.var_samp(c).alias(c) for c in FEATURE_COLUMNS])


def kept_features(features: DataFrame) -> tuple[int, list[str]]:
    """How many entries there are and the features that vary; refused when none does."""
    row = feature_variances(features).first()
    kept = [c for c in FEATURE_COLUMNS if (row[c] or 0.0) > 1e-12]
    if not kept:
        n = row["n_entries"]
        raise LedgerError("the model tier cannot be fitted on {} {}: every one of the {} features is constant".format(
            n, "entry" if n == 1 else "entries", len(FEATURE_COLUMNS)))
    return row["n_entries"], kept
