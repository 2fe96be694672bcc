"""First-digit (Benford) analysis over a population or per segment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nigrini's conformity bands, the 5% chi-square critical value (8 degrees of
# freedom), the smallest sample the test reads, and the note shown ahead of smaller ones.
MAD_BANDS = (
    (0.006, "close conformity"),
    (0.012, "acceptable conformity"),
    (0.015, "marginal conformity"),
)
NONCONFORMITY = "nonconformity"
CRITICAL_5PCT = 15.507
MIN_SAMPLE = 300
SMALL_SAMPLE_NOTE = (
    "Below 300 amounts the first-digit test is not meaningful (Nigrini suggests at least 300 to 500), "
    "so no conformity band is given; MAD and chi-square are shown as computed."
)
# End of fixed values.
EXPECTED = {d: math.log10(1 + 1 / d) for d in range(1, 10)}


def first_digit(cents: Column) -> Column:
    """Leading significant digit of whole cents; null for zero and null, sign ignored."""
    return F.when(cents != 0, F.substring(F.abs(cents).cast("string"), 1, 1).cast("int"))


def mad_conformity(mad: Column) -> Column:
    band = F.lit(NONCONFORMITY)
    for top, name in reversed(MAD_BANDS):
        band = F.when(mad <= top, name).otherwise(band)
    return band


def _digit_counts(value: str) -> list[Column]:
    digit = first_digit(F.col(value))
    return [F.count_if(digit == d).alias(f"c{d}") for d in range(1, 10)]


def _statistics(counted: DataFrame) -> DataFrame:
    n = sum((F.col(f"c{d}") for d in range(2, 10)), F.col("c1"))
    out = counted.withColumn("n", n)
    chi = mad = F.lit(0.0)
    for d, p in EXPECTED.items():
        seen, want = F.col(f"c{d}"), F.lit(p) * F.col("n")
        chi = chi + (seen - want) * (seen - want) / want
        mad = mad + F.abs(seen / F.col("n") - F.lit(p))
    out = out.withColumns({"_chi": F.when(F.col("n") > 0, chi).otherwise(0.0),
                           "_mad": F.when(F.col("n") > 0, mad / 9).otherwise(0.0)})
    return out.withColumns({
        "sufficient_sample": F.col("n") >= MIN_SAMPLE,
        "chi_square": F.round("_chi", 4),
        "chi_square_critical_5pct": F.lit(CRITICAL_5PCT),
        "exceeds_critical": F.col("_chi") > CRITICAL_5PCT,
        "mad": F.round("_mad", 6),
        "conformity": F.when(F.col("n") >= MIN_SAMPLE, mad_conformity(F.col("_mad"))).otherwise("insufficient data"),
    })


RESULT = ("label", "n", "sufficient_sample", "chi_square", "exceeds_critical", "mad", "conformity")


def benford_test(rows: DataFrame, value: str = "abs_cents", label: str = "population") -> DataFrame:
    """One row: digit counts in one aggregate without a shuffle key, then the statistics."""
    return _statistics(rows.agg(*_digit_counts(value))).select(
        F.lit(label).alias("label"), *RESULT[1:4], "chi_square_critical_5pct", *RESULT[4:])


def segmented_benford(rows: DataFrame, by: str | None, value: str = "abs_cents", min_n: int = MIN_SAMPLE) -> DataFrame:
    """The test per segment of at least ``min_n`` rows, most deviant first. Counts are combined
    map-side, so a segment holding most rows sends one partial row per task."""
    if by is None:
        return benford_test(rows, value, "ALL").select(*RESULT)
    counted = (rows.filter(F.col(by).isNotNull()).groupBy(F.col(by).cast("string").alias("label"))
               .agg(F.count("*").alias("_rows"), *_digit_counts(value)).filter(F.col("_rows") >= min_n))
    return _statistics(counted).select(*RESULT).orderBy(F.desc("mad"), "label")


def mad_by(rows: DataFrame, by: str, value: str = "abs_cents") -> DataFrame:
    """``label`` and ``mad``, unrounded, of every segment that has digits, whatever its size."""
    counted = rows.groupBy(F.col(by).cast("string").alias("label")).agg(F.count("*").alias("_rows"), *_digit_counts(value))
    return _statistics(counted).where("n > 0").select("label", F.col("_mad").alias("mad"))


def digit_distribution(rows: DataFrame, value: str = "abs_cents") -> DataFrame:
    """Observed against expected proportion of each digit, absent digits included."""
    counted = rows.agg(*_digit_counts(value))
    total = sum((F.col(f"c{d}") for d in range(2, 10)), F.col("c1"))
    rows_ = F.array(*[F.struct(F.lit(d).alias("digit"), F.col(f"c{d}").alias("observed"), total.alias("n"),
                               F.lit(p).alias("p")) for d, p in EXPECTED.items()])
    prop = F.when(F.col("n") > 0, F.col("observed") / F.col("n")).otherwise(0.0)
    return counted.select(F.inline(rows_)).select(
        "digit", "observed", F.round(prop, 4).alias("observed_prop"), F.round("p", 4).alias("expected_prop"))


def benford_view(rows: DataFrame, by: str | None = None, min_n: int = MIN_SAMPLE) -> DataFrame:
    """The test as a query: scope, figures, and the small-sample note where it applies."""
    found = benford_test(rows).select(*RESULT) if by is None else segmented_benford(rows, by, min_n=min_n)
    note = F.when(~F.col("sufficient_sample"), SMALL_SAMPLE_NOTE).otherwise("")
    return found.select(F.lit(by or "population").alias("scope"), note.alias("note"), *RESULT)
