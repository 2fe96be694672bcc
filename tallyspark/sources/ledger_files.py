"""Ledgers, labels, controls and identity sidecars from files."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.ingest import prepare
from tallyspark.schema import Controls, LedgerError
from tallyspark.sources import csv_records

# What a label's is_anomaly cell may hold.
TRUTH = {"true": True, "false": False, "1": True, "0": False, "1.0": True, "0.0": False}
# End of fixed values.


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """A ledger from CSV files, read by byte ranges; what is wrong with its cells is told with the first one's file and data row."""
    rows, place = csv_records.read(spark, path)
    prepared = prepare(rows, place)
    return prepared.drop(csv_records.ROW)


def read_labels(rows: DataFrame, place: Callable[[int], str] | None = None) -> DataFrame:
    """Labels from text cells: ``is_anomaly`` strictly true or false, a blank type as ''. ``place`` says where a row of some ``row_no`` is."""
    cell = F.lower(F.trim("is_anomaly"))
    truth = F.lit(None).cast("boolean")
    for text, value in TRUTH.items():
        truth = F.when(cell == text, value).otherwise(truth)
    read = rows.withColumn("_truth", truth)
    if "row_no" not in read.columns:
        read = read.withColumn("row_no", F.lit(None).cast("bigint"))
    bad = F.col("_truth").isNull()
    row = read.agg(F.count_if(bad).alias("n"), F.min(F.when(bad, F.col("row_no"))).alias("first"),
                   F.min(F.when(bad, F.coalesce("entry_id", F.lit("")))).alias("entry")).first()
    if row["n"]:
        told = place or (lambda n: f"data row {n}")
        where = f"the first is {told(row['first'])}" if row["first"] is not None else f"e.g. entry {row['entry']!a}"
        raise LedgerError(f"is_anomaly must be true/false or 1/0 on every row; {row['n']} row(s) are blank or something else, {where}")
    return read.select("entry_id", F.col("_truth").alias("is_anomaly"), F.coalesce("anomaly_type", F.lit("")).alias("anomaly_type"))


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    return read_labels(*csv_records.read(spark, path))


class _Object(list):
    """A JSON object as its keys and values, repeated keys kept."""


#: What a controls file holds: for each key, whether a value is of its kind, and what to say if not.
_CONTROLS: dict[str, tuple[Callable[[object], bool], str]] = {
    "version": (lambda v: type(v) is int and v == 1, "version must be 1, got {!a}"),
    "manual_entry_approvers": (lambda v: isinstance(v, list) and not isinstance(v, _Object), "manual_entry_approvers must be a list"),
    "approval_limit": (lambda v: type(v) is int or (isinstance(v, Decimal) and v.is_finite()), "approval_limit must be a number"),
}


def parse_controls(text: str, origin: str | None = None) -> Controls:
    """A controls file: version 1, an approver list and an approval limit. Keys are judged against the table above, then the values
    that are of their kind by what Controls takes; all that is wrong is named together."""
    try:
        document = json.loads(text, object_pairs_hook=_Object, parse_float=Decimal, parse_constant=lambda name: name)
    except (ValueError, RecursionError) as exc:
        raise LedgerError(f"not JSON ({exc})") from None
    if not isinstance(document, _Object):
        raise LedgerError("must hold a JSON object with the keys " + ", ".join(_CONTROLS))
    given = Counter(key for key, _ in document)
    wrong = [f"key {key!a} is given twice" for key, times in given.items() if times > 1]
    wrong += [f"unknown key {key!a}" for key in given if key not in _CONTROLS]
    wrong += [f"missing key {key!a}" for key in _CONTROLS if key not in given]
    sound = {}
    for key, value in document:
        fits, told = _CONTROLS.get(key, (None, ""))
        if fits and fits(value):
            sound[key] = value
        elif fits:
            wrong.append(told.format(value))
    defaults = Controls()
    try:
        read = Controls(tuple(sound.get("manual_entry_approvers", defaults.approvers)), Decimal(sound.get("approval_limit", defaults.approval_limit)), origin)
    except (LedgerError, TypeError) as exc:
        wrong.append(str(exc))
    if wrong:
        raise LedgerError("; ".join(wrong))
    return read
