"""Eval cases (one JSON document) and graded rows (JSON lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.notes import CASE_SCHEMA, CONFIDENCE, ROW_SCHEMA, refuse_bad_cases
from tallyspark.schema import LedgerError


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a case file, defaults filled in; a file that is not one is refused."""
    schema = T.StructType([T.StructField("cases", T.ArrayType(CASE_SCHEMA)), T.StructField("_corrupt_record", T.StringType())])
    read = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    if read.filter(F.col("cases").isNull()).count():
        raise LedgerError('a case file is a JSON object holding a "cases" list')
    cases = read.select(F.inline("cases")).withColumns({
        "must_mention": F.coalesce("must_mention", F.array().cast("array<string>")),
        "must_not_assert": F.coalesce("must_not_assert", F.array().cast("array<string>")),
        "expected_confidence": F.coalesce("expected_confidence", F.array(*[F.lit(c) for c in CONFIDENCE])),
        "notes": F.coalesce("notes", F.lit(""))})
    refuse_bad_cases(cases)
    return cases


def save_cases(cases: DataFrame, path: str, about: str = "Note eval cases.") -> None:
    """A case file; a case set is a few dozen rows, written as the one document it is read as."""
    doc = cases.agg(F.collect_list(F.struct(*cases.columns)).alias("cases")).select(F.lit(about).alias("about"), "cases")
    doc.coalesce(1).write.mode("errorifexists").json(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW_SCHEMA).json(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """Graded rows as a new version; an existing version is never overwritten."""
    rows.write.mode("errorifexists").json(path)
