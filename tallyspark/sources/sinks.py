"""Sinks: ledgers, scored entries and the workpaper's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import export_cells, not_a_formula
from tallyspark.operators.materiality import Materiality, with_bands
from tallyspark.operators.review import STATE_COLUMNS
from tallyspark.plans.staging import beside
from tallyspark.schema import EXPORT_COLUMNS, FLAG_COLUMNS, REQUIRED_COLUMNS, SEVERITIES, Controls

KEPT = ("entry_id", "posting_date", "entered_at", "source", "created_by", "entry_amount", "materiality_band",
        "risk_score", "model_score", "agreement", "n_flags", "tests_fired", "reasons")


def write_ledger(lines: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """A ledger's export columns; lines that do not say how their entry time was found are as given."""
    estimated = F.col("entered_at_estimated") if "entered_at_estimated" in lines.columns else F.lit(False)
    out = lines.withColumn("entered_at_estimated", estimated).select(*EXPORT_COLUMNS)
    write_table(out, path, fmt, mode)


def write_table(rows: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", safe: bool = False) -> None:
    """Any result table. ``safe`` makes CSV text that no spreadsheet reads as a formula."""
    if fmt == "parquet":
        rows.write.mode(mode).parquet(path)
        return
    if safe:
        rows = rows.withColumns({n: not_a_formula(F.col(n)) for n, t in rows.dtypes if t == "string"})
    nested = [n for n, t in rows.dtypes if t.startswith(("array", "struct", "map"))]
    rows = rows.withColumns({n: F.to_json(F.col(n)) for n in nested}) if nested else rows
    (rows.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


def write_partitioned_ledger(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A prepared ledger for repeated use: Parquet by fiscal year, so a year's lines are pruned to."""
    lines.select(*REQUIRED_COLUMNS).write.mode(mode).partitionBy("fiscal_year").parquet(path)


def workpaper_exceptions(scored: DataFrame, top_n: int = 250, state: DataFrame | None = None,
                         m: Materiality | None = None, fiscal_year: int | None = None) -> DataFrame:
    """The exceptions sheet: the top entries by risk, model score and id, with review columns."""
    if m is not None:
        scored = with_bands(scored, m, fiscal_year)
    by = [F.desc("risk_score")] + ([F.desc("model_score")] if "model_score" in scored.columns else [F.desc("entry_cents")])
    lead = scored.filter("risk_score > 0").orderBy(*by, "entry_id").limit(top_n)
    out = lead.select(*[c for c in KEPT if c in scored.columns])
    if state is not None:
        names = [c for c in STATE_COLUMNS if c != "entry_id"]
        out = out.join(state.select("entry_id", *names), "entry_id", "left").withColumnRenamed("narrative_summary", "narrative")
        out = out.withColumns({"narrative_superseded": F.coalesce("narrative_superseded", F.lit(False)),
                               "narrative_seen_by_reviewer": F.coalesce("narrative_seen_by_reviewer", F.lit(""))})
    return out


def worst_severity(flags: DataFrame) -> DataFrame:
    """The highest severity raised on each entry."""
    weight = F.lit(1.0)
    for name, value in SEVERITIES.items():
        weight = F.when(F.col("severity") == name, F.lit(value)).otherwise(weight)
    return flags.groupBy("entry_id").agg(F.max_by("severity", weight).alias("worst_severity"))


def workpaper_summary(scored: DataFrame, flags: DataFrame, exceptions: DataFrame, controls: Controls) -> DataFrame:
    """The summary sheet's rows: label and value as text, in order."""
    counts = beside(
        scored.agg(F.count("*").alias("n"), F.count_if(F.col("risk_score") > 0).alias("flagged")),
        flags.agg(F.count("*").alias("raised"), F.count_distinct("test_id").alias("tests")),
        exceptions.agg(F.count("*").alias("shown")))
    rate = F.format_string("%.2f%%", F.round(F.lit(100.0) * F.col("flagged") / F.greatest("n", F.lit(1)), 2))
    rows = [("Population (entries)", F.col("n")), ("Entries flagged", F.col("flagged")), ("Flag rate", rate),
            ("Total flags raised", F.col("raised")), ("Distinct tests fired", F.col("tests")),
            ("Shown in this workpaper", F.col("shown")), ("JET-12 approvers", F.lit(controls.approver_text)),
            ("JET-06 approval limit", F.lit(controls.limit_text)),
            ("Controls file", F.lit(controls.origin or "none (synthetic defaults)"))]
    items = [F.struct(F.lit(i).alias("place"), F.lit(label).alias("label"), value.cast("string").alias("value"))
             for i, (label, value) in enumerate(rows)]
    return counts.select(F.inline(F.array(*items)))


def write_workpaper(scored: DataFrame, flags: DataFrame, folder: str, controls: Controls, benford: DataFrame | None = None,
                    top_n: int = 250, state: DataFrame | None = None, m: Materiality | None = None,
                    fiscal_year: int | None = None, mode: str = "errorifexists") -> None:
    """The workpaper's tables as Parquet under ``folder``, text fitted to what a cell can hold."""
    exceptions = workpaper_exceptions(scored, top_n, state, m, fiscal_year).join(worst_severity(flags), "entry_id", "left")
    tables = {"exceptions": exceptions, "all_flags": flags.select(*FLAG_COLUMNS),
              "summary": workpaper_summary(scored, flags, exceptions, controls)}
    if benford is not None:
        tables["benford"] = benford
    for name, rows in tables.items():
        text = [n for n, t in rows.dtypes if t == "string"]
        fitted, changes = export_cells(rows, text)
        fitted.write.mode(mode).parquet(f"{folder}/{name}")
        changes.write.mode(mode).parquet(f"{folder}/{name}_changes")
