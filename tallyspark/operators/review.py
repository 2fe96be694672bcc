"""The review log: append-only decisions and notes, filed by ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.text import strip
from tallyspark.plans.staging import beside
from tallyspark.schema import DECISIONS, LedgerError

LEGACY = "legacy"

DECISION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("ledger_id", T.StringType()),
    T.StructField("entry_id", T.StringType()), T.StructField("decision", T.StringType()),
    T.StructField("reviewer", T.StringType()), T.StructField("note", T.StringType()),
    T.StructField("risk_score", T.DoubleType()), T.StructField("model_score", T.DoubleType()),
    T.StructField("narrative_id", T.LongType()), T.StructField("decided_at", T.StringType()),
])
NARRATIVE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("ledger_id", T.StringType()),
    T.StructField("entry_id", T.StringType()), T.StructField("summary", T.StringType()),
    T.StructField("why_flagged", T.StringType()), T.StructField("evidence_to_request", T.ArrayType(T.StringType())),
    T.StructField("suggested_control", T.StringType()), T.StructField("confidence", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("generated_at", T.StringType()),
])
STATE_COLUMNS = ("entry_id", "decision", "reviewer", "note", "decided_at", "narrative_id", "narrative_summary",
                 "narrative_confidence", "narrative_superseded", "narrative_seen_by_reviewer")


def check_ledger_id(ledger_id: str) -> str:
    if not isinstance(ledger_id, str) or not ledger_id or any(c.isspace() for c in ledger_id):
        raise LedgerError(f"a review log is bound to one ledger by its identity, got {ledger_id!a}")
    if ledger_id == LEGACY:
        raise LedgerError("a review log is never bound to 'legacy': adopt those rows into their ledger")
    return ledger_id


def mine(rows: DataFrame, ledger_id: str) -> DataFrame:
    return rows.filter(F.col("ledger_id") == ledger_id)


def latest(rows: DataFrame, ledger_id: str) -> DataFrame:
    """The row of the highest id per entry: one aggregate, no self-join."""
    other = [c for c in rows.columns if c != "entry_id"]
    last = mine(rows, ledger_id).groupBy("entry_id").agg(F.max_by(F.struct(*other), "id").alias("row"))
    return last.select(*[F.col("entry_id") if c == "entry_id" else F.col(f"row.{c}") for c in rows.columns])


def current_decisions(decisions: DataFrame, ledger_id: str) -> DataFrame:
    return latest(decisions, ledger_id).orderBy(F.desc("decided_at"), F.desc("id"))


def latest_narratives(narratives: DataFrame, ledger_id: str) -> DataFrame:
    return latest(narratives, ledger_id).orderBy("entry_id")


def history(rows: DataFrame, ledger_id: str, entry_id: str | None = None) -> DataFrame:
    """Everything recorded, oldest first; for one entry or all."""
    out = mine(rows, ledger_id)
    return out.filter(F.col("entry_id") == entry_id).orderBy("id") if entry_id is not None else out.orderBy("entry_id", "id")


def narrative_by_id(narratives: DataFrame, narrative_id: int) -> DataFrame:
    """One version, whichever ledger it belongs to."""
    return narratives.filter(F.col("id") == narrative_id)


def recorded_ids(rows: DataFrame, ledger_id: str) -> DataFrame:
    return mine(rows, ledger_id).select("entry_id").distinct()


def decision_kind(decision: Column) -> Column:
    return F.when(decision.isin(list(DECISIONS)), decision).when(decision.isNotNull(), "unrecognised")


def decision_counts(decisions: DataFrame, ledger_id: str) -> DataFrame:
    return (latest(decisions, ledger_id).filter(F.col("decision").isNotNull()).groupBy("decision")
            .agg(F.count("*").alias("entries")).orderBy(F.desc("entries"), "decision"))


def outstanding(scored: DataFrame, decisions: DataFrame, ledger_id: str) -> DataFrame:
    """Flagged entries nobody has decided on."""
    return scored.filter("risk_score > 0").join(recorded_ids(decisions, ledger_id), "entry_id", "left_anti")


def review_state(decisions: DataFrame, narratives: DataFrame, ledger_id: str) -> DataFrame:
    """One row per entry with a decision or a note: which note is shown and whether it was read."""
    decided = latest(decisions, ledger_id).select(
        "entry_id", "decision", "reviewer", "note", "decided_at", F.col("narrative_id").alias("recorded"))
    newest = mine(narratives, ledger_id).groupBy("entry_id").agg(F.max("id").alias("newest"))
    notes = mine(narratives, ledger_id).select(
        F.col("id").alias("shown"), F.col("summary").alias("narrative_summary"),
        F.col("confidence").alias("narrative_confidence"), "generated_at")
    both = decided.join(newest, "entry_id", "full_outer").withColumn("shown", F.coalesce("recorded", "newest"))
    out = both.join(notes, "shown", "left")
    known, seen = F.col("decision").isNotNull(), F.col("recorded").isNotNull()
    after = F.coalesce("generated_at", F.lit("")) > F.coalesce("decided_at", F.lit(""))
    state = (F.when(known & seen, "yes").when(known & F.col("shown").isNotNull() & after, "no")
             .when(known & F.col("shown").isNotNull(), "unknown").otherwise(""))
    return out.select(
        "entry_id", "decision", "reviewer", "note", "decided_at", F.col("shown").alias("narrative_id"),
        "narrative_summary", "narrative_confidence",
        F.coalesce(F.col("shown") != F.col("newest"), F.lit(False)).alias("narrative_superseded"),
        state.alias("narrative_seen_by_reviewer"))


def ledgers(decisions: DataFrame, narratives: DataFrame) -> DataFrame:
    """Entries with a note and with a decision, per ledger in the log."""
    rows = narratives.select("ledger_id", "entry_id", F.lit(1).alias("n"), F.lit(0).alias("d")).unionByName(
        decisions.select("ledger_id", "entry_id", F.lit(0).alias("n"), F.lit(1).alias("d")))
    per = rows.groupBy("ledger_id", "entry_id").agg(F.max("n").alias("n"), F.max("d").alias("d"))
    return per.groupBy("ledger_id").agg(F.sum("n").alias("narratives"), F.sum("d").alias("decisions")).orderBy("ledger_id")


def other_ledgers(decisions: DataFrame, narratives: DataFrame, ledger_id: str) -> DataFrame:
    return ledgers(decisions, narratives).filter(F.col("ledger_id") != ledger_id)


def review_status(scored: DataFrame, decisions: DataFrame, narratives: DataFrame, ledger_id: str) -> DataFrame:
    """How far review has got, one row."""
    done = recorded_ids(decisions, ledger_id).withColumn("done", F.lit(1))
    flagged = scored.filter("risk_score > 0").select("entry_id").join(done, "entry_id", "left").agg(
        F.count("*").alias("flagged"), F.count_if(F.col("done").isNull()).alias("outstanding"))
    decided = done.agg(F.count("*").alias("decided"))
    noted = recorded_ids(narratives, ledger_id).agg(F.count("*").alias("narratives"))
    others = other_ledgers(decisions, narratives, ledger_id).agg(F.count("*").alias("other_ledgers"))
    return beside(flagged, decided, noted, others).select(
        F.lit(ledger_id).alias("ledger_id"), "flagged", "decided", "outstanding", "narratives", "other_ledgers")


def decision_reconciliation(scored: DataFrame, decisions: DataFrame, ledger_id: str) -> DataFrame:
    """Current decisions by kind, those with no recorded kind as unrecognised, split by whether
    the entry is flagged now."""
    flagged = scored.filter("risk_score > 0").select("entry_id", F.lit(1).alias("flag"))
    kind = F.coalesce(decision_kind(F.col("decision")), F.lit("unrecognised"))
    return (latest(decisions, ledger_id).select("entry_id", kind.alias("kind")).join(flagged, "entry_id", "left")
            .groupBy("kind").agg(F.count("*").alias("decided"), F.count("flag").alias("decided_flagged")).orderBy("kind"))


def decision_faults(batch: DataFrame, narratives: DataFrame, ledger_id: str) -> DataFrame:
    """What makes a batch of decisions unfit to append: ``problem, rows, example``, from one aggregate."""
    notes = narratives.select(F.col("id").alias("narrative_id"), F.col("entry_id").alias("_entry"), F.col("ledger_id").alias("_ledger"))
    joined = batch.drop("ledger_id").join(notes, "narrative_id", "left")
    own = F.coalesce((F.col("_entry") == F.col("entry_id")) & (F.col("_ledger") == ledger_id), F.lit(False))
    checks = {
        "decision must be one of " + ", ".join(DECISIONS): ~F.coalesce(F.col("decision").isin(list(DECISIONS)), F.lit(False)),
        "a decision must be attributable to a named reviewer": strip(F.coalesce("reviewer", F.lit(""))) == "",
        "a decision must name an entry": strip(F.coalesce("entry_id", F.lit(""))) == "",
        f"a narrative is not one for its entry in ledger {ledger_id}": F.col("narrative_id").isNotNull() & ~own,
    }
    found = [F.struct(F.lit(text).alias("problem"), F.count_if(rule).alias("rows"),
                      F.min(F.when(rule, F.coalesce("entry_id", F.lit("")))).alias("example")).alias(f"c{i}")
             for i, (text, rule) in enumerate(checks.items())]
    return joined.agg(*found).select(F.inline(F.array(*[f"c{i}" for i in range(len(checks))])))


def decision_problems(batch: DataFrame, narratives: DataFrame, ledger_id: str) -> list[str]:
    # one row per kind of problem
    rows = decision_faults(batch, narratives, ledger_id).filter("rows > 0").collect()
    return [f"{r['problem']} ({r['rows']:,} row(s), e.g. {r['example']!a})" for r in rows]
