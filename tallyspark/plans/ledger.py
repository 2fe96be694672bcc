"""A loaded ledger and the questions asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import benford, evaluate, forest, review
from tallyspark.operators.entries import account_amounts, fixed_key_counts
from tallyspark.operators.journal_tests import Settings, registry, run_tests, score_entries, staged_entries
from tallyspark.operators.materiality import Materiality, band, count_by_band, with_bands
from tallyspark.plans.staging import beside, settle
from tallyspark.schema import AGREEMENTS, HELD_OUT, Controls, LedgerError

# Notes that stand beside figures.
CAVEAT = "A flag is a question, not a finding."
SMALL_LEDGER = 50
NO_LABELS_NOTE = "No labels were given, so detection quality was not measured for this ledger."
HELD_OUT_NOTE = (
    "The labels mark held-out archetypes, which no test describes: whatever the rule tier catches of them it "
    "catches by accident, so its recall on them measures nothing."
)
SMALL_NOTE = " entries is a small population; the model tier and Benford analysis need far more to say anything."
# End of fixed values.

ENTRY_COLUMNS = ("entry_id", "posting_date", "fiscal_year", "period", "source", "created_by", "description",
                 "entry_amount", "risk_score", "model_score", "agreement", "tests_fired", "reasons")
LINE_COLUMNS = ("line_no", "account_code", "account_name", "account_type", "description", "debit", "credit")


class Ledger:
    """Lines, flags and both scores of one ledger, each staged once and shared by every question.

    A load that fails leaves nothing half set: fields are assigned only after both tiers have run.
    """

    def __init__(self, lines: DataFrame, controls: Controls | None = None, top_share: float = forest.TOP_SHARE,
                 scores: DataFrame | None = None, stage_lines: bool = True) -> None:
        """``stage_lines=False`` reads ``lines`` in place: right when they are prepared columnar
        files already, and a copy would only be written to be read again."""
        self._lines, self._controls, self._top_share, self._scores = lines, controls or Controls(), top_share, scores
        self._stage_lines = stage_lines
        self.loaded = False

    def load(self) -> "Ledger":
        if self.loaded:
            return self
        lines = settle(self._lines, "lines") if self._stage_lines else self._lines
        settings = Settings(controls=self._controls)
        entries = staged_entries(lines, settings)
        stats = settle(account_amounts(lines), "accounts")
        flags = settle(run_tests(lines, settings=settings, entries=entries, stats=stats), "flags")
        scored = score_entries(entries, flags, ordered=False)
        scores, model = (self._scores, None) if self._scores is not None else forest.score_ledger(lines, entries, stats)
        combined = settle(forest.combine(scored, scores, self._top_share, ordered=False), "combined", wide=True)
        self.lines, self.entries, self.stats, self.flags = lines, entries, stats, flags
        self.combined, self.model = combined, model
        self.loaded = True
        return self

    def top_exceptions(self, **filters) -> DataFrame:
        return top_exceptions(self.load().combined, **filters)

    def search_entries(self, **filters) -> DataFrame:
        return search_entries(self.load().combined, self.lines, **filters)

    def explain_entry(self, entry_id: str, decisions: DataFrame | None = None, narratives: DataFrame | None = None,
                      ledger_id: str | None = None) -> dict[str, DataFrame]:
        """Everything known about one entry, a point filter on each table."""
        self.load()
        one = F.col("entry_id") == entry_id
        if self.combined.filter(one).isEmpty():
            raise LedgerError(f"no entry {entry_id!a} in the ledger")
        out = {
            "entry": self.combined.filter(one).select(*ENTRY_COLUMNS),
            "lines": self.lines.filter(one).select(*LINE_COLUMNS).orderBy("line_no", "account_code"),
            "flags": self.flags.filter(one).orderBy("test_order", "account_code", "line_no").select("test_id", "test_name", "severity", "reason"),
        }
        if decisions is not None and narratives is not None and ledger_id is not None:
            out["narrative_history"] = review.history(narratives, ledger_id, entry_id)
            out["narrative"] = review.latest_narratives(narratives.filter(one), ledger_id)
            out["decisions"] = review.history(decisions, ledger_id, entry_id).select(
                "decided_at", "decision", "reviewer", "note", "narrative_id")
        return out

    def summary(self) -> DataFrame:
        self.load()
        return population_summary(self.combined, self.flags, self.lines)

    def benford(self, by: str | None = None, min_n: int = benford.MIN_SAMPLE) -> DataFrame:
        self.load()
        if by is not None and by not in self.lines.columns:
            raise LedgerError(f"cannot segment by {by!a}; not a ledger column")
        return benford.benford_view(self.lines, by, min_n)


def _within(fiscal_year: int | None, period_from: int | None, period_to: int | None) -> Column:
    keep = F.lit(True)
    if fiscal_year is not None:
        keep = keep & (F.col("fiscal_year") == fiscal_year)
    if period_from is not None:
        keep = keep & (F.col("period") >= period_from)
    if period_to is not None:
        keep = keep & (F.col("period") <= period_to)
    return keep


def _exceptions(combined: DataFrame, fiscal_year: int | None, period_from: int | None, period_to: int | None,
                agreement: str | None) -> DataFrame:
    out = combined.filter("risk_score > 0").filter(_within(fiscal_year, period_from, period_to))
    return out if agreement is None else out.filter(F.col("agreement") == agreement)


def top_exceptions(combined: DataFrame, limit: int = 10, fiscal_year: int | None = None, period_from: int | None = None,
                   period_to: int | None = None, agreement: str | None = None) -> DataFrame:
    """The riskiest flagged entries, with how many matched: a bounded top-k beside one count."""
    found = _exceptions(combined, fiscal_year, period_from, period_to, agreement)
    lead = found.orderBy(F.desc("risk_score"), F.desc("model_score"), "entry_id").limit(limit)
    matching = found.agg(F.count("*").alias("matching"))  # one row
    return beside(lead, matching).select(*ENTRY_COLUMNS, "matching").orderBy(
        F.desc("risk_score"), F.desc("model_score"), "entry_id")


def search_entries(combined: DataFrame, lines: DataFrame, account_code: str | None = None, created_by: str | None = None,
                   source: str | None = None, min_amount: float | None = None, fiscal_year: int | None = None,
                   period: int | None = None, limit: int = 25) -> DataFrame:
    """Entries matching simple filters, riskiest first, unflagged ones included."""
    found = combined.filter(_within(fiscal_year, period, period))
    if account_code:
        found = found.join(lines.filter(F.col("account_code") == account_code).select("entry_id"), "entry_id", "left_semi")
    if created_by:
        found = found.filter(F.col("created_by") == created_by)
    if source:
        found = found.filter(F.col("source") == source)
    if min_amount is not None:
        found = found.filter(F.col("entry_amount") >= F.lit(str(min_amount)).cast("decimal(20,2)"))
    lead = found.orderBy(F.desc("risk_score"), F.desc("entry_amount"), "entry_id").limit(limit)
    matching = found.agg(F.count("*").alias("matching"))
    return beside(lead, matching).select(*ENTRY_COLUMNS, "matching").orderBy(
        F.desc("risk_score"), F.desc("entry_amount"), "entry_id")


def with_review(entries: DataFrame, state: DataFrame) -> DataFrame:
    """Entry rows beside what the review log knows of them."""
    out = entries.join(state.drop("note", "decided_at"), "entry_id", "left")
    return out.withColumns({
        "narrative_superseded": F.coalesce("narrative_superseded", F.lit(False)),
        "narrative_seen_by_reviewer": F.coalesce("narrative_seen_by_reviewer", F.lit(""))})


def explained_entries(combined: DataFrame, lines: DataFrame, flags: DataFrame) -> DataFrame:
    """The bulk form of explain: every flagged entry's lines and flags as rows in a fixed order
    (``part``, ``place``, ``account_code``, ``line_no``), so no entry has to fit in one row."""
    flagged = combined.filter("risk_score > 0").select("entry_id", "risk_score")
    none = F.lit(None)
    line = lines.select("entry_id", F.lit("line").alias("part"), F.lit(0).alias("place"), "account_code", "line_no", "account_name",
                        "debit", "credit", "description", none.cast("string").alias("test_id"), none.cast("string").alias("severity"), none.cast("string").alias("reason"))
    flag = flags.select("entry_id", F.lit("flag").alias("part"), (F.col("test_order") + 1).alias("place"), "account_code", "line_no", none.cast("string").alias("account_name"),
                        none.cast("decimal(18,2)").alias("debit"), none.cast("decimal(18,2)").alias("credit"), none.cast("string").alias("description"), "test_id", "severity", "reason")
    return flagged.join(line.unionByName(flag), "entry_id")


def population_summary(combined: DataFrame, flags: DataFrame, lines: DataFrame) -> DataFrame:
    """The population in numbers, one row; every known test and agreement has a count."""
    entries = combined.agg(
        F.count("*").alias("entries"), F.count_if(F.col("risk_score") > 0).alias("flagged"),
        F.array_join(F.transform(F.array_sort(F.collect_set("fiscal_year")), lambda y: y.cast("string")), ",").alias("fiscal_years"))
    counts = lines.agg(F.count("*").alias("lines"))
    raised = flags.agg(F.count("*").alias("flags_raised"))

    def rolled(rows: DataFrame, column: str, known: tuple[str, ...], name: str) -> DataFrame:
        keyed = fixed_key_counts(rows, column, known)
        place = F.array_position(F.array(*[F.lit(k) for k in known]), F.col("key"))
        item = F.struct(F.when(place == 0, len(known) + 1).otherwise(place).alias("place"), "key", "n")
        text = F.transform(F.array_sort(F.collect_list(item)), lambda i: F.concat(i["key"], F.lit("="), i["n"].cast("string")))
        return keyed.agg(F.array_join(text, ",").alias(name))

    tests = rolled(flags, "test_id", tuple(registry()), "flags_by_test")
    tiers = rolled(combined, "agreement", AGREEMENTS, "tier_agreement")
    out = beside(entries, counts, raised, tests, tiers)
    return out.select("entries", "lines", "fiscal_years", "flagged",
                      F.round(evaluate.ratio(F.col("flagged"), F.col("entries")), 4).alias("flag_rate"),
                      "flags_raised", "flags_by_test", "tier_agreement")


def full_summary(combined: DataFrame, flags: DataFrame, lines: DataFrame, labels: DataFrame | None = None, top: int = 10,
                 m: Materiality | None = None, fiscal_year: int | None = None, status: DataFrame | None = None,
                 report: DataFrame | None = None, top_share: float = forest.TOP_SHARE) -> DataFrame:
    """The summary payload as one row of nested columns: population, model tier, top list, bands,
    review progress, detection and the notes that apply."""
    parts = population_summary(combined, flags, lines).select(F.struct("*").alias("population"))
    tier = combined.agg(F.count_if("model_flag").alias("flagged"), F.lit(top_share).alias("top_pct"))
    if report is not None:
        tier = beside(tier, report)
    parts = beside(parts, tier.select(F.struct("*").alias("model_tier")))
    lead = top_exceptions(combined, top)
    columns = [F.col(c) for c in ENTRY_COLUMNS]
    if m is not None:
        cents = F.round(F.col("entry_amount") * 100).cast("bigint")
        columns.append(band(cents, m, F.col("fiscal_year"), fiscal_year).alias("materiality_band"))
    item = F.struct((-F.col("risk_score")).alias("_r"), (-F.col("model_score")).alias("_m"), F.struct(*columns).alias("entry"))
    # at most ``top`` rows are gathered
    parts = beside(parts, lead.agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["entry"]).alias("top_exceptions")))
    if m is not None:
        banded = count_by_band(with_bands(combined.filter("risk_score > 0"), m, fiscal_year))
        parts = beside(parts, banded.agg(F.map_from_entries(F.collect_list(F.struct("materiality_band", "entries"))).alias("flagged_by_band")))
    if status is not None:
        parts = beside(parts, status.select(F.struct("*").alias("review")))
    notes = []
    if labels is None:
        notes.append(F.lit(NO_LABELS_NOTE))
        found = None
    else:
        found = evaluate.evaluate(flags, labels, combined.select("entry_id"))
        parts = beside(parts, found.select(F.struct("*").alias("detection")))
        recall = evaluate.archetype_reading(evaluate.recall_by_archetype(flags, labels))
        # one item per archetype
        parts = beside(parts, recall.agg(F.collect_list(F.struct("*")).alias("by_archetype")))
        held = F.exists("by_archetype", lambda r: r["anomaly_type"].isin(list(HELD_OUT)))
        notes.append(F.when(held, HELD_OUT_NOTE))
    notes.append(F.when(F.col("population.entries") < SMALL_LEDGER, F.concat(F.col("population.entries").cast("string"), F.lit(SMALL_NOTE))))
    return parts.withColumns({"caveat": F.lit(CAVEAT), "notes": F.filter(F.array(*notes), lambda n: n.isNotNull())})


def exception_queue(combined: DataFrame, flags: DataFrame, decisions: DataFrame, ledger_id: str,
                    severities: list[str] | None = None, tests: list[str] | None = None,
                    agreements: list[str] | None = None, min_amount: float = 0, bands: list[str] | None = None,
                    m: Materiality | None = None, fiscal_year: int | None = None, outstanding_only: bool = False) -> DataFrame:
    """The review queue: entries a chosen flag was raised on, filtered, with the latest decision."""
    chosen = flags
    if severities is not None:
        chosen = chosen.filter(F.col("severity").isin(severities))
    if tests is not None:
        chosen = chosen.filter(F.col("test_id").isin(tests))
    queue = combined.join(chosen.select("entry_id"), "entry_id", "left_semi").filter(
        F.col("entry_amount") >= F.lit(str(min_amount)).cast("decimal(20,2)"))
    if agreements is not None:
        queue = queue.filter(F.col("agreement").isin(agreements))
    extra = []
    if m is not None:
        queue, extra = with_bands(queue, m, fiscal_year), ["materiality_band"]
        if bands is not None:
            queue = queue.filter(F.col("materiality_band").isin(bands))
    if outstanding_only:
        queue = queue.join(review.recorded_ids(decisions, ledger_id), "entry_id", "left_anti")
    current = review.latest(decisions, ledger_id).select("entry_id", "decision", "reviewer")
    return queue.join(current, "entry_id", "left").select(
        "entry_id", "posting_date", "source", "created_by", "entry_amount", *extra, "risk_score", "model_score",
        "agreement", "tests_fired", "decision", "reviewer")


def narration_queue(combined: DataFrame, narrated: DataFrame, top_n: int) -> DataFrame:
    """The next entries to write notes for, those already narrated left out."""
    return (combined.filter("risk_score > 0").join(narrated.select("entry_id"), "entry_id", "left_anti")
            .orderBy(F.desc("risk_score"), F.desc("model_score"), F.desc("entry_amount"), "entry_id").limit(top_n))


def model_only(combined: DataFrame, limit: int = 10) -> DataFrame:
    """Entries only the model finds unusual."""
    return (combined.filter(F.col("agreement") == "model only")
            .orderBy(F.desc("model_score"), "entry_id").limit(limit)
            .select("entry_id", "posting_date", "source", "entry_amount", "model_score"))
