"""Reviewer-note data in bulk: prompts, the reply contract, eval cases and their grading.

Writing the notes is an external service's work; this is the data on either side of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.money import money_text, to_cents
from tallyspark.plans.staging import settle
from tallyspark.schema import ARCHETYPES, LedgerError

# The reply contract, the wording a note may not use, the citation set aside before
# numbers are read, the checks of a grade, and the texts of prompts and refusals.
REQUIRED_KEYS = ("summary", "why_flagged", "evidence_to_request", "suggested_control", "confidence")
CONFIDENCE = ("high", "medium", "low")
TEXT_KEYS = ("summary", "why_flagged", "suggested_control")
FORBIDDEN = (
    r"\bfraud",
    r"\bembezzl",
    r"\bintentional",
    r"\bdeliberate",
    r"\bconceal",
    r"\bcover(ed|ing)? up\b",
    r"\bmanipulat",
    r"\bfalsif",
    r"\bfabricat",
    r"\b(is|was|are|were) (clearly |certainly |definitely |obviously )?(an error|erroneous|wrong|improper|fictitious|illegitimate|unauthori[sz]ed)\b",
    r"\bto (hide|disguise|evade|circumvent)\b",
)
CITATION = r"\bAU[-\u2010-\u2015]C[-\u2010-\u2015\s]*(?:section\s*|\u00a7\s*)?240\b"
METRICS = ("schema_valid", "mentions_required", "no_assertions", "evidence_specific", "no_invented_numbers", "confidence_in_band")
NO_FLAGS = "- (no deterministic test fired)"
PROMPT = ("Journal entry %s\n\nPosted: %s\nKeyed:  %s by %s (source: %s)\nTotal:  $%s\n\nLines:\n%s\n\n"
          "Tests that flagged this entry:\n%s\n\nWrite the reviewer note as JSON.")
FLAG_LINE = "- [%s] %s (severity %s): %s"
LEDGER_LINE = "- line %d: %s %s | debit %s | credit %s | %s"
WHY_ARCHETYPE = "highest-risk flagged entry injected as "
WHY_MULTI = "several tests fired on one entry; the note has to weigh them"
WHY_BENIGN = "an ordinary entry only the access-list test caught; the note should say the innocent reading is more likely"
BENIGN_TEST = "JET-12"
UNRECORDED = "unrecorded"
MISSING = "<NA>"
# End of fixed values.

CASE_SCHEMA = T.StructType([
    T.StructField("entry_id", T.StringType()), T.StructField("archetype", T.StringType()),
    T.StructField("tests_fired", T.StringType()), T.StructField("why_chosen", T.StringType()),
    T.StructField("must_mention", T.ArrayType(T.StringType())), T.StructField("must_not_assert", T.ArrayType(T.StringType())),
    T.StructField("expected_confidence", T.ArrayType(T.StringType())), T.StructField("notes", T.StringType()),
    T.StructField("overrides", T.StructType([T.StructField("lines", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))])),
])
NOTE_SCHEMA = T.StructType([
    T.StructField("summary", T.StringType()), T.StructField("why_flagged", T.StringType()),
    T.StructField("evidence_to_request", T.ArrayType(T.StringType())),
    T.StructField("suggested_control", T.StringType()), T.StructField("confidence", T.StringType())])
_METRICS_MAP = T.MapType(T.StringType(), T.BooleanType())
_HISTORY = T.StructType([
    T.StructField("metrics", _METRICS_MAP), T.StructField("grader_sha256", T.StringType()),
    T.StructField("cases_sha256", T.StringType()), T.StructField("graded_at", T.StringType())])
ROW_SCHEMA = T.StructType([
    T.StructField("entry_id", T.StringType()), T.StructField("archetype", T.StringType()), T.StructField("tests_fired", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("usage", T.MapType(T.StringType(), T.LongType())), T.StructField("latency_s", T.DoubleType()),
    T.StructField("narrative", NOTE_SCHEMA), T.StructField("metrics", _METRICS_MAP), T.StructField("prompt", T.StringType()),
    T.StructField("overrides", CASE_SCHEMA["overrides"].dataType), T.StructField("graded_at", T.StringType()),
    T.StructField("cases_sha256", T.StringType()), T.StructField("grader_sha256", T.StringType()),
    T.StructField("ledger_sha256", T.StringType()), T.StructField("regraded_at", T.StringType()),
    T.StructField("previous_cases_sha256", T.StringType()), T.StructField("metrics_history", T.ArrayType(_HISTORY))])


# -- prompts ----------------------------------------------------------------------------

def build_prompts(scored: DataFrame, flags: DataFrame, lines: DataFrame) -> DataFrame:
    """``entry_id, prompt`` for every row of ``scored`` (usually the flagged ones): its header,
    its lines in order and its flags in order, one string."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))

    wanted = scored.select("entry_id")
    line = F.format_string(LEDGER_LINE, "line_no", "account_code", shown("account_name"),
                           money_text(to_cents(F.col("debit"))), money_text(to_cents(F.col("credit"))), shown("description"))
    per_lines = lines.join(wanted, "entry_id", "left_semi").groupBy("entry_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "account_code", line.alias("text")))), lambda x: x["text"]), "\n").alias("_lines"))
    flag = F.format_string(FLAG_LINE, "test_id", "test_name", "severity", "reason")
    per_flags = flags.join(wanted, "entry_id", "left_semi").groupBy("entry_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("test_order", "account_code", "line_no", flag.alias("text")))), lambda x: x["text"]), "\n").alias("_flags"))
    out = scored.join(per_lines, "entry_id", "left").join(per_flags, "entry_id", "left")
    return out.select("entry_id", F.format_string(
        PROMPT, "entry_id", F.date_format("posting_date", "yyyy-MM-dd"), F.date_format("entered_at", "yyyy-MM-dd HH:mm"),
        shown("created_by"), shown("source"), money_text(to_cents(F.col("entry_amount"))),
        F.coalesce("_lines", F.lit("")), F.coalesce("_flags", F.lit(NO_FLAGS))).alias("prompt"))


# -- the reply contract -------------------------------------------------------------------

def _kind(schema: Column) -> Column:
    return (F.when(schema == "VOID", "null").when(schema == "BOOLEAN", "bool").when(schema == "BIGINT", "int")
            .when(schema.startswith("ARRAY"), "list").when(schema.startswith("OBJECT"), "dict").otherwise("float"))


def check_replies(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Replies held to the contract: adds ``valid``, ``why`` (the refusal) and ``note`` (cleaned)."""
    work = replies.withColumn("_t", F.regexp_replace(column, r"^\s+|\s+$", ""))
    opened = F.when(F.instr("_t", "\n") > 0, F.expr(r"substring(_t, instr(_t, '\n') + 1)")).otherwise(F.col("_t"))
    closed = F.regexp_replace(opened, r"```\s*$", "")
    work = work.withColumn("_body", F.when(F.col("_t").startswith("```"), closed).otherwise(F.col("_t")))
    work = work.withColumn("_p", F.try_parse_json("_body"))
    shape = F.schema_of_variant("_p")
    got = {k: F.try_variant_get("_p", f"$.{k}", "variant") for k in REQUIRED_KEYS}
    work = work.withColumns({"_object": F.coalesce(shape.startswith("OBJECT"), F.lit(False)), **{f"_{k}": v for k, v in got.items()}})
    work = work.withColumns({f"_s_{k}": F.schema_of_variant(f"_{k}") for k in REQUIRED_KEYS})
    work = work.withColumn("_items", F.when(F.col("_s_evidence_to_request").startswith("ARRAY"),
                                            F.try_variant_get("_evidence_to_request", "$", "array<variant>")))
    bad = F.filter(F.transform("_items", lambda x, i: F.struct((i + 1).alias("n"), F.schema_of_variant(x).alias("s"))), lambda b: b["s"] != "STRING")
    joined = F.transform("_items", lambda x: F.array_join(F.filter(F.transform(
        F.split(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")), r"\r\n|\r|\n"), lambda part: F.regexp_replace(part, r"^\s+|\s+$", "")),
        lambda part: part != ""), " "))
    evidence = F.filter(joined, lambda x: x != "")
    missing = F.filter(F.array(*[F.when(F.col(f"_{k}").isNull(), F.lit(k)) for k in REQUIRED_KEYS]), lambda k: k.isNotNull())
    level = F.lower(F.trim(F.coalesce(F.try_variant_get("_confidence", "$", "string"), F.lit("None"))))
    # an unpaired surrogate escape cannot be kept as text
    lone = F.col("_body").rlike(r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2}")
    why = (F.when(F.col("_p").isNull(), "response was not valid JSON")
           .when(~F.col("_object"), "response was not a JSON object")
           .when(F.size(missing) > 0, F.concat(F.lit("missing key(s): "), F.array_join(missing, ", ")))
           .when(F.col("_items").isNull(), "evidence_to_request must be a list")
           .when(F.size(bad) > 0, F.concat(F.lit("evidence_to_request item "), F.get(bad, F.lit(0))["n"].cast("string"),
                                           F.lit(" must be text, got "), _kind(F.get(bad, F.lit(0))["s"])))
           .when(lone, "a field is not text the store can keep: it holds a lone surrogate")
           .when(F.size(evidence) == 0, "evidence_to_request must not be empty")
           .when(~level.isin(list(CONFIDENCE)), F.concat(F.lit("confidence must be one of high, medium, low, got '"), level, F.lit("'"))))
    for key in TEXT_KEYS:
        why = why.when(F.col(f"_s_{key}") != "STRING", F.concat(F.lit(f"{key} must be text, got "), _kind(F.col(f"_s_{key}"))))
        why = why.when(F.regexp_replace(F.try_variant_get(f"_{key}", "$", "string"), r"\s", "") == "", f"{key} must not be empty")
    text = {k: F.try_variant_get(f"_{k}", "$", "string") for k in TEXT_KEYS}
    note = F.struct(text["summary"].alias("summary"), text["why_flagged"].alias("why_flagged"), evidence.alias("evidence_to_request"),
                    text["suggested_control"].alias("suggested_control"), level.alias("confidence"))
    return work.withColumn("why", why).withColumns({"valid": F.col("why").isNull(), "note": F.when(F.col("why").isNull(), note)}).select(
        *replies.columns, "valid", "why", "note")


# -- numbers and grades ---------------------------------------------------------------------

def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)" + CITATION, " ")


def numbers_in(text: Column) -> Column:
    """Numbers of three digits or more, as a set: 9,900.00, 9,900 and 9900 are one."""
    found = F.regexp_extract_all(text, F.lit(r"(\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?)"), 1)
    plain = F.transform(found, lambda t: F.regexp_replace(F.replace(t, F.lit(","), F.lit("")), r"\.00$", ""))
    return F.array_distinct(F.filter(plain, lambda t: F.length(F.replace(t, F.lit("."), F.lit(""))) >= 3))


def note_text(note: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(note["summary"], F.lit("")), F.coalesce(note["why_flagged"], F.lit("")),
                       F.array_join(note["evidence_to_request"], "\n"), F.coalesce(note["suggested_control"], F.lit("")))


def grade(note: Column, prompt: Column, must_mention: Column, must_not_assert: Column, expected: Column) -> Column:
    """A note's checks as a map of booleans, ``passed`` last; a null note fails every check."""
    text = note_text(note)
    said = F.exists(must_not_assert, lambda p: F.rlike(text, F.concat(F.lit("(?i)"), p)))
    for pattern in FORBIDDEN:
        said = said | text.rlike("(?i)" + pattern)
    names = F.regexp_extract_all(prompt, F.lit(r"(?m)^- line \d+: \S+ (.+?) \|"), 1)
    specific = F.exists(note["evidence_to_request"], lambda e: e.rlike(r"\d") | F.exists(names, lambda n: F.contains(F.lower(e), F.lower(n))))
    invented = F.size(F.array_except(numbers_in(strip_citations(text)), numbers_in(prompt))) > 0
    checks = {
        "schema_valid": F.lit(True), "mentions_required": F.forall(must_mention, lambda p: F.rlike(text, F.concat(F.lit("(?i)"), p))),
        "no_assertions": ~said, "evidence_specific": specific, "no_invented_numbers": ~invented,
        "confidence_in_band": F.array_contains(expected, note["confidence"]),
    }
    passed = F.lit(True)
    for c in checks.values():
        passed = passed & c
    parts = [F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit(False)) for kv in {**checks, "passed": passed}.items() for x in kv]
    none = [F.lit(x) for m in (*METRICS, "passed") for x in (m, False)]
    return F.when(note.isNull(), F.create_map(*none)).otherwise(F.create_map(*parts))


def grade_notes(notes: DataFrame, cases: DataFrame, prompts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``entry_id, metrics`` of each case's note (a checked ``note``; null where refused), and the columns ``keep`` of what they were graded
    by: of cases, prompts and notes, so that no caller joins those again. A case without a prompt has no row."""
    told = [c for c in notes.columns if c in ("entry_id", "note") or c in keep and c not in (*cases.columns, *prompts.columns)]
    joined = cases.join(prompts, "entry_id").join(notes.select(*told), "entry_id", "left")
    return joined.select("entry_id", *keep, grade(F.col("note"), F.col("prompt"), F.col("must_mention"), F.col("must_not_assert"),
                                                  F.col("expected_confidence")).alias("metrics"))


# -- cases ------------------------------------------------------------------------------------

def select_cases(scored: DataFrame, labels: DataFrame, n_multi: int = 3, n_benign: int = 2) -> DataFrame:
    """A deterministic case set: the riskiest flagged entry per archetype, entries several tests
    fired on (new combinations first), and ordinary entries only the access-list test caught."""
    spark = scored.sparkSession
    flagged = settle(scored.filter("risk_score > 0").select("entry_id", "risk_score", "n_flags", "tests_fired")
                     .join(labels, "entry_id", "left"), "flagged")
    places = spark.createDataFrame([(a, i) for i, a in enumerate(ARCHETYPES)], "anomaly_type string, place int")
    best = F.min(F.struct((-F.col("risk_score")).alias("r"), "entry_id", "tests_fired")).alias("b")
    chosen = settle(flagged.join(F.broadcast(places), "anomaly_type").groupBy("anomaly_type", "place").agg(best).select(
        "place", F.col("b.entry_id").alias("entry_id"), F.col("anomaly_type").alias("archetype"), F.col("b.tests_fired").alias("tests_fired"),
        F.concat(F.lit(WHY_ARCHETYPE), "anomaly_type").alias("why_chosen")), "chosen")
    several = flagged.filter("n_flags >= 2").join(F.broadcast(chosen.select("entry_id")), "entry_id", "left_anti")
    by_risk = [F.desc("risk_score"), F.asc("entry_id")]
    fresh = (several.join(F.broadcast(chosen.select("tests_fired")), "tests_fired", "left_anti").groupBy("tests_fired").agg(best)
             .select(F.col("b.entry_id").alias("entry_id"), "tests_fired", (-F.col("b.r")).alias("risk_score")))
    fresh = settle(fresh.orderBy(*by_risk).limit(n_multi), "fresh")
    rest = (several.join(F.broadcast(fresh.select("entry_id")), "entry_id", "left_anti")
            .orderBy(*by_risk).limit(n_multi).select("entry_id", "tests_fired", "risk_score"))
    multi = fresh.withColumn("phase", F.lit(0)).unionByName(rest.withColumn("phase", F.lit(1))).orderBy("phase", *by_risk).limit(n_multi)
    base = len(ARCHETYPES)
    multi = multi.select((F.col("phase") + base).alias("place"), "entry_id", F.lit("multi_flag").alias("archetype"), "tests_fired", F.lit(WHY_MULTI).alias("why_chosen"))
    benign = flagged.filter((F.col("tests_fired") == BENIGN_TEST) & ~F.col("is_anomaly")).orderBy("entry_id").limit(n_benign).select(
        F.lit(base + 2).alias("place"), "entry_id", F.lit("benign").alias("archetype"), "tests_fired", F.lit(WHY_BENIGN).alias("why_chosen"))
    level = F.when(F.col("archetype") == "benign", F.array(F.lit("low"))).otherwise(F.array(*[F.lit(c) for c in CONFIDENCE]))
    return chosen.unionByName(multi).unionByName(benign).withColumn("expected_confidence", level)


def case_problems(cases: DataFrame, scored: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Why a case set is stale against a ledger: ``entry_id, problem``, no row when it is not."""
    now = scored.select("entry_id", F.col("tests_fired").alias("now"))
    joined = cases.join(now, "entry_id", "left")
    stale = joined.select("entry_id", F.when(F.col("now").isNull(), "not in the ledger").when(
        F.col("now") != F.col("tests_fired"), F.format_string("tests fired '%s', case expects '%s'", "now", "tests_fired")).alias("problem"))
    out = stale.filter(F.col("problem").isNotNull())
    if lines is not None:
        named = joined.filter(F.col("now").isNotNull()).select("entry_id", F.explode(F.map_keys("overrides.lines")).alias("line"))
        absent = named.join(lines.select("entry_id", F.col("line_no").cast("string").alias("line")), ["entry_id", "line"], "left_anti")
        out = out.unionByName(absent.select("entry_id", F.format_string("no line %s to override", "line").alias("problem")))
    return out


def apply_overrides(cases: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines with the cases' replacement descriptions; the ledger itself is untouched."""
    new = cases.select("entry_id", F.explode("overrides.lines").alias("line", "fields")).select(
        "entry_id", F.col("line").cast("int").alias("line_no"), F.try_element_at("fields", F.lit("description")).alias("_new"))
    return lines.join(new, ["entry_id", "line_no"], "left").withColumn("description", F.coalesce("_new", "description")).drop("_new").select(*lines.columns)


def refuse_bad_cases(cases: DataFrame) -> None:
    """Refuse repeated cases and overrides that are not one line of description on a numbered line."""
    repeated = cases.groupBy("entry_id").count().filter("count > 1").agg(F.count("*"), F.min("entry_id")).first()
    fields = cases.select("entry_id", F.explode("overrides.lines").alias("line", "fields"))
    text = F.try_element_at("fields", F.lit("description"))
    bad = fields.filter(~F.col("line").rlike("^[0-9]+$") | (F.size("fields") != 1) | text.isNull() | (F.trim(text) == "") | text.rlike(r"[\r\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"))
    odd = bad.agg(F.count("*"), F.min("entry_id")).first()
    problems = ([f"{repeated[0]} entry id(s) are repeated in the case set (e.g. {repeated[1]})"] if repeated[0] else []) + (
        [f"{odd[0]} override(s) are not one line of description text on a numbered line (e.g. {odd[1]})"] if odd[0] else [])
    if problems:
        raise LedgerError("; ".join(problems))


# -- results ------------------------------------------------------------------------------------

def aggregate_rows(rows: DataFrame) -> DataFrame:
    """Pass rates over graded rows, counts of the rest, token sums and the hashes seen, one row."""
    graded = F.col("status").isin("ok", "invalid")
    n = F.count_if(graded)

    def passes(m: str) -> Column:
        return F.count_if(graded & F.coalesce(F.try_element_at("metrics", F.lit(m)), F.lit(False)))

    def seen(c: str, rule: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(rule, F.coalesce(c, F.lit(UNRECORDED))))), ",")

    again = graded & (F.size(F.coalesce("metrics_history", F.array().cast(T.ArrayType(_HISTORY)))) > 0)
    first = F.get("metrics_history", F.lit(0))
    changed = again & ~F.try_element_at(first["metrics"], F.lit("passed")).eqNullSafe(F.try_element_at("metrics", F.lit("passed")))
    usage = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    return rows.agg(
        F.count("*").alias("cases"), n.alias("graded"), F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "invalid").alias("invalid"), F.count_if(F.col("status") == "missing").alias("missing"),
        *[F.coalesce(F.round(F.try_divide(passes(m), n), 4), F.lit(0.0)).alias(m) for m in (*METRICS, "passed")],
        F.count("usage").alias("requests"), *[F.coalesce(F.sum(F.try_element_at("usage", F.lit(u))), F.lit(0)).alias(u) for u in usage],
        seen("cases_sha256", F.lit(True)).alias("cases_seen"), seen("grader_sha256", graded).alias("graders_seen"),
        seen("ledger_sha256", graded).alias("ledgers_seen"), F.max("regraded_at").alias("regraded_at"),
        F.count_if(again).alias("rows_regraded"), F.count_if(changed).alias("rows_with_changed_result"),
        F.count_if(again & ~first["graded_at"].eqNullSafe(F.col("graded_at"))).alias("rows_with_unkept_grades"),
        F.count("previous_cases_sha256").alias("rows_regraded_across_cases"))


def confidence_baselines(cases: DataFrame) -> DataFrame:
    """What always answering one confidence level would score."""
    counts = cases.agg(F.count("*").alias("cases"), *[F.count_if(F.array_contains("expected_confidence", c)).alias(c) for c in CONFIDENCE])
    items = [F.struct(F.lit(c).alias("confidence"), F.col(c).alias("accepted"), F.col("cases").alias("cases")) for c in CONFIDENCE]
    return counts.select(F.inline(F.array(*items)))


def regrade(rows: DataFrame, cases: DataFrame, prompts: DataFrame, cases_sha256: str, grader_sha256: str,
            ledger_sha256: str, now: str, allow_cases_change: bool = False) -> DataFrame:
    """Stored rows scored again, the replaced grades kept in ``metrics_history``; refused when rows
    repeat, are left out, come from another ledger, or were graded under another case file.
    The result is a new version of the rows; the stored ones are not touched."""
    stored = rows.groupBy("entry_id").agg(F.count("*").alias("_n"))
    mine = cases.select("entry_id", F.col("overrides").alias("_overrides"), "must_mention", "must_not_assert", "expected_confidence", F.lit(1).alias("_case"))
    work = rows.join(stored, "entry_id").join(mine, "entry_id", "left").join(
        prompts.select("entry_id", F.col("prompt").alias("_rebuilt")), "entry_id", "left")
    work = settle(work, "stored")
    crossed = (F.col("status") != "error") & (F.coalesce("cases_sha256", F.lit(UNRECORDED)) != cases_sha256)
    same = F.to_json("overrides").eqNullSafe(F.to_json("_overrides"))
    checks = {
        "row(s) share an entry with another stored row": F.col("_n") > 1,
        "stored row(s) are not in the case set": F.col("_case").isNull(),
        "row(s) record another ledger": F.col("ledger_sha256").isNotNull() & (F.col("ledger_sha256") != ledger_sha256),
        "row(s) have overrides that changed after their note was written": F.col("_case").isNotNull() & ~same,
        "stored prompt(s) do not rebuild from this ledger": F.col("_case").isNotNull() & ~F.col("_rebuilt").eqNullSafe(F.col("prompt")),
        "row(s) were graded under a different case file": F.lit(not allow_cases_change) & crossed,
    }
    row = work.agg(F.count("*").alias("all"), *[F.count_if(r).alias(f"c{i}") for i, r in enumerate(checks.values())],
                   *[F.min(F.when(r, F.col("entry_id"))).alias(f"e{i}") for i, r in enumerate(checks.values())]).first()
    if not row["all"]:
        raise LedgerError("nothing to re-grade: there are no stored rows")
    problems = [f"{row[f'c{i}']} {text} (e.g. {row[f'e{i}']})" for i, text in enumerate(checks) if row[f"c{i}"]]
    if problems:
        raise LedgerError("; ".join(problems))
    graded = F.col("status") != "error"
    kept = F.struct(F.col("metrics").alias("metrics"), F.coalesce("grader_sha256", F.lit(UNRECORDED)).alias("grader_sha256"),
                    F.coalesce("cases_sha256", F.lit(UNRECORDED)).alias("cases_sha256"), F.coalesce("regraded_at", "graded_at").alias("graded_at"))
    history = F.concat(F.coalesce("metrics_history", F.array().cast(T.ArrayType(_HISTORY))), F.array(kept))
    fresh = grade(F.when(F.col("status") == "ok", F.col("narrative")), F.col("prompt"), F.col("must_mention"), F.col("must_not_assert"), F.col("expected_confidence"))
    return work.select(*[F.col(c) for c in rows.columns if c not in ("metrics", "metrics_history", "grader_sha256", "regraded_at", "previous_cases_sha256", "cases_sha256", "ledger_sha256")],
                       F.when(graded, fresh).otherwise(F.col("metrics")).alias("metrics"),
                       F.when(graded, history).otherwise(F.col("metrics_history")).alias("metrics_history"),
                       F.when(graded, F.lit(grader_sha256)).otherwise(F.col("grader_sha256")).alias("grader_sha256"),
                       F.when(graded, F.lit(now)).otherwise(F.col("regraded_at")).alias("regraded_at"),
                       F.when(crossed, F.coalesce("previous_cases_sha256", "cases_sha256", F.lit(UNRECORDED))).otherwise(F.col("previous_cases_sha256")).alias("previous_cases_sha256"),
                       F.when(graded, F.lit(cases_sha256)).otherwise(F.col("cases_sha256")).alias("cases_sha256"),
                       F.lit(ledger_sha256).alias("ledger_sha256")).select(*rows.columns)


def missing_rows(cases: DataFrame, rows: DataFrame, cases_sha256: str) -> DataFrame:
    """A row for each case a re-grade found nothing stored for."""
    absent = cases.join(rows.select("entry_id"), "entry_id", "left_anti")
    known = {"entry_id": F.col("entry_id"), "archetype": F.col("archetype"), "tests_fired": F.col("tests_fired"), "status": F.lit("missing"),
             "error": F.lit("no stored result row for this case; a re-grade never writes notes"), "cases_sha256": F.lit(cases_sha256)}
    return absent.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ROW_SCHEMA.fields])
