"""Queries of groups B to I: derivation, entries, tests, Benford, model, evaluation, samples, questions."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.catalog.registry import Staged, query
from tallyspark.catalog.views import CONTROLS
from tallyspark.functions.calendar import days_to_period_end, federal_holidays
from tallyspark.functions.money import double_to_cents, to_cents
from tallyspark.operators import benford, entries, evaluate, features, forest, ingest, journal_tests, sampling
from tallyspark.operators.materiality import Materiality, count_by_band, with_bands
from tallyspark.operators.review import latest, recorded_ids, review_status
from tallyspark.plans import ledger as questions
from tallyspark.plans.staging import beside
from tallyspark.schema import AGREEMENTS, DECISIONS

MATERIALITY = Materiality(Decimal("50000"))
YEAR = 1998
SEED = 7
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
PD, EA = TS.format("posting_date"), TS.format("entered_at")

# -- B: derivation ---------------------------------------------------------------------


@query("a02_prepared_table", f"""SELECT entry_id, line_no, {PD}, {EA}, fiscal_year, period, account_code, account_name, account_type,
    description, debit_cents, credit_cents, source, created_by FROM gl""")
def _(s: Staged) -> DataFrame:
    raw = s.lines.select(*ingest.REQUIRED_COLUMNS)
    return ingest.prepare(raw).select(*[c for c in ingest.REQUIRED_COLUMNS if c not in ("debit", "credit")], "debit_cents", "credit_cents")


@query("b08_derived_columns", """SELECT entry_id, line_no, amount_cents, abs_cents, hour(entered_at) AS entered_hour,
    isodow(entered_at) - 1 AS entered_dow, isodow(entered_at) >= 6 AS is_weekend,
    CAST(entered_at AS DATE) IN (SELECT hd FROM holiday) AS is_holiday,
    date_diff('day', CAST(entered_at AS DATE), CAST(posting_date AS DATE)) AS posting_lag_days FROM gl""")
def _(s: Staged) -> DataFrame:
    return s.lines.select("entry_id", "line_no", "amount_cents", "abs_cents", "entered_hour", "entered_dow", "is_weekend",
                          "is_holiday", "posting_lag_days")


@query("b09_federal_holidays", "SELECT strftime(hd, '%Y-%m-%d') AS holiday_date FROM holiday")
def _(s: Staged) -> DataFrame:
    years = s.lines.agg(F.min("fiscal_year"), F.max("fiscal_year")).first()
    return federal_holidays(s.spark, years[0], years[1])


_LIMBS = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {15 * i + 1}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4))


@query("b10_ledger_digest", f"""SELECT count(*) AS lines, 'csv:' || sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {_LIMBS})) AS ledger_id FROM (
    SELECT sha256('["' || concat_ws('","', entry_id, line_no, strftime(posting_date, '%Y-%m-%dT%H:%M:%S'), strftime(entered_at, '%Y-%m-%dT%H:%M:%S'),
      fiscal_year, period, account_code, account_name, account_type, description, printf('%d.%02d', debit_cents // 100, debit_cents % 100),
      printf('%d.%02d', credit_cents // 100, credit_cents % 100), source, created_by) || '"]') AS h FROM gl)""")
def _(s: Staged) -> DataFrame:
    return ingest.ledger_digest(s.lines)


@query("b12_dollars_to_cents", "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 100 + 0.5::DOUBLE) AS BIGINT) AS cents FROM lineitem")
def _(s: Staged) -> DataFrame:
    return s.table("lineitem").select("l_orderkey", "l_linenumber", double_to_cents(F.col("l_extendedprice")).alias("cents"))


@query("b13_days_to_period_end", "SELECT entry_id, line_no, date_diff('day', CAST(posting_date AS DATE), last_day(posting_date)) AS days FROM gl")
def _(s: Staged) -> DataFrame:
    return s.lines.select("entry_id", "line_no", days_to_period_end(F.col("posting_date")).alias("days"))


# -- C: entries --------------------------------------------------------------------------

_ENTRY = f"entry_id, {PD}, {EA}, fiscal_year, period, source, created_by, description, n_lines"


@query("c01_entry_level", f"""SELECT {_ENTRY}, td AS total_debit_cents, tc AS total_credit_cents, ac AS entry_cents, imb AS imbalance_cents,
    hour(entered_at) AS entered_hour, is_weekend, is_holiday FROM ent""")
def _(s: Staged) -> DataFrame:
    out = entries.entry_level(s.lines)
    cents = {f"{n}_cents": to_cents(F.col(n)) for n in ("total_debit", "total_credit", "imbalance")}
    return (out.withColumns({**cents, "entry_cents": to_cents(F.col("entry_amount"))})
            .drop("total_debit", "total_credit", "imbalance", "entry_amount"))


@query("c02_entry_pairs", "SELECT entry_id, debit_accounts, credit_accounts, pair FROM pairs")
def _(s: Staged) -> DataFrame:
    return entries.entry_pairs(s.lines)


@query("c03_value_shares", """SELECT dimension, value, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY dimension) AS DOUBLE), 9) AS share FROM (
    SELECT 'pair' AS dimension, pair AS value FROM ent UNION ALL SELECT 'created_by', created_by FROM ent UNION ALL SELECT 'source', source FROM ent
    UNION ALL SELECT 'debit_side', coalesce(debit_accounts, '') FROM ent UNION ALL SELECT 'credit_side', coalesce(credit_accounts, '') FROM ent)
    WHERE value IS NOT NULL GROUP BY dimension, value""")
def _(s: Staged) -> DataFrame:
    return features.category_shares(s.entries).withColumn("share", F.round("share", 9))


@query("c04_main_account", """SELECT entry_id, account_code AS main_account FROM (SELECT *, row_number() OVER (
    PARTITION BY entry_id ORDER BY abs_cents DESC, line_no) AS rn FROM gl) WHERE rn = 1""")
def _(s: Staged) -> DataFrame:
    return entries.main_accounts(s.lines)


@query("c05_account_median_mad", "SELECT account_code, n, round(med, 9) AS median, round(mad, 9) AS mad FROM acct")
def _(s: Staged) -> DataFrame:
    return entries.account_amounts(s.lines).select("account_code", "n", F.round("median", 9).alias("median"), F.round("mad", 9).alias("mad"))


@query("c06_flags_by_test", """SELECT t.test_id AS key, count(f.test_id) AS n FROM (SELECT 'JET-' || lpad(CAST(i AS VARCHAR), 2, '0') AS test_id
    FROM range(1, 13) r(i)) t LEFT JOIN flags f USING (test_id) GROUP BY 1""")
def _(s: Staged) -> DataFrame:
    return entries.fixed_key_counts(s.flags, "test_id", tuple(journal_tests.TESTS))


@query("c06_counts_by_decision", """SELECT k.key, count(c.decision) AS n FROM (VALUES ('accept'), ('dismiss'), ('escalate')) k(key)
    LEFT JOIN cur c ON c.decision = k.key GROUP BY 1""")
def _(s: Staged) -> DataFrame:
    return entries.fixed_key_counts(latest(s.decisions, "csv:a"), "decision", DECISIONS)


@query("c06_counts_by_agreement", """SELECT k.key, count(c.agreement) AS n FROM (VALUES ('both'), ('rules only'), ('model only'), ('neither')) k(key)
    LEFT JOIN combined c ON c.agreement = k.key GROUP BY 1""")
def _(s: Staged) -> DataFrame:
    return entries.fixed_key_counts(s.combined, "agreement", AGREEMENTS)


@query("c07_sample_population", f"""SELECT entry_id, strftime(posting_date, '%Y-%m-%d') AS posting_date, fiscal_year, description, ac AS cents
    FROM ent WHERE fiscal_year = {YEAR} AND ac > 0""")
def _(s: Staged) -> DataFrame:
    return sampling.population(s.entries, YEAR)[0]


@query("c07_population_facts", f"""SELECT CAST({YEAR} AS BIGINT) AS fiscal_year, count(*) FILTER (fiscal_year = {YEAR}) AS entries_in_year,
    count(*) FILTER (fiscal_year = {YEAR} AND ac > 0) AS sampled_from, count(*) FILTER (fiscal_year = {YEAR} AND ac = 0) AS left_out_no_amount,
    count(*) FILTER (fiscal_year = {YEAR} AND ac < 0) AS left_out_negative, count(*) FILTER (fiscal_year <> {YEAR}) AS other_years,
    CAST(sum(ac) FILTER (fiscal_year = {YEAR} AND ac > 0) AS BIGINT) AS book_cents FROM ent""")
def _(s: Staged) -> DataFrame:
    return sampling.population(s.entries, YEAR)[1]


@query("c08_fiscal_year", f"SELECT DISTINCT fiscal_year FROM ent WHERE fiscal_year = {YEAR}")
def _(s: Staged) -> DataFrame:
    year = entries.fiscal_year_for(s.entries, YEAR)
    return s.entries.filter(F.col("fiscal_year") == year).select("fiscal_year").distinct()


# -- D: tests ----------------------------------------------------------------------------

_NAMES = ("round_amount", "weekend_entry", "after_hours", "holiday_entry", "period_end_manual_revenue", "just_under_threshold",
          "duplicate_entries", "rare_account_pair", "dormant_account", "unbalanced_entry", "large_value_outlier", "unapproved_manual_entry")


def _one_test(number: int, name: str) -> None:
    test_id = f"JET-{number:02d}"

    @query(f"d{number:02d}_{name}", f"SELECT entry_id, test_id, test_name, severity, reason FROM f{number:02d}")
    def _(s: Staged) -> DataFrame:
        return journal_tests.public_flags(journal_tests.run_tests(s.lines, [test_id], settings=s.settings, entries=s.entries))


for _i, _name in enumerate(_NAMES, 1):
    _one_test(_i, _name)


@query("d13_all_tests", "SELECT entry_id, test_id, test_name, severity, reason FROM flags")
def _(s: Staged) -> DataFrame:
    return journal_tests.public_flags(journal_tests.run_tests(s.lines, settings=s.settings, entries=s.entries, stats=s.stats))


@query("d14_scored_entries", f"SELECT {_ENTRY}, ac AS entry_cents, risk_score, n_flags, tests_fired, reasons FROM scored")
def _(s: Staged) -> DataFrame:
    return journal_tests.score_entries(s.entries, s.flags).select(
        "entry_id", *entries.HEADER, "n_lines", "entry_cents", "risk_score", "n_flags", "tests_fired", "reasons")


@query("d15_flag_summary", "SELECT test_id, test_name, severity, count(*) AS flags FROM flags GROUP BY ALL")
def _(s: Staged) -> DataFrame:
    return journal_tests.flag_summary(s.flags)


@query("d16_threshold_sweep", """SELECT v AS value, count(z.entry_id) AS flags_raised, count(DISTINCT z.entry_id) AS entries_flagged,
    count(DISTINCT CASE WHEN l.is_anomaly THEN z.entry_id END) AS true_positives,
    round(CASE WHEN count(DISTINCT z.entry_id) = 0 THEN 0 ELSE count(DISTINCT CASE WHEN l.is_anomaly THEN z.entry_id END) / CAST(count(DISTINCT z.entry_id) AS DOUBLE) END, 4) AS precision,
    CAST(NULL AS BIGINT) AS intended_caught, CAST(NULL AS BIGINT) AS intended_n
    FROM (VALUES (2.5::DOUBLE), (3.0), (3.5), (4.0), (4.5), (5.0), (50.0)) t(v) LEFT JOIN zlines z ON z.z > v LEFT JOIN lab l USING (entry_id) GROUP BY v""")
def _(s: Staged) -> DataFrame:
    z = journal_tests.robust_z(s.lines, s.stats)
    return evaluate.sweep(z, "z", (2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 50.0), s.labels, lambda m, v: m > v, "JET-11")


@query("d16_dormancy_sweep", """SELECT v AS value, count(d.entry_id) AS flags_raised, count(DISTINCT d.entry_id) AS entries_flagged,
    count(DISTINCT CASE WHEN l.is_anomaly THEN d.entry_id END) AS true_positives,
    round(CASE WHEN count(DISTINCT d.entry_id) = 0 THEN 0 ELSE count(DISTINCT CASE WHEN l.is_anomaly THEN d.entry_id END) / CAST(count(DISTINCT d.entry_id) AS DOUBLE) END, 4) AS precision,
    count(DISTINCT CASE WHEN l.anomaly_type = 'dormant_account' THEN d.entry_id END) AS intended_caught,
    (SELECT count(*) FROM lab WHERE anomaly_type = 'dormant_account') AS intended_n
    FROM (VALUES (60.0::DOUBLE), (90.0), (120.0), (180.0), (240.0)) t(v) LEFT JOIN (SELECT *, date_sub('day', lag(posting_date) OVER (
      PARTITION BY account_code ORDER BY posting_date, entered_at, entry_id, line_no), posting_date) AS gap FROM gl) d ON d.gap > v
    LEFT JOIN lab l USING (entry_id) GROUP BY v""")
def _(s: Staged) -> DataFrame:
    gaps = journal_tests.dormancy_gaps(s.lines, over=60)
    return evaluate.sweep(gaps, "gap", (60, 90, 120, 180, 240), s.labels, lambda m, v: m > v, "JET-09")


# -- E: Benford ----------------------------------------------------------------------------

_DIGITS = "SELECT {by} AS label, count(*) AS rows_n, count(*) FILTER (abs_cents > 0) AS n, {counts} FROM gl GROUP BY 1"
_COUNTS = ", ".join(f"count(*) FILTER (abs_cents > 0 AND substr(CAST(abs_cents AS VARCHAR), 1, 1) = '{d}') AS c{d}" for d in range(1, 10))
_P = {d: f"log10(1 + 1.0::DOUBLE / {d})" for d in range(1, 10)}
_CHI = " + ".join(f"pow(c{d} - {p} * n, 2) / ({p} * n)" for d, p in _P.items())
_MAD = " + ".join(f"abs(c{d} / CAST(n AS DOUBLE) - {p})" for d, p in _P.items())


def _benford(by: str, where: str = "TRUE") -> str:
    digits = _DIGITS.format(by=by, counts=_COUNTS)
    return f"""SELECT label, n, n >= 300 AS sufficient_sample, round(chi, 4) AS chi_square, chi > 15.507 AS exceeds_critical, round(mad, 6) AS mad,
      CASE WHEN n < 300 THEN 'insufficient data' WHEN mad <= 0.006 THEN 'close conformity' WHEN mad <= 0.012 THEN 'acceptable conformity'
           WHEN mad <= 0.015 THEN 'marginal conformity' ELSE 'nonconformity' END AS conformity
      FROM (SELECT *, {_CHI} AS chi, ({_MAD}) / 9 AS mad FROM ({digits})) WHERE {where}"""


@query("e01_first_digit", "SELECT entry_id, line_no, CAST(substr(CAST(abs_cents AS VARCHAR), 1, 1) AS BIGINT) AS digit FROM gl WHERE abs_cents > 0")
def _(s: Staged) -> DataFrame:
    out = s.lines.select("entry_id", "line_no", benford.first_digit(F.col("amount_cents")).alias("digit"))
    return out.filter(F.col("digit").isNotNull())


@query("e02_benford_population", _benford("'population'"))
def _(s: Staged) -> DataFrame:
    return benford.benford_test(s.lines).drop("chi_square_critical_5pct")


@query("e03_benford_by_account", _benford("account_code", "rows_n >= 300"))
def _(s: Staged) -> DataFrame:
    return benford.segmented_benford(s.lines, "account_code")


@query("e03_benford_by_user", _benford("created_by", "rows_n >= 100"))
def _(s: Staged) -> DataFrame:
    return benford.segmented_benford(s.lines, "created_by", min_n=100)


@query("e04_mad_band", """SELECT label AS account_code, CASE WHEN mad <= 0.006 THEN 'close conformity' WHEN mad <= 0.012 THEN 'acceptable conformity'
    WHEN mad <= 0.015 THEN 'marginal conformity' ELSE 'nonconformity' END AS band, round(mad, 9) AS mad FROM (
        SELECT account_code AS label, avg(abs(c / CAST(n AS DOUBLE) - log10(1 + 1.0::DOUBLE / d))) AS mad FROM (
            SELECT account_code, d, count(*) FILTER (substr(CAST(abs_cents AS VARCHAR), 1, 1) = CAST(d AS VARCHAR)) AS c, count(*) AS n
            FROM gl, range(1, 10) r(d) WHERE abs_cents > 0 GROUP BY ALL) GROUP BY 1)""")
def _(s: Staged) -> DataFrame:
    found = benford.mad_by(s.lines, "account_code")
    return found.select(F.col("label").alias("account_code"), benford.mad_conformity(F.col("mad")).alias("band"), F.round("mad", 9).alias("mad"))


@query("e05_digit_distribution", """SELECT d AS digit, count(*) FILTER (dig = d) AS observed, round(count(*) FILTER (dig = d) / CAST(count(*) AS DOUBLE), 4) AS observed_prop,
    round(log10(1 + 1.0::DOUBLE / d), 4) AS expected_prop FROM range(1, 10) r(d), (SELECT CAST(substr(CAST(abs_cents AS VARCHAR), 1, 1) AS BIGINT) AS dig FROM gl WHERE abs_cents > 0) GROUP BY d""")
def _(s: Staged) -> DataFrame:
    return benford.digit_distribution(s.lines)


# -- F: features and the model tier --------------------------------------------------------------

_ENTROPY = " + ".join(f"CASE WHEN cnt{d} > 0 THEN -(cnt{d} / len) * log2(cnt{d} / len) ELSE 0 END" for d in range(10))
_LENS = ", ".join(f"CAST(length(txt) - length(replace(txt, '{d}', '')) AS DOUBLE) AS cnt{d}" for d in range(10))


_FEATURES = f"""SELECT e.entry_id, round(log10(greatest(ac, 1) / 100.0::DOUBLE), 6) AS log_amount, CAST(n_lines AS DOUBLE) AS n_lines,
    round(sin(2 * pi() * hour(entered_at) / 24.0::DOUBLE), 6) AS hour_sin, round(cos(2 * pi() * hour(entered_at) / 24.0::DOUBLE), 6) AS hour_cos,
    round(sin(2 * pi() * (isodow(entered_at) - 1) / 7.0::DOUBLE), 6) AS dow_sin, round(cos(2 * pi() * (isodow(entered_at) - 1) / 7.0::DOUBLE), 6) AS dow_cos,
    CAST(date_diff('day', CAST(posting_date AS DATE), last_day(posting_date)) AS DOUBLE) AS days_to_period_end,
    CAST(date_diff('day', CAST(entered_at AS DATE), CAST(posting_date AS DATE)) AS DOUBLE) AS posting_lag_days,
    round(count(*) OVER (PARTITION BY pair) / tot, 6) AS account_pair_freq, round(count(*) OVER (PARTITION BY created_by) / tot, 6) AS user_freq,
    round(count(*) OVER (PARTITION BY source) / tot, 6) AS source_freq, round(count(*) OVER (PARTITION BY debit_accounts) / tot, 6) AS debit_account_freq,
    round(count(*) OVER (PARTITION BY credit_accounts) / tot, 6) AS credit_account_freq,
    round(coalesce(0.6745::DOUBLE * (log10(greatest(ac, 1) / 100.0::DOUBLE) - a.med) / nullif(a.mad, 0), 0), 6) AS amount_z_in_account,
    (ac % 100000) / 100.0::DOUBLE AS round_1000_remainder, round(en.ent_bits, 6) AS digit_entropy
    FROM ent e JOIN (SELECT entry_id, account_code FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY abs_cents DESC, line_no) AS rn FROM gl) WHERE rn = 1) m USING (entry_id)
    LEFT JOIN acct a USING (account_code) JOIN (SELECT entry_id, {_ENTROPY} AS ent_bits FROM (SELECT entry_id, CAST(length(txt) AS DOUBLE) AS len, {_LENS}
      FROM (SELECT entry_id, lpad(CAST(abs(ac) AS VARCHAR), CAST(greatest(3, length(CAST(abs(ac) AS VARCHAR))) AS INTEGER), '0') AS txt FROM ent))) en USING (entry_id),
    (SELECT CAST(count(*) AS DOUBLE) AS tot FROM ent)"""


@query("f01_features", _FEATURES)
def _(s: Staged) -> DataFrame:
    exact = ("n_lines", "days_to_period_end", "posting_lag_days", "round_1000_remainder")
    out = features.build_features(s.lines, s.entries, s.stats)
    return out.select("entry_id", *[F.col(c) if c in exact else F.round(c, 6).alias(c) for c in features.FEATURE_COLUMNS])


@query("f02_cyclical_encoding", """SELECT entry_id, round(sin(2 * pi() * hour(entered_at) / 24.0::DOUBLE), 9) AS hour_sin, round(cos(2 * pi() * hour(entered_at) / 24.0::DOUBLE), 9) AS hour_cos,
    round(sin(2 * pi() * (isodow(entered_at) - 1) / 7.0::DOUBLE), 9) AS dow_sin, round(cos(2 * pi() * (isodow(entered_at) - 1) / 7.0::DOUBLE), 9) AS dow_cos FROM ent""")
def _(s: Staged) -> DataFrame:
    hs, hc = features.cyclical(F.hour("entered_at"), 24)
    ds, dc = features.cyclical(F.weekday("entered_at"), 7)
    named = {"hour_sin": hs, "hour_cos": hc, "dow_sin": ds, "dow_cos": dc}
    return s.entries.select("entry_id", *[F.round(c, 9).alias(n) for n, c in named.items()])


@query("f03_digit_entropy", f"""SELECT entry_id, round({_ENTROPY}, 9) AS digit_entropy FROM (SELECT entry_id, CAST(length(txt) AS DOUBLE) AS len, {_LENS}
    FROM (SELECT entry_id, lpad(CAST(abs(ac) AS VARCHAR), CAST(greatest(3, length(CAST(abs(ac) AS VARCHAR))) AS INTEGER), '0') AS txt FROM ent))""")
def _(s: Staged) -> DataFrame:
    return s.entries.select("entry_id", F.round(features.digit_entropy(F.col("entry_cents")), 9).alias("digit_entropy"))


@query("f04_amount_features", """SELECT e.entry_id, round(log10(greatest(ac, 1) / 100.0::DOUBLE), 6) AS log_amount,
    round(coalesce(0.6745::DOUBLE * (log10(greatest(ac, 1) / 100.0::DOUBLE) - a.med) / nullif(a.mad, 0), 0), 6) AS amount_z, (ac % 100000) / 100.0::DOUBLE AS remainder
    FROM ent e JOIN (SELECT entry_id, account_code FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY abs_cents DESC, line_no) AS rn FROM gl) WHERE rn = 1) m USING (entry_id)
    LEFT JOIN acct a USING (account_code)""")
def _(s: Staged) -> DataFrame:
    out = s.features
    return out.select("entry_id", F.round("log_amount", 6).alias("log_amount"), F.round("amount_z_in_account", 6).alias("amount_z"),
                      F.col("round_1000_remainder").alias("remainder"))


_VARIANCES = ", ".join(f"var_samp({c}) AS {c}" for c in features.FEATURE_COLUMNS)


@query("f05_kept_features", f"SELECT name AS feature, v > 1e-12 AS kept, round(v, 6) AS variance FROM (SELECT {_VARIANCES} FROM feats) UNPIVOT (v FOR name IN ({', '.join(features.FEATURE_COLUMNS)}))",
       {"feats": _FEATURES})
def _(s: Staged) -> DataFrame:
    items = [F.struct(F.lit(c).alias("feature"), (F.col(c) > 1e-12).alias("kept"), F.round(c, 6).alias("variance")) for c in features.FEATURE_COLUMNS]
    return features.feature_variances(s.features).select(F.inline(F.array(*items)))


@query("f06_forest_fit", f"""SELECT any_value(n) AS n_entries, 16::BIGINT AS n_features_in, count(*) FILTER (v > 1e-12) AS n_features_used,
    coalesce(string_agg(name, ', ') FILTER (v <= 1e-12), '') AS dropped_constant, 0.02::DOUBLE AS contamination
    FROM (SELECT count(*) AS n, {_VARIANCES} FROM feats) UNPIVOT (v FOR name IN ({', '.join(features.FEATURE_COLUMNS)}))""", {"feats": _FEATURES})
def _(s: Staged) -> DataFrame:
    return forest.fit_report(s.features, forest.fit_forest(s.features))


@query("f07_model_scores")
def _(s: Staged) -> DataFrame:
    return forest.model_scores(s.features, forest.fit_forest(s.features))


@query("f08_combined_tiers", "SELECT entry_id, risk_score, round(model_score, 9) AS model_score, model_flag, rule_flag, agreement FROM combined")
def _(s: Staged) -> DataFrame:
    out = forest.combine(s.scored, s.scores)
    return out.select("entry_id", "risk_score", F.round("model_score", 9).alias("model_score"), "model_flag", "rule_flag", "agreement")


@query("f09_score_ledger_report")
def _(s: Staged) -> DataFrame:
    scores, model = forest.score_ledger(s.lines, s.entries, s.stats)
    figures = scores.agg(F.count("*").alias("scored"), F.min("model_score").alias("lowest"), F.max("model_score").alias("highest"))
    return beside(forest.fit_report(s.features, model), figures)


# -- G: evaluation ----------------------------------------------------------------------------------

@query("g01_label_coverage", """SELECT 0::BIGINT AS blank, count(*) FILTER (l > 1) AS repeated, min(CASE WHEN l > 1 THEN entry_id END) AS repeated_example,
    count(*) FILTER (l = 0) AS unlabelled, min(CASE WHEN l = 0 THEN entry_id END) AS unlabelled_example, count(*) FILTER (l > 0 AND e = 0) AS unknown,
    min(CASE WHEN l > 0 AND e = 0 THEN entry_id END) AS unknown_example FROM (
      SELECT entry_id, sum(l) AS l, max(e) AS e FROM (SELECT entry_id, 1 AS l, 0 AS e FROM lab WHERE anomaly_type <> 'token_amount'
        UNION ALL SELECT entry_id, 1, 0 FROM lab WHERE anomaly_type = 'round_amount' UNION ALL SELECT entry_id || '-X', 1, 0 FROM lab WHERE anomaly_type = 'dormant_account'
        UNION ALL SELECT entry_id, 0, 1 FROM ent) GROUP BY entry_id)""")
def _(s: Staged) -> DataFrame:
    kind = F.col("anomaly_type")
    odd = (s.labels.filter(kind != "token_amount").unionByName(s.labels.filter(kind == "round_amount"))
           .unionByName(s.labels.filter(kind == "dormant_account").withColumn("entry_id", F.concat("entry_id", F.lit("-X")))))
    return evaluate.label_problems(odd, s.ids)


@query("g02_confusion", """SELECT *, flagged > 0 AS precision_defined, true_anomalies > 0 AS recall_defined, flagged > 0 AND true_anomalies > 0 AS f1_defined,
    round(flagged / CAST(population AS DOUBLE), 4) AS flag_rate, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM (
      SELECT *, true_positives / CAST(flagged AS DOUBLE) AS p, true_positives / CAST(true_anomalies AS DOUBLE) AS r FROM (
        SELECT count(*) AS population, count(*) FILTER (is_anomaly) AS true_anomalies, count(*) FILTER (f) AS flagged, count(*) FILTER (f AND is_anomaly) AS true_positives,
          count(*) FILTER (f AND NOT is_anomaly) AS false_positives, count(*) FILTER (NOT f AND is_anomaly) AS false_negatives, count(*) FILTER (NOT f AND NOT is_anomaly) AS true_negatives
        FROM (SELECT *, entry_id IN (SELECT entry_id FROM flags) AS f FROM lab)))""".replace("SELECT *, flagged > 0", "SELECT * EXCLUDE (p, r), flagged > 0"))
def _(s: Staged) -> DataFrame:
    return evaluate.evaluate(s.flags, s.labels, s.ids)


@query("g03_recall_by_archetype", """SELECT anomaly_type, count(*) AS n, count(*) FILTER (f) AS caught, count(*) FILTER (NOT f) AS missed,
    round(count(*) FILTER (f) / CAST(count(*) AS DOUBLE), 4) AS recall FROM (SELECT *, entry_id IN (SELECT entry_id FROM flags) AS f FROM lab) WHERE is_anomaly GROUP BY 1""")
def _(s: Staged) -> DataFrame:
    return evaluate.recall_by_archetype(s.flags, s.labels)


_INTENDED = """CASE anomaly_type WHEN 'round_amount' THEN 'JET-01' WHEN 'weekend_entry' THEN 'JET-02' WHEN 'after_hours_entry' THEN 'JET-03'
    WHEN 'just_under_threshold' THEN 'JET-06' WHEN 'duplicate_entry' THEN 'JET-07' WHEN 'rare_account_pair' THEN 'JET-08' WHEN 'dormant_account' THEN 'JET-09'
    WHEN 'unbalanced_entry' THEN 'JET-10' ELSE '' END"""


@query("g04_attribution", f"""SELECT anomaly_type, intended_test, count(*) AS n, count(*) FILTER (own OR oth) AS caught, count(*) FILTER (own) AS by_intended_test,
    count(*) FILTER (oth) AS by_other_tests, count(*) FILTER (oth AND NOT own) AS only_by_other_tests, count(*) FILTER (NOT own AND NOT oth) AS missed FROM (
      SELECT l.*, EXISTS (SELECT 1 FROM flags f WHERE f.entry_id = l.entry_id AND f.test_id = intended_test) AS own,
        EXISTS (SELECT 1 FROM flags f WHERE f.entry_id = l.entry_id AND f.test_id <> intended_test) AS oth
      FROM (SELECT *, {_INTENDED} AS intended_test FROM lab WHERE is_anomaly) l) GROUP BY 1, 2""")
def _(s: Staged) -> DataFrame:
    return evaluate.attribution(s.flags, s.labels)


@query("g05_precision_by_test", """SELECT test_id, test_name, count(*) AS entries_flagged, count(*) FILTER (is_anomaly) AS true_positives,
    round(count(*) FILTER (is_anomaly) / CAST(count(*) AS DOUBLE), 4) AS precision FROM (SELECT DISTINCT test_id, test_name, entry_id FROM flags) JOIN lab USING (entry_id) GROUP BY 1, 2""")
def _(s: Staged) -> DataFrame:
    return evaluate.precision_by_test(s.flags, s.labels)


@query("g06_compare_tiers", """SELECT k.segment, count(c.entry_id) AS entries, count(*) FILTER (is_anomaly) AS true_anomalies,
    round(CASE WHEN count(c.entry_id) = 0 THEN 0 ELSE count(*) FILTER (is_anomaly) / CAST(count(c.entry_id) AS DOUBLE) END, 4) AS precision,
    round(count(*) FILTER (is_anomaly) / CAST((SELECT count(*) FROM lab WHERE is_anomaly) AS DOUBLE), 4) AS share_of_all_anomalies
    FROM (VALUES ('both'), ('rules only'), ('model only'), ('neither')) k(segment) LEFT JOIN combined c ON c.agreement = k.segment LEFT JOIN lab l USING (entry_id) GROUP BY 1""")
def _(s: Staged) -> DataFrame:
    return evaluate.compare_tiers(s.combined, s.labels)


@query("g07_model_lift", """SELECT top_n, hits AS true_anomalies, round(hits / CAST(top_n AS DOUBLE), 4) AS precision, round(base, 4) AS base_rate, round(hits / CAST(top_n AS DOUBLE) / base, 1) AS lift_vs_random FROM (
    SELECT t.top_n, count(*) FILTER (is_anomaly) AS hits, (SELECT count(*) FILTER (is_anomaly) / CAST(count(*) AS DOUBLE) FROM lab) AS base
    FROM (VALUES (25::BIGINT), (50), (100), (200), (1000000000000)) t(top_n) JOIN (SELECT entry_id, row_number() OVER (ORDER BY model_score DESC, entry_id) AS rn FROM scores) r ON r.rn <= t.top_n
    JOIN lab USING (entry_id) WHERE t.top_n <= (SELECT count(*) FROM scores) GROUP BY 1)""")
def _(s: Staged) -> DataFrame:
    return evaluate.model_lift(s.scores, s.labels)


@query("g08_budget_by_archetype", """SELECT anomaly_type, count(*) AS n, count(*) FILTER (rule_flag) AS rule_caught, count(*) FILTER (model_flag) AS model_in_budget,
    round(count(*) * any_value(b) / CAST(any_value(p) AS DOUBLE), 2) AS chance, round(count(*) FILTER (model_flag) / CAST(count(*) AS DOUBLE), 4) AS model_recall
    FROM combined JOIN lab USING (entry_id), (SELECT count(*) FILTER (model_flag) AS b, count(*) AS p FROM combined) WHERE is_anomaly GROUP BY 1""")
def _(s: Staged) -> DataFrame:
    return evaluate.budget_recall_by_archetype(s.combined, s.labels)


@query("g09_held_out_budget", """SELECT n, in_budget, round(n * budget / CAST(population AS DOUBLE), 2) AS chance, round(in_budget / CAST(n AS DOUBLE), 4) AS recall,
    round(in_budget / (n * budget / CAST(population AS DOUBLE)), 1) AS lift, budget, population FROM (SELECT count(*) AS n, count(*) FILTER (model_flag) AS in_budget
      FROM combined JOIN lab USING (entry_id) WHERE anomaly_type = 'token_amount'), (SELECT count(*) FILTER (model_flag) AS budget, count(*) AS population FROM combined)""")
def _(s: Staged) -> DataFrame:
    return evaluate.held_out_budget(s.combined, s.labels)


@query("g10_score_by_archetype", """SELECT anomaly_type, count(*) AS n, round(avg(model_score), 4) AS mean_model_score,
    round(avg(model_score) - (SELECT avg(model_score) FROM scores JOIN lab USING (entry_id) WHERE NOT is_anomaly), 4) AS vs_normal
    FROM scores JOIN lab USING (entry_id) WHERE is_anomaly GROUP BY 1""")
def _(s: Staged) -> DataFrame:
    return evaluate.score_by_archetype(s.scores, s.labels)


@query("g11_archetype_reading", """SELECT anomaly_type, n, caught, CASE WHEN anomaly_type IN ('benford_drift', 'dormant_account', 'rare_account_pair') THEN FALSE
    WHEN anomaly_type = 'token_amount' THEN NULL ELSE TRUE END AS definitional, anomaly_type = 'token_amount' AS held_out,
    CASE WHEN anomaly_type IN ('benford_drift', 'dormant_account', 'rare_account_pair') THEN 'not definitional' WHEN anomaly_type = 'token_amount' THEN 'held out' ELSE 'definitional' END AS reading
    FROM (SELECT anomaly_type, count(*) AS n, count(*) FILTER (entry_id IN (SELECT entry_id FROM flags)) AS caught FROM lab WHERE is_anomaly GROUP BY 1)""")
def _(s: Staged) -> DataFrame:
    out = evaluate.archetype_reading(evaluate.recall_by_archetype(s.flags, s.labels))
    return out.select("anomaly_type", "n", "caught", "definitional", "held_out", "reading")


# -- H: materiality and samples ---------------------------------------------------------------------

_BAND = f"""CASE WHEN fiscal_year <> {YEAR} THEN 'other year' WHEN ac < 0 THEN 'negative' WHEN ac = 0 THEN 'no amount' WHEN ac >= 5000000 THEN 'material'
    WHEN ac >= 3750000 THEN 'above performance' WHEN ac > 250000 THEN 'below performance' ELSE 'clearly trivial' END"""


@query("h02_materiality_bands", f"SELECT entry_id, ac AS entry_cents, {_BAND} AS materiality_band FROM ent")
def _(s: Staged) -> DataFrame:
    return with_bands(s.entries, MATERIALITY, YEAR).select("entry_id", "entry_cents", "materiality_band")


@query("h03_flagged_by_band", f"""SELECT k.b AS materiality_band, count(s.band) AS entries FROM (VALUES ('material'), ('above performance'), ('below performance'), ('clearly trivial'),
    ('no amount'), ('negative'), ('other year')) k(b) LEFT JOIN (SELECT {_BAND} AS band FROM scored WHERE risk_score > 0) s ON s.band = k.b GROUP BY 1""")
def _(s: Staged) -> DataFrame:
    return count_by_band(with_bands(s.scored.filter("risk_score > 0"), MATERIALITY, YEAR))


# the sample start for seed 7: the first draw of Python's generator as a whole number of 2^-53
_K = "2916826238065975"
_POP = f"SELECT entry_id, ac, CAST(coalesce(sum(ac) OVER (ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS low FROM ent WHERE fiscal_year = {YEAR} AND ac > 0"
_UNITS = "({x} * n // b + CASE WHEN ({x} * n % b) * 9007199254740992::HUGEINT > k * b THEN 1 ELSE 0 END)"
_MUS = f"""SELECT * FROM (SELECT *, greatest(0, {_UNITS.format(x='low')}) AS first, least(n, {_UNITS.format(x='(low + ac)')}) - greatest(0, {_UNITS.format(x='low')}) AS hits
    FROM mus_pop, (SELECT b, CAST(ceil(b * 2.995732273553991::DOUBLE / 3750000) AS HUGEINT) AS n, {_K}::HUGEINT AS k FROM (SELECT CAST(sum(ac) AS HUGEINT) AS b FROM mus_pop))) WHERE hits > 0"""


@query("h04_monetary_unit_sample", """SELECT entry_id, CAST(ac AS BIGINT) AS cents, CAST(hits AS BIGINT) AS hits,
    CAST(first * b // n + ((first * b % n) * 9007199254740992::HUGEINT + k * b) // (n * 9007199254740992::HUGEINT) AS BIGINT) AS first_unit_cents, ac * n >= b AS certain,
    CASE WHEN ac * n >= b THEN 'at or above the sampling interval, so selected whatever the start' ELSE 'a selected dollar falls in it' END AS why FROM mus_hit""",
       {"mus_pop": _POP, "mus_hit": _MUS})
def _(s: Staged) -> DataFrame:
    picked = sampling.mus_select(s.lines, MATERIALITY, seed=SEED, fiscal_year=YEAR, entries=s.entries)
    return picked.items.select("entry_id", "cents", "hits", "first_unit_cents", "certain", "why")


_SIZE, _STRATA = 40, 3
_STRAT = f"""SELECT *, CAST(before * {_STRATA} // total AS BIGINT) + 1 AS band FROM (SELECT entry_id, ac,
    CAST(coalesce(sum(ac) OVER (ORDER BY ac, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS before, CAST(sum(ac) OVER () AS HUGEINT) AS total
    FROM ent WHERE fiscal_year = {YEAR} AND ac > 0 AND ac < 3750000)"""
# no band is exhausted at this size, so largest remainder needs one round
_ALLOC = f"""SELECT band, whole + CASE WHEN row_number() OVER (ORDER BY share - whole DESC, band) <= {_SIZE} - sum(whole) OVER () THEN 1 ELSE 0 END AS drawn, n, v, lo, hi
    FROM (SELECT *, v * {_SIZE} / CAST(sum(v) OVER () AS DOUBLE) AS share, CAST(floor(v * {_SIZE} / CAST(sum(v) OVER () AS DOUBLE)) AS BIGINT) AS whole FROM (
      SELECT band, count(*) AS n, CAST(sum(ac) AS BIGINT) AS v, min(ac) AS lo, max(ac) AS hi FROM strat GROUP BY 1))"""
_STRAT_CTES = {"strat": _STRAT, "alloc": _ALLOC}


@query("h05_stratified_sample", f"""SELECT entry_id, ac AS cents, CAST(band AS VARCHAR) AS band, 'drawn at random from band ' || band || ' of {_STRATA}' AS why FROM (
      SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('{SEED}:' || entry_id), entry_id) AS rn FROM strat) JOIN alloc USING (band) WHERE rn <= drawn
    UNION ALL SELECT entry_id, ac, 'full', 'at or above performance materiality: examined in full' FROM ent WHERE fiscal_year = {YEAR} AND ac >= 3750000""", _STRAT_CTES)
def _(s: Staged) -> DataFrame:
    picked = sampling.stratified_select(s.lines, MATERIALITY, _SIZE, SEED, _STRATA, YEAR, s.entries)
    return picked.items.select("entry_id", "cents", "band", "why")


@query("h07_strata_table", "SELECT band, n AS entries, v AS value_cents, lo AS from_cents, hi AS to_cents, CAST(drawn AS BIGINT) AS drawn FROM alloc", _STRAT_CTES)
def _(s: Staged) -> DataFrame:
    return sampling.stratified_select(s.lines, MATERIALITY, _SIZE, SEED, _STRATA, YEAR, s.entries).bands


@query("h08_selection_memo", f"""SELECT {YEAR}::BIGINT AS fiscal_year, {SEED}::BIGINT AS seed, any_value(CAST(n AS BIGINT)) AS size, count(*) AS entries_selected, CAST(sum(ac) AS BIGINT) AS selected_cents, any_value(CAST(b AS BIGINT)) AS book_cents,
    'mus' AS method, 3750000::BIGINT AS performance_cents FROM mus_hit""", {"mus_pop": _POP, "mus_hit": _MUS})
def _(s: Staged) -> DataFrame:
    picked = sampling.mus_select(s.lines, MATERIALITY, seed=SEED, fiscal_year=YEAR, entries=s.entries)
    memo = sampling.selection_memo(picked, "csv:a", "2024-01-31")
    paths = {"fiscal_year": "population.fiscal_year", "seed": "seed", "size": "parameters.size", "entries_selected": "entries_selected", "selected_cents": "selected_cents",
             "book_cents": "population.book_cents", "performance_cents": "materiality.performance_cents"}
    return memo.select(F.get_json_object("memo", "$.method").alias("method"), *[F.get_json_object("memo", f"$.{p}").cast("bigint").alias(n) for n, p in paths.items()])


# -- I: questions --------------------------------------------------------------------------------------

_SHOWN = f"entry_id, {PD}, fiscal_year, period, source, created_by, description, ac AS entry_cents, risk_score, round(model_score, 9) AS model_score, agreement, tests_fired, reasons"


def _entry_rows(df: DataFrame, *extra: str) -> DataFrame:
    out = df.withColumns({"entry_cents": to_cents(F.col("entry_amount")), "model_score": F.round("model_score", 9)})
    return out.select(*[c for c in questions.ENTRY_COLUMNS if c != "entry_amount"], "entry_cents", *extra)


_SUMMARY = """(SELECT count(*) FROM scored) AS entries, (SELECT count(*) FROM gl) AS lines, (SELECT count(*) FROM scored WHERE risk_score > 0) AS flagged, (SELECT count(*) FROM flags) AS flags_raised"""


@query("i01_loaded_ledger", f"SELECT {_SUMMARY}, greatest(1, CAST(round_even((SELECT count(*) FROM scored) * 0.02::DOUBLE, 0) AS BIGINT)) AS budget")
def _(s: Staged) -> DataFrame:
    loaded = questions.Ledger(s.lines, CONTROLS, stage_lines=False).load()
    # the forest's scores differ from entry to entry at the cutoff, so the budget is met exactly
    budget = loaded.combined.agg(F.count_if("model_flag").alias("budget"))
    return beside(loaded.summary(), budget).select("entries", "lines", "flagged", "flags_raised", "budget")


@query("i02_top_exceptions", f"""SELECT {_SHOWN}, (SELECT count(*) FROM combined WHERE risk_score > 0 AND fiscal_year = {YEAR} AND period BETWEEN 3 AND 9) AS matching
    FROM combined WHERE risk_score > 0 AND fiscal_year = {YEAR} AND period BETWEEN 3 AND 9 ORDER BY combined.risk_score DESC, combined.model_score DESC, entry_id LIMIT 25""")
def _(s: Staged) -> DataFrame:
    return _entry_rows(questions.top_exceptions(s.combined, 25, YEAR, 3, 9), "matching")


@query("i03_search_entries", f"""SELECT {_SHOWN}, (SELECT count(*) FROM found) AS matching FROM found ORDER BY found.risk_score DESC, ac DESC, entry_id LIMIT 25""",
       {"found": "SELECT * FROM combined WHERE source = 'Manual' AND created_by = 'user3' AND ac >= 1000000 AND entry_id IN (SELECT entry_id FROM gl WHERE account_code = '1200')"})
def _(s: Staged) -> DataFrame:
    return _entry_rows(questions.search_entries(s.combined, s.lines, "1200", "user3", "Manual", 10000), "matching")


@query("i04_explained_entries", """SELECT entry_id, c.risk_score, d.* EXCLUDE (entry_id) FROM combined c JOIN (
    SELECT entry_id, 'line' AS part, account_code, line_no, account_name, debit_cents, credit_cents, description, NULL AS test_id, NULL AS severity, NULL AS reason FROM gl
    UNION ALL SELECT entry_id, 'flag', account_code, line_no, NULL, NULL, NULL, NULL, test_id, severity, reason FROM flags) d USING (entry_id) WHERE c.risk_score > 0""")
def _(s: Staged) -> DataFrame:
    out = questions.explained_entries(s.combined, s.lines, s.flags)
    return out.withColumns({"debit_cents": to_cents(F.col("debit")), "credit_cents": to_cents(F.col("credit"))}).drop("debit", "credit", "place")


@query("i04_one_entry", f"""SELECT part, n FROM (SELECT 'lines' AS part, (SELECT count(*) FROM gl WHERE entry_id = x) AS n, x FROM worst UNION ALL SELECT 'flags', (SELECT count(*) FROM flags WHERE entry_id = x), x FROM worst
    UNION ALL SELECT 'decisions', (SELECT count(*) FROM mydecs WHERE entry_id = x), x FROM worst UNION ALL SELECT 'narratives', (SELECT count(*) FROM mynotes WHERE entry_id = x), x FROM worst)""",
       {"worst": "SELECT entry_id AS x FROM combined ORDER BY risk_score DESC, model_score DESC, entry_id LIMIT 1"})
def _(s: Staged) -> DataFrame:
    books = questions.Ledger(s.lines, CONTROLS, scores=s.scores, stage_lines=False).load()
    worst = books.top_exceptions(limit=1).first()["entry_id"]
    found = books.explain_entry(worst, s.decisions, s.notes, "csv:a")
    parts = {"lines": "lines", "flags": "flags", "decisions": "decisions", "narratives": "narrative_history"}
    counts = [found[key].agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, key in parts.items()]
    return reduce(DataFrame.unionByName, counts)


@query("i05_population_summary", """SELECT (SELECT count(*) FROM combined) AS entries, (SELECT count(*) FROM gl) AS lines,
    (SELECT string_agg(CAST(fiscal_year AS VARCHAR), ',' ORDER BY fiscal_year) FROM (SELECT DISTINCT fiscal_year FROM combined)) AS fiscal_years,
    (SELECT count(*) FROM combined WHERE risk_score > 0) AS flagged, round((SELECT count(*) FILTER (risk_score > 0) / CAST(count(*) AS DOUBLE) FROM combined), 4) AS flag_rate,
    (SELECT count(*) FROM flags) AS flags_raised, (SELECT string_agg(t || '=' || n, ',' ORDER BY t) FROM (SELECT 'JET-' || lpad(CAST(i AS VARCHAR), 2, '0') AS t,
       (SELECT count(*) FROM flags WHERE test_id = 'JET-' || lpad(CAST(i AS VARCHAR), 2, '0')) AS n FROM range(1, 13) r(i))) AS flags_by_test,
    (SELECT string_agg(a || '=' || n, ',' ORDER BY p) FROM (SELECT a, p, (SELECT count(*) FROM combined WHERE agreement = a) AS n FROM (VALUES ('both', 1), ('rules only', 2), ('model only', 3), ('neither', 4)) v(a, p))) AS tier_agreement""")
def _(s: Staged) -> DataFrame:
    return questions.population_summary(s.combined, s.flags, s.lines)


@query("i06_full_summary", f"""SELECT {_SUMMARY}, 10::BIGINT AS listed, (SELECT count(*) FROM combined WHERE model_flag) AS model_flagged,
    (SELECT count(*) FROM scored WHERE risk_score > 0 AND {_BAND} = 'below performance') AS below_performance, (SELECT count(DISTINCT entry_id) FROM mydecs) AS decided,
    (SELECT count(*) FROM lab WHERE is_anomaly AND entry_id IN (SELECT entry_id FROM flags)) AS true_positives, (SELECT count(DISTINCT anomaly_type) FROM lab WHERE is_anomaly) AS archetypes, 1::BIGINT AS notes""")
def _(s: Staged) -> DataFrame:
    status = review_status(s.combined, s.decisions, s.notes, "csv:a")
    out = questions.full_summary(s.combined, s.flags, s.lines, s.labels, 10, MATERIALITY, YEAR, status)
    fields = {"entries": "population.entries", "lines": "population.lines", "flagged": "population.flagged", "flags_raised": "population.flags_raised", "model_flagged": "model_tier.flagged",
              "decided": "review.decided", "true_positives": "detection.true_positives"}
    return out.select(*[F.col(p).alias(n) for n, p in fields.items()], F.col("flagged_by_band")["below performance"].alias("below_performance"),
                      *[F.size(c).alias(n) for n, c in (("listed", "top_exceptions"), ("archetypes", "by_archetype"), ("notes", "notes"))])


@query("i07_exception_queue", f"""SELECT c.entry_id, strftime(c.posting_date, '%Y-%m-%d %H:%M:%S') AS posting_date, c.source, c.created_by, ac AS entry_cents, {_BAND} AS materiality_band,
    c.risk_score, round(c.model_score, 9) AS model_score, agreement, tests_fired, d.decision, d.reviewer FROM combined c LEFT JOIN cur d USING (entry_id)
    WHERE c.entry_id IN (SELECT entry_id FROM flags WHERE severity IN ('High', 'Medium')) AND agreement IN ('both', 'rules only') AND ac >= 500000
      AND {_BAND} IN ('material', 'below performance') AND c.entry_id NOT IN (SELECT entry_id FROM mydecs)""")
def _(s: Staged) -> DataFrame:
    out = questions.exception_queue(s.combined, s.flags, s.decisions, "csv:a", ["High", "Medium"], None, ["both", "rules only"], 5000,
                                    ["material", "below performance"], MATERIALITY, YEAR, outstanding_only=True)
    return out.withColumns({"entry_cents": to_cents(F.col("entry_amount")), "model_score": F.round("model_score", 9)}).drop("entry_amount")


@query("i08_narration_queue", """SELECT entry_id, risk_score, round(model_score, 9) AS model_score, ac AS entry_cents FROM combined WHERE risk_score > 0
    AND entry_id NOT IN (SELECT entry_id FROM mynotes) ORDER BY combined.risk_score DESC, combined.model_score DESC, ac DESC, entry_id LIMIT 50""")
def _(s: Staged) -> DataFrame:
    out = questions.narration_queue(s.combined, recorded_ids(s.notes, "csv:a"), 50)
    return out.select("entry_id", "risk_score", F.round("model_score", 9).alias("model_score"), "entry_cents")


@query("i09_model_only", f"""SELECT entry_id, {PD}, source, ac AS entry_cents, round(model_score, 9) AS model_score FROM combined WHERE agreement = 'model only'
    ORDER BY combined.model_score DESC, entry_id LIMIT 20""")
def _(s: Staged) -> DataFrame:
    out = questions.model_only(s.combined, 20)
    return out.select("entry_id", "posting_date", "source", to_cents(F.col("entry_amount")).alias("entry_cents"), F.round("model_score", 9).alias("model_score"))


@query("i10_benford_by_source", f"""SELECT 'source' AS scope, CASE WHEN n < 300 THEN 'small' ELSE '' END AS note, * FROM ({_benford('source', 'rows_n >= 300')})""")
def _(s: Staged) -> DataFrame:
    out = benford.benford_view(s.lines, "source")
    return out.withColumn("note", F.when(F.col("note") != "", "small").otherwise(""))
