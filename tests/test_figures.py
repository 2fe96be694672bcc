"""Benford, features, forest, evaluation, materiality and samples on hand-made inputs."""

from __future__ import annotations

import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from conftest import entry
from pyspark.sql import functions as F

from tallyspark.functions.calendar import federal_holidays, is_federal_holiday
from tallyspark.operators import benford, evaluate, features, forest, sampling
from tallyspark.operators.journal_tests import staged_entries
from tallyspark.operators.materiality import Materiality, band
from tallyspark.plans import staging
from tallyspark.schema import LedgerError


def test_calendar_table_and_expression_agree(spark):
    listed = {r[0] for r in federal_holidays(spark, 1995, 2030).collect()}
    days = spark.sql("SELECT explode(sequence(date'1995-01-01', date'2030-12-31')) AS d")
    assert listed == {r[0] for r in days.filter(is_federal_holiday(F.col("d"))).collect()} and len(listed) == 396


def test_first_digits(spark):
    cents = [123400, 4, 990, 70000, -820000, 0, None, 550, 30]
    df = spark.createDataFrame([(c,) for c in cents], "c bigint").select(benford.first_digit(F.col("c")).alias("d"))
    assert [r["d"] for r in df.collect()] == [1, 4, 9, 7, 8, None, None, 5, 3]


def test_small_and_empty_samples_have_no_band(spark):
    for cents, n in (([100, 200, 300], 3), ([], 0)):
        row = benford.benford_test(spark.createDataFrame([(c,) for c in cents], "abs_cents bigint")).first()
        assert (row["n"], row["conformity"], row["sufficient_sample"]) == (n, "insufficient data", False)
    assert (row["chi_square"], row["mad"]) == (0.0, 0.0)


def test_a_conforming_population_conforms(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(int(10 ** (2 + 4 * rng.random())),) for _ in range(20000)], "abs_cents bigint")
    assert benford.benford_test(df).first()["conformity"] == "close conformity"


def test_bands_at_each_edge(spark):
    m = Materiality(Decimal(50000))
    assert (m.performance_cents, m.trivial_cents) == (3_750_000, 250_000)
    cents = [5_000_001, 5_000_000, 4_999_999, 3_750_001, 3_750_000, 3_749_999, 250_001, 250_000, 249_999, 1, 0, -1, -5_000_000]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cents], "c bigint").select(band(F.col("c"), m)).collect()]
    assert got == ["material"] * 2 + ["above performance"] * 3 + ["below performance"] * 2 + ["clearly trivial"] * 3 + ["no amount"] + ["negative"] * 2
    with pytest.raises(LedgerError, match="above 0.*six decimal"):
        Materiality(Decimal(-1), Decimal("0.1234567"))


@pytest.mark.parametrize("size, values, counts, want", [
    (10, [600, 300, 100], [50, 50, 50], [6, 3, 1]), (2, [500, 300, 200], [50, 50, 50], [1, 1, 0]),
    (3, [980, 10, 10], [50, 50, 50], [3, 0, 0]), (6, [900, 50, 50], [2, 10, 10], [2, 2, 2]),
    (2, [100, 100, 0], [5, 5, 0], [1, 1, 0]), (1, [100, 100], [5, 5], [1, 0]), (7, [5, 3, 2], [1, 3, 9], [1, 3, 3])])
def test_draws_shared_by_value(size, values, counts, want):
    assert sampling.share_draws(size, values, counts) == want


def mus(lines, overall, **how):
    return sampling.mus_select(lines, Materiality(Decimal(overall)), fiscal_year=2024, **how)


def test_monetary_units_at_a_known_interval(ledger):
    s = mus(ledger(*[entry(f"JE-{i:03d}", 10000) for i in range(100)]), 50000, seed=1)
    assert (s.parameters["reliability_factor"], s.parameters["size"], s.parameters["interval"]) == (2.9957, 80, 12500.0)
    rows = s.items.collect()
    assert len(rows) == 80 and all(r["hits"] == 1 and not r["certain"] for r in rows)
    one = mus(ledger(entry("JE-000", 1_000_000), *[entry(f"JE-{i:03d}", 100) for i in range(1, 51)]), 50000, seed=1)
    first = one.items.filter("entry_id = 'JE-000'").first()
    assert one.parameters["size"] == 81 and first["hits"] >= 80 and first["certain"]
    tiny = mus(ledger(*[entry(f"JE-{i}", 100) for i in range(3)]), 1, seed=1)
    assert tiny.parameters["size"] == 1199 and tiny.items.filter("certain").count() == 3


def test_monetary_units_equal_walking_each_selected_dollar(ledger):
    amounts = ["3000", "12000", "47.5", "8800", "25000", "1"] * 7
    s = mus(ledger(*[entry(f"JE-{i:03d}", a) for i, a in enumerate(amounts)]), 20000, seed=9)
    cents = [int(Decimal(a) * 100) for a in amounts]
    interval = Fraction(sum(cents), s.parameters["size"])
    at = Fraction(random.Random(9).random()) * interval
    want, firsts, bounds = {}, {}, [0]
    for c in cents:
        bounds.append(bounds[-1] + c)
    for _ in range(s.parameters["size"]):
        i = next(n for n in range(len(cents)) if bounds[n] <= at < bounds[n + 1])
        want[f"JE-{i:03d}"] = want.get(f"JE-{i:03d}", 0) + 1
        firsts.setdefault(f"JE-{i:03d}", int(at))
        at += interval
    rows = s.items.collect()
    assert {r["entry_id"]: r["hits"] for r in rows} == want
    assert {r["entry_id"]: r["first_unit_cents"] for r in rows} == firsts


def test_strata_cover_the_rest_and_are_repeatable(ledger):
    lines = ledger(*[entry(f"JE-{i:03d}", 50 + 37 * i) for i in range(200)], entry("BIG", 90000))
    m = Materiality(Decimal(50000))
    a = sampling.stratified_select(lines, m, 20, 7, 3, 2024)
    b = sampling.stratified_select(lines.repartition(5), m, 20, 7, 3, 2024)
    assert sorted(map(tuple, a.items.collect())) == sorted(map(tuple, b.items.collect()))
    bands = a.bands.orderBy("band").collect()
    assert sum(r["entries"] for r in bands) == 200 and sum(r["drawn"] for r in bands) == 20 and a.items.count() == 21
    with pytest.raises(LedgerError, match="more than the 200 entries"):
        sampling.stratified_select(lines, m, 201, 7, 3, 2024)
    with pytest.raises(LedgerError, match="size.*strata"):
        sampling.check_parameters("stratified", size=0, strata=40)


def test_several_fiscal_years_need_a_name(ledger):
    two = ledger(entry("a", 5), entry("b", 5, posted="2023-01-01"))
    with pytest.raises(LedgerError, match="2023, 2024"):
        sampling.mus_select(two, Materiality(Decimal(1)), seed=1)


def test_digit_entropy_and_features(ledger, spark):
    df = spark.createDataFrame([(555500,), (5,), (1234,)], "c bigint").select(features.digit_entropy(F.col("c")).alias("h"))
    got = [r["h"] for r in df.collect()]
    share = np.array([4, 2]) / 6
    assert got[0] == pytest.approx(-(share * np.log2(share)).sum()) and got[2] == pytest.approx(2.0)
    lines = ledger(*[entry(f"JE-{i:02d}", 100 + i) for i in range(40)])
    f = features.build_features(lines)
    assert f.count() == 40 and all(v is not None for r in f.collect() for v in r)
    with pytest.raises(LedgerError, match="every one of the 16 features is constant"):
        features.kept_features(features.build_features(ledger(entry("only", 5))))


def planted(ledger):
    rng = random.Random(2)
    usual = [entry(f"JE-{i:04d}", f"{rng.lognormvariate(5, 0.4):.2f}", keyed=f"2024-03-{rng.randrange(11, 16)} {rng.randrange(9, 17):02d}:00") for i in range(600)]
    odd = [entry(f"ZZ-{i}", 77_777_777, debit="9999", credit="9998", keyed="2024-03-17 03:00", user="ghost") for i in range(5)]
    return ledger(*usual, *odd)


def test_planted_outliers_rank_at_the_top_whatever_the_partitions(ledger):
    lines = planted(ledger)
    scores, model = forest.score_ledger(lines)
    top = {r["entry_id"] for r in scores.orderBy(F.desc("model_score"), "entry_id").limit(12).collect()}
    assert {f"ZZ-{i}" for i in range(5)} <= top
    ends = scores.agg(F.min("model_score"), F.max("model_score")).first()
    assert tuple(ends) == (0.0, 1.0) and "n_lines" in model.dropped
    again, _ = forest.score_ledger(lines.repartition(7))
    assert sorted(map(tuple, scores.collect())) == sorted(map(tuple, again.collect()))


def test_each_tree_draws_distinct_entries(spark):
    for n, trees, sample in ((50, 20, 50), (1000, 30, 64), (20000, 10, 32)):
        ids = spark.range(n).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("entry_id"))
        sizes = forest.draw_samples(ids, n, trees, sample, 1).groupBy("tree_id").agg(F.count("*").alias("n"), F.count_distinct("entry_id").alias("d")).collect()
        assert len(sizes) == trees and all(r["n"] == r["d"] == sample for r in sizes)


def test_budget_keeps_ties_at_the_cutoff(spark):
    scored = spark.createDataFrame([(f"e{i}", 0.0 if i % 2 else 2.0) for i in range(100)], "entry_id string, risk_score double")
    scores = spark.createDataFrame([(f"e{i}", 0.9 if i < 5 else 0.1) for i in range(100)], "entry_id string, model_score double")
    out = forest.combine(scored, scores)
    assert out.filter("model_flag").count() == 5
    assert {r["agreement"]: r["count"] for r in out.groupBy("agreement").count().collect()} == {"both": 3, "model only": 2, "rules only": 47, "neither": 48}


def test_combining_writes_the_scores_alone(spark):
    scored = spark.createDataFrame([(f"e{i}", float(i % 3), "a long reason") for i in range(100)], "entry_id string, risk_score double, reasons string")
    scores = spark.createDataFrame([(f"e{i}", i / 100) for i in range(90)], "entry_id string, model_score double")
    with staging.watched() as paths:
        out = forest.combine(scored, scores, ordered=False)
    assert [spark.read.parquet(p).columns for p in paths] == [["model_score"]]
    assert (out.count(), out.filter("model_flag").count(), out.filter("model_score = 0").count()) == (100, 2, 11)


def test_labels_must_cover_the_ledger(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "entry_id string")

    def labels(*names):
        return spark.createDataFrame([(n, False, "") for n in names], "entry_id string, is_anomaly boolean, anomaly_type string")

    evaluate.check_labels(labels("a", "b"), ids)
    for names, said in ((("a", "c"), "1 ledger entry has no label.*'b'.*1 label names no ledger entry.*'c'"), (("a", "a", "b"), "more than once.*'a'"),
                        (("a", "b", None, None), "2 rows with no entry id")):
        with pytest.raises(LedgerError, match=said):
            evaluate.check_labels(labels(*names), ids)


def test_ratios_over_nothing(spark):
    flags = spark.createDataFrame([], "entry_id string, test_id string")
    labels = spark.createDataFrame([("a", False, "")], "entry_id string, is_anomaly boolean, anomaly_type string")
    row = evaluate.evaluate(flags, labels).first()
    assert (row["precision"], row["recall"], row["f1"], row["precision_defined"], row["recall_defined"]) == (0.0, 0.0, 0.0, False, False)
    assert evaluate.held_out_budget(spark.createDataFrame([("a", True)], "entry_id string, model_flag boolean"), labels).count() == 0


def test_entries_are_staged_once(ledger):
    lines = planted(ledger)
    assert staged_entries(lines).count() == 605
