"""Measured quality against labels; the only operators that read them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.plans.staging import beside, settle
from tallyspark.schema import ARCHETYPES, HELD_OUT, INTENDED_TEST, NOT_DEFINITIONAL, LedgerError

TOPS = (25, 50, 100, 200)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0.0 over nothing."""
    return F.when(bottom != 0, top.cast("double") / bottom).otherwise(0.0)


def _anomalies(labels: DataFrame) -> DataFrame:
    return labels.filter("is_anomaly").select("entry_id", "anomaly_type")


def _place(kind: Column) -> Column:
    """Held-out archetypes, then the planted ones, each in its own order; others last."""
    known = (*HELD_OUT, *ARCHETYPES)
    place = F.lit(len(known))
    for i, name in enumerate(known):
        place = F.when(kind == name, i).otherwise(place)
    return place


def label_problems(labels: DataFrame, entry_ids: DataFrame) -> DataFrame:
    """How far labels and ledger are from covering each other, as one row of counts and examples."""
    found = labels.select("entry_id", F.lit(1).alias("l"), F.lit(0).alias("e")).unionByName(
        entry_ids.select("entry_id", F.lit(0).alias("l"), F.lit(1).alias("e")))
    per = found.groupBy("entry_id").agg(F.sum("l").alias("l"), F.max("e").alias("e"))
    named = F.col("entry_id").isNotNull()
    rules = {"repeated": named & (F.col("l") > 1), "unlabelled": named & (F.col("l") == 0),
             "unknown": named & (F.col("l") > 0) & (F.col("e") == 0)}
    return per.agg(F.coalesce(F.sum(F.when(~named, F.col("l"))), F.lit(0)).alias("blank"), *[
        c for name, rule in rules.items()
        for c in (F.count_if(rule).alias(name), F.min(F.when(rule, F.col("entry_id"))).alias(f"{name}_example"))])


def check_labels(labels: DataFrame, entry_ids: DataFrame) -> None:
    """Raise unless labels and entries match one to one, naming what is missing on either side."""
    row = label_problems(labels, entry_ids).first()

    def count(n: int, one: str, many: str) -> str:
        return f"{n:,} {one if n == 1 else many}"

    if row["blank"]:
        raise LedgerError("the label file has {} with no entry id".format(count(row["blank"], "row", "rows")))
    if row["repeated"]:
        raise LedgerError("the label file lists {} more than once (e.g. {!a})".format(
            count(row["repeated"], "entry id", "entry ids"), row["repeated_example"]))
    said = []
    if row["unlabelled"]:
        said.append("{} no label (e.g. {!a})".format(
            count(row["unlabelled"], "ledger entry has", "ledger entries have"), row["unlabelled_example"]))
    if row["unknown"]:
        said.append("{} no ledger entry (e.g. {!a})".format(
            count(row["unknown"], "label names", "labels name"), row["unknown_example"]))
    if said:
        raise LedgerError("the labels do not cover exactly this ledger's entries: " + "; ".join(said))


def evaluate(flags: DataFrame, labels: DataFrame, entry_ids: DataFrame | None = None) -> DataFrame:
    """Entry-level confusion counts and ratios, one row; one shuffle on ``entry_id``."""
    def marks(f: int, t: int, p: int) -> list[Column]:
        return [F.lit(v).alias(n) for n, v in (("f", f), ("t", t), ("p", p))]

    ids = labels if entry_ids is None else entry_ids
    rows = (flags.select("entry_id", *marks(1, 0, 0)).unionByName(_anomalies(labels).select("entry_id", *marks(0, 1, 0)))
            .unionByName(ids.select("entry_id", *marks(0, 0, 1))))
    per = rows.groupBy("entry_id").agg(*[(F.max(c) == 1).alias(c) for c in ("f", "t", "p")])
    f, t, p = F.col("f"), F.col("t"), F.col("p")
    counts = per.agg(
        F.count_if(p).alias("population"), F.count_if(t).alias("true_anomalies"), F.count_if(f).alias("flagged"),
        F.count_if(f & t).alias("true_positives"), F.count_if(f & ~t).alias("false_positives"),
        F.count_if(~f & t).alias("false_negatives"), F.count_if(p & ~f & ~t).alias("true_negatives"))
    precision = ratio(F.col("true_positives"), F.col("flagged"))
    recall = ratio(F.col("true_positives"), F.col("true_anomalies"))
    f1 = ratio(2 * precision * recall, precision + recall)
    return counts.withColumns({
        "precision": F.round(precision, 4), "recall": F.round(recall, 4), "f1": F.round(f1, 4),
        "flag_rate": F.round(ratio(F.col("flagged"), F.col("population")), 4),
        "precision_defined": F.col("flagged") > 0, "recall_defined": F.col("true_anomalies") > 0,
        "f1_defined": (F.col("flagged") > 0) & (F.col("true_anomalies") > 0),
    })


def recall_by_archetype(flags: DataFrame, labels: DataFrame) -> DataFrame:
    hit = flags.select("entry_id").distinct().withColumn("hit", F.lit(1))
    out = _anomalies(labels).join(hit, "entry_id", "left").groupBy("anomaly_type").agg(
        F.count("*").alias("n"), F.count("hit").alias("caught"))
    return out.select("anomaly_type", "n", "caught", (F.col("n") - F.col("caught")).alias("missed"),
                      F.round(F.col("caught") / F.col("n"), 4).alias("recall")).orderBy("recall", "anomaly_type")


def _intended(kind: Column) -> Column:
    test = F.lit("")
    for name, test_id in INTENDED_TEST.items():
        test = F.when(kind == name, test_id).otherwise(test)
    return test


def attribution(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """Per archetype, how many entries its own test flagged and how many only other tests did."""
    labelled = _anomalies(labels).dropDuplicates(["entry_id", "anomaly_type"]).withColumn(
        "intended_test", _intended(F.col("anomaly_type")))
    per = labelled.join(flags.select("entry_id", "test_id"), "entry_id", "left").groupBy(
        "anomaly_type", "intended_test", "entry_id").agg(
        F.count("test_id").alias("any"),
        F.count_if((F.col("test_id") == F.col("intended_test")) & (F.col("intended_test") != "")).alias("own"),
        F.count_if(F.col("test_id") != F.col("intended_test")).alias("other"))
    out = per.groupBy("anomaly_type", "intended_test").agg(
        F.count("*").alias("n"), F.count_if(F.col("any") > 0).alias("caught"),
        F.count_if(F.col("own") > 0).alias("by_intended_test"), F.count_if(F.col("other") > 0).alias("by_other_tests"),
        F.count_if((F.col("any") > 0) & (F.col("own") == 0)).alias("only_by_other_tests"),
        F.count_if(F.col("any") == 0).alias("missed"))
    return out.orderBy(_place(F.col("anomaly_type")), "anomaly_type")


def sweep(candidates: DataFrame, measure: str, values: Sequence[float], labels: DataFrame,
          keep: Callable[[Column, Column], Column], test_id: str | None = None) -> DataFrame:
    """One test at several settings in one pass: each candidate line is repeated only for the
    settings that flag it (``keep(measure, setting)``)."""
    spark = candidates.sparkSession
    passing = F.filter(F.array(*[F.lit(float(v)) for v in values]), lambda v: keep(F.col(measure), v))
    raised = candidates.select("entry_id", F.explode(passing).alias("value")).groupBy("value", "entry_id").agg(
        F.count("*").alias("flags"))
    kind = next((a for a, t in INTENDED_TEST.items() if t == test_id), None)
    own = F.col("anomaly_type") == F.lit(kind) if kind else F.lit(False)
    truth = labels.select("entry_id", "is_anomaly", own.alias("own"))
    found = raised.join(truth, "entry_id", "left").groupBy("value").agg(
        F.sum("flags").alias("flags_raised"), F.count("*").alias("entries_flagged"),
        F.count_if("is_anomaly").alias("true_positives"), F.count_if("own").alias("own_caught"))
    settings = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "value double, place int")
    total = labels.agg(F.count_if(own).alias("own_n"))  # one row
    out = beside(settings.join(found, "value", "left").fillna(0), total)
    known = F.lit(kind is not None)
    return out.orderBy("place").select(
        "value", "flags_raised", "entries_flagged", "true_positives",
        F.round(ratio(F.col("true_positives"), F.col("entries_flagged")), 4).alias("precision"),
        F.when(known, F.col("own_caught")).alias("intended_caught"), F.when(known, F.col("own_n")).alias("intended_n"))


def precision_by_test(flags: DataFrame, labels: DataFrame) -> DataFrame:
    raised = flags.select("test_id", "test_name", "entry_id").dropDuplicates(["test_id", "entry_id"])
    truth = _anomalies(labels).select("entry_id").distinct().withColumn("hit", F.lit(1))
    out = raised.join(truth, "entry_id", "left").groupBy("test_id", "test_name").agg(
        F.count("*").alias("entries_flagged"), F.count("hit").alias("true_positives"))
    return out.withColumn("precision", F.round(F.col("true_positives") / F.col("entries_flagged"), 4)).orderBy(
        F.desc("precision"), "test_id")


def compare_tiers(combined: DataFrame, labels: DataFrame) -> DataFrame:
    """Each way the tiers relate: entries, anomalies, precision, share of all anomalies."""
    spark = combined.sparkSession
    truth = _anomalies(labels).select("entry_id").distinct().withColumn("hit", F.lit(1))
    found = combined.select("entry_id", "agreement").join(truth, "entry_id", "left").groupBy("agreement").agg(
        F.count("*").alias("entries"), F.count("hit").alias("true_anomalies"))
    total = truth.agg(F.count("*").alias("all_anomalies"))  # one row
    names = ("rules only", "model only", "both", "neither")
    rows = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "agreement string, place int")
    out = beside(rows.join(found, "agreement", "left").fillna(0), total).orderBy("place")
    return out.select(
        F.col("agreement").alias("segment"), "entries", "true_anomalies",
        F.round(ratio(F.col("true_anomalies"), F.col("entries")), 4).alias("precision"),
        F.round(ratio(F.col("true_anomalies"), F.col("all_anomalies")), 4).alias("share_of_all_anomalies"))


def model_lift(scores: DataFrame, labels: DataFrame, tops: Sequence[int] = TOPS) -> DataFrame:
    """Precision among the top N by model score, ties to the lower id, N beyond the ledger left out."""
    truth = _anomalies(labels).select("entry_id").distinct().withColumn("hit", F.lit(1))
    size, known = scores.agg(F.count("*").alias("size")), truth.agg(F.count("*").alias("truth_n"))
    lead = scores.select("entry_id", "model_score").orderBy(F.desc("model_score"), "entry_id").limit(max(tops))
    # at most max(tops) rows are ranked
    rank = F.row_number().over(Window.orderBy(F.desc("model_score"), "entry_id"))
    ranked = lead.withColumn("rank", rank).join(truth, "entry_id", "left")
    hits = ranked.agg(*[F.count_if((F.col("rank") <= n) & F.col("hit").isNotNull()).alias(f"top{n}") for n in tops])
    rows = F.array(*[F.struct(F.lit(n).alias("top_n"), F.col(f"top{n}").alias("true_anomalies")) for n in tops])
    out = beside(hits, size, known).select("size", "truth_n", F.inline(rows)).filter(F.col("top_n") <= F.col("size"))
    precision = F.col("true_anomalies") / F.col("top_n")
    base = ratio(F.col("truth_n"), F.col("size"))
    return out.select("top_n", "true_anomalies", F.round(precision, 4).alias("precision"),
                      F.round(base, 4).alias("base_rate"), F.round(ratio(precision, base), 1).alias("lift_vs_random"))


def _budget(combined: DataFrame) -> DataFrame:
    return combined.agg(F.count_if("model_flag").alias("budget"), F.count("*").alias("population"))


def budget_recall_by_archetype(combined: DataFrame, labels: DataFrame) -> DataFrame:
    """Each archetype in the model's budget, against chance."""
    tiers = combined.select("entry_id", "rule_flag", "model_flag")
    per = _anomalies(labels).join(tiers, "entry_id", "left").groupBy("anomaly_type").agg(
        F.count("*").alias("n"), F.count_if("rule_flag").alias("rule_caught"),
        F.count_if("model_flag").alias("model_in_budget"))
    out = beside(per, _budget(combined))
    return out.select(
        "anomaly_type", "n", "rule_caught", "model_in_budget",
        F.round(ratio(F.col("n") * F.col("budget"), F.col("population")), 2).alias("chance"),
        F.round(ratio(F.col("model_in_budget"), F.col("n")), 4).alias("model_recall"),
    ).orderBy(_place(F.col("anomaly_type")), "anomaly_type")


def held_out_budget(combined: DataFrame, labels: DataFrame) -> DataFrame:
    """The held-out archetypes together; no row when the labels have none."""
    held = _anomalies(labels).filter(F.col("anomaly_type").isin(list(HELD_OUT)))
    per = held.join(combined.select("entry_id", "model_flag"), "entry_id", "left").agg(
        F.count("*").alias("n"), F.count_if("model_flag").alias("in_budget")).filter("n > 0")
    out = beside(per, _budget(combined))
    chance = ratio(F.col("n") * F.col("budget"), F.col("population"))
    return out.select(
        "n", "in_budget", F.round(chance, 2).alias("chance"),
        F.round(ratio(F.col("in_budget"), F.col("n")), 4).alias("recall"),
        F.round(ratio(F.col("in_budget"), chance), 1).alias("lift"), "budget", "population")


def score_by_archetype(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean model score per archetype against the normal baseline."""
    joined = scores.select("entry_id", "model_score").join(labels, "entry_id")
    mean = settle(joined.groupBy(F.when(F.col("is_anomaly"), F.col("anomaly_type")).alias("anomaly_type")).agg(
        F.count("*").alias("n"), F.avg("model_score").alias("mean")), "means")
    base = mean.filter(F.col("anomaly_type").isNull()).agg(F.first("mean").alias("base"))  # one row
    return (beside(mean.filter(F.col("anomaly_type").isNotNull()), base)
            .select("anomaly_type", "n", F.round("mean", 4).alias("mean_model_score"),
                    F.round(F.col("mean") - F.col("base"), 4).alias("vs_normal"))
            .orderBy(F.desc("mean_model_score"), "anomaly_type"))


def archetype_reading(recall: DataFrame) -> DataFrame:
    """Recall rows with what their figures can mean, in summary order."""
    kind = F.col("anomaly_type")
    planted, held = kind.isin(list(ARCHETYPES)), kind.isin(list(HELD_OUT))
    definitional = F.when(planted, ~kind.isin(list(NOT_DEFINITIONAL)))
    reading = (F.when(held, "held out").when(~planted, "unknown")
               .when(definitional, "definitional").otherwise("not definitional"))
    out = recall.withColumns({"definitional": definitional, "held_out": held, "reading": reading})
    late = F.when(F.col("definitional").eqNullSafe(False), 0).otherwise(1)
    return out.orderBy(F.when(held, 0).otherwise(1), F.when(held, _place(kind)).otherwise(0), late, kind)
