"""Ledger-shaped views over the given star-schema tables, for the registered queries.

One order becomes one two-line journal entry; planted patterns give every test work to do.
Each view is derived by Spark from whole tables, so a query's work grows with them.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.money import as_money
from tallyspark.operators.entries import derive
from tallyspark.plans.staging import joined
from tallyspark.schema import Controls

CONTROLS = Controls(("user0", "user1"), Decimal("10000.00"))

# The chart of accounts of the view.
CHART = (
    ("1000", "Cash", "Asset"),
    ("1200", "Receivables", "Asset"),
    ("1300", "Inventory", "Asset"),
    ("1400", "Prepaid", "Asset"),
    ("2000", "Payables", "Liability"),
    ("2200", "Payroll Liabilities", "Liability"),
    ("2500", "Note Payable", "Liability"),
    ("4000", "Sales Revenue", "Revenue"),
    ("6000", "Salaries", "Expense"),
)
# End of fixed values.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract-shaped journal-entry lines; both lines and the planted copies of an entry are
    made by one ``inline`` over the joined order, so the join runs once."""
    # orders without lines drop out of the inner join, as they hold no amount
    tenths = F.floor(F.col("l_extendedprice") * 10 + F.lit(0.5)).cast("bigint")
    amounts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(tenths).alias("c0"))
    base = joined(table(spark, sf_dir, "orders"), amounts, "o_orderkey").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), "c0",
        F.col("o_orderdate").cast("timestamp_ntz").alias("d0"), F.substring("o_orderpriority", 1, 1).alias("pr"))
    k, dow = F.col("k"), F.weekday("d0")
    days = F.make_dt_interval
    b = base.select(
        "k", "cust",
        F.when(k % 613 == 0, F.expr("c0 - c0 % 100000 + 100000")).when(k % 211 == 0, 970000 + k % 30000)
        .when(k % 3001 == 7, F.col("c0") * 100000).otherwise(F.col("c0")).alias("cents"),
        F.when((dow >= 5) & (k % 97 != 0), F.col("d0") + days(7 - dow)).otherwise(F.col("d0")).alias("posted"),
        F.when(F.col("pr") == "1", "Manual").when(F.col("pr") == "2", "AP").when(F.col("pr") == "3", "AR")
        .when(F.col("pr") == "4", "Bank").otherwise("Payroll").alias("source"))
    src = F.col("source")
    b = b.select(
        "k", F.concat(F.lit("JE-"), F.lpad(k.cast("string"), 9, "0")).alias("id"), "posted",
        (F.col("posted") + days(F.lit(0), F.when(k % 89 == 0, 22).otherwise(8 + k % 10).cast("int"))).alias("keyed"),
        "source", F.concat(F.lit("user"), (F.col("cust") % 5).cast("string")).alias("created_by"),
        F.concat(F.lit("Order "), F.col("cust").cast("string")).alias("description"), "cents",
        F.when(k % 2503 == 5, "1400").when(src.isin("Manual", "AR"), "1200").when(src == "AP", "1300")
        .when(src == "Bank", "1000").otherwise("6000").alias("dr"),
        F.when(k % 4001 == 11, "2500").when(src.isin("Manual", "AR"), "4000").when(src == "AP", "2000")
        .when(src == "Bank", "1200").otherwise("2200").alias("cr"))
    # the planted second posting of an entry, k % 10 days later
    copies = F.when(k % 701 == 3, F.array(F.lit(""), F.lit("-D"))).otherwise(F.array(F.lit("")))
    e = b.withColumn("suffix", F.explode(copies)).withColumn(
        "later", F.when(F.col("suffix") == "-D", k % 10).otherwise(F.lit(0)).cast("int"))
    less = F.when(k % 997 == 1, F.lit(1234)).otherwise(F.lit(0)).cast("bigint")
    zero = F.lit(0).cast("bigint")
    e = e.select(
        F.concat("id", "suffix").alias("entry_id"), (F.col("posted") + days(F.col("later"))).alias("posting_date"),
        (F.col("keyed") + days(F.col("later"))).alias("entered_at"), "description", "source", "created_by",
        F.inline(F.array(
            F.struct(F.lit(1).alias("line_no"), F.col("dr").alias("account_code"),
                     F.col("cents").alias("dc"), zero.alias("cc")),
            F.struct(F.lit(2).alias("line_no"), F.col("cr").alias("account_code"),
                     zero.alias("dc"), (F.col("cents") - less).alias("cc")))))
    code = F.col("account_code")
    name = kind = F.lit(None).cast("string")
    for c, n, t in CHART:
        name, kind = F.when(code == c, n).otherwise(name), F.when(code == c, t).otherwise(kind)
    return e.select(
        "entry_id", "line_no", "posting_date", "entered_at", F.year("posting_date").alias("fiscal_year"),
        F.month("posting_date").alias("period"), "account_code", name.alias("account_name"),
        kind.alias("account_type"), "description", as_money(F.col("dc")).cast("decimal(18,2)").alias("debit"),
        as_money(F.col("cc")).cast("decimal(18,2)").alias("credit"), "source", "created_by")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(gl_lines(spark, sf_dir))


def label_view(entry_ids: DataFrame) -> DataFrame:
    """Ground truth for the planted patterns, from the entry number alone."""
    k = F.substring("entry_id", 4, 9).cast("bigint")
    planted = (("round_amount", k % 613 == 0), ("just_under_threshold", k % 211 == 0),
               ("unbalanced_entry", k % 997 == 1), ("dormant_account", k % 2503 == 5),
               ("rare_account_pair", k % 4001 == 11), ("after_hours_entry", k % 89 == 0),
               ("weekend_entry", k % 97 == 0), ("benford_drift", k % 1009 == 2), ("token_amount", k % 1511 == 4))
    kind = F.when(F.col("entry_id").endswith("-D"), "duplicate_entry")
    for name, rule in planted:
        kind = kind.when(rule, name)
    t = entry_ids.select("entry_id", kind.otherwise("").alias("anomaly_type"))
    return t.select("entry_id", (F.col("anomaly_type") != "").alias("is_anomaly"), "anomaly_type")


def stand_in_scores(entry_ids: DataFrame) -> DataFrame:
    """A deterministic score in [0, 1) per entry, so that what follows a model can be checked in SQL."""
    raw = F.conv(F.substring(F.md5(F.col("entry_id")), 1, 8), 16, 10).cast("bigint")
    return entry_ids.select("entry_id", ((raw % 1000003) / F.lit(1000003.0)).alias("model_score"))


def review_views(entry_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deterministic decisions and narratives, as the review log stores them."""
    k = F.substring("entry_id", 4, 9).cast("bigint")
    base = entry_ids.filter(~F.col("entry_id").endswith("-D")).withColumn("k", k)
    owner = F.when(F.col("k") % 11 == 0, "csv:b").otherwise("csv:a")
    version = F.explode(F.when(F.col("k") % 14 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    level = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("k") % 3 + 1).cast("int"))
    clock = F.lpad((F.col("k") % 60).cast("string"), 2, "0")
    notes = base.filter("k % 7 = 0").withColumn("v", version).select(
        (F.col("k") * 2 + F.col("v")).alias("id"), owner.alias("ledger_id"), "entry_id",
        F.concat(F.lit("Note "), F.col("v").cast("string"), F.lit(" on "), F.col("entry_id")).alias("summary"),
        F.lit("Several tests fired.").alias("why_flagged"),
        F.array(F.lit("Invoice"), F.concat(F.lit("Approval of "), F.col("entry_id"))).alias("evidence_to_request"),
        F.lit("none").alias("suggested_control"), level.alias("confidence"), F.lit("writer-1").alias("model"),
        F.concat(F.lit("2024-01-0"), (F.col("k") % 3 + 1 + F.col("v")).cast("string"), F.lit("T10:"), clock,
                 F.lit(":00+00:00")).alias("generated_at"))
    kinds = F.array(*[F.lit(x) for x in ("accept", "dismiss", "escalate")])
    version = F.explode(F.when(F.col("k") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    decided = base.filter("k % 5 = 0").withColumn("v", version).select(
        (F.col("k") * 2 + F.col("v")).alias("id"), owner.alias("ledger_id"), "entry_id",
        F.element_at(kinds, ((F.col("k") + F.col("v")) % 3 + 1).cast("int")).alias("decision"),
        F.concat(F.lit("reviewer"), (F.col("k") % 4).cast("string")).alias("reviewer"),
        F.concat(F.lit("seen "), F.col("v").cast("string")).alias("note"),
        (F.col("k") % 7).cast("double").alias("risk_score"), F.lit(0.5).alias("model_score"),
        F.when((F.col("k") % 35 == 0) & (F.col("k") % 2 == 0), F.col("k") * 2).alias("narrative_id"),
        F.concat(F.lit("2024-01-02T10:"), clock, F.lit(":00+00:00")).alias("decided_at"))
    return decided, notes
