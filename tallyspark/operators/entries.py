"""Derived line columns and the collapse of lines into entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.calendar import days_to_period_end, is_federal_holiday
from tallyspark.functions.money import as_money, to_cents
from tallyspark.plans.staging import attach, middle_values, settle
from tallyspark.schema import LedgerError

HEADER = ("posting_date", "entered_at", "fiscal_year", "period", "source", "created_by", "description")


def derive(lines: DataFrame) -> DataFrame:
    """Add the working columns to contract-shaped lines; narrow and shuffle-free."""
    keyed = F.col("entered_at")
    out = lines.withColumns({"debit_cents": to_cents(F.col("debit")), "credit_cents": to_cents(F.col("credit"))})
    return out.withColumns({
        "amount_cents": F.col("debit_cents") - F.col("credit_cents"),
        "entered_hour": F.hour(keyed),
        "entered_dow": F.weekday(keyed),
        "is_weekend": F.weekday(keyed) >= 5,
        "is_holiday": is_federal_holiday(keyed),
        "posting_lag_days": F.datediff(F.col("posting_date").cast("date"), keyed.cast("date")),
    }).withColumns({
        "abs_cents": F.abs("amount_cents"),
        "amount": as_money(F.col("amount_cents")),
        "abs_amount": as_money(F.abs("amount_cents")),
    })


#: Where a line stands in its entry: its number, then (for numbers given twice) account and text.
LINE_ORDER = ("line_no", "account_code", "description")


def _codes(side: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.when(F.col(side) > 0, F.col("account_code")))), "|")


def entry_facts(lines: DataFrame, period_end_days: int = 3) -> DataFrame:
    """Everything the tests read of an entry, from one shuffle on ``entry_id``.

    Header fields, totals, the debit and credit account sets, the account of the largest line
    and the entry's first period-end manual revenue line. Columns a caller does not select are
    pruned from the aggregate. The contract leaves only ``description`` blank, so every other
    header field is the first line's and one ordered minimum finds them all.
    """
    closing = ((F.col("account_type") == "Revenue") & (F.col("credit_cents") > 0)
               & (F.col("source") == "Manual") & (days_to_period_end(F.col("posting_date")) < period_end_days))
    rest = [c for c in HEADER if c != "description"]
    told = F.when(F.col("description").isNotNull(), F.struct(*LINE_ORDER))
    grouped = lines.groupBy("entry_id").agg(
        F.min(F.struct(*LINE_ORDER, *rest)).alias("_first"),
        F.min(told).getField("description").alias("description"),
        F.sum("debit_cents").alias("debit_sum"),
        F.sum("credit_cents").alias("credit_sum"),
        F.count("line_no").alias("n_lines"),
        _codes("debit_cents").alias("_debits"),
        _codes("credit_cents").alias("_credits"),
        F.max_by("account_code", F.struct("abs_cents", -F.col("line_no"))).alias("main_account"),
        F.min_by(F.struct("credit_cents", "account_name", "posting_date"),
                 F.when(closing, F.struct("line_no", "account_code"))).alias("closing_line"),
    )
    grouped = grouped.withColumns({c: F.col(f"_first.{c}") for c in rest}).drop("_first")
    sided = (F.col("_debits") != "") | (F.col("_credits") != "")
    return grouped.withColumns({
        "total_debit_cents": F.col("debit_sum"),
        "total_credit_cents": F.col("credit_sum"),
        "entry_cents": F.greatest("debit_sum", "credit_sum"),
        "imbalance_cents": F.col("debit_sum") - F.col("credit_sum"),
        "entered_hour": F.hour("entered_at"),
        "is_weekend": F.weekday("entered_at") >= 5,
        "is_holiday": is_federal_holiday(F.col("entered_at")),
        "debit_accounts": F.when(F.col("_debits") != "", F.col("_debits")),
        "credit_accounts": F.when(F.col("_credits") != "", F.col("_credits")),
        "pair": F.when(sided, F.concat("_debits", F.lit(">"), "_credits")),
    }).drop("debit_sum", "credit_sum", "_debits", "_credits")


def with_money(entries: DataFrame) -> DataFrame:
    """Entry cents as the DECIMAL columns a reader expects."""
    return entries.withColumns({
        "total_debit": as_money(F.col("total_debit_cents")),
        "total_credit": as_money(F.col("total_credit_cents")),
        "entry_amount": as_money(F.col("entry_cents")),
        "imbalance": as_money(F.col("imbalance_cents")),
    })


ENTRY_COLUMNS = ("entry_id", *HEADER, "total_debit", "total_credit", "n_lines", "entered_hour",
                 "is_weekend", "is_holiday", "entry_amount", "imbalance")


def entry_level(lines: DataFrame) -> DataFrame:
    """One row per entry: header, totals, amount (the larger side) and imbalance."""
    return with_money(entry_facts(lines)).select(*ENTRY_COLUMNS)


def entry_pairs(lines: DataFrame) -> DataFrame:
    """Debit and credit account sets per entry; an entry with no positive side has no row."""
    facts = entry_facts(lines).select("entry_id", "debit_accounts", "credit_accounts", "pair")
    return facts.filter(F.col("pair").isNotNull())


def main_accounts(lines: DataFrame) -> DataFrame:
    """The account of each entry's largest line, ties to the lowest line number."""
    return entry_facts(lines).select("entry_id", "main_account")


def frequencies(entries: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """How often each value of several columns occurs, as a share of its non-null total:
    ``dimension, value, n, share``, from one pass over the entries."""
    kinds = F.array(*[F.struct(F.lit(name).alias("dimension"), c.cast("string").alias("value"))
                      for name, c in columns.items()])
    counts = (entries.select(F.inline(kinds)).filter(F.col("value").isNotNull())
              .groupBy("dimension", "value").agg(F.count("*").alias("n")))
    # one row per dimension: as many as the caller named columns
    totals = counts.groupBy("dimension").agg(F.sum("n").alias("total"))
    return (counts.join(F.broadcast(totals), "dimension")
            .select("dimension", "value", "n", (F.col("n") / F.col("total")).alias("share")))


def account_amounts(lines: DataFrame) -> DataFrame:
    """Exact median and MAD of log10 amounts per account: ``account_code, n, median, mad``.

    Lines are first counted per (account, amount), which spreads a hot account over all tasks;
    both medians are then found from histograms of those counts.
    """
    counts = settle(lines.filter("abs_cents > 0").groupBy("account_code", F.col("abs_cents").alias("cents"))
                    .agg(F.count("*").alias("weight")), "amounts")
    logged = F.log10(F.col("cents") / F.lit(100.0))
    mid = middle_values(counts, ["account_code"], "cents", "weight", F.floor(F.log2(F.col("cents").cast("double")) * 512))
    centre = settle(mid.select("account_code", "n", (
        (F.log10(F.col("low") / F.lit(100.0)) + F.log10(F.col("high") / F.lit(100.0))) / 2).alias("median")), "medians")
    away = attach(counts, centre.select("account_code", "median"), ["account_code"], "inner", spread="cents")
    mad = middle_values(away.withColumn("dev", F.abs(logged - F.col("median"))), ["account_code"], "dev", "weight", F.floor(F.col("dev") * 8192))
    mad = mad.select("account_code", ((F.col("low") + F.col("high")) / 2).alias("mad"))
    return centre.join(mad, "account_code").select("account_code", "n", "median", "mad")


def fixed_key_counts(rows: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    """Counts per key: every known key in its order, zeros included, unknown keys after them."""
    spark = rows.sparkSession
    found = rows.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).filter(F.col("key").isNotNull())
    # the known keys are a literal list
    listed = spark.createDataFrame([(k, i) for i, k in enumerate(known)], "key string, place int")
    return found.join(listed, "key", "full_outer").select(
        "key", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.coalesce("place", F.lit(len(known))).alias("place")).orderBy("place", "key").select("key", "n")


def fiscal_year_for(entries: DataFrame, fiscal_year: int | None = None) -> int | None:
    """The one fiscal year figures are set for; several, or an absent one, are refused."""
    years = sorted(r[0] for r in entries.select("fiscal_year").distinct().collect())
    if fiscal_year is None:
        if len(years) > 1:
            raise LedgerError("the ledger spans fiscal years {}, and materiality is set for one year's "
                              "financial statements: name the year".format(", ".join(map(str, years))))
        return years[0] if years else None
    if fiscal_year not in years:
        raise LedgerError("the ledger has no entry in fiscal year {} (it holds {})".format(
            fiscal_year, ", ".join(map(str, years)) or "no entries"))
    return fiscal_year
