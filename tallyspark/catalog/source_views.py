"""Source-shaped views for the registered queries: a damaged text ledger, and accounting-system
JSON documents made from the ledger view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = "CAST(substr(entry_id, 4, 9) AS BIGINT)"


def _number() -> Column:
    return F.substring("entry_id", 4, 9).cast("bigint")


def _pick(k: Column, modulus: int, cells: dict[int, str], otherwise: Column) -> Column:
    for rest, text in cells.items():
        otherwise = F.when(k % modulus == rest, text).otherwise(otherwise)
    return otherwise


# The damaged cells, by entry number modulo a prime.
DEBITS = {1: "abc", 2: "1,234.00", 3: "inf", 4: "#N/A", 5: "NA", 6: "", 7: "12.345", 8: " 77.5 ", 9: "1e3"}
LINE_NUMBERS = {1: "1.5", 2: "", 3: "2.0", 4: "two"}
DATES = {4: "240115", 5: "today", 6: " Now ", 7: "2024-01-02 09:15 CET", 8: "2024-01-02T09:15Z", 9: "31/01/2024", 10: "",
         11: "soon", 12: "2024-01-02 09:15:00-08"}
# End of fixed values.


def damaged_lines(lines: DataFrame) -> DataFrame:
    """The ledger as text, with a row number and cells replaced by rule."""
    k = _number()
    dup = F.when(F.col("entry_id").endswith("-D"), 5).otherwise(0)
    posted = F.date_format("posting_date", "yyyy-MM-dd HH:mm:ss")
    for rest, fmt in {1: "yyyyMMdd", 2: "yyyyMMddHHmm", 3: "yyyyMMddHHmmss"}.items():
        posted = F.when(k % 601 == rest, F.date_format("posting_date", fmt)).otherwise(posted)
    entry = F.when(k % 1201 == 9, "").when(k % 1301 == 9, "   ").otherwise(F.col("entry_id"))
    return lines.select(
        (k * 10 + F.col("line_no") + dup).alias("row_no"), entry.alias("entry_id"),
        _pick(k, 503, LINE_NUMBERS, F.col("line_no").cast("string")).alias("line_no"),
        _pick(k, 601, DATES, posted).alias("posting_date"), F.date_format("entered_at", "yyyy-MM-dd HH:mm:ss").alias("entered_at"),
        F.col("fiscal_year").cast("string").alias("fiscal_year"), F.col("period").cast("string").alias("period"),
        F.when(k % 1009 == 3, " ").otherwise(F.col("account_code")).alias("account_code"), "account_name", "account_type",
        "description", _pick(k, 401, DEBITS, F.col("debit").cast("string")).alias("debit"), F.col("credit").cast("string").alias("credit"),
        "source", F.when(k % 997 == 3, "").otherwise(F.col("created_by")).alias("created_by"))


# -- accounting documents ----------------------------------------------------------------

def account_documents(lines: DataFrame) -> DataFrame:
    """One account record per code in the ledger: ids A<code>, some without numbers, some sub-accounts."""
    one = lines.groupBy("account_code").agg(F.min("account_name").alias("n"), F.min("account_type").alias("t"))
    code = F.col("account_code")
    return one.select(
        F.concat(F.lit("A"), code).alias("Id"), F.when(code != "6000", F.concat(F.lit(" "), code)).alias("AcctNum"),
        F.col("n").alias("Name"), F.concat(F.lit("Top:"), "n").alias("FullyQualifiedName"), (code == "2500").alias("SubAccount"),
        (code != "1400").alias("Active"), F.when(code == "2200", "Odd").otherwise(F.col("t")).alias("Classification")
    ).filter(F.col("Id") != "A1300")


STAMPS = ("%sT%s-08:00", "%sT%s.250Z", "%s", "", "%s soon")


def _stamp(k: Column, when: Column) -> Column:
    day, clock = F.date_format(when, "yyyy-MM-dd"), F.date_format(when, "HH:mm:ss")
    out = F.lit("")
    forms = {0: F.concat(day, F.lit("T"), clock, F.lit("-08:00")), 1: F.concat(day, F.lit("T"), clock, F.lit(".250Z")), 2: day,
             3: F.lit(""), 4: F.concat(day, F.lit(" soon")), 5: F.date_format(when, "MM/dd/yyyy hh:mm:ss a"), 6: F.lit("soon")}
    for rest, form in forms.items():
        out = F.when(k % 7 == rest, form).otherwise(out)
    return out


def journal_documents(lines: DataFrame) -> DataFrame:
    """Manual entries as journal-entry documents: two posting lines each, with description-only,
    zero and negative lines planted."""
    k = _number()
    money = F.when(F.col("debit_cents") > 0, F.col("debit")).otherwise(F.col("credit"))
    side = F.when(F.col("debit_cents") > 0, "Debit").otherwise("Credit")
    other = F.when(F.col("debit_cents") > 0, "Credit").otherwise("Debit")
    minus = k % 5 == 0
    line = F.struct(
        F.col("line_no").cast("string").alias("Id"), F.when(k % 4 != 0, F.col("description")).alias("Description"),
        F.when(minus, F.concat(F.lit("-"), money.cast("string"))).otherwise(money.cast("string")).alias("Amount"),
        F.lit("JournalEntryLineDetail").alias("DetailType"),
        F.struct(F.when(minus, other).otherwise(side).alias("PostingType"),
                 F.struct(F.concat(F.lit("A"), "account_code").alias("value"), F.col("account_name").alias("name")).alias("AccountRef")).alias("JournalEntryLineDetail"))
    # two lines per entry
    docs = lines.filter("source = 'Manual'").groupBy("entry_id").agg(
        F.array_sort(F.collect_list(F.struct("line_no", line.alias("l")))).alias("ls"), F.min("posting_date").alias("p"), F.min("entered_at").alias("e"))
    kind = docs.selectExpr("transform(ls, x -> x.l) AS Line").schema["Line"].dataType.elementType
    blank = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "DetailType" else F.lit("DescriptionOnly").alias("DetailType") for f in kind.fields])
    zero = F.transform(F.slice("ls", 1, 1), lambda x: x["l"].withField("Amount", F.lit("0.00")))
    none = F.array().cast(f"array<{kind.simpleString()}>")
    posting = F.transform("ls", lambda x: x["l"])
    every = F.concat(F.when(k % 3 == 0, F.array(blank)).otherwise(none), F.when(k % 11 == 0, zero).otherwise(none),
                     F.when(k % 101 == 0, none).otherwise(posting))
    return docs.select(
        F.col("entry_id").alias("Id"), F.date_format("p", "yyyy-MM-dd").alias("TxnDate"), (k % 10 == 0).alias("Adjustment"),
        F.when(k % 2 == 0, F.concat(F.lit("D"), k.cast("string"))).alias("DocNumber"), F.when(k % 8 == 0, F.lit("memo")).alias("PrivateNote"),
        F.struct(_stamp(k, F.col("e")).alias("CreateTime")).alias("MetaData"), every.alias("Line"))


COLUMNS = ("tx_date", "txn_type", "doc_num", "name", "memo", "debt_amt", "credit_amt", "create_by", "create_date")


def report_documents(lines: DataFrame) -> DataFrame:
    """General-ledger reports, one per 500 entry numbers: account-type sections holding account
    sections holding rows, a beginning-balance row in each; every transaction is listed."""
    k = _number()
    doc = F.floor(k / 500).cast("bigint")
    text = F.when(k % 50 == 0, F.lit("Bill Payment (Check)")).when(k % 97 == 1, F.lit("Inventory Starting Value")).when(F.col("source") == "AP", "Bill") \
        .when(F.col("source") == "AR", "Invoice").when(F.col("source") == "Bank", "Deposit").when(F.col("source") == "Payroll", "Payroll Check").otherwise("Journal Entry")
    kind = F.when(F.col("source") == "Manual", "Journal Entry").otherwise(text)

    def amount(c: str) -> Column:
        cents = F.col(c)
        shown = F.format_string("%,d.%02d", F.call_function("div", cents, F.lit(100)), cents % 100)
        return F.when(cents == 0, "").otherwise(shown)

    def cell(value: Column, ident: Column | None = None) -> Column:
        return F.struct(value.alias("value"), (F.lit(None).cast("string") if ident is None else ident).alias("id"))

    user = F.when(k % 9 == 0, "").when(k % 9 == 1, "  ").otherwise(F.col("created_by"))
    row = F.array(
        cell(F.date_format("posting_date", "yyyy-MM-dd")), cell(kind, F.col("entry_id")), cell(F.when(k % 2 == 0, k.cast("string")).otherwise("")),
        cell(F.when(k % 3 == 0, F.lit("Someone")).otherwise("")), cell(F.when(k % 4 == 0, F.col("description")).otherwise("")),
        cell(amount("debit_cents")), cell(amount("credit_cents")), cell(user), cell(_stamp(k, F.col("entered_at"))))
    # at most 1,000 lines and their copies per document: its lines are brought together once, as they are, and put into cells and sections there
    told = ("entry_id", "line_no", "posting_date", "entered_at", "account_code", "account_name", "account_type", "description", "debit_cents", "credit_cents", "source", "created_by")
    whole_docs = lines.select(doc.alias("doc_no"), *told).repartition("doc_no")
    accounts = whole_docs.groupBy("doc_no", "account_type", "account_code", "account_name").agg(
        F.array_sort(F.collect_list(F.struct("entry_id", "line_no", F.struct(row.alias("ColData")).alias("r")))).alias("rs"))
    balance = F.struct(F.array(*[cell(F.lit("Beginning Balance") if i == 0 else F.lit("")) for i in range(len(COLUMNS))]).alias("ColData"))
    section = F.struct(F.lit("Section").alias("type"),
                       F.struct(F.array(cell(F.col("account_name"), F.concat(F.lit("A"), "account_code"))).alias("ColData")).alias("Header"),
                       F.struct(F.concat(F.array(balance), F.transform("rs", lambda x: x["r"])).alias("Row")).alias("Rows"))
    types = accounts.withColumn("section", section).groupBy("doc_no", "account_type").agg(
        F.array_sort(F.collect_list(F.struct("account_code", "section"))).alias("ss"))
    outer = F.struct(F.lit("Section").alias("type"), F.struct(F.array(cell(F.col("account_type"))).alias("ColData")).alias("Header"),
                     F.struct(F.transform("ss", lambda x: x["section"]).alias("Row")).alias("Rows"))
    docs = types.withColumn("section", outer).groupBy("doc_no").agg(F.array_sort(F.collect_list(F.struct("account_type", "section"))).alias("ts"))
    columns = F.array(*[F.struct(
        F.lit("Debit" if c == "debt_amt" else c).alias("ColTitle"), F.lit(c if c == "credit_amt" else "x").alias("ColType"),
        (F.array(F.struct(F.lit("ColKey").alias("Name"), F.lit(c).alias("Value"))) if c not in ("debt_amt", "credit_amt")
         else F.array().cast("array<struct<Name: string, Value: string>>")).alias("MetaData")) for c in COLUMNS])
    whole = F.struct(F.struct(columns.alias("Column")).alias("Columns"), F.struct(F.transform("ts", lambda x: x["section"]).alias("Row")).alias("Rows"))
    return docs.select("doc_no", F.to_json(whole).alias("report"))
