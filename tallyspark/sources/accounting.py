"""A source system's JSON (accounts, journal entries, general-ledger reports) as ledger lines.

Inputs are DataFrames, one row per document: a pull of many periods is many rows, read and
flattened in parallel. Nothing is dropped silently: lines set aside keep a reason.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.dates import read
from tallyspark.operators.entries import derive, entry_facts
from tallyspark.operators.ingest import prepare
from tallyspark.plans.staging import attach, beside, joined, numbered_within, settle
from tallyspark.schema import ACCOUNT_TYPES, EXPORT_COLUMNS, LedgerError

# Where each transaction type sits among the sources, report column titles, and
# the stand-ins for what a source does not say.
TXN_SOURCE = {
    "JournalEntry": "Manual",
    "Bill": "AP", "BillPayment": "AP", "BillPaymentCheck": "AP", "BillPaymentCreditCard": "AP",
    "VendorCredit": "AP", "Expense": "AP", "Check": "AP", "Purchase": "AP",
    "CreditCardExpense": "AP", "CreditCardCredit": "AP", "PurchaseOrder": "AP",
    "CashExpense": "AP", "SalesTaxPayment": "AP",
    "Invoice": "AR", "Payment": "AR", "SalesReceipt": "AR", "CreditMemo": "AR", "RefundReceipt": "AR", "Refund": "AR",
    "Deposit": "Bank", "Transfer": "Bank", "CreditCardPayment": "Bank",
    "Paycheck": "Payroll",
    "InventoryQtyAdjust": "System",
}
TITLE_KEYS = {
    "date": "tx_date", "transaction type": "txn_type", "num": "doc_num", "name": "name", "memo/description": "memo",
    "split": "split_acc", "debit": "debt_amt", "credit": "credit_amt", "created by": "create_by",
    "create date": "create_date", "last modified by": "last_mod_by", "last modified": "last_mod_date",
    "account": "account_name",
}
KNOWN_KEYS = tuple(sorted({*TITLE_KEYS.values(), "account_num", "subt_nat_amount"}))
NEEDED_KEYS = ("tx_date", "txn_type", "debt_amt", "credit_amt")
UNKNOWN_TYPE, UNKNOWN_USER = "Unknown", "qbo-unknown"
ESTIMATED_HOUR = 12
# End of fixed values.
#: How deep report sections are unrolled at first; for deeper documents, twice as deep, and so on.
FIRST_DEPTH = 5

ACCOUNT_SCHEMA = "Id string, AcctNum string, Name string, FullyQualifiedName string, SubAccount boolean, Active boolean, Classification string"
JOURNAL_SCHEMA = (
    "Id string, TxnDate string, Adjustment boolean, DocNumber string, PrivateNote string, MetaData struct<CreateTime: string>, "
    "Line array<struct<Id: string, Description: string, Amount: string, DetailType: string, "
    "JournalEntryLineDetail: struct<PostingType: string, AccountRef: struct<value: string, name: string>>>>")


def report_schema(depth: int = FIRST_DEPTH) -> T.StructType:
    """A report's shape with its sections unrolled to ``depth``; anything below stays text."""
    cell = T.StructType([T.StructField("value", T.StringType()), T.StructField("id", T.StringType())])
    cells = T.ArrayType(cell)
    rows: T.DataType = T.StringType()
    for _ in range(depth):
        row = T.StructType([
            T.StructField("type", T.StringType()), T.StructField("ColData", cells),
            T.StructField("Header", T.StructType([T.StructField("ColData", cells)])), T.StructField("Rows", rows)])
        rows = T.StructType([T.StructField("Row", T.ArrayType(row))])
    meta = T.StructType([T.StructField("Name", T.StringType()), T.StructField("Value", T.StringType())])
    column = T.StructType([T.StructField("ColTitle", T.StringType()), T.StructField("ColType", T.StringType()),
                           T.StructField("MetaData", T.ArrayType(meta))])
    return T.StructType([T.StructField("Columns", T.StructType([T.StructField("Column", T.ArrayType(column))])),
                         T.StructField("Rows", rows)])


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACCOUNT_SCHEMA).json(path)


def read_journal_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOURNAL_SCHEMA).json(path)


# -- scalar mappings -----------------------------------------------------------------

def type_token(txn_type: Column) -> Column:
    return F.regexp_replace(F.coalesce(txn_type, F.lit("")), "[^A-Za-z0-9]", "")


def _mapped(token: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TXN_SOURCE.items() for x in kv])
    return F.try_element_at(table, token)


def source_for(token: Column) -> Column:
    return F.coalesce(_mapped(token), F.when(token.startswith("Payroll"), "Payroll").otherwise("System"))


def is_mapped(token: Column) -> Column:
    return _mapped(token).isNotNull() | token.startswith("Payroll")


def entry_id_for(token: Column, txn_id: Column) -> Column:
    return F.concat_ws("-", F.lit("QBO"), token, txn_id)


def report_money(text: Column) -> Column:
    """A report amount: grouping commas dropped, blank as nothing."""
    plain = F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit("")))
    return F.when(plain == "", F.lit(0).cast("decimal(18,2)")).otherwise(F.round(plain.cast("decimal(38,10)"), 2).cast("decimal(18,2)"))


def sided(debit: Column, credit: Column) -> tuple[Column, Column]:
    """Negative debits moved to the credit side, then negative credits to the debit side."""
    zero = F.lit(0).cast("decimal(18,2)")
    d, c = F.when(debit < 0, zero).otherwise(debit), F.when(debit < 0, credit - debit).otherwise(credit)
    return F.when(c < 0, d - c).otherwise(d).cast("decimal(18,2)"), F.when(c < 0, zero).otherwise(c).cast("decimal(18,2)")


_STAMP = r"^(\d{4}-\d{1,2}-\d{1,2})[T ](\d{1,2}:\d{2})(?:(:\d{1,2})(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?$"


def read_stamp(text: Column, zone: str | None = None) -> Column:
    """An entry time as ``kind, when, utc``: ``time`` (as given, or in ``zone``), ``date`` (noon),
    ``unreadable-date`` (the date it starts with, noon), ``unreadable``, ``blank``. ``when`` is
    null for the last two: the posting date stands in."""
    t = F.trim(F.coalesce(text, F.lit("")))
    part = lambda i: F.regexp_extract(t, _STAMP, i)
    clock = F.concat(part(1), F.lit(" "), part(2), F.when(part(3) == "", ":00").otherwise(part(3)))
    given = read(clock, "yyyy-M-d H:mm:s")
    fraction = F.coalesce(F.concat(F.lit("0"), F.nullif(part(4), F.lit(""))).try_cast("decimal(8,6)"), F.lit(0).cast("decimal(8,6)"))
    given = given + F.make_dt_interval(secs=fraction.cast("decimal(18,6)"))
    offset = F.regexp_replace(part(5), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    if zone:
        moved = F.convert_timezone(F.when(offset == "Z", "UTC").otherwise(offset), F.lit(zone), given)
        given = F.when(offset != "", moved).otherwise(given)
    noon = F.make_dt_interval(hours=F.lit(ESTIMATED_HOUR))
    clocked = F.coalesce(F.when(t.rlike(_STAMP), given), read(t, "M/d/yyyy h:mm:ss a"), read(t, "M/d/yyyy H:mm:ss"))
    dated = F.coalesce(read(t, "yyyy-M-d"), read(t, "M/d/yyyy"))
    iso, us = F.regexp_extract(t, r"^(\d{4}-\d{1,2}-\d{1,2})(?!\d)", 1), F.regexp_extract(t, r"^(\d{1,2}/\d{1,2}/\d{4})(?!\d)", 1)
    leading = F.coalesce(F.when(iso != "", read(iso, "yyyy-M-d")), F.when(us != "", read(us, "M/d/yyyy")))

    def found(value: Column, kind: str, add: Column | None = None) -> Column:
        """Each way is tried once, only if those ahead of it found nothing."""
        return F.get(F.transform(F.array(value), lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), (v if add is None else v + add).alias("when")))), F.lit(0))

    nothing = F.lit(None).cast("timestamp_ntz")
    read_as = F.coalesce(F.when(t == "", F.struct(F.lit("blank").alias("kind"), nothing.alias("when"))), found(clocked, "time"),
                         found(dated, "date", noon), found(leading, "unreadable-date", noon), F.struct(F.lit("unreadable").alias("kind"), nothing.alias("when")))
    zero = t.rlike(r"(Z|[+-]00:?00)$")
    return F.get(F.transform(F.array(read_as), lambda r: F.struct(r["kind"].alias("kind"), r["when"].alias("when"), (zero & (r["kind"] == "time")).alias("utc"))), F.lit(0))


def stamp_order(stamp: Column) -> Column:
    """How the stamps of one transaction compete: a date beats none, the earliest date wins,
    within it a time of day beats a date, a read value an unreadable one."""
    rank = F.when(stamp["kind"] == "time", 0).when(stamp["kind"].isin("date", "unreadable-date"), 1).otherwise(2)
    return F.struct((rank == 2).alias("none"), stamp["when"].cast("date").alias("day"), rank.alias("rank"),
                    stamp["when"].alias("when"), stamp["kind"].isin("unreadable-date", "blank").alias("weak"))


def entered(stamp: Column, posting: Column) -> Column:
    return F.coalesce(stamp["when"], F.date_trunc("day", posting).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(ESTIMATED_HOUR)))


# -- accounts ----------------------------------------------------------------------

def accounts_by_id(rows: DataFrame) -> DataFrame:
    """Accounts keyed by id: code, name (full path for a sub-account), type, active, sub_account."""
    sub = F.coalesce("SubAccount", F.lit(False))
    full = F.when(sub, F.nullif("FullyQualifiedName", F.lit("")))
    return rows.select(
        F.col("Id").alias("account_id"), F.coalesce(F.nullif(F.trim("AcctNum"), F.lit("")), F.col("Id")).alias("code"),
        F.coalesce(full, F.nullif("Name", F.lit("")), F.col("Id")).alias("name"),
        F.when(F.col("Classification").isin(list(ACCOUNT_TYPES)), F.col("Classification")).otherwise(UNKNOWN_TYPE).alias("type"),
        F.coalesce("Active", F.lit(True)).alias("active"), sub.alias("sub_account"))


def _with_account(lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """Code, name and type of each line's account; one the source did not list is said to be unknown."""
    lookup = accounts.select(F.col("account_id").alias("ref_id"), F.col("code").alias("_code"), F.col("name").alias("_name"), F.col("type").alias("_type"))
    out = attach(lines, lookup, ["ref_id"], spread="txn_id")
    label = F.coalesce(F.nullif("ref_id", F.lit("")), F.lit("none"))
    unknown = F.col("_code").isNull()
    stated = F.coalesce(F.nullif("ref_name", F.lit("")), F.concat(F.lit("Unknown account "), label))
    return out.withColumns({
        "account_code": F.coalesce("_code", label), "account_name": F.when(unknown, stated).otherwise(F.col("_name")),
        "account_type": F.when(unknown, UNKNOWN_TYPE).otherwise(F.col("_type")), "unknown_account": unknown,
    }).drop("_code", "_name", "_type")


_LINE = ("entry_id", "line_no", "posting_date", "entered_at", "fiscal_year", "period", "account_code", "account_name",
         "account_type", "description", "debit", "credit", "source", "created_by", "entered_at_estimated")
_EXTRA = ("token", "txn_id", "stamp_kind", "stamp_utc", "adjusting", "unknown_account", "set_aside")


def _shape(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"fiscal_year": F.year("posting_date"), "period": F.month("posting_date"),
                              "entered_at_estimated": F.col("stamp_kind") != "time"}).select(*_LINE, *_EXTRA)


# -- journal entries ----------------------------------------------------------------

def journal_entries_to_lines(entries: DataFrame, accounts: DataFrame, headers: DataFrame, zone: str | None = None) -> DataFrame:
    """Journal-entry documents as lines, with the lines set aside and why. Line numbers are counted
    inside each document's array, so no window or shuffle is needed for them."""
    zero = F.lit(0).cast("decimal(18,2)")

    def reading(line: Column) -> Column:
        amount = report_money(line["Amount"])
        side = line["JournalEntryLineDetail"]["PostingType"]
        flipped = F.when(amount < 0, F.when(side == "Debit", "Credit").when(side == "Credit", "Debit").otherwise(side)).otherwise(side)
        aside = (F.when(~line["DetailType"].eqNullSafe(F.lit("JournalEntryLineDetail")),
                        F.when(line["DetailType"] == "DescriptionOnly", "description only").otherwise("other detail"))
                 .when((amount == 0) | ~F.coalesce(flipped.isin("Debit", "Credit"), F.lit(False)), "zero amount"))
        ref = line["JournalEntryLineDetail"]["AccountRef"]
        size = F.abs(amount)
        return F.struct(aside.alias("set_aside"), F.when(flipped == "Debit", size).otherwise(zero).alias("debit"),
                        F.when(flipped == "Credit", size).otherwise(zero).alias("credit"), ref["value"].alias("ref_id"),
                        ref["name"].alias("ref_name"), F.nullif(line["Description"], F.lit("")).alias("text"))

    read_lines = F.transform(F.coalesce("Line", F.array().cast(T.ArrayType(entries.schema["Line"].dataType.elementType))), reading)
    kept = F.filter("_lines", lambda x: x["set_aside"].isNull())
    aside = F.filter("_lines", lambda x: x["set_aside"].isNotNull())
    ordered = F.concat(F.transform(kept, lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("x"))),
                       F.transform(aside, lambda x: F.struct(F.lit(None).cast("int").alias("line_no"), x.alias("x"))))
    docs = entries.withColumn("_lines", read_lines).withColumn("_empty", F.size(kept) == 0)
    posting = read(F.substring(F.trim("TxnDate"), 1, 10), "yyyy-MM-dd")
    note = F.coalesce(F.nullif("PrivateNote", F.lit("")), F.concat(F.lit("Journal entry "), F.coalesce(F.nullif("DocNumber", F.lit("")), F.col("Id"))))
    docs = docs.withColumn("_ordered", ordered).select(
        F.col("Id").alias("txn_id"), posting.alias("posting_date"), read_stamp(F.col("MetaData.CreateTime"), zone).alias("stamp"),
        F.coalesce("Adjustment", F.lit(False)).alias("adjusting"), note.alias("note"), "_empty", "_ordered")
    docs = docs.select("txn_id", "posting_date", "stamp", "adjusting", "note", "_empty", F.inline_outer("_ordered"))
    users = headers.filter(F.col("token") == "JournalEntry").select("txn_id", "create_by")
    lines = joined(docs, users, "txn_id", "left").select(
        "txn_id", "posting_date", "stamp", "adjusting", "note", "_empty", "line_no", "x.*", "create_by")
    lines = _with_account(lines, accounts)
    return _shape(lines.withColumns({
        "token": F.lit("JournalEntry"), "entry_id": entry_id_for(F.lit("JournalEntry"), F.col("txn_id")),
        "entered_at": entered(F.col("stamp"), F.col("posting_date")), "stamp_kind": F.col("stamp.kind"),
        "stamp_utc": F.col("stamp.utc") & F.lit(zone is None), "description": F.coalesce("text", "note"),
        "source": F.lit("Manual"), "created_by": F.coalesce(F.nullif(F.trim("create_by"), F.lit("")), F.lit(UNKNOWN_USER)),
        "set_aside": F.when(F.col("_empty") & F.col("set_aside").isNull(), "no posting line").otherwise(F.col("set_aside"))}))


# -- general-ledger reports ------------------------------------------------------------

def column_key(column: Column) -> Column:
    """A report column's key: its ColKey metadata, a known type, what its title stands for, its title."""
    keyed = F.filter(F.coalesce(column["MetaData"], F.array().cast("array<struct<Name: string, Value: string>>")),
                     lambda m: (m["Name"] == "ColKey") & (m["Value"] != ""))
    title = F.coalesce(column["ColTitle"], F.lit(""))
    titles = F.create_map(*[F.lit(x) for kv in TITLE_KEYS.items() for x in kv])
    return F.coalesce(F.get(keyed, F.lit(0))["Value"], F.when(column["ColType"].isin(list(KNOWN_KEYS)), column["ColType"]),
                      F.try_element_at(titles, F.lower(F.trim(title))), title)


def _data_rows(rows: Column, account: Column, path: Column, level: int, depth: int) -> Column:
    """Every data row below ``rows`` as (path, cells, account): one nested expression per report."""
    def one(row: Column, i: Column) -> Column:
        here = F.array_append(path, i)
        item = F.array(F.struct(here.alias("path"), row["ColData"].alias("cells"), account.alias("account")))
        none = F.slice(item, 1, 0)
        data = F.when(row["ColData"].isNotNull(), item).otherwise(none)
        if level == depth:
            return data
        section = row["type"].eqNullSafe(F.lit("Section")) | row["Header"].isNotNull() | row["Rows"].isNotNull()
        head = F.get(row["Header"]["ColData"], F.lit(0))
        inner = F.when(F.coalesce(head["id"], F.lit("")) != "", head).otherwise(account)
        below = _data_rows(row["Rows"]["Row"], inner, here, level + 1, depth)
        return F.when(section, F.coalesce(below, none)).otherwise(data)

    return F.flatten(F.transform(rows, one))


def _too_deep(rows: Column, level: int, depth: int) -> Column:
    if level == depth:
        return F.exists(rows, lambda r: r["Rows"].isNotNull())
    return F.exists(rows, lambda r: F.coalesce(_too_deep(r["Rows"]["Row"], level + 1, depth), F.lit(False)))


def report_rows(reports: DataFrame, depth: int = FIRST_DEPTH) -> DataFrame:
    """Report documents (``doc_no``, ``report`` JSON text) as data rows: values by key, the
    transaction id, the account of the innermost section and the row's place."""
    parsed = reports.select("doc_no", F.from_json("report", report_schema(depth)).alias("r"))
    keys = F.transform(F.coalesce(F.col("r.Columns.Column"), F.array().cast(report_schema(depth)["Columns"].dataType["Column"].dataType)), column_key)
    parsed = parsed.withColumn("keys", keys)
    missing = F.filter(F.array(*[F.lit(k) for k in NEEDED_KEYS]), lambda k: ~F.array_contains("keys", k))
    deep = F.coalesce(_too_deep(F.col("r.Rows.Row"), 1, depth), F.lit(False))
    nobody = F.lit(None).cast("struct<value: string, id: string>")
    rows = _data_rows(F.col("r.Rows.Row"), nobody, F.array().cast("array<int>"), 1, depth)
    parsed = parsed.select("doc_no", "keys", F.array_join(missing, ", ").alias("_missing"), deep.alias("_deep"), rows.alias("_rows"))
    flat = parsed.select("doc_no", "keys", "_missing", "_deep", F.inline_outer("_rows"))

    def value(key: str) -> Column:
        at = F.array_position("keys", F.lit(key)).cast("int")
        return F.when(at > 0, F.coalesce(F.get("cells", at - 1)["value"], F.lit(""))).otherwise("")

    named = F.arrays_zip("keys", "cells")
    ids = F.filter(named, lambda z: z["keys"].isin("txn_type", "tx_date") & (F.coalesce(z["cells"]["id"], F.lit("")) != ""))
    # written once: the documents are parsed one time, and what is wrong with them is read off the rows
    flat = settle(flat.select(
        "doc_no", "path", "account", F.get(ids, F.lit(0))["cells"]["id"].alias("txn_id"), "_missing", "_deep",
        *[value(k).alias(k) for k in ("tx_date", "txn_type", "doc_num", "name", "memo", "debt_amt", "credit_amt", "create_by", "create_date")],
    ).withColumn("token", type_token(F.col("txn_type"))), "report")
    bad = flat.agg(F.min(F.nullif("_missing", F.lit(""))).alias("missing"),
                   F.count_distinct(F.when(F.col("_deep"), F.col("doc_no"))).alias("deep")).first()
    if bad["missing"]:
        raise LedgerError(f"the GeneralLedger report has no {bad['missing']} column(s)")
    if bad["deep"]:  # sections go deeper than they were unrolled
        return report_rows(reports, 2 * depth)
    return flat.filter(F.col("path").isNotNull()).drop("_missing", "_deep")


def report_headers(rows: DataFrame) -> DataFrame:
    """Who keyed each transaction and when: its first row's values."""
    place = F.struct("doc_no", "path")
    return rows.filter(F.col("txn_id").isNotNull()).groupBy("token", "txn_id").agg(
        F.min_by("create_by", place).alias("create_by"), F.min_by("create_date", place).alias("create_date"))


def general_ledger_to_lines(rows: DataFrame, accounts: DataFrame, zone: str | None = None) -> DataFrame:
    """Every transaction but journal entries, rebuilt from report rows, set-aside rows kept."""
    rows = settle(rows.filter(F.col("txn_id").isNotNull()).withColumn("token", F.when(F.col("token") == "", "UnknownType").otherwise(F.col("token")))
                  .filter(F.col("token") != "JournalEntry").withColumn("stamp", read_stamp(F.col("create_date"), zone)), "report")
    place = F.struct("doc_no", "path")
    ranked = F.struct(stamp_order(F.col("stamp")).alias("o"), place.alias("p"))
    user = F.nullif(F.trim("create_by"), F.lit(""))
    debit, credit = sided(report_money(F.col("debt_amt")), report_money(F.col("credit_amt")))
    lines = rows.withColumns({"debit": debit, "credit": credit}).withColumn(
        "set_aside", F.when((F.col("debit") == 0) & (F.col("credit") == 0), "zero amount"))
    per = settle(lines.groupBy("token", "txn_id").agg(
        F.min_by("tx_date", place).alias("first_date"), F.min_by(F.struct("stamp", user.alias("user")), ranked).alias("keyed"),
        F.min_by(user, F.when(user.isNotNull(), place)).alias("any_user"),
        (F.count_if(F.col("set_aside").isNull()) == 0).alias("_empty")), "transactions")
    kept = numbered_within(lines.filter(F.col("set_aside").isNull()), ["token", "txn_id"], ["doc_no", "path"], "line_no")
    aside = lines.filter(F.col("set_aside").isNotNull()).withColumn("line_no", F.lit(None).cast("int"))
    every = kept.unionByName(aside).drop("stamp", "create_by", "create_date", "tx_date")
    out = attach(every, per, ["token", "txn_id"], "inner", spread="path", keyed=rows)
    out = out.withColumns({"ref_id": F.col("account.id"), "ref_name": F.col("account.value"),
                           "posting_date": read(F.substring(F.trim("first_date"), 1, 10), "yyyy-MM-dd")})
    out = _with_account(out, accounts)
    label = F.coalesce(F.nullif("txn_type", F.lit("")), F.col("token"))
    text = F.coalesce(F.nullif("memo", F.lit("")), F.nullif("name", F.lit("")),
                      F.when(F.col("doc_num") != "", F.concat(label, F.lit(" "), F.col("doc_num"))).otherwise(label))
    return _shape(out.withColumns({
        "entry_id": entry_id_for(F.col("token"), F.col("txn_id")), "entered_at": entered(F.col("keyed.stamp"), F.col("posting_date")),
        "stamp_kind": F.col("keyed.stamp.kind"), "stamp_utc": F.col("keyed.stamp.utc") & F.lit(zone is None),
        "description": text, "source": source_for(F.col("token")),
        "created_by": F.coalesce("keyed.user", "any_user", F.lit(UNKNOWN_USER)), "adjusting": F.lit(False)}))


# -- one period -------------------------------------------------------------------------

def to_ledger(lines: DataFrame) -> DataFrame:
    """Posted lines as a prepared ledger in the export columns."""
    posted = lines.filter(F.col("set_aside").isNull()).select(*EXPORT_COLUMNS)
    if posted.isEmpty():
        raise LedgerError("no transactions in range")
    return prepare(posted)


def assemble(accounts: DataFrame, entries: DataFrame, reports: DataFrame, zone: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One pull: the prepared ledger and its statistics."""
    accounts = settle(accounts_by_id(accounts), "accounts")
    rows = report_rows(reports)
    headers = settle(report_headers(rows), "headers")
    lines = settle(journal_entries_to_lines(entries, accounts, headers, zone)
                   .unionByName(general_ledger_to_lines(rows, accounts, zone)), "pulled")
    return to_ledger(lines), pull_statistics(accounts, entries, rows, headers, lines)


def pull_statistics(accounts: DataFrame, entries: DataFrame, rows: DataFrame, headers: DataFrame, lines: DataFrame) -> DataFrame:
    """What a pull found and what it set aside, as one row of counters and a map of unmapped types."""
    posted = lines.filter(F.col("set_aside").isNull())
    je = F.col("token") == "JournalEntry"
    per_line = lines.agg(
        F.count_if(F.col("set_aside") == "description only").alias("description_only_lines"),
        F.count_if(F.col("set_aside") == "other detail").alias("other_detail_lines"),
        F.count_if(F.col("set_aside") == "zero amount").alias("zero_amount_lines"),
        F.count_if(F.col("set_aside").isNull() & F.col("unknown_account")).alias("unknown_account_lines"))
    entry = lines.groupBy("token", "txn_id").agg(
        F.count_if(F.col("set_aside").isNull()).alias("posted"), F.max("adjusting").alias("adjusting"),
        F.max("stamp_kind").alias("kind"), F.max("stamp_utc").alias("utc"), F.max("created_by").alias("user"))
    kept = F.col("posted") > 0
    per_entry = entry.agg(
        F.count_if(kept & je).alias("journal_entries"), F.count_if(kept & je & F.col("adjusting")).alias("adjusting_entries"),
        F.count_if(kept & ~je).alias("other_transactions"), F.count_if(~kept).alias("zero_transactions"),
        F.count_if(kept & (F.col("kind") != "time")).alias("estimated_entered_at"),
        F.count_if(kept & F.col("kind").startswith("unreadable")).alias("unreadable_entered_at"),
        F.count_if(kept & (F.col("user") == UNKNOWN_USER)).alias("unknown_users"),
        F.count_if(kept & F.col("utc")).alias("utc_times_without_zone"))
    unmapped = entry.filter(kept & ~je & ~is_mapped(F.col("token"))).groupBy("token").agg(F.count("*").alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "n")))).alias("unmapped_types"))
    listed = accounts.agg(F.count("*").alias("accounts"), F.count_if(~F.col("active")).alias("inactive_accounts"),
                          F.count_if("sub_account").alias("sub_accounts"))
    loose = rows.agg(F.count_if(F.col("txn_id").isNull()).alias("rows_without_txn_id"))
    uneven = entry_facts(derive(posted.select(*EXPORT_COLUMNS))).agg(
        F.count_if(F.abs("imbalance_cents").cast("decimal(20,2)") > F.lit(Decimal("0.5"))).alias("unbalanced_entries"))
    asked = entries.select(F.col("Id").alias("txn_id"), F.lit(1).alias("q")).distinct()
    told = headers.filter(je).select("txn_id", F.lit(1).alias("h")).distinct()
    match = asked.join(told, "txn_id", "full_outer").agg(
        F.count_if(F.col("h").isNull()).alias("je_ids_missing_from_report"),
        F.count_if(F.col("q").isNull()).alias("je_ids_missing_from_query"))
    return beside(listed, per_line, per_entry, loose, uneven, match, unmapped)
