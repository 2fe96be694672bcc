"""Quotation linking for message threads, in DataFrame operations only.

Lines that begin with marks of quotation (">") are parsed to their level; runs of lines of one level
are passages. A passage's words, in lower case and with single spaces, are hashed, and so are the
paragraphs and lines that each message says itself; a quoted passage is joined to the latest
earlier message of its conversation that said it, else to the one that said most of it by lines and
paragraphs. A message replies to the message that its
outermost quotation came from, without one to the message before it. What remains is written
without quotations, thread by thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.plans.staging import settle

MARK = r"^[\x20\t]*(?:>[\x20\t]?)+"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, ``_row``, ``said`` (the text without quoted lines) and ``passages``: an array of
    (level, body) of the runs of lines of one level above 0, in their order. Blank lines end no run
    of the level around them and are in none of another."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")
    rows = messages.select(F.monotonically_increasing_id().alias("_row"), "conv_id", F.col("turn").cast("long").alias("turn"), "role", lines.alias("_lines"))
    quoted = F.exists("_lines", lambda x: x.rlike(MARK))
    marks = F.transform("_lines", lambda x: F.struct(
        (F.length(F.regexp_extract(x, MARK, 0)) - F.length(F.replace(F.regexp_extract(x, MARK, 0), F.lit(">"), F.lit("")))).alias("level"),
        F.regexp_replace(x, MARK, "").alias("body")))
    rows = rows.withColumn("_lines", F.when(quoted, marks).otherwise(F.transform("_lines", lambda x: F.struct(F.lit(0).alias("level"), x.alias("body")))))
    said = F.array_join(F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    runs = F.expr(
        "CASE WHEN NOT exists(_lines, x -> x.level > 0) THEN CAST(array() AS array<struct<level:int,body:string>>) ELSE "
        "filter(aggregate(_lines, CAST(array() AS array<struct<level:int,body:string>>), (a, x) -> CASE "
        "WHEN size(a) > 0 AND element_at(a, -1).level = x.level THEN array_append(slice(a, 1, size(a) - 1), "
        "named_struct('level', x.level, 'body', concat(element_at(a, -1).body, '\\n', x.body))) "
        "ELSE array_append(a, named_struct('level', x.level, 'body', x.body)) END), x -> x.level > 0 AND trim(x.body) <> '') END")
    return rows.select("_row", "conv_id", "turn", "role", F.regexp_replace(F.trim(said), r"^\s+|\s+$", "").alias("said"), runs.alias("passages"))


def _hash(body: Column) -> Column:
    return F.xxhash64(_normal(body), F.lit(0))


def links(rows: DataFrame) -> DataFrame:
    """``_row``, ``nth``, ``level`` and ``source`` (a turn, null where nobody said it) of every passage of
    ``rows`` (:func:`parsed`). Only what some passage asks for is kept of the messages; equal
    phrases of a conversation are reduced to one row per turn before they meet."""
    asked = rows.where(F.size("passages") > 0).select("_row", "conv_id", "turn", F.posexplode("passages").alias("nth", "p"))
    asked = settle(asked.select("_row", "conv_id", "turn", "nth", "p.level", _hash(F.col("p.body")).alias("said_hash")), "passages")
    wanted = asked.select("conv_id", "said_hash").distinct()
    units = F.array_distinct(F.flatten(F.array(F.array("said"), F.split("said", r"\n\s*\n"), F.split("said", "\n"))))
    talks = rows.join(asked.select("conv_id").distinct(), "conv_id", "left_semi")
    told = talks.select("conv_id", "turn", F.explode(units).alias("unit")).where(F.trim("unit") != "")
    told = told.select("conv_id", "turn", _hash(F.col("unit")).alias("said_hash")).distinct().join(wanted, ["conv_id", "said_hash"], "left_semi")
    earlier = told.withColumnRenamed("turn", "source")
    # the latest saying before a turn: both kinds of rows in one order of turns, partitioned by phrase
    both = asked.select("conv_id", "said_hash", "turn", F.lit(1).alias("asks"), "_row", "nth", "level").unionByName(
        earlier.select("conv_id", "said_hash", F.col("source").alias("turn"), F.lit(0).alias("asks")), allowMissingColumns=True)
    before = Window.partitionBy("conv_id", "said_hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.when(F.col("asks") == 0, F.col("turn"))).over(before)
    whole = settle(both.withColumn("source", latest).where("asks = 1").select("_row", "nth", "level", "source"), "whole")
    return whole.join(_in_parts(rows, whole), ["_row", "nth"], "left").select("_row", "nth", "level", F.coalesce("source", "part").alias("source"))


def _in_parts(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """``_row``, ``nth`` and ``part`` of the passages that nobody said as one piece: the earlier turn that said
    most of the passage's words, and more than half of them, the latest of equals. A line counts as
    said where it stands as a line, or the passage's paragraph around it as a paragraph."""
    left = whole.where("source IS NULL").select("_row", "nth")
    body = rows.where(F.size("passages") > 0).select("_row", "conv_id", "turn", F.posexplode("passages").alias("nth", "p")).join(left, ["_row", "nth"])
    parts = body.select("_row", "nth", "conv_id", "turn", F.posexplode(F.split("p.body", r"\n\s*\n")).alias("block", "paragraph"))
    lines = parts.select("*", F.posexplode(F.split("paragraph", "\n")).alias("line", "body")).where(F.trim(_normal(F.col("body"))) != "")
    lines = settle(lines.select("_row", "nth", "conv_id", "turn", "block", "line", F.size(F.split(_normal(F.col("body")), " ")).alias("words"),
                                F.array_distinct(F.array(_hash(F.col("body")), _hash(F.col("paragraph")))).alias("hashes")), "lines")
    asked = lines.select("_row", "nth", "conv_id", "turn", "block", "line", "words", F.explode("hashes").alias("said_hash"))
    units = F.array_distinct(F.flatten(F.array(F.split("said", r"\n\s*\n"), F.split("said", "\n"))))
    told = rows.join(lines.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", F.col("turn").alias("part"), F.explode(units).alias("unit"))
    told = told.where(F.trim("unit") != "").select("conv_id", "part", _hash(F.col("unit")).alias("said_hash")).distinct()
    met = asked.join(told, ["conv_id", "said_hash"]).where("part < turn").select("_row", "nth", "block", "line", "words", "part").distinct()
    held = met.groupBy("_row", "nth", "part").agg(F.sum("words").alias("held"))
    best = held.groupBy("_row", "nth").agg(F.max(F.struct("held", "part")).alias("m"))
    total = lines.groupBy("_row", "nth").agg(F.sum("words").alias("total"))
    return best.join(total, ["_row", "nth"]).where("2 * m.held > total").select("_row", "nth", F.col("m.part").alias("part"))


def threads(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``_row``, ``reply_to`` (a turn), ``thread`` (the turn it goes back to) and ``depth``. The way to the
    first message is halved each round by the ancestor's ancestor; messages that arrived rest."""
    outer = found.where("source IS NOT NULL").groupBy("_row").agg(F.min(F.struct("level", "nth", "source")).alias("m")).select("_row", F.col("m.source").alias("source"))
    spoken = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("turn")
    chain = spoken.select("conv_id", "turn", F.lag("turn").over(before).alias("previous"))
    quoting = rows.join(outer, "_row").groupBy("conv_id", "turn").agg(F.min("source").alias("source"))
    step = chain.join(quoting, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("source", "previous").alias("reply_to"), F.col("source").isNotNull().alias("quotes"))
    # turns that reply by their place alone hang on the chain up to the last quoting turn: one step for all of them
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    step = step.withColumn("_stop", F.max(F.when(F.col("quotes") | F.col("reply_to").isNull(), F.col("turn"))).over(order))
    step = step.withColumn("_nth", F.row_number().over(before))
    heads = step.where("turn = _stop").select("conv_id", F.col("turn").alias("_stop"), F.col("_nth").alias("_first"), F.col("reply_to").alias("_up"))
    step = settle(step.join(heads, ["conv_id", "_stop"]).select("conv_id", "turn", "reply_to", "_stop", "_up", (F.col("_nth") - F.col("_first")).cast("long").alias("_steps")), "turns")
    up = settle(step.select("conv_id", "turn", F.coalesce("_up", "_stop").alias("at"), (F.col("_steps") + F.col("_up").isNotNull().cast("long")).alias("depth"),
                            F.col("_up").isNull().alias("done")), "ancestors")
    while True:
        open_rows = up.where("NOT done")
        if open_rows.isEmpty():
            break
        there = up.select("conv_id", F.col("turn").alias("at"), F.col("at").alias("_at"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        moved = open_rows.join(there, ["conv_id", "at"]).select("conv_id", "turn", F.col("_at").alias("at"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        up = settle(up.where("done").unionByName(moved), "ancestors")
    return step.select("conv_id", "turn", "reply_to").join(up.select("conv_id", "turn", F.col("at").alias("thread"), "depth"), ["conv_id", "turn"])


def conversations(messages: DataFrame) -> DataFrame:
    """One row per row of ``messages`` (conv_id, turn, role, text; others are let be), in the order of
    conversation, thread, depth and turn: conv_id, thread, depth, turn, reply_to, role, said (without
    quotations), formatted, n_passages, n_linked and sources (turns quoted, in order of passage).

    A null text says nothing. Repeated turns share their place. Messages without conv_id or turn
    belong to no thread: thread, depth and reply_to are null. An empty table gives an empty one.
    """
    rows = settle(parsed(messages), "messages")
    whole = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    found = settle(links(whole), "links")
    counts = found.groupBy("_row").agg(F.sum(F.col("source").isNotNull().cast("long")).alias("n_linked"), F.sort_array(F.collect_list(F.struct("nth", "source"))).alias("_s"))
    placed = threads(whole, found)
    out = rows.join(placed, ["conv_id", "turn"], "left").join(counts, "_row", "left")
    sources = F.coalesce(F.transform("_s", lambda x: x["source"]), F.array().cast("array<bigint>"))
    out = out.select("conv_id", "thread", "depth", "turn", "reply_to", "role", "said", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "said", F.lit("\n")).alias("formatted"),
                     F.size("passages").cast("long").alias("n_passages"), F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), F.array_join(sources, ",", "-").alias("sources"))
    return out.repartitionByRange("conv_id", "thread", "depth", "turn").sortWithinPartitions("conv_id", "thread", "depth", "turn")
