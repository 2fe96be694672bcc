"""CSV files read by byte ranges, with line breaks inside cells, and the number of every data row.

Files are read as physical lines, range by range. A line lies inside a quoted cell where the quotes ahead of it in its file
are odd in number; a range alone cannot know that, so each line is staged with the parity and the records counted from its range's
start, for both ways the range can begin. A table of one row per range then gives each range its beginning and the number of its
first row. Lines that are whole records, nearly all, are read where they stand; only the lines of records that run over several are
brought together. No task reads a whole file, and nothing depends on which range a task was given.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.plans.staging import attach, discard, setting, settle
from tallyspark.schema import LedgerError

#: The number of a data row over all files in order of their paths, from 1; headers and blank lines are not counted.
ROW = "row_no"
#: Of ranges smaller than this, a task reads several.
TASK_BYTES = 32 * 1024 * 1024
_LINES = "file string, start long, line string, i long, odd boolean, odd_after boolean, ends long, ends_odd long, blank boolean"


def physical_lines(spark: SparkSession, path: str, per_task: int = 1) -> DataFrame:
    """Every line of the files: its file and range (the place it begins), its number ``i`` in the range; whether the quotes of
    the range ahead of it, and with it, are odd; and the records that end in the range ahead of it, if the range begins outside a cell
    (``ends``) or inside one (``ends_odd``). Blank lines outside cells are no records. A task reads ``per_task`` ranges one after another,
    so that small ranges of a large input are not as many tasks."""
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    if per_task > 1:
        count = read.rdd.getNumPartitions()
        tasks = max(-(-count // per_task), min(count, 2 * spark.sparkContext.defaultParallelism))
        read = read.coalesce(tasks) if tasks < count else read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, i, parity, ends, ends_odd = None, 0, 0, 0, 0
        for batch in batches:
            files, starts = (batch.column(c).dictionary_encode() for c in ("file", "start"))
            key = files.indices.to_numpy().astype(np.int64) << 32 | starts.indices.to_numpy()
            quotes = pc.count_substring(batch.column("line"), '"').to_numpy()
            blank = pc.equal(pc.utf8_trim_whitespace(batch.column("line")), "").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for first, last in zip(edges, edges[1:], strict=False):
                part = batch.slice(first, last - first)
                here = (part.column("file")[0].as_py(), part.column("start")[0].as_py())
                if here != now:
                    now, i, parity, ends, ends_odd = here, 0, 0, 0, 0
                after = (parity + np.cumsum(quotes[first:last])) % 2
                before = np.append(parity, after[:-1])
                empty = blank[first:last]
                even, odd = (after == 0) & ~(empty & (before == 0)), (after == 1) & ~(empty & (before == 1))
                counts = [n + np.append(0, np.cumsum(hit)) for n, hit in ((ends, even), (ends_odd, odd))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(i + np.arange(last - first)), pa.array(before == 1), pa.array(after == 1),
                     *[pa.array(c[:-1]) for c in counts], pa.array(empty)],
                    names=["file", "start", "line", "i", "odd", "odd_after", "ends", "ends_odd", "blank"])
                i, parity, ends, ends_odd = i + last - first, int(after[-1]), int(counts[0][-1]), int(counts[1][-1])

    return read.mapInArrow(run, _LINES)


def ranges(lines: DataFrame) -> DataFrame:
    """One settled row per range: whether it begins inside a cell (``inside``), the records of its file ahead of it (``ahead``)
    and the data rows of all files ahead of its file (``offset``). A file that ends inside a cell is refused."""
    last = F.struct("i", "odd_after", "ends", "ends_odd", (~F.col("odd_after") & ~(F.col("blank") & ~F.col("odd"))).cast("long").alias("one"),
                    (F.col("odd_after") & ~(F.col("blank") & F.col("odd"))).cast("long").alias("one_odd"))
    each = lines.groupBy("file", "start").agg(F.max(last).alias("l")).select(
        "file", "start", F.col("l.odd_after").cast("int").alias("odd"), (F.col("l.ends") + F.col("l.one")).alias("ends"), (F.col("l.ends_odd") + F.col("l.one_odd")).alias("ends_odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    each = each.withColumn("records", F.when(F.col("inside"), F.col("ends_odd")).otherwise(F.col("ends")))
    each = settle(each.withColumn("ahead", F.coalesce(F.sum("records").over(before), F.lit(0))), "ranges")
    files = each.groupBy("file").agg((F.sum("odd") % 2 == 1).alias("open"), F.greatest(F.sum("records") - 1, F.lit(0)).alias("rows"))
    cut = files.where("open").agg(F.min("file")).first()[0]
    if cut is not None:
        raise LedgerError(f"{cut} ends inside a quoted cell")
    # one row per file
    offset = F.coalesce(F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return settle(each.join(files.select("file", offset.alias("offset")), "file").select("file", "start", "inside", "ahead", "offset"), "ranges")


def records(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """``file``, ``at`` (the record's number in its file, the header's 0), ``offset`` and ``record`` of every record."""
    placed = attach(lines, starts, ["file", "start"], "inner", spread="i")
    placed = placed.select("file", "start", "i", "line", "offset", (F.col("odd") != F.col("inside")).alias("in"), (F.col("odd_after") != F.col("inside")).alias("in_after"),
                           "blank", (F.col("ahead") + F.when(F.col("inside"), F.col("ends_odd")).otherwise(F.col("ends"))).alias("at"))
    alone = ~F.col("in") & ~F.col("in_after")
    single = placed.where(alone & ~F.col("blank")).select("file", "at", "offset", F.col("line").alias("record"))
    pieces = F.array_sort(F.collect_list(F.struct("start", "i", "line")))
    joined = placed.where(~alone).groupBy("file", "at").agg(F.min("offset").alias("offset"), F.array_join(F.transform(pieces, lambda p: p["line"]), "\n").alias("record"))
    return single.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))


def _names(header: str) -> list[str]:
    names = next(csv.reader([header.removeprefix("﻿")]))
    return [n if names.count(n) == 1 else f"{n}{i}" for i, n in enumerate(names)]


def read(spark: SparkSession, path: str, range_bytes: int | None = None) -> tuple[DataFrame, Callable[[int], str]]:
    """The data rows of the files under ``path``, settled: every cell as text, an empty field null, and the row's number; and a
    function that says where a row of some number is. Ranges are of ``range_bytes`` at most, by default the session's. Records end at a line feed, with or without a carriage return; every
    file's header must be the first one's, a row must have as many cells, and files without a line have no rows."""
    with setting(spark, spark__sql__files__maxPartitionBytes=range_bytes and str(range_bytes), spark__sql__files__openCostInBytes=range_bytes and "1"):
        lines = settle(physical_lines(spark, path, max(1, TASK_BYTES // range_bytes) if range_bytes else 1), "lines")
    starts = ranges(lines)
    every = records(lines, starts)
    heads = settle(every.where("at = 0").select("file", "record"), "headers")  # one row per file
    first = heads.agg(F.min_by("record", "file").alias("header"), F.min("file").alias("file"), F.count("*").alias("files")).first()
    if not first["files"]:
        raise LedgerError(f"{path} holds no header")
    other = heads.where(F.col("record") != first["header"]).agg(F.min("file")).first()[0]
    if other is not None:
        raise LedgerError(f"the header of {other} is not that of {first['file']}")
    names = _names(first["header"])
    cells = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    how = {"nullValue": "", "emptyValue": "", "quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST"}
    rows = every.where("at > 0").select(F.from_csv("record", F.lit(cells), how).alias("c"), (F.col("offset") + F.col("at")).alias("n"))
    read_rows = settle(rows.select(*[F.col("c").getField(n).alias(n) for n in names], *([] if ROW in names else [F.col("n").alias(ROW)])), "cells", wide=True)
    discard(lines, heads)

    def place(row: int) -> str:
        at = starts.where(F.col("offset") < row).agg(F.max(F.struct("offset", "file")).alias("f")).first()["f"]
        name = "" if first["files"] == 1 or at is None else f" of {at['file'].rpartition('/')[2]}"
        return f"data row {row - (at['offset'] if at else 0)}{name}"

    return read_rows, place
