"""Plan-level helpers: staged tables, size-checked lookups, skew-safe ranks and running totals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A lookup is broadcast only when its measured size is at or below this many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024
#: How many ways a lookup too large to broadcast is spread, so that one hot key of the
#: other side is shared by this many tasks. AQE's skew join splits what is still large.
SPREAD = 16


def local_folder() -> str:
    """A folder for a local session's stages, gone when the process ends."""
    kept = tempfile.TemporaryDirectory(prefix="tallyspark-", ignore_cleanup_errors=True)
    _LOCAL.append(kept)
    return kept.name


_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the cluster names, never a local one there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = local_folder()
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tallyspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "stage", wide: bool = False, long: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back. ``wide``: many expressions are worked out on each row. ``long``: rows
    hold texts of any length; what a task holds of them, here and when they are read, does not grow with its rows.

    Cuts lineage (a lost executor re-reads files rather than redoing shuffles), lets several
    branches share one computation, and gives Catalyst real sizes, column pruning and pushdown.
    """
    path = new_path(df.sparkSession, name)
    for written in _WATCHED:
        written.append(path)
    with shuffles_freed(df.sparkSession), short_methods(df.sparkSession) if wide else nullcontext(), small_batches(df.sparkSession) if long else nullcontext():
        df.write.options(**(LONG_ROWS if long else {})).parquet(path)
    return df.sparkSession.read.schema(_nullable(df.schema)).parquet(path)


@contextmanager
def setting(spark: SparkSession, **values: str | None) -> Iterator[None]:
    """Session settings (dots as double underscores; None: as it is) for what is run inside."""
    named = {k.replace("__", "."): v for k, v in values.items() if v is not None}
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffles_freed(spark: SparkSession):
    """Shuffle files of what is written inside go when its write has ended: the stage is read from
    then on, so they would only fill the executors' disks until the driver collects its garbage."""
    return setting(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def short_methods(spark: SparkSession):
    """What is run inside is not compiled into one method a stage where that has more bytes than a JVM compiles to machine code
    (8,000): it would be interpreted for every row. Spark's own limit is 65,535."""
    return setting(spark, spark__sql__codegen__hugeMethodLimit="8000")


#: How files of long rows are laid out. A reader takes as much as 4,096 rows of a row group into one batch, and a writer looks at what it holds only
#: every 100 rows: row groups are ended after about 1 MB, looked at row by row, and before any page is compressed, so that the text itself counts.
LONG_ROWS = {"parquet.block.size": str(1 << 20), "parquet.page.size": str(1 << 21), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: How many bytes a Python worker is sent at once of long rows.
BATCH_BYTES = 4 * 1024 * 1024


def small_batches(spark: SparkSession):
    """What is run inside sends Python workers long rows in batches of about BATCH_BYTES."""
    return setting(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES))


def discard(*stages: DataFrame) -> None:
    """Delete the files of settled stages that nothing reads any more. Other files are let be."""
    for stage in stages:
        spark = stage.sparkSession
        own = f"/tallyspark/{spark.sparkContext.applicationId}/"
        for path in {f.rpartition("/")[0] for f in stage.inputFiles()}:
            if own in path:
                _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_WATCHED: list[list[str]] = []


@contextmanager
def watched() -> Iterator[list[str]]:
    """The paths of the stages that are settled inside, as they come."""
    paths: list[str] = []
    _WATCHED.append(paths)
    try:
        yield paths
    finally:
        _WATCHED[:] = [p for p in _WATCHED if p is not paths]


def discard_unread(spark: SparkSession, paths: list[str], reader: DataFrame) -> list[str]:
    """Delete stages by their paths, but for those that ``reader`` still reads: their paths are returned."""
    names = {f.rpartition("/")[0].rpartition("/")[2] for f in reader.inputFiles()}
    read = [p for p in paths if p.rpartition("/")[2] in names]
    for path in paths:
        if path not in read:
            _delete(spark, path)
    return read


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def unused(name: str, columns: Sequence[str]) -> str:
    """``name``, or with as many underscores as it takes to be no column's."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About what a value takes in a row in memory, nested ones by what they hold."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(value)), F.lit(0)) + 32
    return F.lit(8)


def fits(lookup: DataFrame, limit: int | None = None) -> bool:
    """Whether a (settled) lookup is small enough to broadcast: rows, with what a hash table adds to each, text and nested values are measured."""
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in lookup.schema.fields), F.lit(64))
    size = lookup.agg(F.coalesce(F.sum(row.cast("bigint")), F.lit(0)).alias("b")).first()["b"]
    return size <= (BROADCAST_BYTES if limit is None else limit)


def joined(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow: by shuffle, where Spark would take a table's size from its compressed files and send a
    large one through the driver."""
    return left.join(right.hint("merge"), on, how)


def hot_keys(rows: DataFrame, on: Sequence[str]) -> list[int]:
    """Hashes of the keys of a 256th of all rows and more (at most about 256; a few below that share may be among them), from one
    pass that keeps a bounded table of the most frequent."""
    top = F.expr(f"approx_top_k(xxhash64({', '.join(f'`{c}`' for c in on)}), 300, 4096)")
    found = rows.agg(top.alias("top"), F.count("*").alias("n")).first()
    return sorted(t["item"] for t in found["top"] or [] if 256 * t["count"] >= found["n"])


def attach(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left",
           spread: str = "entry_id", small: bool | None = None, keyed: DataFrame | None = None) -> DataFrame:
    """Join ``lookup`` (at most one row per key, settled) to ``facts`` on ``on``, nulls equal.

    A lookup measured small is broadcast and ``facts`` is not moved. With a larger one both are
    shuffled by key. Keys that hold many of the rows (counted in ``keyed``, a settled table with the
    keys of ``facts``, by default ``facts`` itself) are besides spread ``SPREAD`` ways by a hash of ``spread``,
    and only their rows of the lookup are repeated, so that a key holding a third of all rows is not one task's
    work. Same rows either way.
    """
    right = lookup.withColumnsRenamed({c: f"_r_{c}" for c in on})
    match = None
    for c in on:
        here = facts[c].eqNullSafe(right[f"_r_{c}"])
        match = here if match is None else match & here
    keys = [f"_r_{c}" for c in on]
    if small is None:
        small = fits(lookup)
    if small:
        return facts.join(F.broadcast(right), match, how).drop(*keys)
    kinds = dict(facts.dtypes)
    keyed = (facts if keyed is None else keyed).select(*[F.col(f"`{c}`").cast(kinds[c]) for c in on])
    hot = hot_keys(keyed, on)
    if not hot:
        return joined(facts, right, match, how).drop(*keys)
    left = facts.withColumn("_way", F.when(F.xxhash64(*on).isin(hot), F.pmod(F.xxhash64(spread), F.lit(SPREAD))).otherwise(F.lit(0)).cast("bigint"))
    held = F.xxhash64(*[F.col(f"_r_{c}").cast(kinds[c]) for c in on]).isin(hot)
    ways = F.when(held, F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    match = left["_way"] == F.col("_r_way")
    for c in on:
        match = match & left[c].eqNullSafe(F.col(f"_r_{c}"))
    right = right.withColumn("_r_way", F.explode(ways))
    return joined(left, right, match, how).drop("_way", "_r_way", *keys)


def beside(df: DataFrame, *figures: DataFrame) -> DataFrame:
    """``df`` with the columns of one-row tables beside every row, as scalar subqueries: each is
    worked out once and read as a constant, so nothing is joined."""
    for one in figures:
        whole = one.select(F.struct(*one.columns).alias("figures")).scalar()
        df = df.withColumn("_figures", whole).select(*df.columns, "_figures.*")
    return df


def middle_values(counts: DataFrame, keys: Sequence[str], value: str, weight: str,
                  bucket: Column) -> DataFrame:
    """Exact weighted median of ``value`` per key, as ``keys, n, low, high``.

    ``counts`` holds values with their counts (a value may stand on several rows); ``bucket`` is
    any non-decreasing function of ``value``. A histogram over the buckets, combined map-side,
    finds the one or two that hold each key's middle ranks; those (at most two rows per key) are
    looked up by the counts, which are not shuffled, and only the rows found are ordered.
    ``low`` and ``high`` are the values of the two middle ranks (equal for an odd count).
    """
    keys = list(keys)
    tagged = counts.withColumn("_bucket", bucket)
    hist = tagged.groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_in"))
    ordered = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    hist = (hist.withColumn("_before", F.coalesce(F.sum("_in").over(ordered), F.lit(0)))
            .withColumn("_n", F.sum("_in").over(Window.partitionBy(*keys)))
            .withColumn("_lo", F.expr("(_n - 1) div 2")).withColumn("_hi", F.expr("_n div 2"))
            .filter("(_lo >= _before AND _lo < _before + _in) OR (_hi >= _before AND _hi < _before + _in)")
            .select(*keys, "_bucket", "_before", "_n", "_lo", "_hi"))
    targets = settle(hist, "targets")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    near = (attach(tagged, targets, [*keys, "_bucket"], "inner", spread=value)
            .withColumn("_from", F.col("_before") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
            .withColumn("_to", F.col("_from") + F.col(weight)))
    return near.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        F.max(F.when(F.expr("_lo >= _from AND _lo < _to"), F.col(value))).alias("low"),
        F.max(F.when(F.expr("_hi >= _from AND _hi < _to"), F.col(value))).alias("high"))


def nth_largest(df: DataFrame, value: str, n: int) -> float:
    """The ``n``-th largest of a column of doubles in [0, 1], exactly, counting repeats.

    Two rounds of 65,536-bucket histograms narrow the place to a 2^-32 slice, and only the
    distinct values of that slice are ordered, so ``n`` may be millions.
    """
    steps = 65536
    level = F.floor(F.col(value) * steps)
    finer = F.floor((F.col(value) * steps - level) * steps)
    left, where = n, F.lit(True)
    for bucket in (level, finer):
        hist = df.filter(where).groupBy(bucket.alias("b")).agg(F.count("*").alias("c"))
        w = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
        hit = (hist.withColumn("above", F.coalesce(F.sum("c").over(w), F.lit(0)))
               .filter((F.col("above") < left) & (F.col("above") + F.col("c") >= left)).first())
        left -= hit["above"]
        where = where & (bucket == F.lit(hit["b"]))
    values = df.filter(where).groupBy(value).agg(F.count("*").alias("c"))
    w = Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    return (values.withColumn("above", F.coalesce(F.sum("c").over(w), F.lit(0)))
            .filter((F.col("above") < left) & (F.col("above") + F.col("c") >= left)).first()[value])


def running_total(df: DataFrame, order: Sequence[str], amount: str, name: str = "before") -> DataFrame:
    """Each row's total of ``amount`` over the rows ahead of it in ``order`` (a unique key).

    Rows are range-partitioned by the key and written with their slice number, so both passes
    see one layout; slice totals (one row per slice) give each slice its offset.
    """
    sliced = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_slice", F.spark_partition_id())
    laid = settle(sliced, "laid")
    totals = laid.groupBy("_slice").agg(F.sum(F.col(amount).cast("decimal(38,0)")).alias("_sum"))
    ahead = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_slice", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).cast("decimal(20,0)").alias("_offset"))
    inside = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(amount).over(inside), F.lit(0)).cast("decimal(20,0)")
    # one row per slice: never more than spark.sql.shuffle.partitions rows
    return (laid.join(F.broadcast(offsets), "_slice")
            .withColumn(name, (F.col("_offset") + within).cast("decimal(20,0)")).drop("_slice", "_offset"))


def numbered(df: DataFrame, order: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """Rows numbered from ``start`` in ``order`` (a unique key), without one task seeing them all."""
    counted = running_total(df.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", "_ahead")
    return counted.withColumn(name, (F.col("_ahead") + start).cast("bigint")).drop("_one", "_ahead")


def numbered_within(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rows numbered from 1 inside each group in ``order``; a group of any size is spread over the slices of a range partitioning.
    Only the first group of a slice can have rows in slices before it: their number is one row per slice."""
    keys, kinds = [f"_g_{g}" for g in group], dict(df.dtypes)
    sliced = df.repartitionByRange(*[F.col(c) for c in (*group, *order)]).withColumn("_slice", F.spark_partition_id())
    laid = settle(sliced, "laid")
    leads = laid.groupBy("_slice").agg(F.min(F.struct(*group)).alias("_lead"))
    leads = settle(leads.select(F.col("_slice").alias("_at"), *[F.col(f"_lead.{g}").cast(kinds[g]).alias(k) for g, k in zip(group, keys, strict=True)]), "leads")

    def same() -> Column:
        return reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys, strict=True)])

    # one row per slice: never more than spark.sql.shuffle.partitions rows
    shared = laid.select("_slice", *group).join(F.broadcast(leads.select(*keys).distinct()), same()).groupBy("_slice", *keys).agg(F.count("*").alias("_rows"))
    known = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys])
    ahead = leads.alias("l").join(F.broadcast(shared.alias("s")), known & (F.col("s._slice") < F.col("l._at"))).groupBy(
        "l._at").agg(F.sum("s._rows").alias("_ahead"))
    ahead = settle(leads.join(F.broadcast(ahead), "_at"), "ahead")
    inside = F.row_number().over(Window.partitionBy("_slice", *group).orderBy(*order))
    counted = laid.withColumn("_inside", inside)
    return (counted.join(F.broadcast(ahead), (F.col("_slice") == F.col("_at")) & same(), "left")
            .withColumn(name, (F.col("_inside") + F.coalesce("_ahead", F.lit(0))).cast("int"))
            .drop("_slice", "_at", "_inside", "_ahead", *keys))


def smallest_per_group(df: DataFrame, group: str, order: Sequence[str], limit: str,
                       spread: str = "entry_id") -> DataFrame:
    """The first ``limit`` (a column, constant per group) rows of each group in ``order``.

    Ranked first inside hashed parts of a group, so that a group holding most rows is shared
    by many tasks; only each part's leaders meet for the second ranking.
    """
    parts = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(SPREAD * 4)))
    first = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    leaders = parts.withColumn("_rank", first).filter(F.col("_rank") <= F.col(limit)).drop("_rank", "_part")
    final = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return leaders.withColumn("_rank", final).filter(F.col("_rank") <= F.col(limit)).drop("_rank")
