from __future__ import annotations

import random
import statistics
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyspark import catalog
from tallyspark.plans import staging


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", rng.randrange(1, 5000), f"id{i:05d}") for i in range(4000)]
    return rows, spark.createDataFrame(rows, "k string, v bigint, id string").repartition(6)


def test_middle_values_is_the_exact_median(skewed):
    rows, df = skewed
    counts = df.groupBy("k", "v").agg(F.count("*").alias("w"))
    got = staging.middle_values(counts, ["k"], "v", "w", F.floor(F.log2(F.col("v").cast("double")) * 4)).collect()
    want = {}
    for k, v, _ in rows:
        want.setdefault(k, []).append(v)
    assert {r["k"]: (r["n"], (r["low"] + r["high"]) / 2) for r in got} == {k: (len(v), statistics.median(v)) for k, v in want.items()}


def test_nth_largest_counts_repeats(spark):
    rng = random.Random(5)
    values = [rng.random() for _ in range(3000)] + [0.75] * 900 + [0.75 + 1e-12, 1.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(values, reverse=True)
    for n in (1, 2, 700, 1200, len(values)):
        assert staging.nth_largest(df, "x", n) == ordered[n - 1]


def test_running_total_and_numbers_match_a_sequential_walk(skewed):
    rows, df = skewed
    got = {r["id"]: int(r["before"]) for r in staging.running_total(df, ["v", "id"], "v").collect()}
    total, want = 0, {}
    for k, v, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i], total = total, total + v
    assert got == want
    numbered = {r["id"]: r["n"] for r in staging.numbered(df, ["id"], "n", 10).collect()}
    assert numbered == {i: n + 10 for n, (_, _, i) in enumerate(sorted(rows, key=lambda r: r[2]))}
    within = {r["id"]: r["n"] for r in staging.numbered_within(df, ["k"], ["id"], "n").collect()}
    places = {}
    for k, _, i in sorted(rows, key=lambda r: r[2]):
        places.setdefault(k, []).append(i)
    assert within == {i: n + 1 for ids in places.values() for n, i in enumerate(ids)}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach_gives_the_same_rows_broadcast_and_spread(spark, skewed, how):
    _, df = skewed
    df = df.withColumn("k", F.when(F.col("k") != "k1", F.col("k")))  # a null key matches a null key
    lookup = spark.createDataFrame([("hot", 1), ("k2", 2), (None, 3)], "k string, x int")
    small = staging.attach(df, lookup, ["k"], how, spread="id", small=True)
    spread = staging.attach(df, lookup, ["k"], how, spread="id", small=False)
    assert sorted(map(tuple, small.select("id", "k", "x").collect()), key=str) == sorted(map(tuple, spread.select("id", "k", "x").collect()), key=str)


def test_fits_measures_text(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 10, "t string")
    assert staging.fits(df, 20_000) and not staging.fits(df, 10_000)


def test_smallest_per_group_with_limits_of_its_own(spark, skewed):
    rows, df = skewed
    limited = df.withColumn("lim", F.when(F.col("k") == "hot", 7).otherwise(2))
    got = {}
    for r in staging.smallest_per_group(limited, "k", ["v", "id"], "lim", spread="id").collect():
        got.setdefault(r["k"], set()).add(r["id"])
    want = {}
    for k, v, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if len(want.setdefault(k, [])) < (7 if k == "hot" else 2):
            want[k].append(i)
    assert got == {k: set(v) for k, v in want.items()}


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(Session())


def test_a_settled_stage_leaves_no_shuffle_and_can_be_discarded(spark):
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    stage = staging.settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "freed")
    assert tracker.shuffleStatuses().size() <= before
    assert stage.count() == 7
    folder = Path(stage.inputFiles()[0].removeprefix("file://")).parent
    given = spark.read.parquet("/root/testdata/sf0.001/region.parquet")
    staging.discard(stage, given)
    assert not folder.exists() and given.count() == 5


def test_fits_measures_what_nested_columns_hold(spark):
    df = spark.createDataFrame([(("x" * 1000, ["y" * 1000]),)] * 10, "s struct<t: string, a: array<string>>")
    assert staging.fits(df, 30_000) and not staging.fits(df, 20_000)


def test_only_hot_keys_of_a_large_lookup_are_repeated(spark, skewed):
    _, df = skewed
    lookup = df.select("k").distinct().withColumn("x", F.length("k"))
    even = spark.range(4000).select(F.concat(F.lit("id"), "id").alias("id"), F.concat(F.lit("k"), F.col("id") % 1000).alias("k"))
    assert staging.hot_keys(df, ["k"]) and not staging.hot_keys(even, ["k"])
    for rows, repeated in ((df, True), (even, False)):
        plan = staging.attach(rows, lookup, ["k"], spread="id", small=False)._jdf.queryExecution().toString()
        assert ("explode" in plan) == repeated and "BroadcastHashJoin" not in plan


def test_numbers_within_groups_send_no_table_through_the_driver(spark):
    """One row per slice is broadcast, whatever the number of groups; a group may lie in several slices."""
    df = spark.range(6000).select(F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    numbered = staging.numbered_within(df, ["k"], ["id"], "n")
    rows = numbered.collect()
    places = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        places.setdefault(r["k"], []).append(r["n"])
    assert len(rows) == 6000 and all(p == list(range(1, len(p) + 1)) for p in places.values())
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ahead-") and "SortMergeJoin" not in plan and plan.count("HashAggregate") == 0


def test_wide_stages_are_written_in_short_methods(spark, monkeypatch):
    limit, seen = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(limit)

    class Writer(type(spark.range(1).write)):
        def parquet(self, *args, **kwargs):
            seen.append(spark.conf.get(limit))
            super().parquet(*args, **kwargs)

    monkeypatch.setattr(type(spark.range(1)), "write", property(Writer))
    assert staging.settle(spark.range(5), "t", wide=True).count() == staging.settle(spark.range(5), "t").count() == 5
    assert seen == ["8000", before] and spark.conf.get(limit) == before


def groups_of(path):
    """Bytes of every row group of a stage's files, as a reader holds them."""
    files = [pq.ParquetFile(f).metadata for f in Path(path.removeprefix("file:")).glob("*.parquet")]
    return [m.row_group(g).total_byte_size for m in files for g in range(m.num_row_groups)]


def test_what_a_task_holds_of_long_rows_does_not_grow_with_them(spark):
    texts = spark.range(0, 300, 1, 1).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 1000).alias("text"))
    with staging.watched() as paths:
        kept = staging.settle(texts, "texts", long=True)
    assert len(groups_of(paths[0])) > 10 and max(groups_of(paths[0])) < 2 * (1 << 20)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    with staging.small_batches(spark):
        seen = [r["n"] for r in kept.coalesce(1).mapInArrow(sizes, "n long").collect()]
    assert len(seen) > 3 and max(seen) < 2 * staging.BATCH_BYTES
    assert kept.where("length(text) = 64000").count() == kept.select("text").distinct().count() == 300


def test_sanitized_reports_are_staged_as_long_rows(spark):
    with staging.watched() as paths:
        rows = catalog.queries()["l03_sanitized_reports"](spark, "/root/testdata/sf0.01")
    assert rows.agg(F.sum("n_rows")).first()[0] > 29_000
    for name in ("reports-", "clean-"):
        sizes = [s for p in paths if f"/{name}" in p for s in groups_of(p)]
        assert sum(sizes) > 5_000_000 and max(sizes) < 1.2 * (1 << 20)
