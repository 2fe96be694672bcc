"""Headline queries timed on the given tables; prints one JSON line.

The shared stages (lines, entries, flags, scores) are timed as entries of their own, each once;
then every query, reading them, is timed three times after a warm-up run and its median kept.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tallyspark.catalog import queries
from tallyspark.catalog.registry import Staged, staged
from tallyspark.session import local_session

HEADLINE = (
    "b08_derived_columns", "b10_ledger_digest", "c01_entry_level", "c05_account_median_mad", "d07_duplicate_entries",
    "d09_dormant_account", "d11_large_value_outlier", "d13_all_tests", "d14_scored_entries", "d16_threshold_sweep",
    "e02_benford_population", "e03_benford_by_account", "f01_features", "f07_model_scores", "f08_combined_tiers",
    "g02_confusion", "g04_attribution", "h04_monetary_unit_sample", "h05_stratified_sample", "i02_top_exceptions",
    "i05_population_summary", "j09_review_state", "k01_prompts", "k06_numbers_in_text", "l01_one_line",
)
STAGES = ("lines", "entries", "stats", "flags", "scored", "scores", "combined", "labels", "decisions", "features")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = local_session(cpus, shuffle_partitions=cpus)
    found = queries()
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):  # compile and load what the timed runs use
        for name in HEADLINE:
            run(found[name](spark, warm))
    times: dict[str, float] = {}
    shared: Staged = staged(spark, sf_dir)
    for stage in STAGES:
        start = time.perf_counter()
        getattr(shared, stage)
        times[f"stage_{stage}"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            run(found[name](spark, sf_dir))
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    entries = shared.entries.count()
    print(json.dumps({
        "metric": "total seconds, shared stages once and headline queries (median of 3)", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "entries": entries,
        "entries_per_sec_rules": round(entries / (times["d13_all_tests"] + times["d14_scored_entries"])),
        "entries_per_sec_forest": round(entries / times["f07_model_scores"])}))


if __name__ == "__main__":
    main()
