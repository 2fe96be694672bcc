"""The model tier: a distributed isolation forest (Liu, Ting and Zhou, 2008) and its scores.

Trees see small hashed samples, are built in parallel (one task per tree) and are small enough
to broadcast; scoring is one pass over the features. Splits do not depend on a feature's scale,
so features are not standardised first.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.features import FEATURE_COLUMNS, build_features, kept_features
from tallyspark.plans.staging import nth_largest, settle

# the helpers below travel with the tasks, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The forest's size, seed and the share of entries flagged by rank.
TREES = 300
SAMPLE = 256
SEED = 20260922
CONTAMINATION = 0.02
TOP_SHARE = 0.02
# End of fixed values.

_NODES = "tree_id int, node int, feature int, threshold double, below int, above int, size int, depth int"


@dataclass
class Forest:
    columns: list[str]
    sample: int
    nodes: dict[str, np.ndarray]
    n_entries: int

    @property
    def dropped(self) -> list[str]:
        return [c for c in FEATURE_COLUMNS if c not in self.columns]


def draw_samples(features: DataFrame, n: int, trees: int, sample: int, seed: int) -> DataFrame:
    """Give each tree ``sample`` distinct entries: the entries are put in an order by hash, which
    is cut into one run per tree, and re-ordered for another round when one does not reach.

    Only about trees x sample rows are ever ranked, whatever the ledger holds, and the draw
    depends on ids and seed alone, not on partitions.
    """
    per_round = n // sample
    rounds = math.ceil(trees / per_round)
    needed = trees * sample
    tagged = (features.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
              .withColumn("_draw", F.xxhash64(F.lit(seed), "_round", "entry_id")))
    if rounds == 1 and n > 2 * needed:
        share = 1.1 * needed / n
        while True:  # a hash cut that holds the rows needed; 1.1 is enough but for bad luck
            bound = int(-(2 ** 63) + share * 2 ** 64)
            cut = tagged.filter(F.col("_draw") < F.lit(min(bound, 2 ** 63 - 1)))
            if share >= 1 or cut.count() >= needed:
                tagged = cut
                break
            share *= 2
    rank = F.row_number().over(Window.partitionBy("_round").orderBy("_draw", "entry_id")) - 1
    ranked = tagged.withColumn("_run", F.floor(rank / sample).cast("int"))
    ranked = ranked.filter(F.col("_run") < per_round)
    return (ranked.withColumn("tree_id", (F.col("_round") * per_round + F.col("_run")).cast("int"))
            .filter(F.col("tree_id") < trees).drop("_round", "_draw", "_run"))


def _grow(values: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes: list[list] = []
    stack = [(np.arange(len(values)), 0, -1, 0)]
    while stack:
        rows, depth, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(rows), depth])
        if parent >= 0:
            nodes[parent][3 + side] = me
        if depth >= limit or len(rows) <= 1:
            continue
        part = values[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if not len(open_):
            continue
        feature = int(rng.choice(open_))
        cut = float(rng.uniform(low[feature], high[feature]))
        under = part[:, feature] <= cut
        if under.all():
            cut, under = float(low[feature]), part[:, feature] <= low[feature]
        nodes[me][1], nodes[me][2] = feature, cut
        stack.append((rows[~under], depth + 1, me, 1))
        stack.append((rows[under], depth + 1, me, 0))
    return [tuple(n) for n in nodes]


def fit_forest(features: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    n, columns = kept_features(features)
    size = min(sample, n)
    picked = draw_samples(features.select("entry_id", *columns), n, trees, size, seed)
    limit = math.ceil(math.log2(max(size, 2)))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree_id"].iloc[0])
        values = group.sort_values("entry_id")[columns].to_numpy(dtype=float)
        grown = _grow(values, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(grown, columns=["node", "feature", "threshold", "below", "above", "size", "depth"])
        out.insert(0, "tree_id", tree)
        return out

    # at most trees x (2 x sample - 1) node rows reach the driver
    grown = picked.groupBy("tree_id").applyInPandas(build, _NODES).toPandas().sort_values(["tree_id", "node"])
    offsets = grown.groupby("tree_id")["node"].size().cumsum().shift(fill_value=0)
    base = grown["tree_id"].map(offsets).to_numpy()
    leaf = grown["feature"].to_numpy() < 0
    nodes = {
        "feature": grown["feature"].clip(lower=0).to_numpy(np.int32),
        "threshold": grown["threshold"].to_numpy(float),
        "below": np.where(leaf, base + grown["node"], base + grown["below"]).astype(np.int32),
        "above": np.where(leaf, base + grown["node"], base + grown["above"]).astype(np.int32),
        "length": (grown["depth"] + grown["size"].map(_average_path)).to_numpy(float),
        "roots": offsets.to_numpy(np.int32),
        "levels": np.int32(grown["depth"].max()),
    }
    return Forest(columns, size, nodes, n)


def _average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a tree of ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def raw_scores(features: DataFrame, forest: Forest) -> DataFrame:
    """``entry_id, raw``: 2^(-mean depth / expected depth) for every entry, in Arrow batches."""
    shared = features.sparkSession.sparkContext.broadcast(forest.nodes)
    columns, expected = list(forest.columns), max(_average_path(forest.sample), 1e-12)
    cores = features.sparkSession.sparkContext.defaultParallelism
    if features.rdd.getNumPartitions() < cores:  # a few small files: let every core score
        features = features.repartition(cores)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes = shared.value
        for batch in batches:
            values = batch[columns].to_numpy(dtype=float)
            rows = np.arange(len(values))[:, None]
            at = np.broadcast_to(nodes["roots"], (len(values), len(nodes["roots"])))
            for _ in range(int(nodes["levels"])):
                under = values[rows, nodes["feature"][at]] <= nodes["threshold"][at]
                at = np.where(under, nodes["below"][at], nodes["above"][at])
            depth = nodes["length"][at].mean(axis=1)
            yield pd.DataFrame({"entry_id": batch["entry_id"], "raw": 2.0 ** (-depth / expected)})

    return features.select("entry_id", *columns).mapInPandas(score, "entry_id string, raw double")


def model_scores(features: DataFrame, forest: Forest) -> DataFrame:
    """``entry_id, model_score`` in [0, 1], higher is stranger, rescaled by the extremes."""
    raw = settle(raw_scores(features, forest), "raw")
    ends = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).first()
    if ends["lo"] is None or not ends["hi"] > ends["lo"]:
        return raw.select("entry_id", F.lit(0.0).alias("model_score"))
    return raw.select("entry_id", ((F.col("raw") - ends["lo"]) / (ends["hi"] - ends["lo"])).alias("model_score"))


def score_ledger(lines: DataFrame, entries: DataFrame | None = None,
                 stats: DataFrame | None = None) -> tuple[DataFrame, Forest]:
    features = settle(build_features(lines, entries, stats), "features")
    forest = fit_forest(features)
    return model_scores(features, forest), forest


def fit_report(features: DataFrame, forest: Forest) -> DataFrame:
    """What the fit did: entries, features supplied and used, constants dropped."""
    return features.sparkSession.range(1).select(
        F.lit(forest.n_entries).cast("bigint").alias("n_entries"), F.lit(len(FEATURE_COLUMNS)).alias("n_features_in"),
        F.lit(len(forest.columns)).alias("n_features_used"), F.lit(", ".join(forest.dropped)).alias("dropped_constant"),
        F.lit(CONTAMINATION).alias("contamination"))


def budget_size(n: int, share: float = TOP_SHARE) -> int:
    return max(1, int(round(n * share)))


def combine(scored: DataFrame, scores: DataFrame, top_share: float = TOP_SHARE, ordered: bool = True) -> DataFrame:
    """Both tiers side by side. The model flag is by rank: the top share by score, ties at the
    cutoff included; ``agreement`` says how the two tiers relate."""
    joined = scored.join(scores.select("entry_id", "model_score"), "entry_id", "left").withColumn("model_score", F.coalesce("model_score", F.lit(0.0)))
    # only the scores are written; whoever reads the tiers joins the columns asked for, not every reason and header
    ranked = settle(joined.select("model_score"), "ranked")
    n = ranked.count()
    cutoff = nth_largest(ranked, "model_score", budget_size(n, top_share)) if n else 0.0
    out = joined.withColumns({"model_flag": F.col("model_score") >= cutoff, "rule_flag": F.col("risk_score") > 0})
    rule, model = F.col("rule_flag"), F.col("model_flag")
    out = out.withColumn("agreement", F.when(rule & model, "both").when(rule, "rules only")
                         .when(model, "model only").otherwise("neither"))
    return out.orderBy(F.desc("risk_score"), F.desc("model_score"), "entry_id") if ordered else out
