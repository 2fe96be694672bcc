"""Hard negatives for embeddings: exact window searches over Hilbert-ordered blocks with zone maps.

Rows are ordered by label and place on a Hilbert curve through the dimensions of most variance, and written
as blocks, one Parquet row each: a label's next BLOCK rows, with the least and the most of every dimension (the zone map) beside
them. Interval arithmetic bounds an anchor's inner products with a block by its zone map: at most the sum of a * most
where a > 0 and a * least elsewhere. A block is read for an anchor only if those bounds meet one of its windows of
scores. The first search finds an anchor's positives; its own block, read when the anchors are listed, tells it what the last of
them scores at least. Their scores give the windows of the second search, for the negatives.

Searches run in cells of some blocks by some anchors. The zone maps, a small part of the blocks, choose in cells which blocks
any anchor of a group must read; only those are dealt out with their rows. A cell reads its blocks from the most promising on,
and its windows narrow as they fill. What a cell returns is a few rows per anchor and window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import hilbert, vectors
from tallyspark.plans.staging import settle

SCALE, EACH, LOW, HIGH = 256.0, 5, 80, 100
#: Steps beyond this count as it, so that scores and their order fit 64 bits.
MOST_STEPS = 2**20
BLOCK, CELL_BLOCKS, CELL_ANCHORS, SLICE = 2048, 64, 65536, 512
CURVE_DIMENSIONS, CURVE_BITS = 8, 7
LEAST, MOST = -(2**62), 2**62
_BLOCK = "label string, ids binary, x binary, marks binary, lows array<int>, highs array<int>"


def on_curve(rows: DataFrame) -> DataFrame:
    """``rows`` (_x) of the commonest length of vector (of equals the least), with ``_curve``."""
    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in parts:
            for at, x in vectors.matrices(batch.column(0)):
                x = x.astype(float)
                held[x.shape[1]] = held.get(x.shape[1], 0) + np.stack((np.full(x.shape[1], len(at)), x.sum(axis=0), (x * x).sum(axis=0)))
        for length, (n, s, q) in held.items():
            yield pa.record_batch({"length": pa.array([length] * length, pa.int32()), "i": pa.array(range(length), pa.int32()), "n": n, "s": s, "q": q})

    sums = rows.select("_x").mapInArrow(spread, "length int, i int, n double, s double, q double").groupBy("length", "i").agg(*[F.sum(c).alias(c) for c in "nsq"])
    sums = settle(sums, "spread")
    top = sums.where("i = 0").orderBy(F.desc("n"), "length").limit(1).select("length").first()
    length = top["length"] if top else 0
    own = sorted(sums.where(F.col("length") == length).collect(), key=lambda r: r["i"])
    mean = np.array([r["s"] / r["n"] for r in own])
    deviation = np.sqrt(np.maximum(0, np.array([r["q"] / r["n"] for r in own]) - mean**2))
    dims = np.sort(np.argsort(-deviation, kind="stable")[:CURVE_DIMENSIONS])
    side = 1 << CURVE_BITS

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at, x in vectors.matrices(batch.column("_x")):
                if length and x.shape[1] == length:
                    shifted = (x[:, dims] - mean[dims]) / np.maximum(deviation[dims], 1e-9) * (side / 5) + side / 2
                    cells = np.clip(np.floor(shifted), 0, side - 1)
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(hilbert.places(cells, CURVE_BITS))], names=[*batch.schema.names, "_curve"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(place, kinds + ", _curve long")


def blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """The settled blocks of ``rows`` (_id, _label, _mark, _x): block, label, ids, x, marks (the places of anchors), lows and highs."""
    laid = on_curve(rows).repartitionByRange("_label", "_curve", "_id").sortWithinPartitions("_label", "_curve", "_id")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        label, count = None, 0

        def block() -> pa.RecordBatch:
            ids, marks, x = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.record_batch({
                "label": pa.array([label]), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "x": pa.array([x.astype("<i4").tobytes()], pa.binary()),
                "marks": pa.array([np.flatnonzero(marks).astype("<i4").tobytes()], pa.binary()),
                "lows": pa.array([x.min(axis=0).astype(np.int32)], pa.list_(pa.int32())), "highs": pa.array([x.max(axis=0).astype(np.int32)], pa.list_(pa.int32()))})

        for batch in parts:
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_mark"))
            labels = batch.column("_label").to_numpy(zero_copy_only=False)
            x = batch.column("_x").flatten().to_numpy().reshape(len(ids), -1)
            edges = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(ids)]
            for first, last in zip(edges, edges[1:], strict=False):
                if held and labels[first] != label:
                    yield block()
                    held, count = [], 0
                label = labels[first]
                while first < last:
                    upto = min(last, first + size - count)
                    held.append((ids[first:upto], marks[first:upto], x[first:upto]))
                    count, first = count + upto - first, upto
                    if count == size:
                        yield block()
                        held, count = [], 0
        if held:
            yield block()

    made = laid.select("_id", "_label", "_mark", "_x").mapInArrow(write, _BLOCK)
    return settle(made.select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")


def _matrix(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, "<i4").reshape(n, -1).astype(float)


def leaders(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """``allowed`` without what is not among its row's ``k`` first by score, falling, and id."""
    over = np.flatnonzero(allowed.sum(axis=1) > k)
    if len(over):
        n = len(ids)
        tie = np.empty(n, np.int64)
        tie[np.lexsort((np.arange(n), ids))] = np.arange(n - 1, -1, -1)
        key = np.where(allowed[over], scores[over] * n + tie, -(2**63))
        allowed[over] = key >= np.partition(key, n - k, axis=1)[:, n - k, None]
    return allowed


def listed(parts: DataFrame, k: int = EACH) -> DataFrame:
    """The settled anchors of blocks: block and place (together one row), anchor_id, label, x, and the windows of the first search: from the
    score of the k-th other row of the own block on, or any score where that has fewer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, marks = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["marks"], "<i4")
                x = _matrix(row["x"], len(ids))
                for some in np.array_split(marks, -(-len(marks) // SLICE)) if len(marks) else ():
                    scores = x[some] @ x.T
                    scores[np.arange(len(some)), some] = -np.inf
                    floor = np.partition(scores, -k, axis=1)[:, -k].astype(np.int64) if len(ids) > k else np.full(len(some), LEAST)
                    yield pa.record_batch({
                        "block": pa.array([row["block"]] * len(some), pa.int64()), "place": pa.array(some, pa.int32()), "anchor_id": pa.array(ids[some], pa.int64()),
                        "label": pa.array([row["label"]] * len(some), pa.string()), "x": pa.array([x[i].astype("<i4").tobytes() for i in some.tolist()], pa.binary()),
                        "lows": pa.array([[f] for f in floor.tolist()], pa.list_(pa.int64())), "highs": pa.array([[MOST]] * len(some), pa.list_(pa.int64()))})

    return settle(parts.select("block", "label", "ids", "x", "marks").mapInArrow(
        run, "block long, place int, anchor_id long, label string, x binary, lows array<long>, highs array<long>"), "anchors")


class _Anchors:
    """A cell's anchors and, per window, the best found so far."""

    def __init__(self, table: pa.Table, k: int) -> None:
        self.k = k
        self.block, self.place, self.anchor = (table.column(c).to_numpy() for c in ("block", "place", "anchor_id"))
        self.label = table.column("label").to_numpy()
        self.x = _matrix(b"".join(table.column("x").to_pylist()), len(self.block))
        lists = [table.column(c).to_pylist() for c in ("lows", "highs")]
        self.windows = max(map(len, lists[0]))
        # a window that an anchor does not have is empty
        self.low, self.high = (np.array([w + [fill] * (self.windows - len(w)) for w in some], np.int64) for some, fill in zip(lists, (MOST, LEAST), strict=True))
        self.found = [np.zeros((0, 3), np.int64) for _ in range(self.windows)]  # anchor, score, id

    def bounds(self, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most that each anchor's scores with each zone can be."""
        plus, minus = np.maximum(self.x, 0), np.minimum(self.x, 0)
        return plus @ lows.T + minus @ highs.T, plus @ highs.T + minus @ lows.T

    def wanted(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which anchors have a window that meets the bounds."""
        return ((most[:, None] >= self.low) & (least[:, None] <= self.high) & (self.low <= self.high)).any(axis=1)

    def read(self, some: np.ndarray, block: int, ids: np.ndarray, x: np.ndarray) -> None:
        """The anchors ``some`` read a block."""
        for rows in np.array_split(some, -(-len(some) // SLICE)):
            scores = np.rint(self.x[rows] @ x.T).astype(np.int64)
            other = np.ones(scores.shape, bool)
            own = np.flatnonzero(self.block[rows] == block)
            other[own, self.place[rows[own]]] = False
            for w in range(self.windows):
                hits = leaders(scores, ids, other & (scores >= self.low[rows, w, None]) & (scores <= self.high[rows, w, None]), self.k)
                at, where = np.nonzero(hits)
                if len(at):
                    self.add(w, np.stack((rows[at], scores[at, where], ids[where]), axis=1))

    def add(self, w: int, new: np.ndarray) -> None:
        every = np.concatenate((self.found[w], new))
        every = every[np.lexsort((every[:, 2], -every[:, 1], every[:, 0]))]
        starts = np.flatnonzero(np.append(True, every[1:, 0] != every[:-1, 0]))
        rank = np.arange(len(every)) - np.repeat(starts, np.diff(np.append(starts, len(every))))
        last = every[rank == self.k - 1]
        self.low[last[:, 0], w] = np.maximum(self.low[last[:, 0], w], last[:, 1])
        self.found[w] = every[rank < self.k]


def _zones(table: pa.Table) -> tuple[np.ndarray, ...]:
    return (table.column("block").to_numpy(), table.column("label").to_numpy(),
            *(np.array(table.column(c).to_pylist(), float) for c in ("lows", "highs")))


def searched(parts: DataFrame, anchors: DataFrame, same: bool, k: int = EACH, cell_blocks: int = CELL_BLOCKS, cell_anchors: int = CELL_ANCHORS) -> DataFrame:
    """The first ``k`` rows, by score, falling, and id, in each window of each anchor, among the blocks of its label (``same``) or of
    all others: block and place (the anchor's), anchor_id, window, rank, id and score."""
    part, nth = F.shiftright("block", 33), F.col("block").bitwiseAND((1 << 33) - 1)
    facts = parts.agg(F.count("*").alias("blocks"), F.max(part).alias("last")).first()
    total = anchors.count()
    tasks, writers = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), (facts["last"] or 0) + 1
    deals = max(1, -(-facts["blocks"] // cell_blocks), min(facts["blocks"], tasks))
    groups = max(1, -(-total // cell_anchors))
    dealt = F.pmod(part + nth * writers, F.lit(deals)).cast("int").alias("_deal")
    group = F.least(F.floor(part * groups / writers), F.lit(groups - 1)).cast("int").alias("_group")
    asking = anchors.select("*", group).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).groupBy("_deal", "_group")
    zones = parts.select("block", "label", "lows", "highs", dealt).withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def choose(key: tuple, zone: pa.Table, own: pa.Table) -> pa.Table:
        found: list[int] = []
        if zone.num_rows and own.num_rows:
            asks = _Anchors(own, k)
            names, labels, lows, highs = _zones(zone)
            least, most = asks.bounds(lows, highs)
            found = [name for i, name in enumerate(names.tolist()) if ((asks.label == labels[i]) == same)[asks.wanted(least[:, i], most[:, i])].any()]
        return pa.table({"block": pa.array(found, pa.int64()), "_group": pa.array([key[1].as_py()] * len(found), pa.int32())})

    chosen = settle(zones.groupBy("_deal", "_group").cogroup(asking).applyInArrow(choose, "block long, _group int"), "chosen")

    def search(key: tuple, block: pa.Table, own: pa.Table) -> pa.Table:
        rows: list[np.ndarray] = []
        if block.num_rows and own.num_rows:
            asks = _Anchors(own, k)
            names, labels, lows, highs = _zones(block)
            least, most = asks.bounds(lows, highs)
            for i in np.argsort(-most.max(axis=0), kind="stable").tolist():
                some = np.flatnonzero(((asks.label == labels[i]) == same) & asks.wanted(least[:, i], most[:, i]))
                if len(some):
                    ids = np.frombuffer(block.column("ids")[i].as_py(), "<i8")
                    asks.read(some, int(names[i]), ids, _matrix(block.column("x")[i].as_py(), len(ids)))
            rows = [np.column_stack((asks.block[f[:, 0]], asks.place[f[:, 0]], asks.anchor[f[:, 0]], np.full(len(f), w), f[:, 2], f[:, 1])) for w, f in enumerate(asks.found)]
        out = np.concatenate(rows) if rows else np.zeros((0, 6), np.int64)
        return pa.table({"block": out[:, 0], "place": out[:, 1].astype(np.int32), "anchor_id": out[:, 2], "window": out[:, 3].astype(np.int32), "id": out[:, 4], "score": out[:, 5]})

    read = parts.select("block", "label", "ids", "x", "lows", "highs", dealt).join(chosen, "block").groupBy("_deal", "_group")
    found = read.cogroup(asking).applyInArrow(search, "block long, place int, anchor_id long, window int, id long, score long")
    first = Window.partitionBy("block", "place", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, vector: str = "embedding", label: str = "label", row_id: str = "vec_id", positives: int = EACH,
                   negatives: int = EACH, low: int = LOW, high: int = HIGH, scale: float = SCALE, block: int = BLOCK, **cells: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each row where ``anchors`` holds and each of its first
    ``positives`` other rows of its label, the first ``negatives`` rows of other labels that score ``low`` to ``high`` percent of the positive.

    Scores are inner products of floor(scale * entry); first is by score, falling, then the lesser id. Rows with a null id, label or vector,
    null or non-finite entries, or a vector of another length than the commonest (of equals the least) take no part. Repeated rows are
    rows each: a repeat of an anchor is another row. An anchor without positives, or a positive without negatives, has no rows; negative positive
    scores have none either. Empty tables give empty ones; only the named columns are read, and equal scores of any number of rows are
    settled by id.
    """
    taking = rows.where(vectors.finite(vector) & F.col(label).isNotNull() & F.col(row_id).isNotNull())
    taking = taking.select(F.col(row_id).cast("long").alias("_id"), F.col(label).cast("string").alias("_label"), F.coalesce(anchors, F.lit(False)).alias("_mark"),
                           vectors.steps(vector, scale, 0, MOST_STEPS).alias("_x"))
    parts = blocks(taking, block)
    asking = listed(parts, positives)
    near = settle(searched(parts, asking, True, positives, **cells), "positives")
    score = f"(x.score * {low})"
    least = f"CASE WHEN x.score > 0 THEN ({score} + {high - 1}) div {high} ELSE {score} div {high} END"
    windows = near.groupBy("block", "place").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("_near"))
    windows = windows.select("block", "place", F.expr(f"transform(_near, x -> {least})").alias("lows"), F.expr("transform(_near, x -> x.score)").alias("highs"))
    far = searched(parts, settle(asking.drop("lows", "highs").join(windows, ["block", "place"]), "windows"), False, negatives, **cells)
    named = near.select("block", "place", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(named, ["block", "place", "window"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The query's rows in DuckDB: every anchor against every row.
ORACLE = """
WITH taking AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
pairs AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_dot_product(a.x, r.x)::BIGINT AS score
    FROM taking a JOIN taking r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
