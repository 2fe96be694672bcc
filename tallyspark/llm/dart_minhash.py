"""Near-duplicate documents by DartMinHash signatures, banded joining and exact checks.

Each element of a weighted set (here: five-word shingles) owns the region [0, weight) x [0, inf) of
weight and rank. Darts fall on an element's plane at unit density, at places that a hash of element
and cell fixes, so every document that holds the element throws the same darts; a dart counts where
it lands below the document's weight. A dart also names a coordinate; the signature keeps, per
coordinate, the dart of the lowest rank. Ranks are thrown in bands of growing height until every
coordinate has a dart, which is final since later ranks are higher. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity.

Exact copies count as one text. Texts that agree in a band meet in a bucket. A bucket is never
paired with itself: in each round a few of its texts are leaders, which are checked against its
other texts of other classes and then leave it. After the first round the texts whose buckets still
hold two classes are undecided; they meet again by their rarest shingles, enough of them that texts
of the threshold's similarity must share one (a large group of texts edited apart from one text fills
its bands' buckets, yet its members share only frequent shingles). Rounds go on until no bucket holds
two classes, or until what is left makes so few pairs that all are met in one round. Agreement of whole signatures rules out far pairs (by five standard deviations); shingle
sets decide the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import spans
from tallyspark.llm.arrow import batches
from tallyspark.plans.staging import discard, fits, settle, unused

WORDS, THRESHOLD = 5, 0.8
#: Coordinates of a signature, and how many of them make a band. Each coordinate is in three bands: one
#: of its neighbours, one of those at equal steps from it, one of a diagonal across those steps.
SIZE, ROWS = 128, 8
#: Height of the first band of ranks; the following ones double what has been thrown.
FIRST_RANK = 1 / 64
#: The most cells in which shingles are counted (a byte each), and cells in a row of counts.
CELLS, BLOCK = 1 << 24, 1 << 14
#: Buckets that make no more pairs than this in all are gone through in one last round: a round costs its stages, however few its pairs.
PAIRS = 1 << 17
#: Tables of pairs, classes and leaders are broadcast up to so many bytes as measured: several are in memory at once, beside the Python workers.
FEW = 4 << 20
_U = np.uint64


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0 ** -53


def _counts(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson draws of a mean of at most 1 from uniform numbers."""
    odds = np.cumprod(np.concatenate(([1.0], mean / np.arange(1, 20)))) * np.exp(-mean)
    return np.searchsorted(np.cumsum(odds), u, side="right")


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    """The (n, size) signatures of n weighted sets. ``owner`` names each element's set; a repeated
    element of a set counts once, with its largest weight. Empty sets get zeros."""
    best = np.full(n * size, np.inf)
    out = np.zeros(n * size, np.uint64)
    keep = weights > 0
    elements, weights, owner = elements[keep], weights[keep].astype(np.float64), owner[keep]
    slices = np.maximum(0, np.ceil(np.log2(np.maximum(weights, 1)))).astype(np.int64) + 1
    at = np.repeat(np.arange(len(elements)), slices)  # weight in [0, 1), [1, 2), [2, 4) ...
    part = np.arange(len(at)) - np.repeat(np.cumsum(slices) - slices, slices)
    low, high, level = 0.0, FIRST_RANK, 0
    while len(at):
        for p in np.unique(part).tolist():
            mine = at[part == p]
            base, width = (0.0, 1.0) if p == 0 else (2.0 ** (p - 1), 2.0 ** (p - 1))
            cells = max(1, int(np.ceil(width * (high - low))))
            for first in range(0, cells, 64):
                here = np.arange(first, min(cells, first + 64), dtype=np.uint64)
                seed = spans.mix(np.repeat(elements[mine], len(here)) + _U(p * 0x9E3779B97F4A7C15 % 2**64)
                                 + np.tile((here + _U(1)) * _U(0xD6E8FEB86659FD93), len(mine)) + _U(level * 0xA0761D6478BD642F % 2**64))
                found = _counts(_unit(seed), width * (high - low) / cells)
                hit = np.flatnonzero(found)
                _throw(best, out, seed[hit], found[hit], np.repeat(mine, len(here))[hit], weights, owner, size,
                       base, width, low + (high - low) * (hit % len(here) + first) / cells, (high - low) / cells)
        open_sets = np.isinf(best.reshape(n, size)).any(axis=1)
        left = open_sets[owner[at]]
        at, part = at[left], part[left]
        low, high, level = high, high * 2, level + 1
    return out.reshape(n, size)


def _throw(best, out, seed, found, at, weights, owner, size, base, width, rank, height) -> None:
    order = np.repeat(np.arange(len(seed)), found)
    nth = np.arange(len(order)) - np.repeat(np.cumsum(found) - found, found)
    dart = spans.mix(seed[order] ^ ((nth.astype(np.uint64) + _U(1)) * _U(0xE7037ED1A0B428DB)))
    place = base + width * _unit(spans.mix(dart + _U(1)))
    ok = place < weights[at[order]]
    order, dart = order[ok], dart[ok]
    ranks = rank[order] + height * _unit(spans.mix(dart + _U(2)))
    slot = owner[at[order]] * size + (spans.mix(dart + _U(3)) % _U(size)).astype(np.int64)
    down = np.argsort(-ranks, kind="stable")  # of darts in one slot the lowest is written last
    slot, ranks, dart = slot[down], ranks[down], dart[down]
    low = ranks < best[slot]
    best[slot[low]] = ranks[low]
    out[slot[low]] = dart[low]


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``words`` words of lower-cased texts, and the text each is of. A text of
    fewer words has one, of all its words; one without words has none."""
    hashes, owners = [], []
    seen = 0
    for chunk in spans.chunks(texts):
        points, ends = spans.code_points([t.lower() for t in chunk])
        starts, stops, outside = spans.blank_words(points)
        word = spans.hashes(points, starts, stops, outside, spans._BASES[:1])[0]
        count = np.diff(np.searchsorted(starts, ends), prepend=0)
        text = np.repeat(np.arange(len(chunk)), count)
        left = np.repeat(np.cumsum(count), count) - np.arange(len(word))  # words from here on
        total = np.repeat(count, count)
        value = np.zeros(len(word), np.uint64)
        for k in range(words):
            there = np.concatenate((word[k:], np.zeros(min(k, len(word)), np.uint64)))
            value = value * _U(0x9FB21C651E98DF25) + np.where(left > k, there, _U(0))
        whole = (left >= words) | (left == total)
        hashes.append(spans.mix(value[whole]))
        owners.append(text[whole] + seen)
        seen += len(chunk)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def signed(docs: DataFrame, keep: list[str], size: int = SIZE, weight: str = "presence", words: int = WORDS) -> DataFrame:
    """The columns ``keep`` of ``docs``, ``node`` (the text's digest, 16 bytes, null without
    words) and ``signature`` (4 bytes a coordinate). ``weight``: presence (1 a shingle, so plain
    Jaccard similarity) or count (how often it occurs)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = batch.column("text").to_pylist()
            for first in range(0, len(texts), 1000):
                some = texts[first:first + 1000]
                elements, owner = shingles(some, words)
                if weight == "count":
                    frame = pd.DataFrame({"o": owner, "e": elements}).groupby(["o", "e"], sort=False).size()
                    owner, elements = (frame.index.get_level_values(i).to_numpy() for i in (0, 1))
                    weights = frame.to_numpy()
                else:
                    weights = np.ones(len(elements))
                sign = (signatures(elements, weights, owner, len(some), size) & _U(0xFFFFFFFF)).astype("<u4")
                has = np.bincount(owner, minlength=len(some)) > 0
                part = batch.slice(first, len(some))
                yield pa.record_batch([*(part.column(c) for c in keep), pa.array([s.tobytes() if h else None for s, h in zip(sign, has, strict=True)], pa.binary()),
                                       part.column("node")], names=[*keep, "signature", "node"])

    rows = docs.select(*keep, "text", F.unhex(F.md5("text")).alias("node"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep]
    out = rows.mapInArrow(run, ", ".join([*fields, "signature binary", "node binary"]))
    return out.withColumn("node", F.when(F.col("signature").isNotNull(), F.col("node")))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``node`` and ``held``, the sorted shingle hashes of its text (8 bytes each)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in parts:
                texts = batch.column("text").to_pylist()
                for first in range(0, len(texts), 500):
                    some = texts[first:first + 500]
                    elements, owner = shingles(some)
                    cut = np.searchsorted(owner, np.arange(len(some) + 1))
                    for i, node in enumerate(batch.column("node").slice(first, len(some)).to_pylist()):
                        yield node, np.unique(elements[cut[i]:cut[i + 1]]).tobytes()
        yield from batches(rows(), pa.schema([("node", pa.binary()), ("held", pa.binary())]))

    return texts.select("node", "text").mapInArrow(run, "node binary, held binary")


def _similar(pairs: DataFrame) -> DataFrame:
    """``a``, ``b`` and ``similarity`` of pairs with both shingle sets."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out = []
            for x, y in zip(batch.column("held_a"), batch.column("held_b"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                out.append(both / (len(one) + len(two) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "held_a", "held_b").mapInArrow(run, "a binary, b binary, similarity double")


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each cell occur in ``sets``, in one byte: up to 128 as it is, then by the logarithm.

    A shingle's cell is its lowest bits. There are about a quarter as many cells as shingles, at most CELLS, so what a task hands on
    and what is sent back (a byte a cell) is bounded. A task counts no cell beyond 255."""
    total = sets.agg(F.sum(F.expr("octet_length(held) div 8")).alias("n")).first()["n"] or 0
    cells = min(CELLS, max(BLOCK, 1 << max(1, total // 4).bit_length()))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(cells, np.int64)
        for batch in parts:
            for x in batch.column("held"):
                np.add.at(counts, _cells(x, cells), 1)
        share = TaskContext.get().partitionId() % 64
        least = np.minimum(counts, 255).astype(np.uint8).reshape(-1, BLOCK)
        rows = ((k, share, least[k].tobytes()) for k in np.flatnonzero(least.any(axis=1)).tolist())
        yield from batches(rows, pa.schema([("block", pa.int32()), ("share", pa.int32()), ("counts", pa.binary())]))

    def add(kind: str, last: bool):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            counts = sum(np.frombuffer(x, kind).astype("<u4") for x in part["counts"])
            if last:
                counts = np.where(counts <= 128, counts, np.minimum(255, 128 + 5 * np.log2(np.maximum(counts, 1) / 128))).astype(np.uint8)
            return pd.DataFrame({"block": part["block"].iloc[:1], "share": part["share"].iloc[:1], "counts": [counts.tobytes()]})
        return run

    kind = "block int, share int, counts binary"
    shares = sets.select("held").mapInArrow(run, kind).groupBy("block", "share").applyInPandas(add("u1", False), kind)
    out = np.zeros(cells, np.uint8)
    for row in shares.groupBy("block").applyInPandas(add("<u4", True), kind).collect():  # one job; toLocalIterator runs one for each partition
        out[row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], np.uint8)
    return out


def _cells(held: pa.Scalar, cells: int) -> np.ndarray:
    return (np.frombuffer(held.as_buffer(), np.uint64) & _U(cells - 1)).astype(np.int64)


def rare_buckets(sets: DataFrame, threshold: float) -> DataFrame:
    """``bucket`` (a shingle), ``node``, ``size`` (all its shingles) and ``rank`` (the shingle's place among them) for the first shingles of
    each text in an order that all texts have in common: the count of the shingle's cell, then its hash. A text of n shingles shares at
    least threshold * n with one of that similarity, so of its n - ceil(threshold * n) + 1 first ones one is among the other's first too,
    whatever the order; rare ones first keeps buckets small. Shingles alone in their cell are of one text; they take their places and
    are left out."""
    counts = shingle_counts(sets)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for first in range(0, batch.num_rows, 100):
                some = batch.slice(first, 100)
                buckets, sizes, ranks = [], [], []
                for held in some.column("held"):
                    own = np.frombuffer(held.as_buffer(), np.int64)
                    count = counts[_cells(held, len(counts))]
                    order = np.lexsort((own, count))[:len(own) - int(np.ceil(threshold * len(own) - 1e-6)) + 1]
                    rank = np.flatnonzero(count[order] > 1)
                    buckets.append(own[order[rank]])
                    ranks.append(rank.astype(np.int32) + 1)
                    sizes.append(len(own))
                each = np.array([len(x) for x in buckets])
                yield pa.record_batch([pa.array(np.concatenate(buckets)), some.column("node").take(pa.array(np.repeat(np.arange(len(each)), each))),
                                       pa.array(np.repeat(np.array(sizes, np.int32), each)), pa.array(np.concatenate(ranks).astype(np.int32))],
                                      names=["bucket", "node", "size", "rank"])

    return sets.select("node", "held").mapInArrow(run, "bucket bigint, node binary, size int, rank int")


def _within_reach(threshold: float, other_size: Column, other_rank: Column | None = None) -> Column:
    """Whether the shingles from ``rank`` on are enough for the similarity to a text of ``other_size``:
    the rarest shingle that two texts share has at most so many shared ones after it in either."""
    rest = F.col("size") - F.col("rank") + 1
    if other_rank is not None:
        rest = F.least(rest, other_size - other_rank + 1)
    return rest >= threshold / (1 + threshold) * (F.col("size") + other_size) - 1e-6


def _of_reach(members: DataFrame, threshold: float) -> DataFrame:
    """The members that some text of their bucket's least size, or the least similar one, is in reach of."""
    least = members.groupBy("bucket").agg(F.min("size").alias("least"))
    other = F.greatest(F.col("least").cast("double"), threshold * F.col("size"))
    return members.join(least, "bucket").where(_within_reach(threshold, other)).drop("least")


def _agreement(size: int) -> Column:
    """The share of equal coordinates of the signatures ``sign_a`` and ``sign_b``."""
    same = F.lit(0)
    for k in range(size):
        same = same + (F.substring("sign_a", 4 * k + 1, 4) == F.substring("sign_b", 4 * k + 1, 4)).cast("int")
    return same / size


def _few(table: DataFrame) -> DataFrame:
    """A settled table to join to another: broadcast where it is measured small, so that the other is not moved."""
    return F.broadcast(table) if fits(table, FEW) else table


def classes_of(links: DataFrame) -> DataFrame:
    """``node`` and ``class`` (the least node it hangs together with) of links ``a``, ``b`` (settled: each round reads them), by
    rounds of taking the least class of a neighbour and then the class of that class."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("class")), "classes")
    while True:
        small = fits(label, FEW)
        few = F.broadcast(label) if small else label
        if small:  # nothing is moved to see whether all links are inside a class; otherwise the last round shows it
            x, y = (few.select(F.col("node").alias(c), F.col("class").alias(f"class_{c}")) for c in "ab")
            if links.join(x, "a").join(y, "b").where("class_a <> class_b").isEmpty():
                return label
        near = both.join(few.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("m"))
        step = near.join(few, "node").select("node", F.col("class").alias("was"), F.least("class", "m").alias("m"))
        up = few.select(F.col("node").alias("m"), F.col("class").alias("up"))
        after = settle(step.join(up, "m").select("node", "was", F.least("m", "up").alias("class")), "classes")
        discard(label)
        label = after.select("node", "class")
        if not small and after.where("was <> class").isEmpty():
            return label


def classes_with(label: DataFrame, links: DataFrame) -> DataFrame:
    """The classes ``label`` (node, class; settled) once ``links`` (a, b) are among the links too. Only the classes that these bring together
    are gone through, by the least node of each; a node that ``label`` lacks is a class of its own."""
    few = _few(label)
    ends = links.join(few.select(F.col("node").alias("a"), F.col("class").alias("x")), "a", "left").join(
        few.select(F.col("node").alias("b"), F.col("class").alias("y")), "b", "left")
    between = settle(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b"), "links")
    moved = classes_of(between)
    to = moved.select(F.col("node").alias("class"), F.col("class").alias("to"))
    known = label.join(_few(to), "class", "left").select("node", F.coalesce("to", "class").alias("class"))
    after = settle(known.union(moved.join(few.select("node"), "node", "left_anti").select("node", "class")), "classes")
    discard(between, moved)
    return after


def _band_hashes(size: int, rows: int) -> list[Column]:
    """A hash of each band of ``sign``."""
    def part(coordinates) -> Column:
        return F.xxhash64(F.concat(*(F.substring("sign", 4 * c + 1, 4) for c in coordinates)))
    step = size // rows
    near = [F.xxhash64(F.substring("sign", 4 * rows * k + 1, 4 * rows)) for k in range(step)]
    return near + [part(range(k, size, step)) for k in range(step)] + [part(step * j + (k + j) % step for j in range(rows)) for k in range(step)]


def _sets_of(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """The shingle sets of the texts ``asked`` (node, repeated ones too) for. A list measured small is broadcast, so that
    only its texts are shuffled; a larger one is joined."""
    if not fits(asked, FEW):
        asked = settle(asked.distinct(), "asked")
    few = F.broadcast(asked) if fits(asked) else asked
    texts = docs.select(F.unhex(F.md5("text")).alias("node"), "text").join(few, "node", "left_semi")
    return settle(shingle_sets(texts.dropDuplicates(["node"])), "sets")


def _of_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """The pairs (settled) with ``value`` of their two nodes in ``table``, as ``value_a`` and ``value_b``. Pairs measured few are broadcast to the
    table: no other row of it is moved, and the pairs of one node are no one task's. Otherwise, if the list of their nodes is
    small, that is broadcast; beyond that the table is joined by node."""
    def ends(rows: DataFrame) -> list[DataFrame]:
        return [rows.select(F.col("node").alias(c), F.col(value).alias(f"{value}_{c}")) for c in "ab"]
    if fits(pairs, FEW):
        a, b = (end.join(F.broadcast(pairs), c) for end, c in zip(ends(table), "ab", strict=True))
        return a.join(b, ["a", "b"])
    asked = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    a, b = ends(table.join(F.broadcast(asked), "node", "left_semi") if fits(asked) else table)
    return pairs.join(b, "b").join(a, "a")


def _of_mixed_buckets(members: DataFrame, label: DataFrame) -> DataFrame:
    """The members, with their ``class``, of buckets that hold two classes or more."""
    held = members.join(_few(label), "node", "left").withColumn("class", F.coalesce("class", "node"))
    mixed = held.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("bucket")
    return settle(held.join(mixed, "bucket"), "held")


def _by_class(members: DataFrame, label: DataFrame) -> DataFrame:
    """The members of buckets that hold two classes or more, with their ``class``, ``like`` (its members in the bucket), ``largest`` (the class
    with the most of them) and ``others`` (how many members are of other classes than that)."""
    held = members.join(_few(label), "node", "left").withColumn("class", F.coalesce("class", "node"))
    sizes = held.groupBy("bucket", "class").agg(F.count("*").alias("like"))
    most = sizes.groupBy("bucket").agg(F.sum("like").alias("n"), F.max(F.struct("like", "class")).alias("m"))
    most = most.select("bucket", F.col("m.class").alias("largest"), (F.col("n") - F.col("m.like")).alias("others")).where("others > 0")
    return settle(held.join(sizes.join(most, "bucket"), ["bucket", "class"]), "held")


def _classes(signs: DataFrame, docs: DataFrame, threshold: float, size: int, rows: int) -> DataFrame:
    """``node`` and ``class`` (the least node) of the texts that links, similar by at least ``threshold``, hang together."""
    nodes = signs.where("node IS NOT NULL").groupBy("node").agg(F.first("signature").alias("sign"))
    nodes = settle(nodes, "nodes")
    met = nodes.select("node", F.posexplode(F.array(*_band_hashes(size, rows))).alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "node")
    full = met.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = settle(met.join(full, "bucket"), "buckets")
    margin = max(0.0, threshold - 5 * (threshold * (1 - threshold) / size) ** 0.5)

    def agreeing(pairs: DataFrame) -> DataFrame:
        return settle(_of_both(pairs, nodes, "sign").where(_agreement(size) >= margin).select("a", "b"), "near")

    def similar(near: DataFrame, sets: DataFrame) -> DataFrame:
        return settle(_similar(_of_both(near, sets, "held")).where(F.col("similarity") >= threshold).select("a", "b"), "links")

    # the text whose buckets are the fullest leads: in a group of copies edited apart, the one they were made from
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    plain, members = members, settle(members.select("bucket", "node").join(degree, "node"), "buckets")
    discard(plain)
    lead = members.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("m")).select("bucket", F.col("m.node").alias("a"))
    pairs = members.join(lead, "bucket").where("node <> a").select(F.least("node", "a").alias("a"), F.greatest("node", "a").alias("b")).distinct()
    tried = settle(pairs, "met")
    near = agreeing(tried)
    sets = _sets_of(near.select(F.explode(F.array("a", "b")).alias("node")), docs)
    links = similar(near, sets)
    label = classes_of(links)
    held = _of_mixed_buckets(members, label)
    undecided = settle(held.select("node", "degree").distinct(), "undecided")
    discard(members, near, links, held)
    few = F.broadcast(undecided) if fits(undecided) else undecided
    more = _sets_of(undecided.select("node").join(_few(sets.select("node")), "node", "left_anti"), docs)
    before, sets = sets, settle(sets.join(few, "node", "left_semi").union(more), "sets")  # every round reads them
    discard(before, more)
    first = settle(rare_buckets(sets, threshold), "first")
    often = first.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = settle(first.join(often, "bucket").join(few, "node"), "buckets")
    discard(first)
    turn, last = 1, False
    while not last:
        held = _by_class(_of_reach(members, threshold), label)
        open_pairs = held.agg(F.sum("others").alias("n")).first()["n"] or 0  # each of a bucket's texts with those outside its largest class
        if not open_pairs:
            break
        last = open_pairs <= PAIRS
        if last:
            ranked = held.where("class <> largest")
        else:  # of the largest class, which takes most others in; then of the smallest, whose rest is met in full
            order = Window.partitionBy("bucket").orderBy(F.desc("like") if turn % 2 else F.asc("like"), "class", F.desc("degree"), "node")
            ranked = held.withColumn("k", F.row_number().over(order)).where(F.col("k") <= 4 ** ((turn + 1) // 2))
        lead = settle(ranked.select("bucket", F.col("node").alias("a"), F.col("class").alias("lead_class"), F.col("size").alias("lead_size"), F.col("rank").alias("lead_rank")), "leaders")
        reach = _within_reach(threshold, F.col("lead_size"), F.col("lead_rank"))
        few = _few(lead)
        pairs = held.join(few, "bucket").where((F.col("class") != F.col("lead_class")) & reach)
        pairs = pairs.select(F.least("node", "a").alias("a"), F.greatest("node", "a").alias("b")).distinct().join(_few(tried), ["a", "b"], "left_anti")
        pairs = settle(pairs, "met")
        near = agreeing(pairs)
        new = similar(near, sets)
        tried = tried.union(pairs)
        if not new.isEmpty():
            before, label = label, classes_with(label, new)
            discard(before)
        before = members
        if not last:
            left = held.join(few.select("bucket", F.col("a").alias("node")), ["bucket", "node"], "left_anti")
            members = settle(left.select("bucket", "node", "size", "rank", "degree"), "buckets")
        discard(before, held, lead, near, new)
        turn += 1
    return label


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, threshold: float = THRESHOLD, size: int = SIZE,
                    rows: int = ROWS) -> DataFrame:
    """The columns ``keep`` (by default doc_id) of every row of ``docs`` (doc_id, text; others are
    let be), ``node`` and ``class_id``: the least doc_id among the rows of its class.

    Rows are of one class if their texts are equal, or similar by ``threshold`` over the sets of
    five-word shingles (lower case, words between ASCII white space), or linked by such rows. A row
    whose text is null or has no words is alone, with its own doc_id. Repeated rows come back as
    often as they are there. Null ids count as larger than all others; a class of null ids alone has
    a null class_id. An empty table gives an empty one.
    """
    keep = keep or ["doc_id"]
    labelled = classed(docs, keep, threshold, size, rows)
    least = labelled.where("node IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    few = labelled.join(least, "class", "left")
    return few.select(*keep, "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def classed(docs: DataFrame, keep: list[str], threshold: float = THRESHOLD, size: int = SIZE, rows: int = ROWS) -> DataFrame:
    """The columns ``keep``, ``node`` (the text's digest) and ``class`` (the least node of its class) of every row of ``docs``; both
    are null for rows without words."""
    signs = settle(signed(docs, keep, size), "signatures")
    label = _classes(signs, docs, threshold, size, rows)
    return signs.drop("signature").join(_few(label), "node", "left").withColumn("class", F.coalesce("class", "node"))


def without_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` less all but one of each class: the one of the least id (null last), of equal ids the first row. Classes are
    of texts, so unrelated texts under one id are kept each. Rows without words stay, null texts too; of repeated rows one stays;
    other columns are let be whatever their names, an empty table gives an empty one."""
    row = unused("_row", docs.columns)
    rows = settle(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = classed(rows.select(F.col(row).alias("_uid"), "doc_id", "text"), ["_uid", "doc_id"], **how)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_uid"))
    # one row per text; then one text per class
    one = found.where("node IS NOT NULL").groupBy("class", "node").agg(best.alias("m"))
    kept = one.groupBy("class").agg(F.min("m").alias("m")).select(F.col("m._uid").alias(row))
    alone = found.where("node IS NULL").select(F.col("_uid").alias(row))
    return rows.join(kept.union(alone), row, "left_semi").drop(row)
