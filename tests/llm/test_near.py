from __future__ import annotations

import random

import numpy as np
import plain
import pytest

from tallyspark.llm import dart_minhash
from tallyspark.plans import staging


def edited(words, draw, n):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"z{draw.randrange(10**6)}"
    return " ".join(words)


def test_classes_as_by_hand(spark):
    draw = random.Random(2)
    rows = [(None, None), (1, None), (2, ""), (3, " "), (4, "one two"), (5, "One  two"), (None, "null id twin here now ok"), (None, "null id twin here now ok")]
    for family in range(12):
        base = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        for _ in range(draw.randrange(1, 25)):
            rows.append((len(rows), edited(base, draw, draw.choice((0, 0, 1, 2, 12, 30)))))
    for shared in range(60):  # a shared passage of most of the text, below the threshold
        rows.append((len(rows), " ".join([*(f"s{k}" for k in range(150)), *(f"o{shared}x{k}" for k in range(60))])))
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, node string").repartition(4)
    got = sorted(((r["doc_id"], r["class_id"]) for r in dart_minhash.near_duplicates(docs).collect()), key=str)
    assert got == plain.near_classes(rows)
    kept = dart_minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    classes = {c for d, c in got if c is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert {i for i in ids if i is not None} == classes
    assert ids.count(None) == 2  # a null text, and one of the twins


def test_repeated_rows_and_nothing(spark, empty):
    docs = spark.createDataFrame([(7, "a b c d e f g")] * 3, "doc_id long, text string")
    assert [r["class_id"] for r in dart_minhash.near_duplicates(docs).collect()] == [7, 7, 7]
    assert dart_minhash.without_near_duplicates(docs).count() == 1
    assert dart_minhash.near_duplicates(empty).count() == 0 and dart_minhash.without_near_duplicates(empty).count() == 0


def test_weighted_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(1)
    errors = []
    pool = draw.integers(1, 2**63, 50).astype(np.uint64)
    for _ in range(30):
        sets = [dict(zip(draw.choice(pool, k, replace=False).tolist(), draw.uniform(0.2, 6, k), strict=True)) for k in (40, 30)]
        every = set(sets[0]) | set(sets[1])
        true = sum(min(s.get(e, 0) for s in sets) for e in every) / sum(max(s.get(e, 0) for s in sets) for e in every)
        sign = dart_minhash.signatures(np.array([e for s in sets for e in s], np.uint64), np.array([w for s in sets for w in s.values()]),
                                       np.repeat([0, 1], [40, 30]), 2, 512)
        errors.append((sign[0] == sign[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.04


def test_count_weights(spark):
    docs = spark.createDataFrame([(1, "a b c d e " * 9), (2, "a b c d e " * 9)], "doc_id long, text string")
    one, two = dart_minhash.signed(docs, ["doc_id"], weight="count").collect()
    assert one["signature"] == two["signature"]


def group_edited_apart(n):
    """Texts edited apart from one text: many are not similar among themselves, but share shingles that many have."""
    draw = random.Random(9)
    base = [f"w{k}" for k in range(160)]
    return [(k, edited(base, draw, 1 + k % 7)) for k in range(n)]


@pytest.mark.parametrize(("pairs", "room"), [(0, None), (0, -1)])
def test_many_rounds_and_lists_of_any_size(spark, monkeypatch, pairs, room):
    rows = group_edited_apart(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(dart_minhash, "PAIRS", pairs)
    if room is not None:  # nothing is measured small
        monkeypatch.setattr(staging, "BROADCAST_BYTES", room)
    got = sorted(((r["doc_id"], r["class_id"]) for r in dart_minhash.near_duplicates(docs).collect()), key=str)
    assert got == plain.near_classes(rows)


def test_few_pairs_take_few_stages(spark):
    """Each stage costs a shuffle's tasks, however few its rows."""
    docs = spark.createDataFrame(group_edited_apart(40), "doc_id long, text string").repartition(4)
    with staging.watched() as settled:
        dart_minhash.near_duplicates(docs).count()
    assert len(settled) <= 30


def test_classes_with_more_links(spark):
    def linked(pairs):
        return staging.settle(spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in pairs], "a binary, b binary"))
    old, new = [(1, 2), (2, 3), (5, 6), (8, 9)], [(3, 5), (7, 8), (10, 11), (11, 6)]
    got = dart_minhash.classes_with(dart_minhash.classes_of(linked(old)), linked(new)).collect()
    assert sorted((r["node"][0], r["class"][0]) for r in got) == [*((n, 1) for n in (1, 2, 3, 5, 6)), (7, 7), (8, 7), (9, 7), (10, 1), (11, 1)]
