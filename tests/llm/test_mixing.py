"""Mixing against plain Python: targets by resharing round by round, selection by one sorted list per source."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import mixing, queries
from tests.compare import connect, difference

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes: dict, shares=(3, 1, 2), share_of_all=1.5, most=2) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: shares[i % len(shares)] for i, s in enumerate(order)}
    full, left = {}, share_of_all * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > most * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def plain_mix(rows: list[tuple], weight=None) -> Counter:
    """doc_id, text and source to (doc_id, size, source_size, taken)."""
    every = []
    for doc, text, source in rows:
        text = text or ""
        words = len(WORD.findall(text))
        marks = len("".join(WORD.findall(text)))
        w = max(0.05, sum(c.isalpha() for c in text) / marks) if marks else 0.05
        w = weight(doc) if weight else w
        digest = hashlib.md5(f"{mixing.SEED}:{'' if doc is None else doc}:{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()
        every.append((-math.log((int(digest[:13], 16) + 0.5) / 2**52) / w, -1 if doc is None else doc, words, source))
    sizes = Counter()
    for _, _, words, source in every:
        sizes[source] += words
    targets, out, place = plain_targets(sizes), Counter(), Counter()
    for _, doc, words, source in sorted(every, key=lambda r: r[:3]):
        budget = math.floor(targets[source] + 0.5)
        epochs = budget // sizes[source] if sizes[source] else 0
        part = max(0, min(words, budget - epochs * sizes[source] - place[source]))
        place[source] += words
        out[None if doc < 0 else doc, words, sizes[source], epochs * words + part] += 1
    return out


@pytest.fixture(scope="module")
def rows(odd_texts):
    """A source with most rows, a tiny one that fills up, one without words, a null one; null ids, repeated rows."""
    texts = [t for t in odd_texts if t != "Ünï cödé \U0001F600 text"]
    made = [(i, t, "hot" if i % 3 else "b") for i, t in enumerate(texts)]
    made += [(100 + i, f"word {i} " * (1 + i % 7), "hot") for i in range(200)]
    made += [(400, "one two three", ""), (401, "four five", "\U00010000"), (402, None, "none"), (403, " ", "none"), (404, "x y z " * 40, None)]
    return made + [(None, "no id here", "b"), (None, "no id here", "b"), (405, "again and again", "hot"), (405, "again and again", "hot")]


def frame(spark, rows):
    out = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return out.withColumn("size", F.lit("clash")).withColumn("_slice", F.lit(1)).withColumn("place", F.lit(None).cast("int"))


def test_mix_is_the_plain_one(spark, rows):
    got = mixing.mixed(frame(spark, rows).repartition(5)).select("doc_id", "size", "source_size", "taken").collect()
    assert Counter(map(tuple, got)) == plain_mix(rows)


def test_targets(spark, rows):
    mix = mixing.mixed(frame(spark, rows), ["doc_id", "source"])
    found = {r["source"]: r for r in mix.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("all")).collect()}
    want = plain_targets({s: r["all"] for s, r in found.items()})
    for source, r in found.items():
        assert r["target"] == pytest.approx(want[source])
        assert abs(r["taken"] - want[source]) <= 0.5
        assert r["target"] <= 2 * r["all"]
    assert sum(want.values()) == pytest.approx(1.5 * sum(r["all"] for r in found.values()))
    assert mix.where("taken > 2 * size OR taken < 0").isEmpty()


def test_weights_and_reruns(spark, rows):
    docs = frame(spark, [r for r in rows if r[0] is not None]).withColumn("w", F.when(F.col("doc_id") % 2 == 0, 5.0).otherwise(0.5))
    first, again = (mixing.mixed(docs.repartition(n), weight=F.col("w")).select("doc_id", "size", "source_size", "taken").collect() for n in (2, 7))
    assert Counter(map(tuple, first)) == Counter(map(tuple, again)) == plain_mix([r for r in rows if r[0] is not None], lambda d: 0.5 if d % 2 else 5.0)


def test_heavier_documents_are_taken_more_often(spark):
    """Of equal sizes, a tenth taken: the share of heavy documents is that of sequential weighted draws."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.lit("s").alias("source"))
    mix = mixing.mixed(docs, weight=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0), share_of_all=0.1)
    heavy, light = (mix.where(f"doc_id % 2 = {k}").agg(F.sum("taken")).first()[0] / 10_000 for k in (0, 1))
    # draws without replacement to a tenth: (1 - q^4 + 1 - q) / 2 = 0.1
    q = next(1 - x / 10_000 for x in range(10_000) if (2 - (1 - x / 10_000) ** 4 - (1 - x / 10_000)) / 2 >= 0.1)
    assert heavy == pytest.approx(1 - q**4, abs=0.02) and light == pytest.approx(1 - q, abs=0.02)


def test_copies(spark, rows):
    docs = frame(spark, rows).withColumn("epoch", F.lit("old"))
    out = mixing.copies(docs).select("doc_id", "text", "epoch").collect()
    words = Counter()
    for r in out:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    want = Counter()
    for (doc, _, _, taken), n in plain_mix(rows).items():
        want[doc] += taken * n
    assert words == +want
    whole = {doc: text for doc, text, _ in rows}
    assert all(whole[r["doc_id"]].startswith(r["text"]) for r in out if r["doc_id"] is not None)


def test_empty_table(spark, empty):
    assert mixing.mixed(empty).isEmpty() and mixing.copies(empty).isEmpty()
    assert mixing.mixed(spark.createDataFrame([(1, None, None)], "doc_id int, text string, source string")).first()["taken"] == 0


def test_query_is_its_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert difference(queries.op11_efraimidis_mixing(spark, sf_dir), connect(sf_dir), mixing.ORACLE) is None


def test_plan_moves_numbers_only(spark):
    plan = mixing.mixed(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "text#" not in plan.split("== Physical Plan ==")[1]
    assert not any(x in plan for x in ("Python", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
