"""The pipeline as a whole, against plain Python stage by stage."""

from __future__ import annotations

import random
import zlib

import plain
import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import decision_lists, pii

LABELS = "doc_id long, quality int, toxic int"


def prose(draw, n=90):
    return " ".join("".join(draw.choices("abcdefghijklmnop", k=draw.randrange(3, 8))) for _ in range(n))


def rows():
    draw = random.Random(11)
    out = [(i, prose(draw)) for i in range(40)]
    out += [(50, out[3][1]), (51, out[3][1] + " tail"), (5, prose(draw)), (5, out[7][1]), (None, prose(draw)), (None, prose(draw))]  # copies, shared and null ids
    out += [(60, "too short"), (61, ""), (62, None), (63, "again " * 80), (64, prose(draw) + " mail a.b@c.example.org or +1 415 555 0100 " + prose(draw))]
    return out + [out[9], out[9]]


def folder(spark, path, docs, labels=()):
    frame = spark.createDataFrame([(d, t, "x", 1, "y", 2.5) for d, t in docs], "doc_id long, text string, _row string, _t int, spans string, _uid double")
    frame.withColumn("n_chars", F.length("text")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_is_the_stages_by_hand(spark, tmp_path):
    """Without labels there is nothing to learn, so the base rules alone decide."""
    docs = rows()
    got = corpus_pipeline.run(spark, folder(spark, tmp_path, docs)).collect()
    fit = [(d, t) for d, t in docs if not plain.base_failed(t)]
    classes = plain.near_groups([t for _, t in fit])
    kept = []
    for group in classes:
        order = sorted(group, key=lambda i: (fit[i][0] is None, fit[i][0] or 0, i))
        kept.append(fit[order[0]])
    from tokenizers import Tokenizer
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((-1 if d is None else d, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*tool.encode(plain.redacted(t), add_special_tokens=False).ids, 1]))) for d, t in kept)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids_crc32"]) for r in got) == want
    assert len(want) == 40 + 4 and any(d == 5 for d, _ in want)


def test_every_stage_keeps_the_columns(spark, tmp_path):
    path = folder(spark, tmp_path, rows(), [(i, i % 2, 0) for i in range(20)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.where("_row <> 'x' OR _t <> 1 OR spans <> 'y' OR _uid <> 2.5").isEmpty()
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert docs.where("text LIKE '%[EMAIL]%[PHONE]%'").count() == 1


def test_nothing_goes_through(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [])).isEmpty()


@pytest.mark.parametrize("few", [0, 10_000])
def test_unseen_identifiers_by_either_way(spark, monkeypatch, few):
    """A third of a slot's words are of no known form; their context gives them away, whether keys are written into conditions or joined."""
    monkeypatch.setattr(pii, "FEW", few)
    docs = [(i, f"please reach me via u{i}@mail.example.com before noon, {w}") for i, w in enumerate(prose(random.Random(1), 60).split())]
    docs += [(100 + i, f"please reach me via handle-{i} before noon") for i in range(30)] + [(200, "we reach the office after noon"), (201, None)]
    out = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(out[100 + i] == f"context:20:{28 + (i > 9)}" for i in range(30)) and out[200] == out[201] == ""
    assert all("context" not in out[i] for i in range(60))


def test_rules_of_columns_named_like_the_operators(spark):
    docs = spark.createDataFrame([(1, "a " * 60, 7, 8)], "doc_id long, text string, _w int, _l int")
    assert decision_lists.kept_documents(docs, spark.createDataFrame([], LABELS)).columns == docs.columns


def test_what_a_stage_settles_is_gone_when_the_next_begins(spark, tmp_path):
    """Unless the next stage still reads it, as where nothing was written between."""
    from pathlib import Path

    from tallyspark.plans.staging import settle

    made = []

    @corpus_pipeline.freeing
    def stage(spark, docs, sf_dir):
        made.append(settle(docs.selectExpr("id + 1 AS id"), "inner"))
        return made[-1]

    def there(df):
        return [Path(f.removeprefix("file:")).exists() for f in df.inputFiles()]

    first = stage(spark, spark.range(5).toDF("id"), "")
    second = stage(spark, first, "")
    assert all(there(made[0])) and sorted(r["id"] for r in second.collect()) == [2, 3, 4, 5, 6]
    second.write.parquet(str(tmp_path / "out"))
    old = [f for df in made for f in df.inputFiles()]
    stage(spark, spark.read.parquet(str(tmp_path / "out")), "")
    assert not any(Path(f.removeprefix("file:")).exists() for f in old)
