from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import plain
import public_tokenizers
import pytest

from tallyspark.llm import decision_lists, packing, pii
from tallyspark.llm.queries import VOCABULARY


def test_quality_counts(docs, odd_texts, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in decision_lists.judged(docs, labels, ["doc_id", "spans", "n_words"]).collect()}
    assert len(got) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        want = plain.quality(text)
        assert {k: got[i * 3][k] for k in want} == want, text and text[:60]
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert got[i * 3]["base_failed"] == failed and got[i * 3]["kept"] == (not failed)


def test_learned_list_finds_planted_rule(spark):
    rows = [(i, ("good word number %d of the text here " % i) * 1 + " ".join(f"w{(i * 7 + k) % 997}" for k in range(60)) + (" ***" * 30 if i % 4 == 0 else ""))
            for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(400)] + [(None, 0), (1, 0)], "doc_id long, quality int")
    out = decision_lists.judged(frame, labels, ["doc_id"]).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in out)
    kept = decision_lists.kept_documents(frame, labels)
    assert kept.columns == frame.columns and kept.count() == 300


def test_quality_of_nothing(empty, spark):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    assert decision_lists.judged(empty, labels, ["doc_id"]).count() == 0
    assert decision_lists.kept_documents(empty, labels).columns == empty.columns


def test_personal_data_base(docs, odd_texts):
    got = {r["doc_id"]: r for r in pii.personal_data(docs, ["doc_id", "figures"]).collect()}
    for i, text in enumerate(odd_texts):
        spans = plain.base_spans(text)
        row = got[i * 3]
        assert row["base_sha256"] == plain.sha(plain.written(spans).encode()), (text and text[:80], row["spans"][:200], spans[:5])
        for kind in plain.PATTERNS:
            assert row[f"n_{kind}"] == sum(s[3] == kind for s in spans)


def test_contexts_find_unseen(spark):
    rows = [(i, f"please write to user{i}@mail.example.com today about case {i}") for i in range(40)]
    rows += [(100, "please write to name7@intranet today about it"), (101, "the year 1999 was good")]
    out = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100] == "context:16:30" and out[101] == ""


def test_contexts_find_many_unseen_of_one_form(spark):
    rows = [(i, f"please write to user{i}@mail.example.com today about case {i}") for i in range(40)]
    rows += [(100 + i, f"please write to name{i}@intranet today about it") for i in range(20)]
    rows += [(200, "card 4111 1111 1111 1111"), (201, "please write to 1111 today about it")]
    rows += [(300 + i, f"go to page{i} now") for i in range(2)]
    out = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[100 + i] == f"context:16:{29 + len(str(i))}" for i in range(20)) and "context:16:20" in out[201]


def test_contexts_without_a_digit(spark):
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(i, f"please write to {name(i)}.doe@mail.example.com today about it") for i in range(40)]
    rows += [(100, "please write to Jane-Handle today about it"), (101, "ask\tJane-Handle"), (102, "please write to us today about it")]
    rows += [(200 + i, f"go to us {name(i)} or to {name(i)}") for i in range(300)]
    out = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100] == "context:16:27" and out[101] == "context:4:15" and out[102] == ""
    assert not any("context" in s for i, s in out.items() if i not in (100, 101))


def test_redacted(docs, odd_texts):
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, text in enumerate(odd_texts):
        want, at = [], 0
        merged: list[list] = []
        for a, _, b, kind in plain.base_spans(text):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b, kind])
        for a, b, kind in merged:
            want.append(text[at:a] + f"[{kind.upper()}]")
            at = b
        assert got[i * 3] == ("".join(want) + text[at:] if merged else text)


def test_nothing_to_redact(empty):
    assert pii.redacted(empty).count() == 0 and pii.personal_data(empty).count() == 0


@pytest.fixture(scope="module")
def tool():
    from tokenizers import Tokenizer
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tool


def test_packing(docs, odd_texts, tool):
    rows = packing.pack_documents(docs.union(docs.where("doc_id = 9")), VOCABULARY, ["doc_id", "spans"]).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in enumerate(odd_texts):
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[i * 3], key=lambda r: r["start"])
        if i == 3:
            assert len(parts) == 2 and all(r["length"] == len(ids) for r in parts)
            continue
        assert [x for r in parts for x in np.frombuffer(r["ids"], "<u4").tolist()] == ids
        assert [r["start"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)])[:-1].tolist()
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"]) for r in parts)
    for held in by_sequence.values():
        held.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in held] == np.cumsum([0, *(r["length"] for r in held)])[:-1].tolist()
        assert sum(r["length"] for r in held) <= 2048


def test_packing_nothing(empty):
    assert packing.pack_documents(empty, VOCABULARY).count() == 0


def test_first_fit_decreasing_as_by_hand():
    draw = np.random.default_rng(3)
    for n in (1, 2, 7, 300):
        sizes = draw.integers(1, 2049, n)
        bins, places = packing.first_fit_decreasing(sizes)
        room: list[int] = []
        for k in np.argsort(-sizes, kind="stable"):
            at = next((i for i, r in enumerate(room) if r >= sizes[k]), len(room))
            if at == len(room):
                room.append(2048)
            assert (bins[k], places[k]) == (at, 2048 - room[at])
            room[at] -= int(sizes[k])
