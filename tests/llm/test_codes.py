from __future__ import annotations

import base64
import zlib

import numpy as np
import plain
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import bpe, lz_fingerprint, pretokens, shared_files, spans, token_store, warc
from tallyspark.llm.queries import RANKS, VOCABULARY


@pytest.fixture(scope="module")
def rank_tool():
    import tiktoken
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab s't'rell 1²٣\n\t 　!<|>dvm.é́\U0001F600'")), max_size=30), max_size=5))
def test_pieces_are_the_patterns(texts):
    import regex
    points, _ = spans.code_points(texts)
    starts, stops = pretokens.pieces(points)
    whole = "\n".join(texts)
    assert [whole[a:b] for a, b in zip(starts, stops, strict=True)] == [m for t in texts for m in regex.findall(public_tokenizers.PATTERN, t)]


def test_replay_as_the_library(docs, odd_texts, rank_tool):
    out = bpe.encode(docs, RANKS, ["doc_id", "spans"])
    got = {r["doc_id"]: r for r in out.collect()}
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(out, RANKS).collect()}
    for i, text in enumerate(odd_texts):
        ids = rank_tool.encode_ordinary(text or "")
        assert np.frombuffer(got[i * 3]["ids"], "<u4").tolist() == ids and got[i * 3]["n_tokens"] == len(ids)
        assert bytes(back[i * 3]) == (text or "").encode()


def test_replay_of_random_words(rank_tool):
    draw = np.random.default_rng(4)
    words = ["".join(draw.choice(list("abcdeet aaonßé漢"), draw.integers(1, 40))) for _ in range(3000)] + ["a" * 777, "=" * 500, ""]
    ids, counts = bpe.replay([w.encode() for w in words], bpe.ranks(RANKS))
    at = 0
    for word, n in zip(words, counts.tolist(), strict=True):
        assert ids[at:at + n].tolist() == (rank_tool._core_bpe.encode_single_piece(word.encode()) if word else [])
        at += n


def test_nothing_to_encode(empty):
    assert bpe.decode(bpe.encode(empty, RANKS), RANKS).count() == 0
    assert token_store.round_trip(empty, VOCABULARY).count() == 0
    assert lz_fingerprint.edited_and_next(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 50256), st.integers(0, 2**64 - 1)), max_size=400), st.sampled_from([1, 7, 64, 8192]))
def test_simple8b_round_trip(ids, block):
    words, starts = token_store.pack(np.array(ids, np.uint64), block)
    assert token_store.unpack(words).tolist() == ids
    for k, first in enumerate(starts.tolist()):
        stop = starts.tolist()[k + 1] if k + 1 < len(starts) else len(words)
        assert token_store.unpack(words[first:stop]).tolist() == ids[k * block:(k + 1) * block]


def test_simple8b_file(tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_IDS", 3000)
    ids = np.random.default_rng(1).integers(0, 50257, 20_000).astype(np.uint32)
    out = token_store.Writer(f"file://{tmp_path}/a/x.s8b", block=256)
    parts = np.split(ids, [0, 0, 1, 900, 901, 902, 903, 904, 905, 9000, 12000, 19_999, 20_000])
    for doc, part in enumerate(parts):
        out.add(None if doc == 3 else -doc, part)
    segments = list(out.close(5))
    assert sum(s[1] for s in segments) == len(parts) and len(segments) > 4 and max(s[1] for s in segments) <= 5
    file = token_store.Reader(out.uri)
    for first, n, start, size in segments:
        assert file.ids(start, size).tolist() == ids[start:start + size].tolist()
        assert list(file.documents(first, n)) == [(None if d == 3 else -d, len(parts[d])) for d in range(first, first + n)]


def test_files_in_the_store_of_spark(spark, tmp_path):
    assert shared_files.folder(spark, str(tmp_path)) == f"file://{tmp_path}"
    assert shared_files.task_uri("file:/a/b") == shared_files.task_uri("file:///a/b") == "file:///a/b"
    assert shared_files.task_uri("s3a://bucket/x") == "s3://bucket/x" and shared_files.task_uri("hdfs://name:1/x") == "hdfs://name:1/x"


def test_the_store_is_read_by_many_tasks(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of"), F.col("id").cast("string")).alias("text"))
    rows = token_store.round_trip(docs.repartition(3), VOCABULARY, segment=16)
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 4 and max(r["count"] for r in sizes) <= 100 and rows.count() == 600


def test_added_tokens_as_the_library():
    from tokenizers import Tokenizer
    from tallyspark.llm import pretokens
    tool = Tokenizer.from_file(VOCABULARY)
    end = "<|endoftext|>"
    texts = [end, f"a {end} b", f"{end}{end}x  {end}  ", f"it{end}'s  {end[:-1]} {end.upper()}", None, "", f"  {end}\n\n{end[1:]}", "plain words"]
    got = [ids.tolist() for ids in pretokens.encoded_by(VOCABULARY, texts)]
    assert got == [tool.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got[0] == [50256]


def test_token_store(docs, odd_texts):
    from tokenizers import Tokenizer
    tool = Tokenizer.from_file(VOCABULARY)
    rows = sorted(token_store.round_trip(docs.union(docs.where("doc_id = 9")), VOCABULARY).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        ids = [*tool.encode(odd_texts[r["doc_id"] // 3] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], zlib.crc32(r["ids"])) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [r["doc_id"] for r in rows] == sorted([*(i * 3 for i in range(len(odd_texts))), 9])


def test_fingerprints(docs, odd_texts):
    for parts in (1, 4):
        got = {r["doc_id"]: r for r in lz_fingerprint.edited_and_next(docs, parts).collect()}
        assert len(got) == len(odd_texts)
        for i, text in enumerate(odd_texts):
            text, after = text or "", odd_texts[(i + 1) % len(odd_texts)] or ""
            k = len(text) // 4
            edited = text[:len(text) - k] + after[:k]
            row = got[i * 3]
            assert (row["n_chars"], row["edited_sha256"]) == (len(text), plain.sha(edited.encode()))
            marks = [lz_fingerprint.fingerprint(t) for t in (text, edited, after)]
            assert (row["fingerprint"], row["edited_fingerprint"]) == tuple(marks[:2])
            codes = [np.frombuffer(bytes.fromhex(m), ">u2") for m in marks]
            assert row["near_edited"] == lz_fingerprint.likeness(codes[0], codes[1]) and row["near_next"] == lz_fingerprint.likeness(codes[0], codes[2])


def test_phrases_are_lz78():
    text = "abababcabcaaaabbbab" * 20
    seen, at, cuts = set(), 0, []
    for stop in range(1, len(text) + 1):
        if text[at:stop] not in seen:
            seen.add(text[at:stop])
            cuts.append(stop)
            at = stop
    phrases = lz_fingerprint.Phrases()
    phrases.read([ord(c) for c in text[:100]], 0)
    branch = phrases.branch()
    branch.read([ord(c) for c in text[100:]], 100)
    assert branch.cuts == cuts


def test_likeness_follows_shared_phrases():
    def phrases(text):
        seen, at = set(), 0
        for stop in range(1, len(text) + 1):
            if text[at:stop] not in seen:
                seen.add(text[at:stop])
                at = stop
        return seen
    draw = np.random.default_rng(8)
    words = ["".join(draw.choice(list("etaoinshr"), draw.integers(2, 8))) for _ in range(200)]
    errors = []
    for _ in range(20):
        base = " ".join(draw.choice(words, 600))
        other = base[:int(len(base) * draw.uniform(0.1, 1))] + " ".join(draw.choice(words, 200))
        a, b = phrases(base), phrases(other)
        one, two = (np.frombuffer(bytes.fromhex(lz_fingerprint.fingerprint(t)), ">u2") for t in (base, other))
        errors.append(lz_fingerprint.likeness(one, two) - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.03


def test_warc_round_trip(spark):
    long = "é" * 60
    rows = [(5, "http://a/ b\r\nX: y", long), (3, None, long), (9, "u", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", long), (7, "u", "x" * 99),
            (8, "u", "x" * 99), (10, "u", "\r\n\r\n" * 50), (3, "again", long), (None, None, "z" * 200), (11, "u", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "kept out") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write(pages)
    got = warc.read(index).collect()
    assert len(got) == len(rows)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        visit = 3 if html == long and page != 3 else None
        want.append((page, len(data), plain.sha(data), "revisit" if visit else "response", visit))
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    payloads = {r["page_id"]: r["payload"] for r in got if r["record_type"] == "response" and r["page_id"] is not None}
    assert all(bytes(payloads[p]) == (h or "").encode() for p, _, h in rows if p in payloads)
    some = warc.read(index.where("page_id IN (1, 11)")).collect()
    assert {r["page_id"] for r in some} == {1, 11}


def test_warc_of_nothing(spark):
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_ranges_join_neighbours():
    out = list(warc.ranges([(0, 10), (10, 5), (100, 5), (10**6, 7), (2 * 10**6, 10**7)]))
    assert [(a, b, len(x)) for a, b, x in out] == [(0, 105, 3), (10**6, 10**6 + 7, 1), (2 * 10**6, 12 * 10**6, 1)]
