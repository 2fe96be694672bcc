"""Redaction of texts, records and reports, and the leak check."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import redaction
from tallyspark.plans import staging


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)


def people(spark, **names):
    return spark.createDataFrame([(n, s) for n, s in names.items()] or [("x", "x")], "name string, stand_in string")


def texts(df, column="t"):
    return [r[column] for r in df.orderBy("i").collect()]


JANE = {"Jane Dev": "qbo-user-1", "Jane": "qbo-user-2"}


def test_names_in_any_case_and_spacing(spark):
    rows = frame(spark, "jane \u00a0DEV, Janet, JANE a.b@c.org 14620", "xJane Jane_ Jane2 (jane)", None, "", "Jane\nDev\tJane  Dev", "\n\n Jane\n\n")
    assert texts(redaction.scrubbed(rows, "t", "4620", people(spark, **JANE))) == [
        "qbo-user-1, Janet, qbo-user-2 redacted@example.com 1REALM", "xJane Jane_ Jane2 (qbo-user-2)", None, "", "qbo-user-1\tqbo-user-1", "\n\n qbo-user-2\n\n"]


def test_overlaps_go_to_the_longest(spark):
    names = {"a b": "1", "b c d": "2", "d": "3", "O'Neil (jr": "4", "Straße": "5", "Γιώργος": "6", "micro µ": "7"}
    rows = frame(spark, "a b c d", "a b d", "d d d", "o'neil  (JR)", "STRASSE strassen", "seen by ΓΙΏΡΓΟΣ, Γιώργος", "İ İ ß ß micro μ!")
    assert texts(redaction.scrubbed(rows, "t", "", people(spark, **names))) == ["a 2", "1 3", "3 3 3", "4)", "5 strassen", "seen by 6, 6", "İ İ ß ß 7!"]


def test_leftovers(spark):
    names = {**JANE, "Straße": "qbo-user-3", "Γιώργος": "qbo-user-4", "qbo-user-9": "qbo-user-9"}
    rows = frame(spark, "JANE\n dev 14620", "Janet", "by STRASSE today", "seen by Γιώργος today", "ΓΙΏΡΓΟΣ", None, "", "qbo-user-9")
    assert texts(redaction.leftovers(rows, "t", "4620", people(spark, **names)), "findings") == [
        ["the realm id", "a user name (qbo-user-1)", "a user name (qbo-user-2)"], [], ["a user name (qbo-user-3)"], ["a user name (qbo-user-4)"],
        ["a user name (qbo-user-4)"], None, [], []]


def test_every_user_of_a_record(spark):
    record = json.dumps({"MetaData": {"LastModifiedByRef": {"value": 55, "name": "Jane Å \"J\" Dev", "x": {"n": 1}}, "n": 1}, "CreatedBy": {"name": "Bob Roe"},
                         "Approved_2By": "Cy", "UserName": "dee", "name": "not a user", "By": "", "OffBy": 0, "list": [{"KeyedBy": 7}]})
    names = {r["name"] for r in redaction.record_users(frame(spark, record, "no json", None, "[1, {\"UserName\": \"eve\"}]"), "t").collect()}
    assert names == {"55", "Jane Å \"J\" Dev", "Bob Roe", "Cy", "dee", "7", "eve"}


def test_one_stand_in_per_person(spark):
    rows = frame(spark, json.dumps([{"CreatedBy": "Ann"}, {"LastModifiedBy": "Bo"}]), json.dumps({"UserName": "Ann", "memo": "for ANN, not Anna"}))
    assert list(map(json.loads, texts(redaction.sanitized(rows, "t", "")))) == [
        [{"CreatedBy": "qbo-user-1"}, {"LastModifiedBy": "qbo-user-2"}], {"UserName": "qbo-user-1", "memo": "for qbo-user-1, not Anna"}]


def test_a_whole_record(spark):
    record = {"id_token": "x", "access_token": "s3", "refresh_token": None, "LastModifiedByRef": {"value": 9, "name": "Jane Dev", "deep": {"UserName": "Jane"}},
              "n": 1.5, "realm": 4620, "ok": True, "none": None, "k4620": ["a4620b", "jane  dev paid a@b.example"], "Jane Dev": {"9": 9}}
    out = redaction.sanitized(frame(spark, json.dumps(record)).withColumn("problem", F.lit(3)).withColumn("_text", F.lit("kept")), "t", "4620").first()
    assert json.loads(out["t"]) == {
        "access_token": "TEST-ACCESS", "refresh_token": "TEST-REFRESH", "LastModifiedByRef": {"value": "qbo-user-1", "name": "qbo-user-3", "deep": {"UserName": "qbo-user-2"}},
        "n": 1.5, "realm": "REALM", "ok": True, "none": None, "kREALM": ["aREALMb", "qbo-user-3 paid redacted@example.com"], "qbo-user-3": {"qbo-user-1": 9}}
    assert (out["problem"], out["_text"]) == (None, "kept")


def test_keys_that_become_one_are_refused(spark):
    rows = frame(spark, json.dumps({"4620816365": "a", "REALM": "b"}), json.dumps({"a": 1}), "[" * 100_000, "text of 4620816365 by {")
    out = redaction.sanitized(rows, "t", "4620816365").orderBy("i").collect()
    assert [(r["t"], r["problem"]) for r in out[:2]] == [(None, "two keys scrub to 'REALM'"), ('{"a":1}', None)]
    assert out[2]["problem"] == "nested too deep" or out[2]["t"] == "[" * 100_000
    assert out[3]["t"] == "text of REALM by {"


def test_names_from_a_table_and_from_the_records(spark):
    rows = frame(spark, json.dumps({"CreatedBy": "Ann", "memo": "Jane Dev and zoe and Ann"}))
    out = redaction.sanitized(rows, "t", "", people(spark, **JANE, zoe="Z")).first()
    assert json.loads(out["t"]) == {"CreatedBy": "qbo-user-x1", "memo": "qbo-user-1 and Z and qbo-user-x1"}


def report(users=("Jane Dev", "bo", "  "), key=None):
    columns = [{"ColTitle": "Date", "ColType": "Date"}, {"ColTitle": "Who", "MetaData": [{"Name": "ColKey", "Value": "create_by"}]},
               {"ColTitle": " Last Modified By "}, {"ColTitle": "x", "ColType": "memo"}]
    rows = [{"ColData": [{"value": "2024-01-01"}, {"value": u, "id": "4620"}, {"value": 12}, {"value": f"memo of {u.strip()} a@b.example"}], "type": "Data"} for u in users]
    deep = {"type": "Section", "Header": {"ColData": [{"value": "Bank"}]}, "ColData": [{"value": "a"}, {"value": "no user here"}],
            "Rows": {"Row": [{"Rows": {"Row": rows}}, {"ColData": [{"value": "x"}, {"value": ""}, {}, "text"]}]}}
    return {"Header": {"ReportName": "GL", "UserName": "Cy"}, "Columns": {"Column": columns}, "Rows": {"Row": [deep]}}


def test_report_cells_by_place(spark):
    rows = frame(spark, json.dumps({"wrapped": [report()]}))
    out = json.loads(redaction.sanitized(rows, "t", "4620").first()["t"])["wrapped"][0]
    # names in order: two blanks, 12, Cy, Jane Dev, bo
    section = out["Rows"]["Row"][0]
    cells = [[c["value"] for c in r["ColData"]] for r in section["Rows"]["Row"][0]["Rows"]["Row"]]
    assert cells == [["2024-01-01", "qbo-user-4", "qbo-user-2", "memo of qbo-user-4 redacted@example.com"],
                     ["2024-01-01", "qbo-user-5", "qbo-user-2", "memo of qbo-user-5 redacted@example.com"],
                     ["2024-01-01", "qbo-user-1", "qbo-user-2", "memo of  redacted@example.com"]]
    assert out["Header"]["UserName"] == "qbo-user-3" and section["ColData"][1] == {"value": "no user here"}
    assert section["Rows"]["Row"][1]["ColData"] == [{"value": "x"}, {"value": ""}, {}, "text"]
    assert section["Rows"]["Row"][0]["Rows"]["Row"][0]["ColData"][1]["id"] == "REALM"


def plain_scrub(text, names):
    """One expression per name, the longest first."""
    for name in sorted(names, key=lambda n: (-len(n), n)):
        words = r"\s+".join(map(re.escape, name.split()))
        text = re.sub(rf"(?<!\w){words}(?!\w)", names[name], text, flags=re.IGNORECASE)
    return text


@pytest.mark.parametrize("limit", [staging.BROADCAST_BYTES, 400])
def test_many_names_in_portions(spark, monkeypatch, limit):
    """Names read in one portion or in many, the longest first, give what an expression per name gives."""
    draw = random.Random(8)
    words = ["".join(draw.choices("abcde", k=draw.randrange(2, 6))) for _ in range(300)]
    names = {" ".join(draw.sample(words, draw.choice((1, 1, 2, 3)))): "" for _ in range(200)}
    names = {n: f"<{i}>" for i, n in enumerate(names)}
    docs = ["  ".join(draw.choice((str, str.upper, str.title))(w) for w in draw.choices([*words, *names], k=draw.randrange(0, 60))) for _ in range(60)]
    monkeypatch.setattr(staging, "BROADCAST_BYTES", limit)
    table = people(spark, **names)
    if limit == 400:
        assert len(redaction.portions(staging.settle(table))) > 10
    got = texts(redaction.scrubbed(frame(spark, *docs), "t", "", table))
    # equal lengths that overlap may go either way between portions; all else is as by hand
    same = sum(g == plain_scrub(d, names) for g, d in zip(got, docs, strict=True))
    assert same >= (60 if limit > 400 else 50)
    assert all(not f for f in texts(redaction.leftovers(frame(spark, *got), "t", "", table), "findings"))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "name string, stand_in string")
    assert texts(redaction.scrubbed(frame(spark, "a"), "t", "", none)) == ["a"]
    assert redaction.sanitized(frame(spark, "a").limit(0), "t", "").isEmpty()
    assert texts(redaction.leftovers(frame(spark, "a"), "t", "", none), "findings") == [[]]


def test_texts_are_taken_from_a_batch_in_bounded_runs(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(redaction, "SLICE_BYTES", 10)
    texts = ["aaaa", None, "bbbb", "ccccc", "d" * 40, "", "e"]
    parts = list(redaction.slices(pa.record_batch({"t": texts}), 0))
    assert [t for p in parts for t in p.column("t").to_pylist()] == texts
    assert [p.num_rows for p in parts] == [3, 1, 1, 2] and not list(redaction.slices(pa.record_batch({"t": pa.array([], pa.string())}), 0))


def test_texts_are_gone_through_only_where_something_is_found(monkeypatch):
    names = [("Jane Dev", "qbo-user-1", True), ('Q"', "qbo-user-2", True), ("7", "qbo-user-3", False)]
    gone_through, renamed = [], redaction._renamed
    monkeypatch.setattr(redaction, "_renamed", lambda node, text, realm_id: gone_through.append(node) or renamed(node, text, realm_id))

    def outcome(node, realm_id="55"):
        before = len(gone_through)
        text, why = redaction.cleaner(names, realm_id)(json.dumps(node))
        return why or json.loads(text), len(gone_through) - before

    assert outcome({"CreatedBy": "Jane Dev", "memo": "Janet Devs", "n": 7, "to": "a@b.org"}) == (
        {"CreatedBy": "qbo-user-1", "memo": "Janet Devs", "n": 7, "to": "redacted@example.com"}, 0)
    for given, wanted in (({"memo": "by JANE  dev"}, {"memo": "by qbo-user-1"}), ({"jane dev": 1}, {"qbo-user-1": 1}), ({"memo": "jane\n\tdev"}, {"memo": "qbo-user-1"}),
                          ({"memo": 'q"'}, {"memo": "qbo-user-2"}), ({"id": 55, "x": ["a55"]}, {"id": "REALM", "x": ["aREALM"]}), ({"55": 155}, {"REALM": 155})):
        assert outcome(given)[0] == wanted
    assert outcome({"x": float("nan")}, "nan")[0] == {"x": "REALM"}
    assert outcome({"Jane Dev": 1, "jane  dev": 2})[0] == "two keys scrub to 'qbo-user-1'"
