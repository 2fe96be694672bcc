"""Commits of the review log: whole or not at all, one writer after the other."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from test_records import decisions

from tallyspark.operators import review
from tallyspark.schema import LedgerError
from tallyspark.sources import commits
from tallyspark.sources.review_log import ReviewLog


def legacy(spark, folder):
    """A log with two notes and two decisions filed under no ledger."""
    log = ReviewLog(spark, folder, "csv:other")
    log.ledger_id = review.LEGACY
    notes = spark.createDataFrame([("e1",), ("e2",)], "entry_id string")
    for f in review.NARRATIVE_SCHEMA.fields:
        if f.name not in ("entry_id", "id", "ledger_id"):
            notes = notes.withColumn(f.name, F.lit(None).cast(f.dataType))
    log.save_narratives(notes)
    ids = {r["entry_id"]: r["id"] for r in log.narratives.collect()}
    log.record(decisions(spark, ("e1", "accept", "Ann", ids["e1"]), ("e2", "dismiss", "Bo", None)))
    return log


def test_a_failed_adoption_leaves_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "log")
    legacy(spark, folder)
    log = ReviewLog(spark, folder, "csv:a")
    before = len(log.commits.manifests())
    whole, calls = commits.numbered, []

    def breaks(*args):
        calls.append(args)
        if len(calls) == 2:  # the notes are written, the decisions are not
            raise OSError("executor lost")
        return whole(*args)

    monkeypatch.setattr(commits, "numbered", breaks)
    with pytest.raises(OSError, match="executor lost"):
        log.adopt_legacy()
    monkeypatch.setattr(commits, "numbered", whole)
    assert len(log.commits.manifests()) == before
    assert review.mine(log.narratives, "csv:a").isEmpty() and review.mine(log.decisions, "csv:a").isEmpty()
    log.adopt_legacy()
    notes, made = review.mine(log.narratives, "csv:a").collect(), review.mine(log.decisions, "csv:a").orderBy("entry_id").collect()
    assert {r["entry_id"]: r["id"] for r in notes} == {"e1": 3, "e2": 4} and [r["narrative_id"] for r in made] == [3, None]
    assert [m["last"] for m in log.commits.manifests()][-1] == {"narratives": 4, "decisions": 4}
    with pytest.raises(LedgerError, match="already holds 4"):
        log.adopt_legacy()


def test_two_writers_take_no_id_twice(spark, tmp_path, monkeypatch):
    one, two = (ReviewLog(spark, str(tmp_path / "log"), name) for name in ("csv:a", "csv:b"))
    whole, met = commits.Commits._put, []

    def late(self, number, manifest):
        """The other writer commits between this one's reading and its commit, three times."""
        if self is one.commits and len(met) < 3:
            met.append(number)
            two.record(decisions(spark, (f"x{len(met)}", "accept", "Bo", None)))
        return whole(self, number, manifest)

    monkeypatch.setattr(commits.Commits, "_put", late)
    one.record(decisions(spark, ("e1", "accept", "Ann", None), ("e2", "accept", "Ann", None)))
    rows = one.decisions.orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2, 3, 4, 5] and [r["ledger_id"] for r in rows] == ["csv:b"] * 3 + ["csv:a"] * 2
    assert [m["number"] for m in one.commits.manifests()] == [1, 2, 3, 4] and met == [1, 2, 3]


def test_a_manifest_never_replaces_another(spark, tmp_path):
    log = commits.Commits(spark, str(tmp_path / "log"), {"t": review.DECISION_SCHEMA})
    for data, done in (("first", True), ("second", False)):
        (tmp_path / "log" / "data" / data).mkdir(parents=True)
        assert log._put(1, {"number": 1, "data": data, "last": {}}) is done
    assert [m["data"] for m in log.manifests()] == ["first"]


def test_nothing_to_write_is_no_commit(spark, tmp_path):
    log = commits.Commits(spark, str(tmp_path / "log"), {"t": review.DECISION_SCHEMA})
    assert log.publish(lambda manifests, add: None) == 0 and log.manifests() == [] and log.table("t").isEmpty()
    assert isinstance(log.table("t"), DataFrame)
