"""The review log on storage: two append-only tables that grow by whole commits."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import strip
from tallyspark.operators import review
from tallyspark.plans.staging import settle
from tallyspark.schema import LedgerError
from tallyspark.sources.commits import Commits, Rows


SCHEMAS = {"decisions": review.DECISION_SCHEMA, "narratives": review.NARRATIVE_SCHEMA}


class ReviewLog:
    """Decisions and notes of every ledger under ``folder``, bound to one ledger. Every call that
    records is one commit: all of it is seen, or none."""

    def __init__(self, spark: SparkSession, folder: str, ledger_id: str) -> None:
        self.spark, self.folder = spark, folder
        self.commits = Commits(spark, folder, SCHEMAS)
        self.ledger_id = review.check_ledger_id(ledger_id)

    @property
    def decisions(self) -> DataFrame:
        return self.commits.table("decisions")

    @property
    def narratives(self) -> DataFrame:
        return self.commits.table("narratives")

    def _append(self, rows: DataFrame, name: str, order: list[str]) -> None:
        rows = rows.select("_key", *[f for f in SCHEMAS[name].names if f != "id"])
        self.commits.publish(lambda _, add: add(name, (rows, order)))

    def _keyed(self, batch: DataFrame, order: str | None) -> DataFrame:
        """``batch`` with ``_key``, the order its rows were made in: the column ``order``, or any where
        no entry is there twice. The latest row of an entry counts, so a repeat without one is refused."""
        if order is None and not batch.groupBy("entry_id").count().where("count > 1").isEmpty():
            raise LedgerError("the batch has several rows of one entry; name the column that orders them")
        return batch.withColumn("_key", F.col(order) if order else F.col("entry_id"))

    def record(self, batch: DataFrame, order: str | None = None) -> None:
        """Append decisions; the whole batch is refused when any row is unfit. ``order`` names the column
        that says which decision of an entry came later."""
        batch = self._keyed(batch, order)
        problems = review.decision_problems(batch, self.narratives, self.ledger_id)
        if problems:
            raise LedgerError("; ".join(problems))
        now = datetime.now(timezone.utc).isoformat(timespec="seconds")
        rows = batch.withColumns({"ledger_id": F.lit(self.ledger_id), "reviewer": strip(F.col("reviewer")),
                                  "decided_at": F.lit(now)})
        self._append(settle(rows), "decisions", ["_key", "entry_id"])

    def save_narratives(self, batch: DataFrame, order: str | None = None) -> None:
        """Append notes as new versions, in the order of the column ``order``; nothing is replaced."""
        batch = self._keyed(batch, order)
        now = datetime.now(timezone.utc).isoformat(timespec="seconds")
        rows = batch.withColumns({"ledger_id": F.lit(self.ledger_id), "generated_at": F.lit(now)})
        self._append(settle(rows), "narratives", ["_key", "entry_id"])

    def take_in(self, decisions: DataFrame, narratives: DataFrame) -> None:
        """Rows of an older log, with their ids and ledgers, as the first commit of an empty one."""
        def build(manifests: list[dict], add: Callable[[str, Rows], DataFrame]) -> None:
            if manifests:
                raise LedgerError("rows with ids are taken in only by an empty log")
            for name, rows in (("decisions", decisions), ("narratives", narratives)):
                add(name, (rows.select(*SCHEMAS[name].names), None))

        self.commits.publish(build)

    def adopt_legacy(self, entry_ids: DataFrame | None = None) -> None:
        """Copy legacy rows into this ledger as new rows, notes and decisions in one commit; the originals stay."""
        def build(manifests: list[dict], add: Callable[[str, Rows], DataFrame]) -> None:
            decisions, narratives = (self.commits.table(name, manifests) for name in SCHEMAS)
            held = review.mine(decisions, self.ledger_id).count() + review.mine(narratives, self.ledger_id).count()
            if held:
                raise LedgerError(f"ledger {self.ledger_id} already holds {held} row(s); legacy rows are adopted only into a ledger with none")
            old, notes = settle(review.mine(decisions, review.LEGACY)), settle(review.mine(narratives, review.LEGACY))
            self._refuse_strays(old, notes, entry_ids)
            here = {"ledger_id": F.lit(self.ledger_id)}
            copies = add("narratives", (notes.withColumns(here).withColumn("_old", F.col("id")), ["_old"]))
            remap = copies.select(F.col("_old").alias("narrative_id"), F.col("id").alias("new_id"))
            moved = old.withColumnRenamed("id", "_old").join(remap, "narrative_id", "left")
            add("decisions", (moved.withColumns(here | {"narrative_id": F.col("new_id")}).drop("new_id"), ["_old"]))

        self.commits.publish(build)

    @staticmethod
    def _refuse_strays(old: DataFrame, notes: DataFrame, entry_ids: DataFrame | None) -> None:
        if entry_ids is not None:
            strays = old.select("entry_id").unionByName(notes.select("entry_id")).distinct().join(
                entry_ids.select("entry_id").distinct(), "entry_id", "left_anti").agg(F.count("*"), F.min("entry_id")).first()
            if strays[0]:
                raise LedgerError(f"{strays[0]} legacy row(s) name entries not in this ledger (e.g. {strays[1]}); they were written for a different ledger")
        loose = old.filter(F.col("narrative_id").isNotNull()).join(
            notes.select(F.col("id").alias("narrative_id")), "narrative_id", "left_anti").agg(F.min("id")).first()[0]
        if loose is not None:
            raise LedgerError(f"legacy decision {loose} records a narrative that is not a legacy narrative")
