"""The registered queries: one Spark callable each, and its DuckDB twin where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.catalog import views
from tallyspark.catalog.oracles import statement
from tallyspark.operators import forest, journal_tests
from tallyspark.operators.entries import account_amounts
from tallyspark.operators.features import build_features
from tallyspark.plans.staging import settle

Query = Callable[["Staged"], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = statement(re.sub(r"\n\s*", " ", sql).strip(), extra)
        return fn
    return add


class Staged:
    """What several queries share, derived from the tables and written once per session."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return views.table(self.spark, self.sf_dir, name)

    @cached_property
    def lines(self) -> DataFrame:
        return settle(views.ledger(self.spark, self.sf_dir), "lines", wide=True)

    @cached_property
    def settings(self) -> journal_tests.Settings:
        return journal_tests.Settings(controls=views.CONTROLS)

    @cached_property
    def entries(self) -> DataFrame:
        return journal_tests.staged_entries(self.lines, self.settings)

    @cached_property
    def ids(self) -> DataFrame:
        """The entries' ids; where nothing has asked for the entries' facts, those are not worked out for them."""
        if "entries" in self.__dict__:
            return self.entries.select("entry_id")
        return settle(self.lines.select("entry_id").distinct(), "ids")

    @cached_property
    def stats(self) -> DataFrame:
        return settle(account_amounts(self.lines), "accounts")

    @cached_property
    def flags(self) -> DataFrame:
        return settle(journal_tests.run_tests(self.lines, settings=self.settings, entries=self.entries, stats=self.stats), "flags", wide=True)

    @cached_property
    def scored(self) -> DataFrame:
        return settle(journal_tests.score_entries(self.entries, self.flags, ordered=False), "scored", wide=True)

    @cached_property
    def scores(self) -> DataFrame:
        return settle(views.stand_in_scores(self.ids), "scores")

    @cached_property
    def combined(self) -> DataFrame:
        return forest.combine(self.scored, self.scores, ordered=False)

    @cached_property
    def labels(self) -> DataFrame:
        return settle(views.label_view(self.ids), "labels")

    @cached_property
    def _review(self) -> tuple[DataFrame, DataFrame]:
        decisions, notes = views.review_views(self.ids)
        return settle(decisions, "decisions"), settle(notes, "notes")

    @property
    def decisions(self) -> DataFrame:
        return self._review[0]

    @property
    def notes(self) -> DataFrame:
        return self._review[1]

    @cached_property
    def features(self) -> DataFrame:
        return settle(build_features(self.lines, self.entries, self.stats), "features")


_STAGED: dict[tuple[str, str], Staged] = {}


def staged(spark: SparkSession, sf_dir: str) -> Staged:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STAGED:
        _STAGED[key] = Staged(spark, sf_dir)
    return _STAGED[key]


def flat(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and timestamps as text, the forms both engines agree on."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("bigint") if f.dataType.scale == 0 else c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)
