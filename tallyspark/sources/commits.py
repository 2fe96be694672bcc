"""Tables that grow by whole commits: several tables at once, or nothing.

Rows are written to a folder of their own first. A commit is a small manifest with the next number; it names the folder and
the last id of each table, and is put in place, complete, only if no manifest has that number yet. Readers read what manifests
name. So a writer that fails leaves nothing to be read, and of two writers one comes second and starts anew from the other's ids.
The store must be one that can rename without overwriting (HDFS, ABFS, a local or mounted disk), as for streaming checkpoints.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tallyspark.plans.staging import numbered
from tallyspark.schema import LedgerError

#: Rows of one table, and the columns that order those still without ids (a unique key); None: their ids stay.
Rows = tuple[DataFrame, list[str] | None]
ATTEMPTS = 20


class Commits:
    """The tables ``schemas`` under ``folder``; each has an ``id`` that grows by one a row."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, T.StructType]) -> None:
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas

    def manifests(self) -> list[dict]:
        """One small dict per commit, in their order."""
        try:
            rows = self.spark.read.text(f"{self.folder}/commits").collect()
        except AnalysisException as failed:
            if failed.getCondition() != "PATH_NOT_FOUND":
                raise
            return []  # nothing committed yet
        return sorted((json.loads(r["value"]) for r in rows), key=lambda m: m["number"])

    def table(self, name: str, manifests: list[dict] | None = None) -> DataFrame:
        """The committed rows of one table."""
        done = self.manifests() if manifests is None else manifests
        paths = [f"{self.folder}/data/{m['data']}/{name}" for m in done if name in m["last"]]
        reader = self.spark.read.schema(self.schemas[name])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[name])

    @staticmethod
    def last(manifests: list[dict], name: str) -> int:
        return max((m["last"][name] for m in manifests if name in m["last"]), default=0)

    def publish(self, build: Callable[[list[dict], Callable[[str, Rows], DataFrame]], None]) -> int:
        """Commits what ``build`` adds, and returns the commit's number. ``build`` gets the manifests so far and a function that adds
        rows to a table, in an order, and returns them as written, with their ids; it is called anew when another writer came first."""
        for _ in range(ATTEMPTS):
            manifests = self.manifests()
            number, data = (manifests[-1]["number"] if manifests else 0) + 1, uuid.uuid4().hex
            last: dict[str, int] = {}

            def add(name: str, rows: Rows, manifests: list[dict] = manifests, data: str = data, last: dict = last) -> DataFrame:
                schema, path = self.schemas[name], f"{self.folder}/data/{data}/{name}"
                first = self.last(manifests, name) + 1
                extra = [c for c in rows[0].columns if c not in schema.names]
                placed = numbered(rows[0].drop("id"), rows[1], "id", first) if rows[1] else rows[0]
                placed.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], *extra).write.parquet(path)
                written = self.spark.read.parquet(path)
                last[name] = written.agg(F.max("id")).first()[0] or first - 1
                return written

            build(manifests, add)
            if not last:
                return number - 1
            if self._put(number, {"number": number, "data": data, "last": last}):
                return number
        raise LedgerError(f"{self.folder} is written to by others all the time; nothing was recorded")

    def _put(self, number: int, manifest: dict) -> bool:
        """Whether the manifest got its number: it appears complete, or not at all."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        ready, target = path(f"{self.folder}/data/{manifest['data']}/manifest"), path(f"{self.folder}/commits/{number:012d}")
        store = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        store.mkdirs(target.getParent())
        out = store.create(ready, False)
        out.writeBytes(json.dumps(manifest) + "\n")
        out.close()
        if store.getScheme() == "file":  # a local rename would overwrite; a link does not
            try:
                os.link(ready.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        if store.exists(target):
            return False
        return store.rename(ready, target)
