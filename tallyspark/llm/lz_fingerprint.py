"""Document fingerprints of Lempel-Ziv phrases.

A text is cut into phrases, each the shortest run of code points that is not yet a phrase of the text
(LZ78). The set of phrases is hashed, and per bin of the hash the least value is kept: texts that a
shared dictionary would compress well have many phrases, and so many least values, in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import spans
from tallyspark.llm.arrow import batches

#: Bins of a fingerprint, of four hex letters each; a bin without phrases has 0000.
BINS = 128


class Phrases:
    """The dictionary of one text, and where its phrases end."""

    def __init__(self) -> None:
        self.children: dict[int, int] = {}
        self.node, self.cuts = 0, []

    def read(self, points: list[int], at: int) -> None:
        """Goes on with ``points``, the first of which stands at ``at``."""
        children, node, cuts = self.children, self.node, self.cuts
        get, size = children.get, len(children)
        for place, point in enumerate(points, at + 1):
            key = node << 21 | point
            node = get(key)
            if node is None:
                size += 1
                children[key] = size
                cuts.append(place)
                node = 0
        self.node = node

    def branch(self) -> Phrases:
        out = Phrases()
        out.children, out.node, out.cuts = self.children.copy(), self.node, self.cuts.copy()
        return out


def sketch(points: np.ndarray, cuts: list[int]) -> np.ndarray:
    """The fingerprint of the phrases that end at ``cuts``; an unfinished one at the end is a phrase
    already seen. A text without phrases has zeros."""
    if not cuts:
        return np.zeros(BINS, np.uint16)
    stops = np.array(cuts, np.int64)
    starts = np.concatenate(([0], stops[:-1]))
    outside = np.zeros(len(points), bool)
    outside[stops[-1]:] = True
    value = spans.hashes(points, starts, stops, outside, spans._BASES[:1])[0]
    out = np.full(BINS, 0xFFFF, np.int64)
    np.minimum.at(out, (value >> np.uint64(57)).astype(np.int64), ((value & np.uint64(0xFFFFFFFF)) * np.uint64(0xFFFE) >> np.uint64(32)).astype(np.int64))
    return np.where(out == 0xFFFF, 0, out + 1).astype(np.uint16)


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Equal bins among those that either has; 1 for two empty fingerprints."""
    has = (one != 0) | (two != 0)
    return float(((one == two) & has).sum() / has.sum()) if has.any() else 1.0


def fingerprint(text: str | None) -> str:
    """Four hex letters a bin; equal texts have equal ones."""
    points = _points(text or "")
    phrases = Phrases()
    phrases.read(points.tolist(), 0)
    return _hex(sketch(points, phrases.cuts))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hex(marks: np.ndarray) -> str:
    return marks.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` and ``fingerprint`` of its whole text (null: empty)."""
    keep = [c for c in keep if c not in ("fingerprint", "text")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            marks = [fingerprint(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(marks, pa.string())], names=[*keep, "fingerprint"])

    rows = docs.select(*keep, "text")
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(run, own + "fingerprint string")


def beside_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) dealt by ascending doc_id into ranges (_part), each followed by a copy of the
    row that begins the next range (_late), after the last range of the very first row. Ranges begin
    at quantiles of the ids. A null id counts as less than all; rows of one id are ordered by text."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)).alias("_key"))
    found = rows.agg(F.min("_key").alias("least"), F.percentile_approx("_key", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("cuts")).first()
    edges = np.array(sorted({found["least"] or 0, *(found["cuts"] or [])} if parts > 1 else {found["least"] or 0}), np.int64)

    @F.pandas_udf("array<int>")
    def ranges(key: pd.Series) -> pd.Series:
        keys = key.to_numpy(np.int64)
        at = np.searchsorted(edges, keys, side="right") - 1
        return pd.Series([[int(p), int((p - 1) % len(edges))] if k == edges[p] else [int(p)] for k, p in zip(keys, at, strict=True)])

    dealt = rows.select("doc_id", "text", "_key", F.posexplode(ranges("_key")).alias("_late", "_part"))
    return dealt.repartition(parts, "_part").sortWithinPartitions("_part", "_late", "_key", "text")


def edited_and_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """For every row of ``docs`` (doc_id, text; null: empty): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next. The edited text has its last floor(n_chars / 4)
    code points replaced by the first as many of the next row's text by doc_id (after the last row,
    the first), or all where it has fewer. A single row is its own next; repeated rows come back
    each; an empty table gives an empty one."""

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def rows():
            last = ended = None
            for batch in batches_in:
                for doc, text, part, late in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_part", "_late")), strict=True):
                    if late and ended == part:
                        continue  # only the first row of the next range counts
                    points = _points(text)
                    listed, keep = points.tolist(), len(points) - len(points) // 4
                    phrases = Phrases()
                    if late:
                        start = None
                        phrases.read(listed, 0)
                    else:
                        phrases.read(listed[:keep], 0)
                        start = phrases.branch()
                        phrases.read(listed[keep:], keep)
                    marks = sketch(points, phrases.cuts)
                    if last is not None and last[0] == part:
                        yield finished(*last[1:], points, listed, marks)
                    last = (part, doc, points, keep, start, marks)
                    if late:
                        ended, last = part, None

        def finished(doc, points, keep, start, marks, other, listed, other_marks):
            tail = other[:len(points) - keep]
            start.read(listed[:len(points) - keep], keep)
            edited = np.concatenate((points[:keep], tail))
            new = sketch(edited, start.cuts)
            said = edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            return (doc, len(points), hashlib.sha256(said).hexdigest(), _hex(marks), _hex(new), likeness(marks, new), likeness(marks, other_marks))

        yield from batches(rows(), pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                                              ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]))

    return beside_next(docs, parts).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                                    "near_edited double, near_next double")
