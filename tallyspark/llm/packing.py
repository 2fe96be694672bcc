"""Packing documents into sequences: first-fit decreasing on a tournament tree, group by group.

Documents are encoded and cut into pieces of at most a sequence. Pieces are dealt by a hash of their
row number into groups of a bounded size; each group is packed by itself, largest piece first, into
the first sequence with room, found by a descent of a tree that holds the largest room of each
half. Groups are alike in their sizes, so what packing them apart costs is one part-filled
sequence each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import pretokens
from tallyspark.llm.arrow import batches
from tallyspark.plans.staging import settle

SEQUENCE, END_ID, GROUP = 2048, 1, 4096


def first_fit_decreasing(sizes: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each size (1 to ``capacity``); equal sizes in their order."""
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)  # every bin begins empty; node i has children 2i and 2i + 1
    bins, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins[item], places[item] = at - leaves, capacity - room[at]
        room[at] -= size
        at //= 2
        while at:
            most = room[2 * at] if room[2 * at] > room[2 * at + 1] else room[2 * at + 1]
            if room[at] == most:
                break
            room[at] = most
            at //= 2
    return bins, places


def pieces(docs: DataFrame, vocabulary: str, keep: list[str], capacity: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """For each piece of each document (null text: empty): the columns ``keep``, ``start``, ``length``,
    ``doc_tokens`` and ``ids`` (little-endian unsigned 32-bit). The document's ids end with ``end_id``."""
    fields = [f for f in docs.select(*keep).schema.fields]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch):
            own = zip(*(batch.column(c).to_pylist() for c in keep), strict=True) if keep else iter(() for _ in range(batch.num_rows))
            end = np.array([end_id], "<u4")
            for mine, ids in zip(own, pretokens.encoded_by(vocabulary, batch.column("text").to_pylist()), strict=True):
                ids = np.concatenate((ids, end))
                for first in range(0, len(ids), capacity):
                    part = ids[first:first + capacity]
                    yield (*mine, first, len(part), len(ids), part.tobytes())

        for batch in parts:
            kinds = [(c, batch.schema.field(c).type) for c in keep]
            schema = pa.schema([*kinds, ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
            yield from batches(rows(batch), schema)

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return docs.select(*keep, "text").mapInArrow(run, own + "start long, length long, doc_tokens long, ids binary")


def packed(parts: DataFrame, capacity: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """``parts`` (any rows with ``length``) with ``sequence_id`` and ``offset``; older columns of these
    names give way. ``parts`` is written once, so the numbers of its rows are settled."""
    names = [c for c in parts.columns if c not in ("sequence_id", "offset", "_row")]
    rows = settle(parts.select(*names, F.monotonically_increasing_id().alias("_row")), "pieces")
    groups = max(1, round(rows.count() / group))
    dealt = rows.select("_row", "length", F.pmod(F.xxhash64("_row", F.lit("pack")), F.lit(groups)).alias("_group"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_row")
        bins, places = first_fit_decreasing(part["length"].to_numpy(), capacity)
        return pd.DataFrame({"_row": part["_row"].to_numpy(), "sequence_id": (part["_group"].to_numpy() << 32) + bins, "offset": places})

    placed = dealt.groupBy("_group").applyInPandas(pack, "_row long, sequence_id long, offset long")
    return rows.join(placed, "_row").drop("_row")


def pack_documents(docs: DataFrame, vocabulary: str, keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece of ``docs``: the columns ``keep`` (by default doc_id), start, length, doc_tokens,
    ids_crc32, sequence_id, offset, and ids unless ``with_ids`` is false. Repeated rows are packed
    each, null ids too; an empty text is the end id alone; an empty table gives an empty one."""
    keep = [c for c in keep or ["doc_id"] if c not in ("start", "length", "doc_tokens", "ids", "ids_crc32", "sequence_id", "offset")]
    parts = pieces(docs, vocabulary, keep).withColumn("ids_crc32", F.crc32("ids"))
    return packed(parts if with_ids else parts.drop("ids"))
