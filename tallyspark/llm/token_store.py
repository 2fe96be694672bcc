"""Token ids in files of Simple-8b words.

A 64-bit word has a 4-bit selector and 60 bits of ids: 60 of 1 bit, 30 of 2, and so on to 1 of 60;
selector 0 holds 120 zeros, and selector 15 says that the next word is one id as it is. Ids
are cut into blocks, no word crosses a block, and the file lists where each block's words begin, so
any block decodes by itself, all words of one selector at once.

A file: MAGIC, the words, the blocks' first words, then what bounds the documents: their ids (0 for a null one), the
numbers of their ids, and a byte each that is 1 for a null id; then the tail: counts of ids, words, blocks, ids a block
and documents. All but the bytes are 64-bit little-endian. Rows are ordered by id, and cut into files by ranges; a table of one row per
some thousand documents of a file (a segment) tells readers which blocks to read, and where their ids stand among all.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import pretokens, shared_files
from tallyspark.llm.arrow import batches
from tallyspark.plans.staging import new_path, settle

MAGIC = b"S8BTOKEN"
BLOCK = 8192
#: Ids a word and bits an id by selector; selector 15 is the escape.
COUNTS = (120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
_U = np.uint64
_LIMITS = np.array([1 << b for b in BITS], np.uint64)
_STEPS = np.array([*COUNTS, 1], np.int64)
#: A segment ends at either bound, always with a document.
SEGMENT_DOCS, SEGMENT_IDS = 4096, 1 << 20


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``ids`` (unsigned), and where each block's words begin."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.minimum(block - np.arange(n, dtype=np.int32) % block, n - np.arange(n, dtype=np.int32))
    needs = np.searchsorted(_LIMITS, ids, side="right").astype(np.int8)  # the first selector each id fits
    choice = np.full(n, len(COUNTS) - 1, np.int8)
    open_yet = np.ones(n, bool)
    for k in range(len(COUNTS) - 1):  # from many ids a word to few: the first that fits is best
        fits = needs <= k
        at = np.flatnonzero(fits & open_yet & (left >= COUNTS[k]))
        if not len(at):
            continue
        if not fits.all():
            wide = np.zeros(n + 1, np.int32)  # ids too large for it, so far
            np.cumsum(~fits, out=wide[1:])
            at = at[wide[at + COUNTS[k]] == wide[at]]
        choice[at], open_yet[at] = k, False
    choice[needs == len(COUNTS)] = ESCAPE
    steps, at, starts = _STEPS[choice].tolist(), 0, []
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, np.int64)
    kind = choice[starts].astype(np.int64)
    size = 1 + (kind == ESCAPE)
    place = np.cumsum(size) - size
    words = np.zeros(place[-1] + size[-1], np.uint64)
    words[place] = kind.astype(np.uint64)
    for k in range(1, len(COUNTS)):
        mine = np.flatnonzero(kind == k)
        if len(mine):
            held, first = words[place[mine]], starts[mine]
            for j in range(COUNTS[k]):
                held |= ids[first + j] << _U(4 + BITS[k] * j)
            words[place[mine]] = held
    far = kind == ESCAPE
    words[place[far] + 1] = ids[starts[far]]
    return words, place[np.searchsorted(starts, np.arange(0, n, block))]


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of the words of whole blocks."""
    kind = (words & _U(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(kind == ESCAPE).tolist():  # the word after an escape is no selector
        if not raw[at]:
            raw[at + 1] = True
    head = np.flatnonzero(~raw)
    kind = kind[head]
    count = np.array((*COUNTS, 1))[kind]
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for k in range(1, len(COUNTS)):
        mine = np.flatnonzero(kind == k)
        for j in range(COUNTS[k]) if len(mine) else ():
            out[place[mine] + j] = (words[head[mine]] >> _U(4 + BITS[k] * j)) & _U((1 << BITS[k]) - 1)
    far = kind == ESCAPE
    out[place[far]] = words[head[far] + 1]
    return out


class Writer:
    """One file; documents come one by one."""

    def __init__(self, uri: str, block: int = BLOCK) -> None:
        self.uri, self.block, self.n, self.words = uri, block, 0, 0
        self.starts: list[np.ndarray] = []
        self.held: list[np.ndarray] = []
        self.waiting = 0
        self.docs, self.lengths, self.nulls = array("q"), array("q"), bytearray()
        self.file = shared_files.writer(uri)
        self.file.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc or 0)
        self.nulls.append(doc is None)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 128 * self.block:
            self._put(self.waiting // self.block * self.block)

    def _put(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        words, starts = pack(ids[:n], self.block)
        self.file.write(words.astype("<u8").tobytes())
        self.starts.append(starts + self.words)
        self.n, self.words = self.n + n, self.words + len(words)
        self.held, self.waiting = [ids[n:]], len(ids) - n

    def close(self, segment: int = SEGMENT_DOCS) -> Iterator[tuple[int, int, int, int]]:
        """The file's segments: first document, documents, first id, ids."""
        self._put(self.waiting)
        starts, lengths = np.concatenate(self.starts), np.array(self.lengths, "<i8")
        for part in (starts.astype("<i8"), np.array(self.docs, "<i8"), lengths):
            self.file.write(part.tobytes())
        self.file.write(bytes(self.nulls))
        self.file.write(np.array([self.n, self.words, len(starts), self.block, len(lengths)], "<i8").tobytes())
        self.file.close()
        first, before, ends = 0, 0, np.cumsum(lengths)
        while first < len(lengths):
            full = int(np.searchsorted(ends, before + SEGMENT_IDS)) + 1
            stop = min(len(lengths), first + segment, max(full, first + 1))
            yield first, stop - first, before, int(ends[stop - 1]) - before
            first, before = stop, int(ends[stop - 1])


class Reader:
    """One file, read by blocks."""

    def __init__(self, uri: str) -> None:
        self.file = shared_files.reader(uri)
        size = self.file.size()
        self.n, self.words, self.blocks, self.block, self.docs = np.frombuffer(self.file.read_at(40, size - 40), "<i8").tolist()
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is not a file of token ids")
        self.nulls_at = size - 40 - self.docs
        self.lengths_at = self.nulls_at - 8 * self.docs
        self.docs_at = self.lengths_at - 8 * self.docs
        self.starts_at = self.docs_at - 8 * self.blocks

    def _longs(self, at: int, first: int, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(8 * n, at + 8 * first), "<i8")

    def documents(self, first: int, n: int) -> Iterator[tuple[int | None, int]]:
        """Ids and lengths of documents."""
        nulls = self.file.read_at(n, self.nulls_at + first)
        for doc, length, null in zip(self._longs(self.docs_at, first, n).tolist(), self._longs(self.lengths_at, first, n).tolist(), nulls, strict=True):
            yield None if null else doc, length

    def ids(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from the ``first`` on: the blocks that hold them are read, no others."""
        if not n:
            return np.zeros(0, np.uint64)
        low, high = first // self.block, -(-(first + n) // self.block)
        starts = np.append(self._longs(self.starts_at, low, min(high + 1, self.blocks) - low), self.words)
        a, b = int(starts[0]), int(starts[high - low])
        back = unpack(np.frombuffer(self.file.read_at(8 * (b - a), 8 + 8 * a), "<u8"))
        return back[first - low * self.block:][:n]


def write(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None, segment: int = SEGMENT_DOCS) -> DataFrame:
    """Encodes ``docs`` (doc_id, text; null text: empty), each with ``end_id`` after its ids, and writes
    files in ascending doc_id order (null first, equal ids by text). Returns the settled table of segments: file, task (files in
    their order), first_doc, docs, first_id, ids."""
    spark = docs.sparkSession
    folder = shared_files.folder(spark, folder or new_path(spark, "tokens"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        end = np.array([end_id], "<u4")
        for batch in parts:
            out = out or Writer(shared_files.fresh(folder, "s8b"))
            for doc, ids in zip(batch.column("doc_id").to_pylist(), pretokens.encoded_by(vocabulary, batch.column("text").to_pylist()), strict=True):
                out.add(doc, np.concatenate((ids, end)))
        if out is not None:
            task = TaskContext.get().partitionId()
            kind = pa.schema([("file", pa.string()), ("task", pa.int32()), *((c, pa.int64()) for c in ("first_doc", "docs", "first_id", "ids"))])
            yield from batches(((out.uri, task, *part) for part in out.close(segment)), kind)

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = ids.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return settle(ordered.mapInArrow(run, "file string, task int, first_doc long, docs long, first_id long, ids long"), "token-files")


def placed(segments: DataFrame) -> DataFrame:
    """One row per file: ``file`` and ``before``, the ids of the files before it. Files are few (one a task that wrote), so one task
    orders them."""
    one = segments.groupBy("file", "task").agg(F.sum("ids").alias("ids"))
    order = Window.orderBy("task", "file").rowsBetween(Window.unboundedPreceding, -1)
    return one.select("file", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before"))


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all rows before it), n_tokens and ids of every row, read from the files by segments, which are
    dealt evenly to tasks; a task holds one segment's ids at a time."""
    spark = segments.sparkSession
    many = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    jobs = segments.join(placed(segments), "file").select("file", "first_doc", "docs", "first_id", "ids", "before")
    jobs = jobs.repartition(max(1, min(segments.count(), many)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in parts:
                for job in batch.to_pylist():
                    file = Reader(job["file"])
                    ids, at = file.ids(job["first_id"], job["ids"]).astype("<u4"), 0
                    for doc, n in file.documents(job["first_doc"], job["docs"]):
                        yield doc, job["before"] + job["first_id"] + at, n, ids[at:at + n].tobytes()
                        at += n
        yield from batches(rows(), pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]))

    return jobs.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2, **how) -> DataFrame:
    """Writes ``docs`` and reads them back: one row per row of ``docs``, repeated ones too, null and
    empty texts as the end id alone. An empty table gives an empty one, and no files."""
    return read_documents(write(docs, vocabulary, end_id, **how))
