"""Byte-level BPE by corpus-level merge replay.

The distinct pieces of many texts lie side by side as one array of tokens. An inverted index leads
from the rank of a token pair to the places where it stands. Merges are replayed in rank order, each
over all its places at once; only the neighbours of a merged pair get a new rank and a new entry in
the index. A piece merges its leftmost pair of the least rank at a time, as encoders of single
pieces do, so a rank that a merge newly allows is taken in its turn even if it is a lower one.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.llm import pretokens, spans
from tallyspark.llm.arrow import batches

#: Code points of text whose distinct pieces are merged together.
WINDOW = 8_000_000
_NONE = np.int32(2**31 - 1)


class Ranks:
    """The vocabulary of a rank file: bytes of each id, and the id that each pair of ids merges to."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.size = max(ranks.values()) + 1
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        by_id = {rank: token for token, rank in ranks.items()}
        words = [by_id.get(i, b"") for i in range(self.size)]
        self.lengths = np.fromiter(map(len, words), np.int64, self.size)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(words), np.uint8)
        self._ranks = ranks

    def index_pairs(self) -> None:
        """Lists the pairs that merge; decoding needs none."""
        ranks = self._ranks
        pairs = {ranks[t[:k]] * self.size + ranks[t[k:]]: rank for t, rank in ranks.items()
                 for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[p] for p in self.pairs.tolist()], np.int32)
        self._ranks = {}

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where there is none."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == key, self.merged[at], _NONE)


@lru_cache(2)
def ranks(path: str, pairs: bool = True) -> Ranks:
    table = Ranks(path)
    if pairs:
        table.index_pairs()
    table._ranks = {}
    return table


def replay(words: list[bytes], table: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, and how many each has."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = len(raw)
    if not n:
        return np.zeros(0, np.int32), sizes
    token = np.append(table.first[raw], np.int32(0))
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    after = np.arange(1, n + 2, dtype=np.int32)  # place n stands for none
    after[np.cumsum(sizes)[sizes > 0] - 1] = n
    before = np.arange(-1, n, dtype=np.int32)
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = n
    rank = np.full(n + 1, _NONE, np.int32)
    whole = after[:n] < n
    rank[:n][whole] = table.of(token[:n][whole], token[1:][whole])
    index: dict[int, list[np.ndarray]] = {}
    order: list[int] = []

    def enter(places: np.ndarray, values: np.ndarray) -> None:
        at = np.argsort(values, kind="stable")
        places, values = places[at], values[at]
        cut = np.flatnonzero(values[1:] != values[:-1]) + 1
        for value, part in zip(values[np.concatenate(([0], cut))].tolist(), np.split(places, cut), strict=True):
            held = index.get(value)
            if held is None:
                index[value] = [part]
                heapq.heappush(order, value)
            else:
                held.append(part)

    open_places = np.flatnonzero(rank != _NONE)
    if len(open_places):
        enter(open_places, rank[open_places])
    while order:
        now = heapq.heappop(order)
        held = index.pop(now)
        places = held[0] if len(held) == 1 else np.concatenate(held)
        places = places[rank[places] == now]
        if not len(places):
            continue
        if len(places) > 1:
            places = np.unique(places)
            own = word[places]
            first = np.concatenate(([True], own[1:] != own[:-1]))
            if not first.all():  # one merge of a word at a time
                index[now] = [places[~first]]
                heapq.heappush(order, now)
                places = places[first]
        right = after[places]
        following = after[right]
        token[places] = now
        after[places] = following
        rank[right] = _NONE
        rank[places] = _NONE
        has = following < n
        left, follow = places[has], following[has]
        before[follow] = left
        ahead = before[places]
        has = ahead < n
        ahead, here = ahead[has], places[has]
        touched = np.concatenate((left, ahead))
        new = table.of(token[touched], np.concatenate((token[follow], token[here])))
        rank[touched] = new
        good = new != _NONE
        if good.any():
            enter(touched[good], new[good])
    alive = np.ones(n, bool)
    alive[_dead(after, sizes, n)] = False
    counts = np.add.reduceat(alive, (np.cumsum(sizes) - sizes)[sizes > 0]) if n else sizes
    out = np.zeros(len(words), np.int64)
    out[sizes > 0] = counts
    return token[:n][alive], out


def _dead(after: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Places that were taken into the token before them: those that no chain from a word's first
    place passes."""
    reached = np.zeros(n + 1, bool)
    at = (np.cumsum(sizes) - sizes)[sizes > 0].astype(np.int64)
    while len(at):
        reached[at] = True
        at = after[at]
        at = at[at < n]
    return np.flatnonzero(~reached[:n])


def _encoded(parts: Iterator[pa.RecordBatch], keep: list[str], path: str) -> Iterator[pa.RecordBatch]:
    table = ranks(path)
    held: list[tuple] = []
    numbers: dict[str, int] = {}
    size = 0

    def flush():
        ids, counts = replay([w.encode() for w in numbers], table)
        offsets = np.cumsum(counts) - counts
        for own, codes in held:
            out = ids[spans.gather(offsets[codes], counts[codes])].astype("<u4")
            yield (*own, len(out), out.tobytes())

    schema = None
    for batch in parts:
        schema = pa.schema([*((c, batch.schema.field(c).type) for c in keep), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        own = zip(*(batch.column(c).to_pylist() for c in keep), strict=True)
        for chunk in spans.chunks(batch.column("text").to_pylist()):
            points, ends = spans.code_points(chunk)
            starts, stops = pretokens.pieces(points)
            codes, first = spans.distinct(points, starts, stops, points == spans.END)
            whole = "\n".join(chunk)
            named = np.array([numbers.setdefault(whole[a:b], len(numbers)) for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)], np.int32)
            codes = named[codes] if len(codes) else np.zeros(0, np.int32)
            at = 0
            for stop in np.searchsorted(starts, ends).tolist():
                held.append((next(own), codes[at:stop]))
                at = stop
            size += len(points)
            if size >= WINDOW:
                yield from batches(flush(), schema)
                held, numbers, size = [], {}, 0
    if held:
        yield from batches(flush(), schema)


def encode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (by default doc_id) of every row of ``docs`` (text), ``n_tokens`` and ``ids``
    (little-endian unsigned 32-bit), by the rank file ``path``. Null and empty texts have no ids;
    special tokens' strings are text; columns of ``keep`` named n_tokens or ids give way. Memory
    holds the distinct pieces of WINDOW code points, or of the longest text."""
    keep = [c for c in keep or ["doc_id"] if c not in ("n_tokens", "ids", "text")]
    rows = docs.select(*keep, "text")
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(lambda parts: _encoded(parts, keep, path), own + "n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ``ids`` (null ids: null); ``ids`` go."""
    names = [c for c in encoded.columns if c not in ("ids", "decoded")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path, pairs=False)

        def read(ids: bytes | None) -> bytes | None:
            if ids is None:
                return None
            ids = np.frombuffer(ids, "<u4")
            return table.letters[spans.gather(table.offsets[ids], table.lengths[ids])].tobytes()

        for batch in parts:
            for first in range(0, batch.num_rows, 500):
                some = batch.slice(first, 500)
                out = [read(x.as_py()) for x in some.column("ids")]
                yield pa.record_batch([*(some.column(c) for c in names), pa.array(out, pa.binary())], names=[*names, "decoded"])

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in encoded.schema.fields if f.name in names)
    return encoded.select(*names, "ids").mapInArrow(run, own + "decoded binary")
