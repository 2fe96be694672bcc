"""Words of many texts at once, as numpy arrays: code points, spans, hashes. Runs inside tasks.

Texts of an Arrow batch are laid side by side in chunks, so that cutting and hashing words is array
work. Memory follows the chunk, or the longest single text where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Code points worked on at once; a longer text makes a chunk by itself.
CHUNK = 2_000_000
#: Stands after each text; no code point has this value.
END = 0x110000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[list[str]]:
    """The texts in order, null as empty, in lists of about ``limit`` code points."""
    held: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield held


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points with END after each text, and the place of each END."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.cumsum(lengths + 1) - 1
    points[ends] = END
    return points, ends


def mix(x: np.ndarray) -> np.ndarray:
    """A finisher that spreads every bit of 64 over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashes(points: np.ndarray, starts: np.ndarray, stops: np.ndarray, outside: np.ndarray,
           bases: tuple[np.uint64, ...] = _BASES) -> list[np.ndarray]:
    """A 64-bit hash of each span for each base. Spans are in order and do not overlap; ``outside``
    marks the code points of none, which weigh nothing."""
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in bases]
    base = int(starts[0])
    cuts = (starts - base).astype(np.int32)
    place = np.arange(len(points) - base, dtype=np.int32)
    place -= np.repeat(cuts, np.diff(starts, append=len(points)))
    values = points[base:].astype(np.uint64)
    values += np.uint64(0x632BE5AB)
    values *= _MIX
    values ^= values >> np.uint64(32)
    values[outside[base:]] = 0
    most = int(place.max()) + 1
    sizes = (stops - starts).astype(np.uint64) * _MIX
    return [mix(np.add.reduceat(values * powers(b, most)[place], cuts) + sizes) for b in bases]


def distinct(points: np.ndarray, starts: np.ndarray, stops: np.ndarray,
             outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each span the number of its word, and for each word the span that holds it first. Two
    64-bit hashes decide; spans whose first hash agrees and whose second does not are told apart."""
    one, two = hashes(points, starts, stops, outside)
    codes, found = pd.factorize(one)
    first = np.full(len(found), -1, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    if (two != two[first][codes]).any():
        codes, found = pd.factorize(pd.MultiIndex.from_arrays([one, two]))
        first = np.full(len(found), -1, np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, first


def blank_words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words between U+0020 and U+0009 to U+000D, and what is outside."""
    outside = (points == 32) | ((points >= 9) & (points <= 13)) | (points == END)
    edge = np.diff(outside.astype(np.int8), prepend=1, append=1)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1), outside


def gather(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all items of the given runs of a flat array, run after run."""
    total = np.cumsum(lengths)
    if not len(total):
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(offsets - (total - lengths), lengths)
