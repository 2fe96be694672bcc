"""The split before byte-level merges, for many texts at once, and ids per distinct piece.

The split is that of ``public_tokenizers.PATTERN``, worked out from runs of letters, numbers, white
space and other characters. A piece encodes the same wherever it stands, so each distinct piece of
a chunk is encoded once and its ids are dealt to its places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

from tallyspark.llm import spans

#: Pieces whose ids a worker keeps between chunks; beyond it the store starts anew.
KEPT = 200_000
_LETTER, _NUMBER, _SPACE, _OTHER, _END = range(5)


@lru_cache(1)
def classes() -> np.ndarray:
    out = np.full(spans.END + 1, _OTHER, np.uint8)
    every = "".join(map(chr, (c for c in range(spans.END) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for run in regex.finditer(pattern, every):
            out[ord(run[0][0]):ord(run[0][-1]) + 1] = kind
    out[spans.END] = _END
    return out


def pieces(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the pieces of END-separated texts; they cover all but the ENDs."""
    kind = classes()[points]
    before = np.concatenate(([np.uint8(_END)], kind[:-1]))
    after = np.concatenate((kind[1:], [np.uint8(_END)]))
    space = kind == _SPACE
    last = space & (after != _SPACE) & (after != _END)
    start = (kind != before) | last
    joins = last & (points == 32)
    start[1:][joins[:-1]] = False  # one U+0020 belongs to the piece after it
    quotes = np.flatnonzero((points == 39) & start & (after == _LETTER))
    for at in quotes.tolist():  # an apostrophe that begins a piece of its own
        two = chr(points[at + 1]) + (chr(points[at + 2]) if points[at + 2] != spans.END else "")
        size = 1 if two[0] in "stmd" else 2 if two in ("re", "ve", "ll") else 0
        if size:
            start[at + 1] = False
            if kind[at + 1 + size] == _LETTER:
                start[at + 1 + size] = True
    starts = np.flatnonzero(start)
    stops = np.concatenate((starts[1:], [len(points)]))
    real = kind[starts] != _END
    return starts[real], stops[real]


def encoded(texts: list[str | None], encode: Callable[[list[str]], list[list[int]]],
            kept: dict[str, list[int]]) -> Iterator[np.ndarray]:
    """The ids (uint32) of each text in order. ``encode`` gives the ids of pieces; ``kept`` holds
    them between calls and stays below KEPT pieces and one chunk's."""
    for chunk in spans.chunks(texts):
        points, ends = spans.code_points(chunk)
        starts, stops = pieces(points)
        codes, first = spans.distinct(points, starts, stops, points == spans.END)
        whole = "\n".join(chunk)
        words = [whole[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
        if len(kept) > KEPT:
            kept.clear()
        new = [w for w in words if w not in kept]
        kept.update(zip(new, encode(new), strict=True))
        ids = [kept[w] for w in words]
        flat = np.fromiter(chain.from_iterable(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        offsets = np.cumsum(sizes) - sizes
        counts = sizes[codes] if len(codes) else np.zeros(0, np.int64)
        out = flat[spans.gather(offsets[codes], counts)] if len(codes) else flat
        cut = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, ends)]
        begin = 0
        for stop in cut.tolist():
            yield out[begin:stop]
            begin = stop


def encoded_by(path: str, texts: list[str | None]) -> Iterator[np.ndarray]:
    """The ids (uint32) of each text in order by the tokenizers file at ``path``. Strings of the file's added tokens become those
    tokens' ids; what stands between them is encoded as texts of their own, as the tokenizers library does."""
    encode, kept, added = library(path)
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    parted = [cut.split(t) if t and any(a in t for a in added) else [t] for t in texts]
    between = encoded([part for own in parted for part in own[::2]], encode, kept)
    for own in parted:
        ids = [next(between)]
        for token in own[1::2]:
            ids += [np.array([added[token]], "<u4"), next(between)]
        yield np.concatenate(ids) if len(ids) > 1 else ids[0]


@lru_cache(2)
def library(path: str) -> tuple[Callable[[list[str]], list[list[int]]], dict[str, list[int]], dict[str, int]]:
    """An encoder of pieces by the vocabulary of a tokenizers file (byte-level BPE), its store, and the
    file's added tokens; one per worker and file. Pieces need the merges alone, so the file's ranks are
    given to the faster of the installed libraries."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, added = whole["model"], whole.get("added_tokens", [])
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("the file's added tokens take white space or whole words only")
    of = letters()
    ranks = {bytes(of[c] for c in token): rank for token, rank in model["vocab"].items() if all(c in of for c in token)}
    order = [model["vocab"]["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in model["merges"]]
    if order != sorted(order):
        raise ValueError("the file's merges are not in the order of its ids")
    ranks = {token: rank for token, rank in ranks.items() if rank <= order[-1]}  # without special tokens
    tool = tiktoken.Encoding("file", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    core = tool._core_bpe

    def encode(words: list[str]) -> list[list[int]]:
        return [core.encode_single_piece(w.encode()) for w in words]

    return encode, {}, {t["content"]: t["id"] for t in added}


def letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 bytes
    for themselves, the rest for U+0100 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
