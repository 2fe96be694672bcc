"""Rows to Arrow batches of bounded size, inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

ROWS, BYTES = 4096, 8_000_000


def batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each row's text and bytes count towards BYTES; a batch closes at either bound."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= ROWS or size >= BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
