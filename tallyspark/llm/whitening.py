"""Whitening of embeddings: distributed centred covariance, leading components on the driver (a matrix of the
dimensions only), projection by the broadcast components.

A task keeps, per length of vectors, their number, exact sums, mean and centred products, and hands them on
one matrix row at a time; each matrix row is merged over the tasks, in their order, by a group of its own. Merging
centres before it multiplies too: two parts' products add up with the product of their means' difference.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import symmetric, vectors
from tallyspark.plans.staging import settle

SCALE, OFFSET, COMPONENTS = 1024.0, 100_000, 8
#: Steps beyond this count as it, so that sums stay whole numbers of 64 bits.
MOST_STEPS = 2**40
_MOMENTS = "length int, i int, task int, n long, total decimal(38,0), mean array<double>, products array<double>"
MADE = ("n", "deviation", "whitened", "explained", "identity_error")


def _merged(one: tuple, other: tuple) -> tuple:
    """n, mean and products (of any of the matrix's rows: ``rows`` says which) of both parts together."""
    (n, mean, products), (m, far, more), rows = one[:3], other[:3], one[3]
    gap = far - mean
    return n + m, mean + gap * (m / (n + m)), products + more + np.outer(gap[rows], gap) * (n * m / (n + m)), rows


def moments(rows: DataFrame, column: str, whole: bool) -> DataFrame:
    """Number, sum (of ``whole`` numbers; else null), mean and row ``i`` of the centred products of an array column, per length."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        totals: dict[int, np.ndarray] = {}
        for batch in parts:
            for at, x in vectors.matrices(batch.column(0)):
                every = slice(None)
                mean = x.mean(axis=0)
                gap = x - mean
                new = (len(at), mean, gap.T @ gap, every)
                length = x.shape[1]
                held[length] = _merged(held[length], new) if length in held else new
                if whole:
                    totals[length] = totals.get(length, 0) + x.sum(axis=0)
        task = TaskContext.get().partitionId()
        schema = pa.schema([("length", pa.int32()), ("i", pa.int32()), ("task", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0)),
                            ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])
        for length, (n, mean, products, _) in held.items():
            for i in range(length):
                total = Decimal(int(totals[length][i])) if whole else None
                yield pa.RecordBatch.from_pylist([{"length": length, "i": i, "task": task, "n": n, "total": total, "mean": mean, "products": products[i]}], schema)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("task")
        i = int(part["i"].iloc[0])
        parts = [(n, np.asarray(mean), np.asarray(row)[None, :], [i]) for n, mean, row in zip(part["n"].tolist(), part["mean"], part["products"], strict=True)]
        one = parts[0]
        for other in parts[1:]:
            one = _merged(one, other)
        total = sum(part["total"].tolist(), Decimal(0)) if whole else None
        return pd.DataFrame({"length": part["length"].iloc[:1], "i": [i], "n": [one[0]], "total": [total], "products": [one[2][0]]})

    return (rows.select(column).mapInArrow(run, _MOMENTS).groupBy("length", "i")
            .applyInPandas(merge, "length int, i int, n long, total decimal(38,0), products array<double>"))


def covariance(rows: DataFrame, column: str, whole: bool = False) -> tuple[int, list[int], np.ndarray]:
    """n, sums and covariance (divisor n) of the array column's commonest length (of equals the least); 0 where there is none."""
    settled = settle(moments(rows, column, whole), "moments")
    top = settled.where("i = 0").orderBy(F.desc("n"), "length").limit(1).select("length").first()
    if top is None:
        return 0, [], np.zeros((0, 0))
    own = sorted(settled.where(F.col("length") == top["length"]).collect(), key=lambda r: r["i"])
    products = np.array([r["products"] for r in own])
    return own[0]["n"], [int(r["total"] or 0) for r in own], (products + products.T) / 2 / own[0]["n"]


def whitened(rows: DataFrame, vector: str = "embedding", keep: Sequence[str] = ("vec_id",), components: int = COMPONENTS,
             scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """For each row of ``rows`` that takes part the columns ``keep``, n, deviation, and the arrays whitened and explained
    with one entry a component, falling by eigenvalue; identity_error is one value for all.

    Null vectors and vectors with null or non-finite entries take no part, nor do those of another length than
    the commonest (of equals the least). Entries become floor(scale * entry) + offset. Components whose variance is 0 but for rounding are
    none, so equal vectors, one vector and empty ones give empty arrays, with identity_error 0. ``deviation`` is exact, and null
    beyond 64 bits. Repeated rows count each; an empty table gives an empty one; ``keep`` columns named like results give way.
    """
    keep = [c for c in keep if c not in MADE]
    named = {c: f"_keep_{i}" for i, c in enumerate(keep)}
    rows = rows.where(vectors.finite(vector)).select(*[F.col(c).alias(a) for c, a in named.items()], vectors.steps(vector, scale, offset, MOST_STEPS).alias("_x"))
    n, sums, matrix = covariance(rows, "_x", whole=True)
    length = len(sums)
    values, comps = symmetric.leading(matrix, components)
    trace = float(np.trace(matrix))
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # the nearest whole number to each mean
    rest = np.array([s - n * int(m) for s, m in zip(sums, middle, strict=True)], np.int64)
    project = (comps / np.sqrt(values)[:, None]).T

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - middle) - rest / max(n, 1)) @ project

    def plain(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for _, x in vectors.matrices(batch.column(0)):
                if x.shape[1] == length:
                    yield pa.record_batch({"w": pa.array(list(projected(x)), pa.list_(pa.float64()))})

    error = 0.0
    if len(values):
        _, _, found = covariance(rows.select("_x").mapInArrow(plain, "w array<double>"), "w")
        error = float(np.abs(found - np.eye(len(values))).max())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at, x in vectors.matrices(batch.column(batch.num_columns - 1)):
                if x.shape[1] != length:
                    continue
                own = batch.take(pa.array(at)).columns[:-1]
                gap = (x - middle) * n - rest
                if length * float(np.abs(gap).max(initial=0)) ** 2 < 2**62:
                    deviation = (gap * gap).sum(axis=1).tolist()
                else:
                    whole = ((x - middle).astype(object) * n - rest.astype(object))
                    deviation = [d if (d := sum(v * v for v in row)) < 2**63 else None for row in whole]
                m = len(at)
                made = [pa.array([n] * m, pa.int64()), pa.array(deviation, pa.int64()), pa.array(list(projected(x)), pa.list_(pa.float64())),
                        pa.array([values / trace if trace else values] * m, pa.list_(pa.float64())), pa.array([error] * m, pa.float64())]
                yield pa.RecordBatch.from_arrays([*own, *made], names=[*named.values(), *MADE])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(run, kinds + "n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    return out.withColumnsRenamed({a: c for c, a in named.items()})
