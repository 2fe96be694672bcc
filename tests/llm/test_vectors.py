"""Eigenvalues against numpy, whitening and hard negatives against brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import hard_negatives, hilbert, queries, symmetric, whitening
from tests.compare import connect, difference

KIND = "vec_id long, embedding array<float>, label int, n string, whitened int, _x string, _label string, block int"


def odd_rows(n: int, dims: int = 12, labels: int = 4, seed: int = 3) -> list[tuple]:
    """A third of the rows are one vector; others in clusters; repeated rows; odd vectors, labels and ids."""
    draw = np.random.default_rng(seed)
    middles = draw.standard_normal((8, dims))
    rows = []
    for i in range(n):
        v = middles[0] if i % 3 == 0 else middles[draw.integers(8)] + 0.2 * draw.standard_normal(dims)
        rows.append((i, [float(np.float32(c)) for c in v], int(draw.integers(labels))))
    rows += [rows[100], rows[100], rows[7], (None, rows[5][1], 1), (n, None, 1), (n + 1, [None] * dims, 1), (n + 2, [float("nan")] * dims, 1),
             (n + 3, [float("inf"), *rows[3][1][1:]], 0), (n + 4, rows[3][1], None), (n + 5, [], 2), (n + 6, rows[3][1][:3], 2)]
    return [(*r, "x", 1, "y", "z", 5) for r in rows]


def whole(rows: list[tuple], dims: int = 12) -> list[tuple]:
    return [r for r in rows if r[1] is not None and len(r[1]) == dims and all(c is not None and np.isfinite(c) for c in r[1])]


@pytest.mark.parametrize("dims, bits", [(1, 4), (2, 5), (3, 3), (5, 2)])
def test_curve_meets_every_cell_step_by_step(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    places = hilbert.places(grid, bits)
    assert sorted(places) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(places)], axis=0)).sum(axis=1) == 1).all()


def matrices():
    draw = np.random.default_rng(4)
    for n in (1, 2, 3, 9, 40):
        a = draw.standard_normal((n, n + 2))
        turn = np.linalg.qr(draw.standard_normal((n, n)))[0]
        yield from (a @ a.T, np.eye(n) * 2, np.diag(draw.integers(0, 3, n)).astype(float), np.zeros((n, n)), np.ones((n, n)),
                    turn @ np.diag(np.repeat([4.0, 4 - 1e-9, 1], -(-n // 3))[:n]) @ turn.T, 1e-9 * a @ a.T)


def test_leading_components_are_numpys():
    for matrix in matrices():
        matrix = (matrix + matrix.T) / 2
        values, found = symmetric.leading(matrix, 8)
        want = np.linalg.eigvalsh(matrix)[::-1][:8]
        rank = int((want > 1e-12 * max(want[0], 1e-300)).sum())
        assert len(values) == rank
        if rank:
            assert np.abs(values - want[:rank]).max() <= 1e-13 * want[0]
            assert np.abs(found @ found.T - np.eye(rank)).max() < 1e-12
            assert np.abs(matrix @ found.T - found.T * values).max() < 1e-12 * want[0]


def test_sturm_counts():
    draw = np.random.default_rng(6)
    diagonal, side = draw.standard_normal(20), draw.standard_normal(19)
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(side, 1) + np.diag(side, -1))
    at = np.linspace(-5, 5, 200)
    assert (symmetric.below(diagonal, side, at) == [(values < x).sum() for x in at]).all()


def test_whitening_is_numpys(spark):
    rows = odd_rows(700)
    got = whitening.whitened(spark.createDataFrame(rows, KIND).repartition(6), keep=["vec_id", "label", "n", "_x"]).collect()
    mine = whole(rows)
    x = np.floor(1024 * np.array([r[1] for r in mine])) + 100_000
    n, sums = len(x), x.sum(axis=0)
    values, turn = np.linalg.eigh(np.cov(x.T, bias=True))
    values, turn = values[::-1], turn[:, ::-1]
    assert len(got) == n and {r["n"] for r in got} == {n}
    deviation = (((n * x - sums) ** 2).sum(axis=1)).astype(int).tolist()
    assert Counter((r["vec_id"], r["deviation"]) for r in got) == Counter((r[0], d) for r, d in zip(mine, deviation, strict=True))
    assert np.allclose(got[0]["explained"], values[:8] / values.sum(), rtol=1e-9)
    assert got[0]["identity_error"] < 1e-9
    want = {r[0]: w for r, w in zip(mine, (x - sums / n) @ turn[:, :8] / np.sqrt(values[:8]), strict=True)}
    found = np.array([r["whitened"] for r in got])
    other = np.array([want[r["vec_id"]] for r in got])
    assert np.abs(found * np.sign((found * other).sum(axis=0)) - other).max() < 1e-8
    assert np.abs(np.cov(found.T, bias=True) - np.eye(8)).max() < 1e-9


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])] * 3 + [(2, None)], "vec_id long, embedding array<double>")
    assert [(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in whitening.whitened(one).collect()] == [(3, 0, [], 0.0)] * 3
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], "vec_id long, embedding array<double>")
    rows = whitening.whitened(flat).collect()
    assert {len(r["whitened"]) for r in rows} == {1} and rows[0]["explained"][0] == pytest.approx(1)
    assert whitening.whitened(one.limit(0)).isEmpty() and whitening.whitened(one.where("embedding IS NULL")).isEmpty()


def test_whitening_of_huge_entries(spark):
    """Deviations beyond 64 bits are null, entries beyond the most steps count as it, and what is nothing beside them is no component."""
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 3.0])], "vec_id long, embedding array<double>")
    rows = {r["vec_id"]: r for r in whitening.whitened(huge).collect()}
    assert rows[1]["deviation"] is None and rows[2]["deviation"] is not None and len(rows[1]["whitened"]) == 1


def test_op12_columns(spark):
    out = queries.op12_whitening(spark, "/root/testdata/sf0.001")
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    per = out.groupBy("vec_id").agg(F.sort_array(F.collect_list("component")).alias("c")).select("c").distinct().collect()
    assert [r["c"] for r in per] == [list(range(1, 9))]


def plain_negatives(rows: list[tuple], every: int = 10) -> Counter:
    rows = [r for r in rows if r[0] is not None and r[2] is not None]
    ids, labels = [r[0] for r in rows], [r[2] for r in rows]
    x = np.floor(256 * np.array([r[1] for r in rows])).astype(int)
    out = Counter()
    for a in (i for i, d in enumerate(ids) if d % every == 0):
        scores = (x @ x[a]).tolist()
        near = sorted((-scores[j], ids[j]) for j in range(len(ids)) if j != a and labels[j] == labels[a])[:5]
        for p, positive in near:
            far = sorted((-scores[j], ids[j]) for j in range(len(ids)) if labels[j] != labels[a] and 80 * -p <= 100 * scores[j] <= 100 * -p)[:5]
            out.update((ids[a], positive, rank, d, -p, -s) for rank, (s, d) in enumerate(far, 1))
    return out


@pytest.mark.parametrize("cells", [{}, {"block": 16, "cell_blocks": 3, "cell_anchors": 7}])
def test_negatives_are_the_brute_force_ones(spark, cells):
    rows = odd_rows(600)
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, KIND).repartition(5), F.col("vec_id") % 10 == 0, **cells).collect()
    want = plain_negatives(whole(rows))
    assert len(want) > 200 and Counter(map(tuple, got)) == want


def test_zone_maps_leave_blocks_unread(spark):
    """In clustered data most blocks lie outside an anchor's windows, by the bounds alone."""
    rows = [r[:3] for r in whole(odd_rows(2000, dims=12, labels=2, seed=9)) if r[0] is not None and r[0] % 3]
    taking = spark.createDataFrame(rows, "_id long, v array<float>, l int")
    taking = taking.select("_id", F.col("l").cast("string").alias("_label"), (F.col("_id") == 100).alias("_mark"), hard_negatives.vectors.steps("v", 256.0, 0, 2**20).alias("_x"))
    parts = hard_negatives.blocks(taking, 16)
    facts = parts.select("lows", "highs", "x", "ids").collect()
    for f in facts:  # the maps are those of the rows
        x = np.frombuffer(f["x"], "<i4").reshape(len(f["ids"]) // 8, -1)
        assert f["lows"] == x.min(axis=0).tolist() and f["highs"] == x.max(axis=0).tolist()
    anchors = hard_negatives.listed(parts)
    table = anchors.toArrow()
    asks = hard_negatives._Anchors(table, 5)
    least, most = asks.bounds(np.array([f["lows"] for f in facts], float), np.array([f["highs"] for f in facts], float))
    scores = [np.frombuffer(f["x"], "<i4").reshape(len(f["ids"]) // 8, -1) @ asks.x[0] for f in facts]
    assert all(lo <= s.min() and s.max() <= hi for lo, hi, s in zip(least[0], most[0], scores, strict=True))
    read = sum(bool(asks.wanted(least[:, i], most[:, i])[0]) for i in range(len(facts)))
    assert 0 < read < len(facts) / 2


def test_negatives_of_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    assert hard_negatives.hard_negatives(none, F.col("vec_id") % 100 == 0).isEmpty()
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2), (2, None, 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(alone, F.col("vec_id") % 100 == 0).isEmpty()
    assert hard_negatives.hard_negatives(alone, F.lit(False)).isEmpty()


def test_op13_is_its_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert difference(queries.op13_hilbert_negatives(spark, sf_dir), connect(sf_dir), hard_negatives.ORACLE) is None
