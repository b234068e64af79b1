"""The partition tree: nothing lost, nothing twice, few pairs looked at."""

import numpy as np
import pytest
from helpers import frame, kernel_table, pair_dict
from pyspark.sql import functions as F

from marginwise.functions.kernels import GaussianKernel
from marginwise.operators import pairs, partition


def clusters(rng, n, d, k, scale=10.0):
    return rng.normal(size=(k, d))[rng.integers(0, k, n)] * scale + rng.normal(size=(n, d)) * 0.3


def visits(spark, X, Y, radius, **options):
    def weighted(M):
        return frame(spark, M).select("id", "x", F.lit(1.0).alias("weight")).repartition(3)

    right = None if Y is None else weighted(Y)
    placed = partition.partition(weighted(X), right, radius, X.shape[1], **options)
    return placed.select("cell.round", "cell.number", "guest", "id").collect()


def meetings(rows, triangle):
    """How often each pair meets: homes with later homes of their cell (triangle) and with its guests."""
    cells = {}
    for r in rows:
        cells.setdefault((r["round"], r["number"]), ([], []))[r["guest"]].append(r["id"])
    met = {}
    for home, guests in cells.values():
        found = [(min(a, b), max(a, b)) for k, a in enumerate(home) for b in home[k + 1 :]] if triangle else []
        found += [(min(a, b), max(a, b)) if triangle else (a, b) for a in home for b in guests]
        for pair in found:
            met[pair] = met.get(pair, 0) + 1
    return met, len(cells)


@pytest.mark.parametrize("leaves, leaf_rows, chunk_rows", [(256, 20, None), (4, 20, 64), (6, 40, 7)])
def test_every_near_pair_meets_once(spark, leaves, leaf_rows, chunk_rows):
    rng = np.random.default_rng(leaves)
    X = np.concatenate([clusters(rng, 300, 3, 12), rng.uniform(-15, 15, (200, 3)), np.repeat(rng.normal(size=(1, 3)), 60, axis=0)])
    options = {"leaf_rows": leaf_rows, "leaves": leaves, "chunk_rows": chunk_rows, "sample": 200}
    rows = visits(spark, X, None, 1.5, **options)
    assert sorted(r["id"] for r in rows if not r["guest"]) == list(range(len(X)))
    met, n_cells = meetings(rows, True)
    near = np.linalg.norm(X[:, None] - X[None], axis=2) <= 1.5
    assert set(met.values()) == {1}
    assert all((a, b) in met for a in range(len(X)) for b in range(a + 1, len(X)) if near[a, b])
    assert n_cells > 5 and len(met) < len(X) ** 2 / 6
    X, Y = X[::2], X[1::2]
    met, _ = meetings(visits(spark, X, Y, 1.5, **options), False)
    assert set(met.values()) == {1} and len(met) < len(X) * len(Y) / 3
    assert all((a, b) in met for a in range(len(X)) for b in range(len(Y)) if near[2 * a, 2 * b + 1])


def test_a_ball_that_reaches_everything_is_not_cut(spark):
    X = np.random.default_rng(2).normal(size=(300, 8))
    rows = visits(spark, X, None, 20.0, leaf_rows=16)
    assert len({r["number"] for r in rows}) == 1 and len(rows) == 300


@pytest.mark.parametrize("leaf_rows", [64, 300])
def test_clusters_of_64_dimensions(spark, leaf_rows):
    """Fewer than a tenth of all pairs are looked at, and none is lost."""
    rng = np.random.default_rng(64)
    X = clusters(rng, 3000, 64, 60, 1.0)
    kernel, epsilon = GaussianKernel(0.08), 0.3
    found = pairs.pairs_evaluated(frame(spark, X), kernel, epsilon, leaf_rows=leaf_rows).first()
    K = kernel_table(kernel, X[:400], X)
    assert found["n_pairs"] == 3000 * 2999 // 2
    assert found["share"] < 0.1 and found["n_kept"] > 3000
    got = pairs.kernel_pairs(frame(spark, X), kernel, epsilon, leaf_rows=leaf_rows).where("i < 400").count()
    assert got == sum(int((K[a, a + 1 :] > epsilon).sum()) for a in range(400))


def test_no_limit_on_groups(spark):
    """Groups are a table: several thousand of them are no special case."""
    X = np.random.default_rng(3).normal(size=(5000, 2))
    rows = frame(spark, X).withColumn("g", (F.col("id") % 2500).cast("int"))
    from marginwise.operators.tiles import emit_pairs, tile_join

    found = tile_join(rows, None, GaussianKernel(1.0), -1.0, emit_pairs(True), pairs._PAIR_DDL, pairs._PAIR_ARROW, group="g")
    assert pair_dict(found).keys() == {(i, i + 2500) for i in range(2500)}


def test_pivots_follow_the_clusters():
    rng = np.random.default_rng(4)
    X = clusters(rng, 2000, 6, 20)
    nobody = np.zeros(2000, bool)
    pivots = partition.grow(X, nobody, 1.0, 1.0, 50, True)
    home, near = partition.visits(((X[:, None] - pivots[None]) ** 2).sum(axis=2), pivots, 1.0, nobody, True)
    assert 8 <= len(pivots) <= partition.LEAVES and near.sum() < 2000
    assert np.bincount(home).max() < 1000
    assert len(partition.grow(np.repeat(X[:1], 500, axis=0), nobody[:500], 1.0, 1.0, 50, True)) == 0
    # A sample stands for more rows: the same cut pays more, never less.
    assert len(partition.grow(X, nobody, 1.0, 0.01, 50, True)) >= len(pivots)


def test_far_numbers_keep_their_pairs(spark):
    """Rows beyond the squares that fit meet one another; NaN and infinity meet nobody."""
    X = np.concatenate([np.random.default_rng(5).normal(size=(80, 2)), [[1e200, 0.0]] * 3, [[np.inf, 0.0], [np.nan, 1.0]] * 2])
    got = pair_dict(pairs.kernel_pairs(frame(spark, X), GaussianKernel(1.0), 0.5, leaf_rows=16))
    with np.errstate(all="ignore"):
        K = kernel_table(GaussianKernel(1.0), X)
    assert got.keys() == {(a, b) for a in range(len(X)) for b in range(a + 1, len(X)) if K[a, b] > 0.5}
