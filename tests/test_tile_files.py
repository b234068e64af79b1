"""A cell of many tiles is read from files: nothing is copied to partner tiles, and the results are the same."""

import numpy as np
import pytest
from helpers import frame, kernel_table, pair_dict
from pyspark.sql import functions as F

from marginwise.functions.kernels import GaussianKernel, PolynomialKernel
from marginwise.operators import pairs, tiles

RNG = np.random.default_rng(21)
X = RNG.normal(size=(160, 3))
IDS = RNG.permutation(5000)[:160]
GAUSS, POLY = GaussianKernel(1.0), PolynomialKernel(1.0, 0.0, 2.0)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kernel", [GAUSS, POLY])
def test_pairs_without_copies(spark, kernel):
    rows = frame(spark, X, ids=IDS)
    found = pairs.kernel_pairs(rows, kernel, 0.2, tile_rows=10)
    assert "Exchange" not in plan_of(found) and "Generate" not in plan_of(found)
    K = kernel_table(kernel, X)
    want = {}
    for a in range(len(X)):
        for b in range(len(X)):
            if IDS[a] < IDS[b] and K[a, b] > 0.2:
                want[IDS[a], IDS[b]] = K[a, b]
    assert pair_dict(found) == pytest.approx(want)
    assert pairs.nonzero_count_train(rows, kernel, 0.2).first()["nonzero"] == 160 + 2 * len(want)


def test_pairs_between_tables(spark):
    left, right = frame(spark, X[:90], ids=IDS[:90]), frame(spark, X[90:], ids=IDS[:70])
    few = pair_dict(pairs.kernel_pairs_between(left, right, POLY, 0.2, prune=False))
    found = pairs.kernel_pairs_between(left, right, POLY, 0.2, tile_rows=7, prune=False)
    assert "Exchange" not in plan_of(found) and pair_dict(found) == pytest.approx(few) and few


@pytest.mark.parametrize("n_weights", [1, 9])
@pytest.mark.parametrize("run", [2, 32])
def test_sums_of_many_tiles(spark, monkeypatch, n_weights, run):
    monkeypatch.setattr(tiles, "RUN_TILES", run)
    weight = F.array(*[F.col("id") * F.lit(0.01 * (k + 1)) for k in range(n_weights)])
    rows = frame(spark, X, ids=IDS).withColumn("weight", weight)
    got = {r["id"]: r["sums"] for r in pairs.weighted_sums(rows, GAUSS, 0.2, n_weights, tile_rows=10, prune=False).collect()}
    K = kernel_table(GAUSS, X)
    Q = np.where(K > 0.2, K, 0.0)
    np.fill_diagonal(Q, 0.0)
    W = np.outer(IDS * 0.01, np.arange(1, n_weights + 1))
    want = Q @ W
    assert all(got[i] == pytest.approx(list(want[k])) for k, i in enumerate(IDS) if i in got or want[k].any())


def test_infinite_values_stay_with_their_pairs(spark):
    Z = X[:60].copy()
    Z[3], Z[5, 1] = 1e170, np.nan
    weight = F.array(*[F.when(F.col("id") == 3, 0.0).otherwise(1.0)] * 8)
    rows = frame(spark, Z).withColumn("weight", weight)
    few, many = ({r["id"]: r["sums"] for r in pairs.weighted_sums(rows, POLY, 0.2, 8, tile_rows=t).collect()} for t in (1000, 5))
    assert few.keys() == many.keys()
    assert all(few[i] == pytest.approx(many[i]) for i in few)


def test_empty_tiles_and_sets(spark):
    """More tiles than a hash fills; sets are merged over all tiles."""
    rows = frame(spark, X[:70], ids=IDS[:70])
    few, many = ({(r["i"], r["segment"]): r["columns"] for r in pairs.kernel_adjacency(rows, POLY, 0.2, tile_rows=t).collect()} for t in (1000, 1))
    assert few == many and few
