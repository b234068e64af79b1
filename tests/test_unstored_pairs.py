"""Training without a pair table gives the same coefficients as with one."""

import numpy as np
import pytest
from helpers import frame
from pyspark.sql import functions as F

from marginwise.functions.kernels import GaussianKernel, PolynomialKernel
from marginwise.params import AlgoParams, ModelParams
from marginwise.plans import problem as problems
from marginwise.plans import training, tuning
from marginwise.plans.problem import prepare

RNG = np.random.default_rng(8)
X = np.concatenate([RNG.normal(size=(150, 3)), np.repeat(RNG.normal(size=(1, 3)), 20, axis=0)])
Y = np.where(X[:, 0] + 0.3 * RNG.normal(size=len(X)) > 0, 1, -1)
ALGO = AlgoParams(max_iter=2, decline=0.8, batch_prob=0.9, epsilon=0.2, min_delta_alpha=0.0)


@pytest.mark.parametrize("builder, kernel", [("tree", GaussianKernel(1.0)), ("auto", PolynomialKernel(0.5, 1.0, 2.0))])
def test_same_sums_for_several_models(spark, builder, kernel):
    rows, cells = frame(spark, X, Y), [training.Cell(c, ModelParams(C, 0.1)) for c, C in enumerate((0.5, 1.0, 2.0))]
    found = []
    for store in (True, False):
        problem = prepare(rows, kernel, 0.2, builder=builder, cells=3, store=store)
        assert (problem.pairs is None) != store and problem.has_copies
        state = training.initial_state(problem, cells, ALGO)
        # A model that gives half of the rows no coefficient.
        state = state.withColumn("alpha", F.when((F.col("cell") == 1) & (F.col("id") % 2 == 0), 0.0).otherwise(F.col("alpha")))
        got = training.gradient(problem, state, n_cells=3).select("cell", "id", "gradient").collect()
        found.append({(r["cell"], r["id"]): r["gradient"] for r in got})
    assert len(found[0]) == 3 * len(X) and found[1] == pytest.approx(found[0])


def test_many_pairs_are_not_stored(spark, monkeypatch):
    rows = frame(spark, X, Y)
    want = tuning.grid_search_cv(rows, {"g": GaussianKernel(1.0)}, (0.1, 1.0), ALGO, 0.1, 3).collect()
    monkeypatch.setattr(problems, "STORED_PAIRS", 100)
    assert prepare(rows, GaussianKernel(1.0), 0.2).pairs is None
    got = tuning.grid_search_cv(rows, {"g": GaussianKernel(1.0)}, (0.1, 1.0), ALGO, 0.1, 3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_odd_values_spoil_only_their_own_pairs(spark):
    """Zero coefficients take no part whatever the kernel, and infinite kernel values stay with their pairs."""
    Z = X[:40].copy()
    Z[3], Z[5, 1] = 1e170, np.nan
    kernel, sums = PolynomialKernel(1.0, 0.0, 2.0), []
    for store in (True, False):
        problem = prepare(frame(spark, Z, Y[:40]), kernel, 0.2, store=store)
        z = problem.rows.select(F.lit(0).alias("cell"), "vid", F.when(F.col("id") == 3, 0.0).otherwise(1.0).alias("z"))
        sums.append({r["vid"]: r["s"] for r in training.pair_sums(problem, z).collect() if r["s"] != 0})
    assert sums[0].keys() == sums[1].keys() and sums[1] == pytest.approx(sums[0])
