"""Pair samples in tiles: the same draws as by joins, without a row per draw."""

import numpy as np
import pytest
from helpers import frame
from pyspark.sql import functions as F

from marginwise.functions.kernels import GaussianKernel
from marginwise.operators import sampling

RNG = np.random.default_rng(12)
X, Z = RNG.normal(size=(230, 3)), RNG.normal(size=(90, 3))


@pytest.mark.parametrize("probability", [0.3, 1.0])
@pytest.mark.parametrize("between", [False, True])
def test_tiles_count_the_draws(spark, monkeypatch, probability, between):
    monkeypatch.setattr(sampling, "BLOCK_DRAWS", 70)
    rows, evals, kernel = frame(spark, X), frame(spark, Z) if between else None, GaussianKernel(1.0)
    values = [r["k"] for r in sampling.sampled_values(rows, kernel, probability, evals, 5).collect()]
    counts = sampling.sampled_counts(rows, kernel, 0.3, probability, evals, 5, tile_rows=64)
    assert tuple(counts.agg(F.sum("n_sampled"), F.sum("n_above")).first()) == (len(values), sum(v > 0.3 for v in values))
    if probability == 1.0:
        assert len(values) == (230 * 90 if between else 230 * 229 // 2)


def test_many_draws_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(sampling, "sampled_values", None)
    got = sampling.density_sampled(frame(spark, X), GaussianKernel(1.0), 0.3, 0.9).first()
    assert 0.85 < got["n_sampled"] / (230 * 229 / 2) < 0.95 and 0 < got["density"] < 1
