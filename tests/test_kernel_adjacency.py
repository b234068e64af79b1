"""Sets of partners begin inside the tiles and equal those of the pair table."""

import numpy as np
from helpers import frame

from marginwise.functions.kernels import GaussianKernel
from marginwise.operators import pairs

X = np.random.default_rng(5).normal(size=(300, 3))
IDS = [-200_000 + 1_313 * k for k in range(300)]


def test_sets_of_pairs(spark):
    rows, kernel = frame(spark, X, ids=IDS), GaussianKernel(0.5)
    want = pairs.adjacency_sets(pairs.mirror(pairs.kernel_pairs(rows, kernel, 0.3)))
    for tile_rows in (None, 70):
        got = pairs.kernel_adjacency(rows, kernel, 0.3, tile_rows=tile_rows)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.select("segment").distinct().count() > 3
    assert pairs.kernel_adjacency(rows, kernel, 0.999999).count() == 0
