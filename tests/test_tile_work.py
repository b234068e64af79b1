"""The work of a task is bounded: rows of a tile, and tasks that grow in number with the pairs of rows."""

import numpy as np
from helpers import frame, kernel_table, pair_dict

from marginwise.functions.kernels import GaussianKernel
from marginwise.operators import pairs, tiles


def test_tasks_grow_with_the_pairs_of_rows(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_ROWS", 64)
    monkeypatch.setattr(tiles, "TASK_PAIRS", 2500)
    X = np.random.default_rng(1).normal(size=(1000, 3))
    for prune in (False, None):
        found = pairs.kernel_pairs(frame(spark, X), GaussianKernel(1.0), 0.4, prune=prune)
        # 16 tiles, 136 pairs of them.
        assert found.rdd.getNumPartitions() == 136
    K = kernel_table(GaussianKernel(1.0), X)
    assert pair_dict(found).keys() == {(a, b) for a in range(1000) for b in range(a + 1, 1000) if K[a, b] > 0.4}


def test_narrow_rows_do_not_make_large_tiles(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    assert tiles.TILE_ROWS * tiles.TILE_ROWS <= 1 << 28
    monkeypatch.setattr(tiles, "TILE_ROWS", 64)

    def emit(s):
        seen.add(int(len(s.right_id) > 200))
        return tiles.emit_counts(s)

    X = np.random.default_rng(2).normal(size=(3000, 1))
    counts = tiles.tile_join(frame(spark, X), None, GaussianKernel(1.0), 0.5, emit, pairs._COUNT_DDL, pairs._COUNT_ARROW, prune=False)
    assert counts.groupBy().sum("n_considered").first()[0] == 3000 * 2999 // 2 and seen.value == 0


def test_values_against_one_side_equal_the_block():
    rng = np.random.default_rng(3)
    X, Y = rng.normal(size=(70, 4)), rng.normal(size=(90, 4))
    X[3, 1], Y[5, 2], Y[6, 0] = np.nan, np.inf, 1e200
    for gamma, epsilon in ((1.0, 0.2), (1.0, 0.0), (0.01, 0.2)):
        kernel = GaussianKernel(gamma)
        with np.errstate(all="ignore"):
            want, got = kernel_table(kernel, X, Y), kernel.against(Y, epsilon)(X)
        assert ((got > epsilon) == (want > epsilon)).all()
        assert np.allclose(got[want > epsilon], want[want > epsilon])
