"""The scale probe looks at all pairs twice, and finds the same values from bad first bounds."""

import numpy as np
import pytest
from helpers import frame, order_quantile

from marginwise.functions.kernels import DistanceForm
from marginwise.operators import pairs

X = np.random.default_rng(4).normal(size=(400, 6))
VALUES = [float(np.sqrt(((X[a] - X[b]) ** 2).sum())) for a in range(400) for b in range(a + 1, 400)]


@pytest.mark.parametrize("bounds,passes", [(None, 2), ((3.0, 9.0), None), ((0.5, 0.6), None)])
def test_passes(spark, monkeypatch, bounds, passes):
    calls, join = [], pairs.tile_join
    monkeypatch.setattr(pairs, "tile_join", lambda *a, **k: calls.append(1) or join(*a, **k))
    if bounds:
        monkeypatch.setattr(pairs, "_sampled_bounds", lambda *a: bounds)
    got = pairs.pair_value_quantile(frame(spark, X), DistanceForm(False), 0.01)
    assert got == pytest.approx(order_quantile(VALUES, 0.01), rel=1e-12)
    assert passes is None or len(calls) == passes
