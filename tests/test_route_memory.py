"""Rows find their cells in strips, whatever the size of a chunk."""

import numpy as np
import pyarrow as pa

from marginwise.operators import partition


def test_no_matrix_of_all_rows_by_all_pivots(monkeypatch):
    rng = np.random.default_rng(1)
    X, P = rng.uniform(0, 9, (900, 2)), rng.uniform(0, 9, (30, 2))
    rows = pa.table({"cell": [0] * 900, "guest": rng.random(900) < 0.2, "id": range(900), "x": list(X), "weight": np.ones(900)})
    pivots = pa.table({"cell": [0], "n_pivots": [30], "pivots": [P.ravel()]})
    whole = partition._route(0.8, True, 256)(rows, pivots)
    asked, visits = [], partition.visits

    def seen(D, *rest):
        asked.append(D.size)
        return visits(D, *rest)

    monkeypatch.setattr(partition, "visits", seen)
    monkeypatch.setattr(partition, "STRIP_CELLS", 1000)
    assert partition._route(0.8, True, 256)(rows, pivots).equals(whole)
    assert max(asked) <= 1000 and whole.num_rows > 1100
