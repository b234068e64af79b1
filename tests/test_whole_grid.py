"""The grid search of the catalog is the whole one, and equal cells tie."""

import pytest

from marginwise import catalog
from marginwise import oracles as sql
from marginwise.operators import metrics
from marginwise.plans import tuning


def test_query_searches_the_whole_grid(spark, monkeypatch):
    asked = {}

    def note(rows, kernels, costs, algo, delta, k, seed):
        asked.update(costs=costs, k=k, algo=algo)
        return spark.createDataFrame([("gaussian", 1.0, 0.5, True)], "kernel string, C double, mean_error double, is_best boolean")

    monkeypatch.setattr(catalog.tuning, "grid_search_cv", note)
    monkeypatch.setattr(catalog, "vectors", lambda spark, sf: None)
    assert catalog.grid_search_cv(spark, "nowhere").count() == 1
    assert set(asked["costs"]) == {*tuning.COARSE_COSTS, *tuning.FINE_COSTS} and asked["k"] == 10
    # The iterations of the training that the reference runs on the same data, none of them left out early.
    assert asked["algo"].max_iter == 10 and asked["algo"].min_delta_alpha == 0.0
    assert "s10 AS" in sql.GRID_SEARCH_CV and "s11 AS" not in sql.GRID_SEARCH_CV


def test_equal_errors_tie_in_any_order(spark):
    errors = [0.1, 0.2, 0.3, 0.7, 0.55]
    rows = [("g", 2.0, k, e) for k, e in enumerate(errors)] + [("g", 1.0, k, e) for k, e in enumerate(reversed(errors))]
    rows += [("g", 3.0, 0, 0.9), ("g", 3.0, 1, None), ("h", 1.0, 0, None)]
    table = spark.createDataFrame(rows, "kernel string, C double, fold int, error double").coalesce(1)
    found = {(r["kernel"], r["C"]): r for r in metrics.error_mean_by_grid(table.where("kernel = 'g'"), ["kernel", "C"]).collect()}
    assert found["g", 1.0]["mean_error"] == found["g", 2.0]["mean_error"] == pytest.approx(0.37)
    assert [k for k, r in found.items() if r["is_best"]] == [("g", 1.0)] and found["g", 3.0]["mean_error"] == 0.9
    empty = metrics.error_mean_by_grid(table.where("kernel = 'h'"), ["kernel", "C"]).first()
    assert empty["mean_error"] is None
