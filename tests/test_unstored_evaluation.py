"""Scores, sweeps and the choice of a model without a table of evaluation pairs are those with one."""

import numpy as np
import pytest
from helpers import frame
from pyspark.sql import functions as F

from marginwise.functions.kernels import GaussianKernel
from marginwise.params import AlgoParams, ModelParams
from marginwise.plans import evaluation, training
from marginwise.plans import problem as problems
from marginwise.plans.problem import prepare, prepare_eval

RNG = np.random.default_rng(4)
X = np.concatenate([RNG.normal(size=(110, 3)), np.repeat(RNG.normal(size=(1, 3)), 10, axis=0)])
Y = np.where(X[:, 0] + 0.3 * RNG.normal(size=len(X)) > 0, 1, -1)
V = np.concatenate([RNG.normal(size=(60, 3)), X[:3], np.full((1, 3), 50.0)])
W = np.where(V[:, 0] > 0, 1, -1)
KERNEL = GaussianKernel(1.0)


@pytest.mark.parametrize("slots", [40, 512])
def test_model_choice_without_pairs(spark, monkeypatch, slots):
    monkeypatch.setattr(evaluation, "SUM_SLOTS", slots)
    problem = prepare(frame(spark, X, Y), KERNEL, 0.2)
    run = training.train_one(problem, ModelParams(0.5, 0.1), AlgoParams(max_iter=2, decline=0.8, batch_prob=0.9, epsilon=0.2))
    found = []
    for store in (True, False):
        evals = prepare_eval(problem, frame(spark, V, W), store=store)
        assert (evals.pairs is None) != store
        records = evaluation.validate_run(run, evals, 30)
        chosen = {r["id"]: r["alpha"] for r in evaluation.select_model(run, records).collect()}
        scores = {r["id"]: r["score"] for r in evaluation.score_eval(evals, run.final()).collect()}
        sweep = evaluation.sparsity_sweep(run.final().select("id", "vid", "label", "alpha"), evals, 30).collect()
        found.append((sorted(map(tuple, records.collect())), chosen, sorted(map(tuple, sweep)), scores))
    (records, chosen, sweep, scores), other = found
    assert other[:3] == (records, chosen, sweep) and len(sweep) == 30
    assert other[3] == pytest.approx(scores) and scores[len(V) - 1] == 0.0


def test_many_evaluation_pairs_are_not_stored(spark, monkeypatch):
    problem = prepare(frame(spark, X, Y), KERNEL, 0.2)
    assert prepare_eval(problem, frame(spark, V, W)).pairs is not None
    monkeypatch.setattr(problems, "STORED_PAIRS", 100)
    evals = prepare_eval(problem, frame(spark, V, W))
    assert evals.pairs is None
    nobody = problem.rows.withColumn("alpha", F.lit(0.0))
    assert {r["score"] for r in evaluation.score_eval(evals, nobody).collect()} == {0.0}
