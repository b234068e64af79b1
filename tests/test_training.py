from dataclasses import replace

import numpy as np
import pytest
from helpers import frame, kernel_table, train_dense
from pyspark.sql import functions as F

from marginwise.functions.kernels import GaussianKernel, PolynomialKernel
from marginwise.operators.pairs import kernel_diagonal, kernel_pairs, kernel_pairs_blocked, mirror
from marginwise.params import AlgoParams, ModelParams, SplitRatios
from marginwise.plans import training
from marginwise.plans.problem import collapse, prepare

RNG = np.random.default_rng(11)
X = RNG.normal(size=(60, 3))
Y = np.where(X[:, 0] + 0.3 * RNG.normal(size=60) > 0, 1, -1)
KERNEL, EPSILON = GaussianKernel(0.5), 0.05
ALGO = AlgoParams(max_iter=3, decline=0.8, batch_prob=0.85, epsilon=EPSILON, min_delta_alpha=0.0, seed=2)
MODEL = ModelParams(C=0.6, delta=0.1)


def by_id(df, column="alpha"):
    return np.array([r[column] for r in df.orderBy("id").collect()])


def dense(algo=ALGO, model=MODEL, X=X, Y=Y, kernel=KERNEL, iterations=3):
    return train_dense(kernel_table(kernel, X), Y, range(len(Y)), algo.epsilon, model.C, model.delta, algo, iterations)


def test_run_equals_the_dense_loop(spark):
    run = training.train_one(prepare(frame(spark, X, Y), KERNEL, EPSILON), MODEL, ALGO)
    want = dense()
    assert np.allclose(by_id(run.final()), want[-1][1], atol=1e-10)
    assert np.allclose(by_id(run.final(), "alpha_old"), want[-1][2], atol=1e-10)
    history = run.history()
    for n, (pre, after, _) in enumerate(want, 1):
        rows = history.where(F.col("iteration") == n)
        assert np.allclose(by_id(rows), pre, atol=1e-10)
        assert np.allclose(by_id(rows, "alpha_after"), after, atol=1e-10)
    assert history.where((F.col("alpha") < 0) | (F.col("alpha") > MODEL.C)).isEmpty()


@pytest.mark.parametrize("changes", [{"linear_term": False}, {"constant_step": True}])
def test_variants_equal_the_dense_loop(spark, changes):
    algo = AlgoParams(3, 0.0, 0.8, 0.85, EPSILON, seed=2, **changes)
    run = training.train_one(prepare(frame(spark, X, Y), KERNEL, EPSILON), MODEL, algo)
    assert np.allclose(by_id(run.final()), dense(algo)[-1][1], atol=1e-10)


@pytest.mark.parametrize("kernel,epsilon", [(KERNEL, EPSILON), (PolynomialKernel(0.1, 0.0, 1.0), 0.08)])
@pytest.mark.parametrize("broadcast", [True, False])
def test_copies_are_counted_not_repeated(spark, kernel, epsilon, broadcast):
    # A third of the rows are copies of one vector; with the second kernel some k(x, x) lie below the threshold.
    copies = X.copy()
    copies[20:40] = X[0]
    algo = AlgoParams(2, 0.0, 0.8, 0.85, epsilon, seed=2)
    problem = prepare(frame(spark, copies, Y), kernel, epsilon, broadcast=broadcast)
    assert (problem.n_rows, problem.n_vectors, problem.has_copies) == (60, 40, True)
    run = training.train_one(problem, MODEL, algo)
    want = dense(algo, X=copies, kernel=kernel, iterations=2)
    assert np.allclose(by_id(run.final()), want[-1][1], atol=1e-10)


def test_stored_pairs_are_not_moved_again(spark):
    problem = prepare(frame(spark, X, Y), KERNEL, EPSILON, broadcast=False)
    state = training.initial_state(problem, [training.Cell(0, MODEL)], ALGO)
    # Broadcasting off for the plan, as it would be for a large coefficient table.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        z = state.select("cell", "vid", (F.col("alpha") * F.col("label")).alias("z"))
        sums = training.pair_sums(problem, z)
        plan = sums._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan[plan.index("Join") :]
    moved = [line for line in join.splitlines() if "Exchange hashpartitioning(j" in line]
    assert len(moved) == 1, plan


def test_cells_equal_single_runs(spark):
    folded = frame(spark, X, Y).withColumn("fold", (F.col("id") % 3).cast("int"))
    problem = prepare(folded, KERNEL, EPSILON, cells=4)
    cells = [training.Cell(n, ModelParams(C, 0.1), f) for n, (C, f) in enumerate([(0.3, 0), (0.3, 1), (2.0, 0), (2.0, None)])]
    final = training.train(problem, cells, ALGO).final()
    for cell in cells:
        kept = np.array([cell.fold is None or i % 3 != cell.fold for i in range(60)])
        K = kernel_table(KERNEL, X[kept])
        want = train_dense(K, Y[kept], np.flatnonzero(kept), EPSILON, cell.model.C, 0.1, ALGO, 3)[-1][1]
        assert np.allclose(by_id(final.where(F.col("cell") == cell.cell)), want, atol=1e-10)


def test_gradient_forms_agree(spark):
    rows = frame(spark, X, Y)
    problem = prepare(rows, KERNEL, EPSILON)
    state = training.initial_state(problem, [training.Cell(0, MODEL)], ALGO)
    a = by_id(training.gradient(problem, state), "gradient")
    table = mirror(kernel_pairs(rows, KERNEL, EPSILON))
    b = by_id(training.gradient_from_pairs(state, table, kernel_diagonal(rows, KERNEL), n_rows=60), "gradient")
    K = np.where(kernel_table(KERNEL, X) > EPSILON, kernel_table(KERNEL, X), 0)
    alpha = by_id(state)
    assert np.allclose(a, Y * (K @ (alpha * Y)) - 1, atol=1e-10)
    assert np.allclose(a, b, atol=1e-10)


def test_own_pair_builder(spark):
    problem = prepare(frame(spark, X, Y), KERNEL, EPSILON, builder=kernel_pairs_blocked, distinct=False)
    assert 0 < problem.pairs.count() < prepare(frame(spark, X, Y), KERNEL, EPSILON).pairs.count()


def test_equality_constraint_before_clamping(spark):
    df = frame(spark, X, Y).withColumn("step", F.rand(1))
    moved = training.project_equality(df, "step", "projected")
    assert abs(moved.agg(F.sum(F.col("projected") * F.col("label"))).first()[0]) < 1e-9


def test_small_change_stops(spark):
    algo = AlgoParams(5, 1e9, 0.8, 0.85, EPSILON)
    run = training.train_one(prepare(frame(spark, X, Y), KERNEL, EPSILON), MODEL, algo)
    assert run.last == {0: 0}
    assert np.allclose(by_id(run.final()), by_id(run.initial))
    assert by_id(run.history()).size == 60


def test_sparse_coefficients_abort(spark):
    problem = prepare(frame(spark, X, Y), KERNEL, EPSILON)
    zero = training.initial_state(problem, [training.Cell(0, MODEL)], ALGO).withColumn("alpha", F.lit(0.0))
    with pytest.raises(RuntimeError, match="zero"):
        training.train_one(problem, MODEL, ALGO, zero)
    run = training.train(problem, [training.Cell(0, MODEL)], ALGO, zero, strict=False)
    assert run.last == {0: 0}


def test_labels_are_checked(spark):
    with pytest.raises(ValueError, match="labels"):
        prepare(frame(spark, X, np.where(Y > 0, 1, 0)), KERNEL, EPSILON)


def test_one_class(spark):
    run = training.train_one(prepare(frame(spark, X, np.ones(60, dtype=int)), KERNEL, EPSILON), MODEL, ALGO)
    assert np.allclose(by_id(run.final()), dense(Y=np.ones(60))[-1][1], atol=1e-10)


def test_signed_zero_is_one_vector(spark):
    found = collapse(frame(spark, [[0.0, 1.0], [-0.0, 1.0], [2.0, 1.0]]))
    assert (found.n_rows, found.n_vectors) == (3, 2)


@pytest.mark.parametrize(
    "make",
    [
        lambda: AlgoParams(batch_prob=1.0),
        lambda: AlgoParams(decline=0.0),
        lambda: AlgoParams(epsilon=-1.0),
        lambda: AlgoParams(clip_quantile=1.0),
        lambda: ModelParams(C=0.0),
        lambda: SplitRatios(0.7, 0.4),
        lambda: SplitRatios(0.5, 0.1).sizes(499, strict=True),
        lambda: SplitRatios(0.5, 0.1).sizes(30, strict=True),
    ],
)
def test_parameters_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_step_sizes():
    model, algo = ModelParams(1.0, 0.5), AlgoParams(decline=0.5)
    assert [model.step_size(algo, n) for n in (1, 2, 3)] == [0.25, 0.125, 0.0625]
    assert model.step_size(AlgoParams(decline=0.5, constant_step=True), 3) == 0.25


@pytest.mark.parametrize("block", [3, 64, None])
def test_many_cells_share_one_row_per_pair(spark, monkeypatch, block):
    """Strips and block products of all cells give the sums of the cells one by one."""
    if block:
        monkeypatch.setattr(training, "BLOCK_CELLS", block)
        monkeypatch.setattr(training, "fits_broadcast", lambda *_: False)
    problem = prepare(frame(spark, X, Y), KERNEL, EPSILON)
    rng = np.random.default_rng(3)
    rows = [(c, i, float(rng.normal())) for c in range(8) for i in range(len(X)) if (i + c) % 4]
    z = spark.createDataFrame(rows, "cell int, vid bigint, z double")
    got = {(r["cell"], r["vid"]): r["s"] for r in training.pair_sums(problem, z, 8).collect()}
    want = {}
    for c in range(8):
        one = z.where(F.col("cell") == c)
        want |= {(c, r["vid"]): r["s"] for r in training.pair_sums(problem, one, 1).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("name", ["full", "tree"])
def test_named_builders_build_the_same_pairs(spark, name):
    usual = prepare(frame(spark, X, Y), KERNEL, EPSILON).pairs.collect()
    named = prepare(frame(spark, X, Y), KERNEL, EPSILON, builder=name).pairs.collect()
    assert {tuple(r)[:2] for r in named} == {tuple(r)[:2] for r in usual} and len(named) == len(usual)


@pytest.mark.parametrize("after", [1, 2])
def test_resumed_run_equals_an_unbroken_one(spark, tmp_path, after):
    """A driver that is lost after an iteration, in the middle of the next: another one goes on."""
    problem = prepare(frame(spark, X, Y), KERNEL, EPSILON, cells=3)
    cells = [training.Cell(k, ModelParams(C, 0.1)) for k, C in enumerate((0.2, 0.5, 1.0))]
    whole = training.train(problem, cells, ALGO)
    path = str(tmp_path / "run")
    first = training.train(problem, cells, replace(ALGO, max_iter=after), path=path)
    # A step without its log entry: the iteration had not finished.
    first.step(after).limit(3).write.parquet(f"{path}/steps/iteration={after + 1}")
    again = prepare(frame(spark, X, Y), KERNEL, EPSILON, cells=3)
    run = training.train(again, cells, replace(ALGO, max_iter=after), path=path)
    assert run.shifts == first.shifts and run.last == first.last
    assert run.history().count() == first.history().count() == after * 180
    run = training.train(again, cells, ALGO, path=path)
    assert run.last == whole.last and len(run.shifts) == ALGO.max_iter
    keys = ["cell", "iteration", "id"]
    got = {tuple(r[k] for k in keys): (r["alpha"], r["alpha_after"]) for r in run.history().collect()}
    want = {tuple(r[k] for k in keys): (r["alpha"], r["alpha_after"]) for r in whole.history().collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    with pytest.raises(ValueError, match="other settings"):
        training.train(again, cells[:2], ALGO, path=path)
