import numpy as np
import pytest
from helpers import frame, kernel_table, order_quantile, ranks_descending
from pyspark.sql import functions as F

from marginwise.functions.kernels import GaussianKernel
from marginwise.operators import metrics
from marginwise.params import AlgoParams, ModelParams
from marginwise.plans import evaluation, training, tuning
from marginwise.plans.problem import prepare, prepare_eval

RNG = np.random.default_rng(21)
X = RNG.normal(size=(80, 3))
X[50:60] = X[0]
Y = np.where(X[:, 0] > 0, 1, -1)
V = np.vstack([RNG.normal(size=(50, 3)), np.repeat(X[:1], 20, axis=0), [[90.0, 90.0, 90.0]]])
W = np.where(V[:, 0] + 0.5 * RNG.normal(size=71) > 0, 1, -1)
KERNEL, EPSILON = GaussianKernel(0.5), 0.05
K = np.where(kernel_table(KERNEL, X, V) > EPSILON, kernel_table(KERNEL, X, V), 0.0)


@pytest.fixture(scope="module")
def prepared(spark):
    problem = prepare(frame(spark, X, Y), KERNEL, EPSILON)
    return problem, prepare_eval(problem, frame(spark, V, W))


def alpha_table(problem, alpha):
    listed = F.array(*[F.lit(float(a)) for a in alpha])
    return problem.rows.withColumn("alpha", F.element_at(listed, (F.col("id") + 1).cast("int")))


ALPHAS = {
    "spread": RNG.random(80),
    "tied and zero": np.repeat([0.0, 0.25, 0.25, 0.5], 20),
    "all equal": np.full(80, 0.3),
}


@pytest.mark.parametrize("name", ALPHAS)
def test_sweep_equals_clip_then_score(prepared, name):
    problem, evals = prepared
    alpha = ALPHAS[name]
    got = evaluation.sparsity_sweep(alpha_table(problem, alpha), evals).orderBy("q").collect()
    assert [r["q"] for r in got] == list(range(99))
    for q, r in enumerate(got):
        clipped = np.where(alpha < order_quantile(list(alpha), 0.01 * q), 0.0, alpha)
        scores = K.T @ (clipped * Y)
        assert r["correct"] == int((np.sign(np.round(scores, 12)) * W > 0).sum()), q


def test_limited_sweep(prepared):
    problem, evals = prepared
    full = evaluation.sparsity_sweep(alpha_table(problem, ALPHAS["spread"]), evals).where("q < 20").collect()
    part = evaluation.sparsity_sweep(alpha_table(problem, ALPHAS["spread"]), evals, 20).collect()
    assert sorted(map(tuple, full)) == sorted(map(tuple, part))


def scores_of(df):
    return np.array([r["score"] for r in df.orderBy("id").collect()])


def test_scores(spark, prepared, monkeypatch):
    problem, evals = prepared
    alpha = ALPHAS["spread"]
    want = K.T @ (alpha * Y)
    table = alpha_table(problem, alpha)
    got = scores_of(evaluation.score_eval(evals, table, problem.n_vectors))
    assert np.allclose(got, want, atol=1e-10)
    assert got[-1] == 0.0
    support = frame(spark, X, Y).join(table.select("id", (F.col("alpha") * F.col("label")).alias("z")), "id")
    small = evaluation.score_rows(frame(spark, V), support, KERNEL, EPSILON, bias=0.5)
    assert np.allclose(scores_of(small), want + 0.5, atol=1e-10)
    monkeypatch.setattr(evaluation, "MODEL_BYTES", 0)
    large = evaluation.score_rows(frame(spark, V), support, KERNEL, EPSILON, bias=0.5)
    assert np.allclose(scores_of(large), want + 0.5, atol=1e-10)
    own = kernel_table(KERNEL, X)
    training_scores = scores_of(evaluation.score_training(problem, table))
    assert np.allclose(training_scores, np.where(own > EPSILON, own, 0.0) @ (alpha * Y), atol=1e-10)


def test_score_without_model(spark):
    support = frame(spark, X).withColumn("z", F.lit(0.0))
    assert set(scores_of(evaluation.score_rows(frame(spark, V), support, KERNEL, EPSILON))) == {0.0}


def test_selected_model_and_validation(prepared):
    problem, evals = prepared
    algo = AlgoParams(3, 0.0, 0.8, 0.9, EPSILON)
    run = training.train_one(problem, ModelParams(0.5, 0.1), algo)
    records = evaluation.validate_run(run, evals, 30)
    rows = sorted(map(tuple, records.collect()))
    assert [r[0] for r in rows] == [1, 2, 3]
    iteration, sparsity, _ = max(rows, key=lambda r: (r[2], r[0]))
    alphas = run.history().where(F.col("iteration") == iteration).orderBy("id").collect()
    alpha = np.array([r["alpha"] for r in alphas])
    want = np.where(alpha < order_quantile(list(alpha), 0.01 * sparsity), 0.0, alpha)
    chosen = evaluation.select_model(run, records).orderBy("id").collect()
    assert np.allclose([r["alpha"] for r in chosen], want if sparsity else alpha)
    got = evaluation.validation_eval(run.final(), evals, 0.001, 3, problem.n_vectors).first()
    final = np.array([r["alpha"] for r in run.final().orderBy("id").collect()])
    cut = max(min(0.001, final.min()), 1e-6)
    scores = K.T @ (np.where(final > cut, final, 0.0) * Y)
    assert tuple(got) == (int((np.sign(scores) * W > 0).sum()), 3)


def scored(spark, scores, labels):
    rows = [(i, int(y), float(s)) for i, (s, y) in enumerate(zip(scores, labels))]
    return spark.createDataFrame(rows, "id bigint, label int, score double")


def test_predict_methods(spark):
    scores = [3.0, 2.0, 2.0, 0.0, -1.0, -1.0]
    labels = [1, -1, 1, 1, -1, 1]
    standard = evaluation.predict(scored(spark, scores, labels)).first().asDict()
    assert (standard["correct"], standard["correct_positive"], standard["correct_negative"]) == (3, 2, 1)
    assert (standard["n"], standard["n_positive"], standard["n_negative"]) == (6, 4, 2)
    ranks = np.array(ranks_descending(scores))
    called = np.where(ranks / ranks.max() > 0.5, -1, 1)
    threshold = evaluation.predict(scored(spark, scores, labels), "threshold", 0.5).first()
    assert threshold["correct"] == int((called * labels > 0).sum())
    assert threshold["sign_correct_positive"] == 2
    with pytest.raises(ValueError):
        evaluation.predict(scored(spark, scores, labels), "other")
    with pytest.raises(ValueError):
        evaluation.predict(scored(spark, scores, labels), "threshold", 1.0)


def brute_roc(scores, labels):
    ranks = np.array(ranks_descending(list(scores)))
    quantile, labels = ranks / ranks.max(), np.array(labels)
    for t in range(1, 100):
        positive = quantile < t / 100.0
        tp, fp = int((positive & (labels > 0)).sum()), int((positive & (labels < 0)).sum())
        yield t, tp, fp


@pytest.mark.parametrize("case", ["spread", "ties", "ties at the lowest", "percent steps", "one class"])
def test_roc(spark, case):
    n = 101
    labels = np.where(RNG.random(n) < 0.5, 1, -1)
    scores = {
        "spread": RNG.normal(size=n),
        "ties": RNG.integers(0, 5, n),
        "ties at the lowest": np.maximum(RNG.normal(size=n), 0),
        "percent steps": np.arange(n),
        "one class": np.arange(n),
    }[case]
    if case == "one class":
        labels = np.ones(n, dtype=int)
    rates = evaluation.predict(scored(spark, scores, labels), "auc")
    got = rates.orderBy("cutoff").collect()
    top = max(r["accuracy"] for r in got)
    assert tuple(metrics.best_cutoff(rates).first()) == (min(r["cutoff"] for r in got if r["accuracy"] == top), top)
    assert [(r["cutoff"], r["true_positive"], r["false_positive"]) for r in got] == list(brute_roc(scores, labels))
    for r in got:
        tp, fp, p = r["true_positive"], r["false_positive"], int((labels > 0).sum())
        assert r["sensitivity"] == pytest.approx(tp / p)
        assert r["precision"] == (pytest.approx(tp / (tp + fp)) if tp + fp else None)
        assert r["q_value"] == pytest.approx((tp / (tp + fp)) / np.sqrt(fp / (tp + fp)) if tp and fp else 0.0)
        assert r["accuracy"] == pytest.approx((tp + (n - p) - fp) / n)
        if case == "one class":
            assert r["specificity"] is None


def test_roc_of_equal_scores(spark):
    with pytest.raises(Exception, match="all scores are equal"):
        metrics.roc_table(scored(spark, [1, 1], [1, -1])).collect()


def test_published_confusion_matrices(spark):
    cases = [
        ([(-1, -1, 1096), (-1, 1, 168), (1, -1, 578), (1, 1, 2914)], [-1, 1], 0.8431455),
        ([(0, 0, 11355), (0, 1, 6257), (1, 0, 7391), (1, 1, 14997)], [0, 1], 0.6588),
    ]
    for cells, classes, expected in cases:
        df = spark.createDataFrame(cells, "p int, y int, n int").selectExpr("p", "y", "explode(sequence(1, n)) AS c")
        report = metrics.confusion_report(df, "p", "y", 1).first()
        assert report["accuracy"] == pytest.approx(expected, abs=1e-7)
        table = {r["predicted"]: r for r in metrics.confusion_matrix(df, "p", "y", classes).collect()}
        for p, y, n in cells:
            assert table[p][f"actual_{y}".replace("-", "m")] == n
    assert report["false_positive_over_actual_positive"] == pytest.approx(7391 / 21254)


def test_best_choices_break_ties_upwards(spark):
    sweep = spark.createDataFrame([(0, 5), (3, 7), (9, 7), (10, 6)], "q int, correct bigint")
    assert tuple(metrics.best_sparsity(sweep).first()) == (9, 7)
    records = spark.createDataFrame([(1, 4, 8), (2, 5, 9), (3, 6, 9)], "iteration int, sparsity int, correct bigint")
    assert metrics.best_iteration(records).first().asDict() == {"iteration": 3, "correct": 9, "sparsity": 6}


def test_grid_search_and_report(spark):
    algo = AlgoParams(2, 0.0, 0.8, 0.9, EPSILON)
    rows = frame(spark, X, Y)
    found = tuning.grid_search_cv(rows, {"gaussian": KERNEL}, (0.1, 1.0), algo, 0.1, k=4, seed=1).collect()
    assert [r["C"] for r in sorted(found, key=lambda r: r["C"])] == [0.1, 1.0]
    assert sum(r["is_best"] for r in found) == 1
    best = next(r for r in found if r["is_best"])
    assert best["mean_error"] == min(r["mean_error"] for r in found) and 0 <= best["mean_error"] < 0.5
    report = tuning.final_test_report(rows, frame(spark, V[:20], W[:20]), frame(spark, V[20:], W[20:]), KERNEL, ModelParams(1.0, 0.1), algo)
    assert sum(r["actual_m1"] + r["actual_1"] for r in report.collect()) == 51


@pytest.mark.parametrize("threshold,clip", [(None, 0.0), (0.1, 0.0), (None, 0.4)])
def test_prediction_as_a_matrix_product(spark, threshold, clip):
    from marginwise.operators.pairs import kernel_pairs_between

    alpha = ALPHAS["spread"]
    train = frame(spark, X, Y).withColumn("alpha", F.element_at(F.array(*[F.lit(float(a)) for a in alpha]), (F.col("id") + 1).cast("int")))
    entries = kernel_pairs_between(frame(spark, X), frame(spark, V), KERNEL, EPSILON).withColumnRenamed("k", "value")
    got = evaluation.predict_distributed(train, entries, frame(spark, V, W), 0.0001, threshold, clip).orderBy("id").collect()
    kept = np.where(alpha < order_quantile(list(alpha), clip), 0.0, alpha) if clip else alpha
    cut = max(min(0.0001, kept.min()), 1e-6)
    scores = K.T @ (np.where(kept > cut, kept, 0.0) * Y)
    assert np.allclose([r["score"] for r in got], scores, atol=1e-10)
    want = np.sign(scores) if threshold is None else np.where(scores < threshold, 1, -1)
    assert [r["prediction"] for r in got] == list(want)


def test_scores_do_not_depend_on_the_model_size(spark, monkeypatch):
    rng = np.random.default_rng(12)
    X = [[float(v) for v in x] for x in rng.normal(size=(40, 3))]
    odd = [[float("nan"), 0.0, 1.0], None, [None, 1.0, 2.0], [float("inf"), 0.0, 0.0]]
    rows = [(i, x) for i, x in enumerate(X + odd)] + [(3, X[3])]
    support = [(i, x, float(i % 3 - 1)) for i, x in enumerate(X + odd)] + [(500, [0.0, 0.0, 0.0], 2.0)]
    # Rows at the threshold exactly: distance 1 from the last support vector.
    rows += [(600, [1.0, 0.0, 0.0]), (601, [0.0, -1.0, 0.0])]
    frame = spark.createDataFrame(rows, "id bigint, x array<double>")
    model = spark.createDataFrame(support, "id bigint, x array<double>, z double")
    kernel = GaussianKernel(1.0)
    epsilon = float(np.exp(-1.0))
    found = []
    for limit in (evaluation.MODEL_BYTES, 0):
        monkeypatch.setattr(evaluation, "MODEL_BYTES", limit)
        scored = evaluation.score_rows(frame, model, kernel, epsilon, bias=0.25).collect()
        found.append(sorted((r["id"], round(r["score"], 9)) for r in scored))
    assert found[0] == found[1] and len(found[0]) == len(rows)
    assert dict(found[0])[41] == 0.25
