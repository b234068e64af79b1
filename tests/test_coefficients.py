"""Known answers for coefficient vectors."""

import pytest

from marginwise.operators import metrics, ranks
from marginwise.plans import training


def alphas(spark, alpha, old):
    rows = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(alpha, old))]
    return spark.createDataFrame(rows, "id bigint, alpha double, alpha_old double")


SHUFFLED = [2, 1, 3, 4, 5, 6, 7, 8, 9, 10]
UP = list(range(1, 11))


def values(df, column="alpha"):
    return [r[column] for r in df.orderBy("id").collect()]


def test_momentum_of_one_sixth(spark):
    df = alphas(spark, [1, 2, 3], [2, 2, 2])
    assert metrics.momentum(df).first()[0] == pytest.approx(1 / 6)
    moved = training.momentum_update(df)
    assert values(moved) == pytest.approx([1 + 2 / 6, 2 + 2 / 6, 3 + 2 / 6])
    assert values(moved, "alpha_old") == [1, 2, 3]


def test_zero_old_vector_leaves_everything(spark):
    moved = training.momentum_update(alphas(spark, UP, [0] * 10))
    assert values(moved) == UP
    assert values(moved, "alpha_old") == [0] * 10


def test_equal_vectors_do_not_move(spark):
    assert values(training.momentum_update(alphas(spark, UP, UP))) == UP


def test_negative_momentum_is_zero(spark):
    assert metrics.momentum(alphas(spark, [1, 1], [2, 2])).first()[0] == 0.0


def test_clip_at_half_leaves_five(spark):
    df = alphas(spark, SHUFFLED, UP)
    threshold = ranks.order_statistics(df, "alpha", [0.5])[0.5]
    clipped = training.clip_alphas(df, threshold)
    assert sum(v != 0 for v in values(clipped)) == 5
    assert metrics.sparsity_pct(clipped).first()[0] == 50.0


def test_l1_change(spark):
    assert metrics.delta_l1(alphas(spark, [1] * 10, [2] * 10)).first()[0] == 10.0


def test_sorting_keeps_the_original(spark):
    df = alphas(spark, SHUFFLED, UP)
    hist = ranks.histogram(df, "alpha")
    first = ranks.running_totals(hist, "alpha", ["n"]).orderBy("n_upto").first()
    assert first["alpha"] == 1
    assert values(df)[0] == 2


def test_median(spark):
    assert ranks.order_statistics(alphas(spark, UP, UP), "alpha", [0.5])[0.5] == 5.5


def test_quantiles_of_a_constant(spark):
    levels = [0.0, 0.01, 0.1, 0.9, 1.0]
    found = ranks.order_statistics(alphas(spark, [1] * 10, UP), "alpha", levels)
    assert found == {q: 1.0 for q in levels}


def test_initial_coefficients_lie_in_the_box(spark):
    df = training.init_alphas(spark.range(1000), 0.7, seed=4)
    low, high, old_high = df.selectExpr("min(alpha)", "max(alpha)", "max(alpha_old)").first()
    assert 0 < low and high <= 0.7 and old_high <= 0.7
    assert df.where("alpha = alpha_old").count() == 0
