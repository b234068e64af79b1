import numpy as np
import pytest
from helpers import frame, kernel_table, pair_dict

from marginwise.functions.kernels import GaussianKernel, LinearKernel, PolynomialKernel
from marginwise.operators import pairs
from pyspark.sql import functions as F

RNG = np.random.default_rng(3)
POINTS = RNG.normal(size=(150, 5))
KERNELS = [
    (GaussianKernel(0.2), 0.15),
    (GaussianKernel(1.0), 0.0),
    (PolynomialKernel(0.5, 1.0, 2.0), 1.5),
    (PolynomialKernel(1.0, 0.0, 0.5), 0.5),
    (LinearKernel(), -0.2),
]


def expected(kernel, epsilon, X, ids=None):
    ids = list(range(len(X))) if ids is None else ids
    with np.errstate(invalid="ignore"):
        K = kernel_table(kernel, X)
        return {
            (min(ids[a], ids[b]), max(ids[a], ids[b])): K[a, b]
            for a in range(len(X))
            for b in range(a + 1, len(X))
            if K[a, b] > epsilon
        }


@pytest.mark.parametrize("kernel,epsilon", KERNELS)
@pytest.mark.parametrize("tile_rows", [40, 4096])
def test_pairs_equal_brute_force(spark, kernel, epsilon, tile_rows):
    got = pair_dict(pairs.kernel_pairs(frame(spark, POINTS), kernel, epsilon, tile_rows=tile_rows))
    want = expected(kernel, epsilon, POINTS)
    assert got.keys() == want.keys()
    assert all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)
    assert all(i < j for i, j in got)


@pytest.mark.parametrize("kernel,epsilon", KERNELS[:3])
def test_rectangle_equals_brute_force(spark, kernel, epsilon):
    left, right = POINTS[:90], POINTS[90:]
    got = pair_dict(pairs.kernel_pairs_between(frame(spark, left), frame(spark, right), kernel, epsilon, tile_rows=25))
    K = kernel_table(kernel, left, right)
    want = {(a, b): K[a, b] for a in range(90) for b in range(60) if K[a, b] > epsilon}
    assert got.keys() == want.keys()
    assert all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)


@pytest.mark.parametrize("dimensions", [1, 2, 3])
def test_pruning_loses_nothing(spark, dimensions):
    rng = np.random.default_rng(dimensions)
    X = rng.uniform(-20, 20, size=(400, dimensions))
    # A third of the rows crowd into one spot.
    X[:130] = 3.0 + 0.01 * rng.normal(size=(130, dimensions))
    kernel, epsilon = GaussianKernel(0.7), 0.3
    pruned = pair_dict(pairs.kernel_pairs(frame(spark, X), kernel, epsilon, tile_rows=50, prune=True))
    assert pruned.keys() == expected(kernel, epsilon, X).keys()
    half = frame(spark, X[:200]), frame(spark, X[200:])
    a = pair_dict(pairs.kernel_pairs_between(*half, kernel, epsilon, tile_rows=30, prune=True))
    b = pair_dict(pairs.kernel_pairs_between(*half, kernel, epsilon, prune=False))
    assert a.keys() == b.keys()


def test_pruning_evaluates_fewer_pairs(spark):
    X = np.random.default_rng(5).uniform(-50, 50, size=(600, 2))
    from marginwise.operators.tiles import emit_counts, tile_join

    def considered(prune):
        counts = tile_join(
            frame(spark, X), None, GaussianKernel(1.0), 0.3, emit_counts, pairs._COUNT_DDL, pairs._COUNT_ARROW, prune=prune
        )
        return counts.agg(F.sum("n_considered"), F.sum("n_kept")).first()

    full, pruned = considered(False), considered(True)
    assert full[0] == 600 * 599 // 2
    assert pruned[1] == full[1]
    assert pruned[0] < full[0] / 20


def test_arbitrary_ids_and_copies(spark):
    X = np.repeat(POINTS[:10], 6, axis=0)
    ids = [int(v) for v in np.random.default_rng(7).permutation(60) * 1_000_003]
    got = pair_dict(pairs.kernel_pairs(frame(spark, X, ids=ids), GaussianKernel(0.2), 0.5, tile_rows=16))
    assert got.keys() == expected(GaussianKernel(0.2), 0.5, X, ids).keys()


def test_no_pair_survives(spark):
    rows = frame(spark, POINTS)
    assert pairs.kernel_pairs(rows, GaussianKernel(1.0), 0.999999).isEmpty()
    assert pairs.nonzero_count_train(rows, GaussianKernel(1.0), 0.999999).first()[0] == 150


def test_empty_and_single_row(spark):
    none = frame(spark, POINTS[:0].reshape(0, 5))
    assert pairs.kernel_pairs(none, LinearKernel(), 0.0).isEmpty()
    assert pairs.kernel_pairs(frame(spark, POINTS[:1]), GaussianKernel(1.0), 0.1, prune=True).isEmpty()
    assert pairs.kernel_pairs_between(frame(spark, POINTS), none, LinearKernel(), 0.0).isEmpty()


def test_value_at_the_threshold_is_dropped(spark):
    X = np.array([[1.0, 0.0], [0.5, 0.0], [0.50000001, 0.0]])
    got = pair_dict(pairs.kernel_pairs(frame(spark, X), LinearKernel(), 0.5))
    assert got.keys() == {(0, 2)}


def test_column_form_equals_block_form(spark):
    rows = frame(spark, POINTS[:2]).selectExpr("x").collect()
    df = spark.createDataFrame([(rows[0]["x"], rows[1]["x"])], "x array<double>, y array<double>")
    for kernel, _ in KERNELS[:3] + KERNELS[4:]:
        got = df.select(kernel.expr(F.col("x"), F.col("y"))).first()[0]
        assert got == pytest.approx(kernel.block(POINTS[:1], POINTS[1:2])[0, 0], abs=1e-12)


def test_vectors_of_different_length(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "x array<double>, y array<double>")
    with pytest.raises(Exception, match="different length"):
        df.select(LinearKernel().expr(F.col("x"), F.col("y"))).collect()
    with pytest.raises(ValueError):
        GaussianKernel(0.0)


def test_mixed_lengths_are_refused_by_name(spark):
    rows = spark.createDataFrame([(5, [1.0, 2.0]), (7, [1.0]), (9, [1.0, 3.0])], "id bigint, x array<double>")
    with pytest.raises(ValueError, match="row 7 has 1 components"):
        pairs.kernel_pairs(rows, GaussianKernel(1.0), 0.1)
    with pytest.raises(ValueError, match="row 7 has 1"):
        pairs.kernel_pairs_between(rows.where("id = 5"), rows.where("id = 7"), LinearKernel(), 0.1)


def test_blocks_need_four_rows(spark):
    assert pairs.block_ends(8) == [4, 6, 7, 8]
    with pytest.raises(ValueError, match="too few"):
        pairs.block_ends(3)


def test_signed_matrix(spark):
    labels = np.where(RNG.random(40) < 0.5, -1, 1)
    X, kernel = POINTS[:40], GaussianKernel(0.2)
    K = np.outer(labels, labels) * kernel_table(kernel, X)
    for signed_filter in (False, True):
        keep = K > 0.2 if signed_filter else np.abs(K) > 0.2
        got = pairs.kernel_matrix_signed(frame(spark, X, labels), kernel, 0.2, signed_filter, tile_rows=16).collect()
        assert {(r["i"], r["j"]) for r in got} == {tuple(map(int, p)) for p in np.argwhere(keep)}
        assert all(r["value"] == pytest.approx(K[r["i"], r["j"]]) for r in got)


def test_blocks(spark):
    assert pairs.block_ends(10_000) == [5000, 7071, 8660, 10_000]
    X, kernel = POINTS[:80], GaussianKernel(0.2)
    ends = pairs.block_ends(80)
    block = lambda p, e: next(k for k, end in enumerate(e) if p < end)
    got = pair_dict(pairs.kernel_pairs_blocked(frame(spark, X), kernel, 0.2, tile_rows=16))
    want = {p for p in expected(kernel, 0.2, X) if block(p[0], ends) == block(p[1], ends)}
    assert got.keys() == want
    evals = POINTS[80:120]
    quarter = pairs.block_ends(10)
    got = pair_dict(pairs.kernel_pairs_blocked(frame(spark, X), kernel, 0.2, frame(spark, evals), tile_rows=16))
    K = kernel_table(kernel, X, evals)
    want = {(a, b) for a in range(80) for b in range(40) if K[a, b] > 0.2 and block(a, ends) == block(b % 10, quarter)}
    assert got.keys() == want
    with pytest.raises(ValueError, match="multiple of four"):
        pairs.kernel_pairs_blocked(frame(spark, X), kernel, 0.2, frame(spark, evals[:39]))


def test_counts(spark):
    rows, kernel = frame(spark, POINTS), GaussianKernel(0.2)
    n = len(expected(kernel, 0.2, POINTS))
    assert pairs.nonzero_count_train(rows, kernel, 0.2).first()[0] == 150 + 2 * n
    K = kernel_table(kernel, POINTS[:70], POINTS[70:])
    found = pairs.nonzero_count_eval(frame(spark, POINTS[:70]), frame(spark, POINTS[70:]), kernel, 0.2)
    assert found.first()[0] == int((K > 0.2).sum())


def test_upper_triangle(spark):
    for n in (0, 1, 2, 5):
        got = sorted(tuple(r) for r in pairs.upper_triangle(spark, n).collect())
        assert got == [(i, j) for i in range(n) for j in range(i + 1, n)]


def test_nan_is_no_similarity(spark):
    df = spark.createDataFrame([(0, 1, float("nan")), (0, 2, 0.5), (1, 2, 0.1)], "i bigint, j bigint, k double")
    assert pair_dict(pairs.epsilon_filter(df, 0.1)).keys() == {(0, 2)}


def test_adjacency_segments_keep_every_column(spark):
    df = spark.range(3000).selectExpr("0L AS i", "id * 100 AS j", "1.0D AS k")
    sets = pairs.adjacency_sets(df).collect()
    assert all(len(r["columns"]) <= pairs.SEGMENT_IDS for r in sets)
    assert sorted(c for r in sets for c in r["columns"]) == [v * 100 for v in range(3000)]


def test_merge_removes_duplicates(spark):
    table = pairs.kernel_pairs(frame(spark, POINTS), GaussianKernel(0.2), 0.2)
    assert pairs.merge_pair_tables(table, table).count() == table.count()
    assert pairs.merge_pair_tables(table, table, disjoint=True).count() == 2 * table.count()


def test_kernel_scale(spark):
    from helpers import order_quantile

    distances = [np.sqrt(np.linalg.norm(POINTS[a] - POINTS[b])) for a in range(50) for b in range(a + 1, 50)]
    sigma = order_quantile(distances, 0.01) * np.e / 4
    assert pairs.kernel_scale(frame(spark, POINTS[:50])) == pytest.approx(1 / (2 * sigma**2))


def test_kernel_scale_reads_every_row(spark):
    from helpers import order_quantile

    rng = np.random.default_rng(9)
    X = rng.normal(size=(120, 3)) * np.linspace(0.01, 4, 120)[:, None]
    for q in (0.0, 0.3, 1.0):
        values = [np.linalg.norm(X[a] - X[b]) for a in range(120) for b in range(a + 1, 120)]
        gamma = pairs.kernel_scale(frame(spark, X), quantile=q, factor=1.0, root_distance=False)
        assert gamma == pytest.approx(1 / (2 * order_quantile(values, q) ** 2))


def test_kernel_scale_of_far_and_equal_rows(spark):
    """Clusters, copies and one far row: the bound prunes most pairs and the value is that of all."""
    from helpers import order_quantile

    from marginwise.functions.kernels import DistanceForm

    rng = np.random.default_rng(12)
    X = rng.normal(size=(30, 4))[rng.integers(0, 30, 500)] * 50 + rng.normal(size=(500, 4)) * 0.01
    X[:25], X[-1] = X[0], 1e6
    rows = frame(spark, X)
    odd = frame(spark, np.array([[np.nan, 0, 0, 0], [np.inf, 0, 0, 0]]), ids=[900, 901])
    values = [np.sqrt(((X[a] - X[b]) ** 2).sum()) for a in range(500) for b in range(a + 1, 500)]
    for q in (0.0, 0.002, 0.01, 0.5, 1.0):
        got = pairs.pair_value_quantile(rows.unionByName(odd), DistanceForm(False), q)
        assert got == pytest.approx(order_quantile(values, q), rel=1e-12, abs=1e-300)


ODD = [[np.nan, 0.0], [np.inf, 1.0], [-np.inf, np.nan], [1e200, 0.0]]


@pytest.mark.parametrize("prune", [False, True])
@pytest.mark.parametrize("kernel", [GaussianKernel(0.5), PolynomialKernel(1.0, 0.5, 2.0), LinearKernel()])
def test_odd_rows_only_lose_their_own_pairs(spark, prune, kernel):
    rng = np.random.default_rng(10)
    X = np.concatenate([rng.normal(size=(60, 2)), np.array(ODD)])
    rows = frame(spark, X)
    nulls = spark.createDataFrame([(900, 1, None), (901, 1, [None, 1.0])], "id bigint, label int, x array<double>")
    rows = rows.unionByName(nulls)
    with np.errstate(all="ignore"):
        K = kernel_table(kernel, X)
    want = {(i, j) for i in range(len(X)) for j in range(i + 1, len(X)) if K[i, j] > 0.3}
    found = pair_dict(pairs.kernel_pairs(rows, kernel, 0.3, tile_rows=16, prune=prune))
    assert set(found) == want
    between = pair_dict(pairs.kernel_pairs_between(rows, rows, kernel, 0.3, tile_rows=16, prune=prune))
    assert {(i, j) for i, j in between if i < j} == want


def test_pairs_by_block_are_complete(spark):
    X = POINTS[:61]
    kernel = GaussianKernel(0.2)
    got = pairs.kernel_pairs_by_block(frame(spark, X), kernel, 0.2).collect()
    want = pair_dict(pairs.kernel_pairs(frame(spark, X), kernel, 0.2))
    assert {(r["i"], r["j"]): r["k"] for r in got} == want and len(got) == len(want)
    ends = pairs.block_ends(61)
    block = lambda p: sum(p >= e for e in ends)
    assert all((r["block_i"], r["block_j"]) == (block(r["i"]), block(r["j"])) for r in got)
