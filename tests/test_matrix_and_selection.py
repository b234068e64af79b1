import numpy as np
import pytest
from pyspark.sql import functions as F

from marginwise.operators import joins, matrix, metrics, selection
from marginwise.sources.tables import instances

RNG = np.random.default_rng(31)


def entries(spark, M):
    rows = [(int(i), int(j), float(M[i, j])) for i, j in np.argwhere(M != 0)]
    return spark.createDataFrame(rows, "i bigint, j bigint, value double")


def dense(df, shape):
    M = np.zeros(shape)
    for r in df.collect():
        M[r["i"], r["j"]] += r["value"]
    return M


A = np.where(RNG.random((20, 12)) < 0.4, RNG.normal(size=(20, 12)), 0.0)
A[:, 3] = RNG.normal(size=20)  # a crowded inner index
B = np.where(RNG.random((12, 9)) < 0.4, RNG.normal(size=(12, 9)), 0.0)


@pytest.mark.parametrize("rows,hot_rows", [(None, 100_000), (10**9, 5), (10**9, 10**6), (None, 2)])
def test_matmul(spark, rows, hot_rows):
    got = dense(matrix.matmul(entries(spark, A), entries(spark, B), rows, hot_rows), (20, 9))
    assert np.allclose(got, A @ B)


def test_matmul_adds_repeated_entries(spark):
    twice = entries(spark, A).unionByName(entries(spark, A))
    assert np.allclose(dense(matrix.matmul(twice, entries(spark, B)), (20, 9)), 2 * A @ B)


@pytest.mark.parametrize("rows", [None, 12])
def test_matvec_signum(spark, rows):
    v = spark.createDataFrame([(k, float(k) - 4) for k in range(12)], "i bigint, value double")
    got = {r["i"]: r["value"] for r in matrix.matvec_signum(entries(spark, A), v, rows, hot_rows=4).collect()}
    want = np.sign(A) @ (np.arange(12) - 4.0)
    assert all(got[k] == pytest.approx(want[k]) for k in range(20))


def test_vectors_and_rows(spark):
    v = spark.createDataFrame([(0, 0.5), (1, -0.01), (2, -3.0)], "i bigint, value double")
    assert sorted(map(tuple, matrix.vector_to_entries(v, False).collect())) == [(0, 0, 0.5), (1, 0, -0.01), (2, 0, -3.0)]
    sparse = matrix.sparse_vector_to_entries(v, 0.1)
    assert sorted(map(tuple, sparse.collect())) == [(0, 0, 0.5), (0, 2, -3.0)]
    with pytest.raises(ValueError):
        matrix.sparse_vector_to_entries(v, 10.0)
    back = matrix.entries_to_dense_vector(sparse, 4).orderBy("i").collect()
    assert [r["value"] for r in back] == [0.5, 0.0, -3.0, 0.0]
    M = entries(spark, A)
    assert [r["value"] for r in matrix.matrix_row(M, 5, 12).orderBy("i").collect()] == list(A[5])
    assert matrix.matrix_row(M, 99, 12).isEmpty()
    arrays = spark.createDataFrame([(7, [1.0, 2.0])], "id bigint, x array<double>")
    assert sorted(map(tuple, matrix.array_to_entries(arrays, "id", "x").collect())) == [(7, 0, 1.0), (7, 1, 2.0)]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("left_rows,right_rows", [(None, 10), (None, None), (900, None)])
def test_keyed_join_with_a_hot_key(spark, how, left_rows, right_rows):
    left = spark.range(900).selectExpr("if(id < 300, 0L, id % 40) AS k", "id AS v")
    right = spark.range(0, 40, 2).selectExpr("id AS k", "id * 10 AS w")
    got = joins.keyed_join(left, right, ["k"], how, left_rows, right_rows, hot_rows=50)
    assert sorted(map(tuple, got.select("k", "v", "w").collect()), key=repr) == sorted(
        map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()), key=repr
    )


def test_hot_key_is_spread(spark):
    left = spark.range(900).selectExpr("if(id < 300, 0L, id) AS k", "id AS v")
    hot = joins.hot_keys(left, ["k"], 50)
    assert [tuple(r) for r in hot.collect()] == [(0, 6)]
    sizes = [r["count"] for r in joins.salt_left(left, hot).where("k = 0").groupBy("salt").count().collect()]
    assert len(sizes) == 6 and sum(sizes) == 300 and max(sizes) < 100


X = RNG.normal(size=(200, 3))
Y = np.where(X @ [1.0, -0.5, 0.2] + 0.3 * RNG.normal(size=200) > 0, 1, -1)
COLUMNS = ["a", "b", "c"]


def table(spark):
    rows = [(k, int(Y[k]), *map(float, X[k])) for k in range(200)]
    return spark.createDataFrame(rows, "id bigint, label int, a double, b double, c double")


def test_gram_forms_and_ridge_identity(spark):
    df = table(spark)
    wide = {(r["a"], r["b"]): r["value"] for r in selection.gram_matrix(df, COLUMNS).collect()}
    vector = selection.gram_matrix_vector(instances(df, "id", F.col("label"), COLUMNS).repartition(5))
    other = {(r["a"], r["b"]): r["value"] for r in vector.collect()}
    assert wide.keys() == other.keys() == {(a, b) for a in range(3) for b in range(4)}
    assert all(wide[p] == pytest.approx(other[p]) for p in wide)
    weights = selection.solve_ridge(selection.gram_matrix(df, COLUMNS))
    assert np.allclose(weights, X.T @ np.linalg.pinv(X @ X.T + 0.5 * np.eye(200)) @ Y)


def test_replicates_are_averaged(spark, monkeypatch):
    from helpers import hash_uniform

    monkeypatch.setattr(selection, "REPLICATE_ROWS", 60)
    weights = selection.replicate_weights(table(spark), COLUMNS, 200, 0.6, seed=8)
    u = np.array([hash_uniform(8, k) for k in range(200)])
    total = np.zeros(3)
    for replicate in range(3):
        part = (u < 0.6) & (np.minimum(np.floor(u / 0.6 * 3), 2) == replicate)
        total += np.linalg.solve(X[part].T @ X[part] + 0.5 * np.eye(3), X[part].T @ Y[part])
    assert np.allclose(weights, total / 3)


@pytest.mark.parametrize("max_error", [0.0, 0.05, 0.31, 1.0])
def test_selected_instances(spark, max_error):
    df = table(spark)
    kept = selection.select_instances(df, COLUMNS, 0.9, max_error, seed=1)
    w = selection.replicate_weights(df, COLUMNS, 200, 0.9, seed=1)
    p = X[:, 0] * w[0] + X[:, 1] * w[1] + X[:, 2] * w[2]
    m = int(200 * max_error * 0.5)
    up, down = np.sort(p[Y == 1]), np.sort(p[Y == -1])[::-1]
    low = up[m - 1] if 1 <= m <= len(up) else 0.0
    high = down[m - 1] if 1 <= m <= len(down) else 1.0
    want = {k for k in range(200) if low + 1e-12 < p[k] < high - 1e-12}
    assert {r["id"] for r in kept.collect()} == want


def test_counts(spark):
    rows = [(1.0, 1), (1.0, -1), (-1.0, -1), (-1.0, 1), (0.0, 1), (None, 1)]
    df = spark.createDataFrame(rows, "prediction double, label int")
    assert tuple(metrics.accuracy(df).first()) == (2, 4)
    assert tuple(metrics.confusion_counts(df).first()) == (1, 1, 1, 1)
    scored = df.withColumnRenamed("prediction", "score")
    assert tuple(metrics.class_hits(scored).first()) == (1, 1, 1)
    assert tuple(metrics.class_totals(df).first()) == (4, 2)
    parts = spark.createDataFrame([(0, "a", 3), (1, "a", 4), (2, "b", 5)], "replicate int, q string, n bigint")
    assert sorted(map(tuple, metrics.replicate_sum(parts, ["q"], "n").collect())) == [("a", 7), ("b", 5)]


def test_classifiers(spark):
    df = spark.createDataFrame([(0.2,), (0.5,), (0.9,), (0.0,), (-2.0,)], "v double")
    v = F.col("v")
    got = df.select(metrics.classify_sign(v), metrics.classify_quantile(v, 0.5), metrics.classify_raw(v, 0.5)).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (1, 1, -1), (1, -1, -1), (0, 1, 1), (-1, 1, 1)]


def test_grid_errors(spark):
    rows = [("g", 1.0, 0, 0.2), ("g", 1.0, 1, 0.4), ("g", 10.0, 0, 0.1), ("g", 10.0, 1, 0.3), ("p", 1.0, 0, 0.2)]
    errors = spark.createDataFrame(rows, "kernel string, C double, fold int, error double")
    got = {(r["kernel"], r["C"]): (round(r["mean_error"], 6), r["is_best"]) for r in metrics.error_mean_by_grid(errors, ["kernel", "C"]).collect()}
    assert got == {("g", 1.0): (0.3, False), ("g", 10.0): (0.2, True), ("p", 1.0): (0.2, False)}


@pytest.mark.parametrize("wide", [0, 20])
def test_gram_matrix_with_nulls_in_either_form(spark, monkeypatch, wide):
    monkeypatch.setattr(selection, "WIDE_FEATURES", wide)
    rows = [(1.0, 2.0, 1), (None, 3.0, -1), (4.0, None, 1), (5.0, 6.0, None)]
    frame = spark.createDataFrame(rows, "a double, b double, label int")
    got = {(r["a"], r["b"]): r["value"] for r in selection.gram_matrix(frame, ["a", "b"], ridge=0.0).collect()}
    assert got == {(0, 0): 42.0, (0, 1): 32.0, (1, 0): 32.0, (1, 1): 49.0, (0, 2): 5.0, (1, 2): -1.0}


def test_crowded_inner_index_is_a_grid(spark):
    """Both sides of a hot index are dealt: no group holds more of a side than about a slice."""
    rng = np.random.default_rng(6)
    left, right = np.zeros((300, 5)), np.zeros((5, 200))
    left[:, 2], right[2, :] = rng.normal(size=300), rng.normal(size=200)
    left[::40, :], right[:, ::50] = rng.normal(size=(8, 5)), rng.normal(size=(5, 4))
    a, b = entries(spark, left), entries(spark, right)
    got = dense(matrix.matmul(a, b, 10**9, hot_rows=40), (300, 200))
    assert np.allclose(got, left @ right)
    sides = a.select("i", F.col("j").alias("inner"), "value"), b.select(F.col("i").alias("inner"), "j", "value")
    grid = matrix._grid(*sides, 40)
    assert [tuple(r) for r in grid.collect()] == [(2, 8, 5)]
    for df, place, own, other in ((sides[0], "i", "a", "b"), (sides[1], "j", "b", "a")):
        largest = matrix._sliced(df, grid, place, own, other).groupBy("inner", "a", "b").count().agg(F.max("count")).first()[0]
        assert largest <= 65


def test_hot_keys_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 20)
    left = spark.range(3000).select((F.col("id") % 60).alias("k"))
    left = left.unionAll(spark.range(1000).select(F.lit(7).cast("bigint").alias("k")))
    assert {r["k"]: r["n_salts"] for r in joins.hot_keys(left, ["k"], 10).collect()} == {7: 6}


@pytest.mark.parametrize("d, size", [(1, 4), (7, 4), (8, 4), (13, 3), (30, 256)])
def test_block_cholesky(spark, d, size):
    from marginwise.operators.solve import solve_positive

    rng = np.random.default_rng(d)
    M = rng.normal(size=(d + 5, d))
    G, h = M.T @ M + 0.5 * np.eye(d), rng.normal(size=d)
    if d == 13:
        # Blocks without any entry.
        G[8:, :4] = G[:4, 8:] = 0.0
        G += 50 * np.eye(d)
    rows = [(a, b, float(G[a, b])) for a in range(d) for b in range(d) if G[a, b]] + [(a, d, float(h[a])) for a in range(d)]
    entries = spark.createDataFrame(rows, "a int, b int, value double").repartition(4)
    assert solve_positive(entries, d, size) == pytest.approx(np.linalg.solve(G, h))


def test_indefinite_matrix_is_an_error(spark):
    from marginwise.operators.solve import solve_positive

    entries = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 1.0), (0, 2, 1.0)], "a int, b int, value double")
    with pytest.raises(Exception, match="(?i)positive definite"):
        solve_positive(entries, 2, 1)


@pytest.mark.parametrize("strip", [4, 7, 512])
def test_gram_by_strips(spark, strip):
    rng = np.random.default_rng(8)
    M, y = rng.normal(size=(40, 18)), rng.choice([-1, 1], 40)
    rows = spark.createDataFrame([([float(v) for v in m], int(c)) for m, c in zip(M, y)], "x array<double>, label int")
    cells = selection.gram_matrix_vector(rows.repartition(3), strip=strip).collect()
    got = {(r["a"], r["b"]): r["value"] for r in cells}
    want = np.column_stack([M.T @ M + 0.5 * np.eye(18), M.T @ y])
    assert len(cells) == len(got) == 18 * 19
    assert all(got[a, b] == pytest.approx(want[a, b]) for a in range(18) for b in range(19))
    uneven = rows.unionByName(spark.createDataFrame([([1.0], 1)], "x array<double>, label int"))
    with pytest.raises(ValueError, match="different length: 1 and 18"):
        selection.gram_matrix_vector(uneven)
