"""Brute-force forms for small fixtures."""

import numpy as np


def frame(spark, X, labels=None, ids=None):
    """(id, label, x) from a matrix."""
    X = np.asarray(X, dtype=float)
    labels = np.ones(len(X), dtype=int) if labels is None else labels
    ids = range(len(X)) if ids is None else ids
    rows = [(int(i), int(y), [float(v) for v in x]) for i, y, x in zip(ids, labels, X)]
    return spark.createDataFrame(rows, "id bigint, label int, x array<double>")


def kernel_table(kernel, X, Y=None):
    """Full kernel matrix by the row formula."""
    Y = X if Y is None else Y
    return np.array([kernel.rows(np.repeat(x[None, :], len(Y), axis=0), Y) for x in X])


def pair_dict(df):
    rows = df.collect()
    found = {(r["i"], r["j"]): r["k"] for r in rows}
    assert len(found) == len(rows), "a pair was emitted twice"
    return found


def order_quantile(values, q):
    values = sorted(values)
    n = len(values)
    if q == 0:
        return values[0]
    if q == 1:
        return values[-1]
    x = (n + 1) * q
    high, low = min(int(np.ceil(x)), n), max(int(np.floor(x)), 1)
    return values[high - 1] if high == low else 0.5 * (values[high - 1] + values[low - 1])


def ranks_descending(values):
    ordered = sorted(values, reverse=True)
    return [ordered.index(v) for v in values]


def hash_uniform(*parts):
    import hashlib

    word = hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()[:8]
    return int(word, 16) / 4294967296.0


def train_dense(K, y, ids, epsilon, C, delta, algo, iterations):
    """The training loop on a dense kernel matrix; returns [(alpha before momentum, alpha, old)]."""
    n = len(y)
    Q = np.where(K > epsilon, K, 0.0)
    np.fill_diagonal(Q, np.diag(K))
    alpha = np.array([C * (1 - hash_uniform(algo.seed, i, "alpha")) for i in ids])
    old = np.array([C * (1 - hash_uniform(algo.seed, i, "alpha_old")) for i in ids])
    steps = []
    for iteration in range(1, iterations + 1):
        size = delta * algo.decline ** (1 if algo.constant_step else iteration)
        gradient = y * (Q @ (alpha * y)) - (1.0 if algo.linear_term else 0.0)
        step = alpha - size * gradient
        moved = np.clip(step - y * (y @ step) / n, 0.0, C)
        batch = np.array([hash_uniform(algo.seed, i, iteration) < algo.batch_prob for i in ids])
        pre = np.where(batch, moved, algo.decline * alpha)
        if old @ old > 0.001:
            m = max(0.0, pre @ (pre - old) / (old @ old))
            alpha, old = pre + m * old, pre
        else:
            alpha = pre
        steps.append((pre, alpha.copy(), old.copy()))
    return steps
