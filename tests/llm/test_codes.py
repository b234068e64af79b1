import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginwise.llm import codes


def brute(rows, parts, entries, rounds):
    """(id, code, error, label error, digest) by plain Python integers."""
    good = [
        (i, [max(-codes.SPAN, min(codes.SPAN, math.floor(1024 * x))) for x in v], y)
        for i, v, y in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fitting = [r for r in good if r[1] and len(r[1]) % parts == 0]
    size = len(fitting[0][1]) if fitting else 0
    good = [r for r in good if len(r[1]) == size and size]
    w = size // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in good]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[nearest(c[p], books[p])[1]].append(c[p])
            for k, members in groups.items():
                books[p][k] = [sum(col) // len(members) for col in zip(*members)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out, by_label = [], defaultdict(int)
    for (i, _, y), c in zip(good, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[y] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), min(error, codes.LONGEST), y))
    return [(i, c, e, min(by_label[y], codes.LONGEST), digest) for i, c, e, y in out]


def key(row):
    return tuple((v is None, v) for v in row)


def compare(spark, rows, parts=4, entries=8, rounds=3, kind="float"):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    found = codes.compress(table, parts=parts, entries=entries, rounds=rounds).drop("looked")
    # Float columns round the values; the reference reads what the table holds.
    seen = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    got = sorted([tuple(r) for r in found.collect()], key=key)
    assert got == sorted(brute(seen, parts, entries, rounds), key=key)
    return got


def vectors(rng, n, d, scale=1.0):
    centres = rng.normal(size=(7, d)) * scale
    X = centres[rng.integers(0, 7, n)] + rng.normal(size=(n, d)) * 0.1 * scale
    return [(k, [float(v) for v in x], int(k % 3)) for k, x in enumerate(X)]


def test_search_is_exact_and_skips():
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (20, 6))
    E = [[int(v) for v in centres[k % 20] + rng.integers(-9, 9, 6)] for k in range(200)]
    E += E[:30]
    X = codes.whole_numbers([[int(v) for v in centres[k % 20] + rng.integers(-15, 15, 6)] for k in range(3000)] + E)
    for book, rows in ((codes.Codebook.of(E), X), (codes.Codebook.of(E[:1]), X), (codes.Codebook.of([E[0]] * 70), X)):
        at, best, looked = codes.search(rows, book)
        D = ((rows[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
        assert np.array_equal(best, D.min(axis=1)) and np.array_equal(at, D.argmin(axis=1))
        assert looked <= D.size
    _, _, looked = codes.search(X, codes.Codebook.of(E))
    assert looked < 0.35 * len(X) * len(E)


def test_exact_beyond_floating_point():
    rng = np.random.default_rng(2)
    E = [[int(v) for v in rng.integers(-(1 << 60), 1 << 60, 3)] for _ in range(50)]
    E += [[v + 1 for v in e] for e in E]
    X = codes.whole_numbers([[v + 1 for v in e] for e in E[:50]] + E)
    at, best, _ = codes.search(X, codes.Codebook.of(E))
    for x, k, d in zip(X, at, best):
        assert (d, k) == min((sum((int(a) - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(E))


@pytest.mark.parametrize("n, d, parts, entries", [(300, 8, 4, 16), (40, 12, 3, 256), (5, 4, 2, 8), (500, 64, 4, 256)])
def test_against_brute_force(spark, n, d, parts, entries):
    compare(spark, vectors(np.random.default_rng(n), n, d), parts, entries, 2 if n == 500 else 4)


def test_ties_and_repeats(spark):
    """Few different vectors: many equal entries, of which the first is used and the others stay."""
    rng = np.random.default_rng(4)
    rows = [(k // 2, [float(v) / 1024 for v in rng.integers(-1, 2, 4)], k % 2) for k in range(200)]
    compare(spark, rows, 2, 64)
    compare(spark, [(1, [0.5] * 4, 1)] * 50, 4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(np.random.default_rng(5), 60, 8)
    rows += [(100, None, 1), (101, [nan] * 8, 1), (102, [1.0] * 7 + [inf], 1), (103, [1.0] * 7 + [None], 1), (104, [-inf] * 8, 2)]
    rows += [(None, [0.1] * 8, 1), (None, None, None), (105, [0.2] * 8, None), (106, [0.3] * 8, None), (-1, [], 1), (-2, [1.0] * 3, 0)]
    rows += [(107, [1.0] * 4, 5), (108, [-0.0] * 8, 0)]
    compare(spark, rows)
    compare(spark, rows + [(109, [1e30, -1e30] * 4, 0), (110, [3e9] * 8, 1), (-5, [1e12] * 8, 1)], kind="double")


def test_empty_tables_and_clashing_names(spark):
    rows = vectors(np.random.default_rng(6), 30, 8)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    clash = table.select("*", *[F.lit(1).alias(c) for c in ("id", "vector", "name", "code", "error", "total", "salt")])
    assert sorted(codes.compress(clash, entries=8).collect()) == sorted(codes.compress(table, entries=8).collect())
    assert codes.compress(table.limit(0)).collect() == []
    assert codes.compress(table.withColumn("embedding", F.lit(None).cast("array<float>"))).collect() == []
