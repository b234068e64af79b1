"""Instance selection by a linear projection fitted on random subsets."""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginwise.functions.columns import uniform, weighted_sum
from marginwise.operators.ranks import values_at
from marginwise.operators.solve import BLOCK, solve_positive

RIDGE = 0.5
# Above this width the Gram sums are formed by partial matrix products instead of one column per cell.
WIDE_FEATURES = 20
REPLICATE_ROWS = 10_000
# Columns whose products with all others one task holds.
STRIP_COLUMNS = 512


def _cells(d: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(d) for b in range(a, d)]


def gram_wide(df: DataFrame, columns: list[str], label: str = "label", by: list[str] | None = None) -> DataFrame:
    """X'X (upper triangle) and X'y as one row of sums g_a_b, h_a, per key in ``by``."""
    sums = [
        F.coalesce(F.sum(F.col(columns[a]) * F.col(columns[b])), F.lit(0.0)).alias(f"g_{a}_{b}")
        for a, b in _cells(len(columns))
    ]
    sums += [
        F.coalesce(F.sum(F.col(c) * F.col(label)), F.lit(0.0)).alias(f"h_{a}") for a, c in enumerate(columns)
    ]
    return df.groupBy(*(by or [])).agg(*sums)


def gram_matrix(df: DataFrame, columns: list[str], label: str = "label", ridge: float = RIDGE) -> DataFrame:
    """(a, b, value): X'X + ridge on the diagonal for a, b < d, and X'y in column b = d."""
    d = len(columns)
    if d > WIDE_FEATURES:
        x = F.array(*[F.col(c).cast("double") for c in columns])
        return gram_matrix_vector(df.select(x.alias("x"), label), label, ridge)
    wide = gram_wide(df, columns, label)
    entries = []
    for a in range(d):
        for b in range(d):
            value = F.col(f"g_{min(a, b)}_{max(a, b)}") + (ridge if a == b else 0.0)
            entries.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value.alias("value")))
        entries.append(F.struct(F.lit(a).alias("a"), F.lit(d).alias("b"), F.col(f"h_{a}").alias("value")))
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def gram_matrix_vector(
    df: DataFrame, label: str = "label", ridge: float = RIDGE, strip: int = STRIP_COLUMNS
) -> DataFrame:
    """The same from an array column ``x`` of any width: partial products per task, then a sum.

    A task holds the products of ``strip`` columns with all later ones; wider vectors take one scan per strip. Vectors of
    different length are an error.
    """
    rows = df.where(F.col("x").isNotNull()).select("x", F.col(label).cast("double"))
    ends = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if ends[0] != ends[1]:
        raise ValueError(f"vectors of different length: {ends[0]} and {ends[1]}")
    d = ends[1] or 0

    def partial(first: int):
        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                # A NULL adds nothing to a sum, as in the form with one column per cell.
                flat = pa.compute.fill_null(batch.column(0).flatten(), 0.0)
                X = flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                y = pa.compute.fill_null(batch.column(1), 0.0).to_numpy(zero_copy_only=False)
                product = X[:, first : first + strip].T @ np.column_stack([X[:, first:], y])
                total = product if total is None else total + product
            if total is not None:
                for row, values in enumerate(total):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(values), first + row), pa.int32()),
                            pa.array(np.arange(first, first + len(values)), pa.int32()),
                            pa.array(values),
                        ],
                        names=["a", "b", "value"],
                    )

        return products

    kind = "a int, b int, value double"
    parts = reduce(DataFrame.unionAll, [rows.mapInArrow(partial(k), kind) for k in range(0, max(d, 1), strip)])
    on_diagonal = F.when(F.col("a") == F.col("b"), ridge).otherwise(0.0)
    summed = parts.groupBy("a", "b").agg(F.sum("value").alias("value")).withColumn("value", F.col("value") + on_diagonal)
    # Entries left of a strip mirror those of the strips before.
    below = (F.col("b") < d) & (F.floor(F.col("b") / strip) > F.floor(F.col("a") / strip))
    places = F.array(F.struct("a", "b"), F.when(below, F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return summed.select(F.explode(F.array_compact(places)).alias("e"), "value").select("e.*", "value")


def solve_ridge(gram: DataFrame, size: int = BLOCK) -> list[float]:
    """Weights of (X'X + ridge) w = X'y, by blocks: the weights, and no matrix larger than a block, reach the driver."""
    d = gram.agg(F.max("a")).first()[0] + 1
    return solve_positive(gram, d, size).tolist()


def replicate_weights(
    df: DataFrame, columns: list[str], rows: int, sample: float, seed: int = 0, ridge: float = RIDGE
) -> list[float]:
    """Mean of the ridge weights over max(rows / 10000, 1) random subsets.

    A sampled row joins one of the replicates; each replicate is solved where its sums are.
    """
    d = len(columns)
    replicates = max(rows // REPLICATE_ROWS, 1)
    drawn = df.withColumn("_u", uniform(F.lit(seed), F.col("id"))).where(F.col("_u") < sample)
    replicate = F.least(F.floor(F.col("_u") / F.lit(sample) * replicates), F.lit(replicates - 1)).cast("bigint")
    sums = gram_wide(drawn.withColumn("replicate", replicate), columns, by=["replicate"])
    names = [f"g_{a}_{b}" for a, b in _cells(d)]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            systems = np.zeros((len(frame), d, d))
            for (a, b), name in zip(_cells(d), names, strict=True):
                systems[:, a, b] = systems[:, b, a] = frame[name]
            systems += ridge * np.eye(d)
            right = frame[[f"h_{a}" for a in range(d)]].to_numpy()[:, :, None]
            weights = np.linalg.solve(systems, right)[:, :, 0]
            yield pd.DataFrame(weights, columns=[f"w_{a}" for a in range(d)])

    solved = sums.mapInPandas(solve, ", ".join(f"w_{a} double" for a in range(d)))
    # A replicate without rows has zero weights, so the divisor is the number of replicates.
    total = solved.agg(*[F.coalesce(F.sum(f"w_{a}"), F.lit(0.0)) for a in range(d)]).first()
    return [v / replicates for v in total]


def misclassification_cutoffs(
    df: DataFrame, rows: int, max_error: float, projection: str = "projection", label: str = "label"
) -> tuple[float, float]:
    """Projections where the running count of the wrong class reaches m = floor(rows * max_error / 2).

    Low: the m-th smallest projection of class +1; high: the m-th largest of class -1. A count
    that is never reached leaves 0.0 and 1.0.
    """
    m = int(rows * max_error * 0.5)
    if m < 1:
        return 0.0, 1.0
    positive = df.where(F.col(label) == 1).select(projection)
    negative = df.where(F.col(label) == -1).select((-F.col(projection)).alias(projection))
    low = values_at(positive, projection, [m]).get(m)
    high = values_at(negative, projection, [m]).get(m)
    return (0.0 if low is None else low), (1.0 if high is None else -high)


def selection_band(df: DataFrame, low: float, high: float, projection: str = "projection") -> DataFrame:
    """Rows strictly between the cut-offs."""
    return df.where((F.col(projection) > low) & (F.col(projection) < high))


def project(df: DataFrame, columns: list[str], weights: list[float], digits: int | None = None) -> DataFrame:
    value = weighted_sum(columns, weights)
    return df.withColumn("projection", value if digits is None else F.round(value, digits))


def select_instances(
    df: DataFrame,
    columns: list[str],
    sample: float = 0.1,
    max_error: float = 0.01,
    seed: int = 0,
    digits: int | None = None,
) -> DataFrame:
    """Rows of (id, label, columns...) whose mean linear projection lies inside the cut-offs."""
    rows = df.count()
    projected = project(df, columns, replicate_weights(df, columns, rows, sample, seed), digits)
    low, high = misclassification_cutoffs(projected, rows, max_error)
    return selection_band(projected, low, high)
