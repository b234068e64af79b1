"""Column expressions on scalars and feature vectors. All of them stay in the JVM."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(*parts) -> Column:
    """Reproducible uniform number in [0, 1) from the given columns or literals."""
    cols = [(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]
    word = F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8)
    return F.conv(word, 16, 10).cast("double") / F.lit(4294967296.0)


def to_vector(col: Column) -> Column:
    """Any numeric array as ARRAY<DOUBLE>."""
    return col.cast("array<double>")


def _same_length(x: Column, y: Column, value: Column) -> Column:
    return F.when(F.size(x) == F.size(y), value).otherwise(
        F.raise_error(F.lit("vectors of different length")).cast("double")
    )


def dot(x: Column, y: Column) -> Column:
    products = F.zip_with(x, y, lambda a, b: a * b)
    return _same_length(x, y, F.aggregate(products, F.lit(0.0), lambda s, v: s + v))


def squared_distance(x: Column, y: Column) -> Column:
    squares = F.zip_with(x, y, lambda a, b: (a - b) * (a - b))
    return _same_length(x, y, F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def euclidean_distance(x: Column, y: Column) -> Column:
    return F.sqrt(squared_distance(x, y))


def weighted_sum(columns: list[str], weights: list[float]) -> Column:
    """Linear form of scalar columns with fixed weights (one generated expression)."""
    return reduce(add, [F.col(c) * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)])


def relabel(col: Column, transform=None) -> Column:
    """Raw class cell to -1 / +1. The cell is truncated to an integer before the rule applies."""
    whole = col.cast("double").cast("int")
    if transform is not None:
        return transform(whole).cast("int")
    return F.when(whole > 0, 1).otherwise(-1).cast("int")


def elementwise(a: Column, b: Column, factor: float = 1.0) -> dict[str, Column]:
    """The vector arithmetic used by the trainers, on aligned (id, value) columns."""
    return {
        "scaled": a * factor,
        "product": a * b,
        "difference": a - b,
        "magnitude": F.abs(a),
        "sign": F.signum(a),
        "whole": F.floor(a).cast("double"),
        "exponential": F.exp(a),
        "power": F.pow(a, b),
    }


def bin_index(df: DataFrame, value: str, output: str, splits: list[float]) -> DataFrame:
    """Adds the number of ``splits`` that are <= value (splits strictly increasing)."""
    if not splits:
        return df.withColumn(output, F.lit(0))
    from pyspark.ml.feature import Bucketizer

    edges = [float("-inf"), *splits, float("inf")]
    binned = Bucketizer(splits=edges, inputCol=value, outputCol=output, handleInvalid="keep").transform(df)
    return binned.withColumn(output, F.col(output).cast("int"))
