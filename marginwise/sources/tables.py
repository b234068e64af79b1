"""Instances from any DataFrame, and the questions asked of a split data set."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginwise.operators.ranks import values_at
from marginwise.params import SplitRatios

TRAIN, VALIDATION, TEST = "train", "validation", "test"


def instances(df: DataFrame, id: str, label: Column, features, split: Column | None = None) -> DataFrame:
    """(id, label, x[, split]) from a table; ``features`` is an array column or a list of names."""
    if isinstance(features, Column):
        x = features.cast("array<double>")
    else:
        x = F.array(*[F.col(c).cast("double") for c in features])
    cols = [F.col(id).cast("bigint").alias("id"), label.cast("int").alias("label"), x.alias("x")]
    if split is not None:
        cols.append(split.alias("split"))
    return df.select(*cols)


def drop_and_rename(df: DataFrame, drop: list[str], names: list[str]) -> DataFrame:
    """Remove line-number columns and name the rest."""
    return df.drop(*drop).toDF(*names)


def row_lookup(df: DataFrame, split: str, row: int) -> DataFrame:
    return df.where((F.col("split") == split) & (F.col("id") == row))


def labels_of_split(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split).select("id", "label")


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows and number of features per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("x")).cast("bigint").alias("d")
    )


def label_table(df: DataFrame) -> DataFrame:
    """Positives, negatives and total per split."""
    return df.groupBy("split").agg(
        F.count_if(F.col("label") > 0).alias("n_positive"),
        F.count_if(F.col("label") < 0).alias("n_negative"),
        F.count(F.lit(1)).alias("n_total"),
    )


def split_by_ratio(
    df: DataFrame, ratios: SplitRatios | None = None, order: str = "id", strict: bool = False
) -> DataFrame:
    """Adds the positional ``split`` in ascending order of a unique numeric column.

    Only the two boundary values are looked up, so the rows themselves are not moved.
    """
    n_train, n_validation, _ = (ratios or SplitRatios()).sizes(df.count(), strict)
    ends = [n_train, n_train + n_validation]
    found = values_at(df, order, [p for p in ends if p > 0], unique=True)
    lowest = float("-inf")
    train_end, validation_end = (F.lit(found.get(p, lowest)) for p in ends)
    split = F.when(F.col(order) <= train_end, TRAIN).when(F.col(order) <= validation_end, VALIDATION).otherwise(TEST)
    return df.withColumn("split", split)


def head_rows(df: DataFrame, max_rows: int) -> DataFrame:
    """The first min(N, max_rows) training rows by id."""
    return df.orderBy("id").limit(max_rows)


def append_splits(*splits: DataFrame) -> DataFrame:
    stacked = splits[0]
    for part in splits[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def exclude_fold(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("fold") != fold)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet sink for models, pair tables and reports."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
