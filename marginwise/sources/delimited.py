"""Header-less delimited files of numbers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginwise.functions.columns import relabel


def scan_numeric(spark: SparkSession, path: str, n_columns: int, separator: str = ",") -> DataFrame:
    """Every cell as DOUBLE in columns c0, c1, ...; a cell that is no number fails the read."""
    schema = T.StructType([T.StructField(f"c{k}", T.DoubleType(), True) for k in range(n_columns)])
    return (
        spark.read.schema(schema)
        .option("sep", separator)
        .option("header", False)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def file_shape(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Number of lines and the largest number of columns."""
    cells = F.size(F.split(F.col("value"), f"\\Q{separator}\\E", -1))
    return spark.read.text(path).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max(cells).cast("bigint").alias("n_columns"),
    )


def feature_vector(
    df: DataFrame, class_index: int, skip_index: int = -1, transform=None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(label, x): the class cell relabelled, the skipped cell dropped, the rest in order as a vector."""
    columns = [c for c in df.columns if c not in keep]
    inputs = [c for k, c in enumerate(columns) if k not in (class_index, skip_index)]
    return df.select(
        *keep,
        relabel(F.col(columns[class_index]), transform).alias("label"),
        F.array(*[F.col(c).cast("double") for c in inputs]).alias("x"),
    )


def load_splits(readers: dict[str, DataFrame]) -> DataFrame:
    """Separately read splits stacked into one table with a ``split`` column."""
    parts = [df.withColumn("split", F.lit(name)) for name, df in readers.items()]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked
