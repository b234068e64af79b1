"""Column summaries and standardisation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dim, mean, variance, sd) per column: one aggregate over the table, then d rows unpivoted."""
    wide = df.agg(
        *[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)],
        *[F.var_samp(c).alias(f"v{k}") for k, c in enumerate(columns)],
    )
    triples = [
        F.struct(F.lit(k).alias("dim"), F.col(f"m{k}").alias("mean"), F.col(f"v{k}").alias("variance"))
        for k in range(len(columns))
    ]
    long = wide.select(F.explode(F.array(*triples)).alias("s")).select("s.*")
    return long.withColumn("sd", F.sqrt("variance"))


def vector_summary(df: DataFrame) -> DataFrame:
    """The same for an array column ``x`` of any width."""
    return (
        df.select(F.posexplode("x").alias("dim", "v"))
        .groupBy("dim")
        .agg(F.avg("v").alias("mean"), F.var_samp("v").alias("variance"), F.stddev_samp("v").alias("sd"))
    )


def zscore(df: DataFrame, columns: list[str], reference: DataFrame | None = None) -> DataFrame:
    """Columns centred and scaled by mean and sd of ``reference`` (default: the table itself).

    The statistics are one row, read as a scalar subquery; a constant column becomes NULL.
    """
    reference = df if reference is None else reference
    stats = reference.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
        ).alias("stats")
    ).scalar()
    scaled = {c: F.try_divide(F.col(c) - F.col("_stats")[f"m_{c}"], F.col("_stats")[f"s_{c}"]) for c in columns}
    return df.withColumn("_stats", stats).withColumns(scaled).drop("_stats")


def zscore_vector(df: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Standardises the array column ``x``; statistics come from ``reference``."""
    summary = vector_summary(df if reference is None else reference)
    # One (mean, sd) entry per component of the vector.
    ordered = F.sort_array(F.collect_list(F.struct("dim", "mean", "sd")))
    stats = summary.agg(ordered.alias("stats")).scalar()
    scaled = F.zip_with("x", "_stats", lambda v, s: F.try_divide(v - s["mean"], s["sd"]))
    return df.withColumn("_stats", stats).withColumn("x", scaled).drop("_stats")
