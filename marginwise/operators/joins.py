"""Joins that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A table of (key, number) rows below this count is small enough for every executor.
BROADCAST_ROWS = 2_000_000
# Keys with more rows than this are spread over several tasks.
HOT_ROWS = 1_000_000


def fits_broadcast(rows: int | None, width: int = 1) -> bool:
    """``rows`` of ``width`` 16-byte cells stay below the broadcast budget (None: unknown, so no)."""
    return rows is not None and rows * width <= BROADCAST_ROWS


def hot_keys(left: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, n_salts) of the keys with more than ``hot_rows`` rows."""
    counted = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return salts_of(counted, keys, hot_rows, left.agg(F.count(F.lit(1))).scalar())


def hot_bound(hot_rows: int, total: Column) -> Column:
    """``hot_rows``, or more where the table is so large that hot keys could be too many for a broadcast:
    of ``total`` rows, fewer than BROADCAST_ROWS keys have more than this."""
    return F.greatest(F.lit(hot_rows), F.ceil(total / BROADCAST_ROWS))


def salts_of(counted: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, total: Column | None = None) -> DataFrame:
    """The same from a stored table of keys and their row counts ``n``."""
    bound = hot_bound(hot_rows, counted.agg(F.sum("n")).scalar() if total is None else total)
    n_salts = F.ceil(F.col("n") / bound).cast("int")
    return counted.where(F.col("n") > bound).select(*keys, n_salts.alias("n_salts"))


def salt_left(left: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds ``salt``: rows of a hot key are dealt over its salts by a hash of their other columns."""
    keys = [c for c in hot.columns if c != "n_salts"]
    rest = [F.col(c) for c in left.columns if c not in keys]
    spread = F.pmod(F.xxhash64(*rest) if rest else F.spark_partition_id(), F.col("n_salts")).cast("int")
    joined = left.join(F.broadcast(hot), keys, "left")
    return joined.withColumn("salt", F.when(F.col("n_salts").isNull(), 0).otherwise(spread)).drop("n_salts")


def salt_right(right: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds ``salt``: rows of a hot key are repeated once per salt."""
    keys = [c for c in hot.columns if c != "n_salts"]
    salts = F.sequence(F.lit(0), F.coalesce(F.col("n_salts"), F.lit(1)) - 1)
    return right.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(salts)).drop("n_salts")


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    left_rows: int | None = None,
    right_rows: int | None = None,
    right_width: int = 1,
    hot: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner or left equi-join. The right side is broadcast only when its known size allows it;
    otherwise hot left keys are salted unless the left side is known to be small. ``hot`` gives
    the hot keys when they are already known.
    """
    if how not in ("inner", "left"):
        raise ValueError("keyed_join supports inner and left joins")
    if fits_broadcast(right_rows, right_width):
        return left.join(F.broadcast(right), keys, how)
    if left_rows is not None and left_rows <= hot_rows:
        return left.join(right, keys, how)
    if hot is None:
        hot = hot_keys(left, keys, hot_rows)
    return salt_left(left, hot).join(salt_right(right, hot), [*keys, "salt"], how).drop("salt")
