"""Column expressions that several operators share. NULL texts count as empty ones."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other letter stays."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Maximal runs of characters other than space, tab, line feed, vertical tab, form feed, return."""
    return F.array_remove(F.split(whole(text), SPACES), "")


def fresh(*frames: DataFrame, stem: str = "_m") -> str:
    """A prefix that no column of the frames starts with: names made with it cannot clash."""
    taken = [c.lower() for f in frames for c in f.columns]
    k = 0
    while any(c.startswith(f"{stem}{k}_") for c in taken):
        k += 1
    return f"{stem}{k}_"


def fence(df: DataFrame) -> DataFrame:
    """``df``, with a row count observed on the way.

    Filters are not moved below an observation. Without it a later filter on an array expression
    would carry the expression into lambdas, where it is computed anew for every element.
    """
    return df.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
