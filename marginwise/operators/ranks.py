"""Exact ranks, quantiles and positions without a one-task window.

Values are first counted per distinct value, so ties never crowd into one task. The distinct
values fall into at most MAX_BUCKETS value ranges; a running total inside a range plus the
total of the ranges before it is the exact global running total.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginwise.functions.columns import bin_index, uniform
from marginwise.operators.joins import keyed_join
from marginwise.session import settle, stored

ROWS_PER_BUCKET = 250_000
MAX_BUCKETS = 4096


def histogram(df: DataFrame, value: str, **sums) -> DataFrame:
    """One row per distinct value: ``n`` rows and any extra aggregates."""
    extra = [expression.alias(name) for name, expression in sums.items()]
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), *extra)


def _splits(df: DataFrame, value: str, rows: int, rows_per_bucket: int) -> list[float]:
    buckets = min(MAX_BUCKETS, math.ceil(rows / rows_per_bucket))
    if buckets <= 1:
        return []
    cuts = df.approxQuantile(value, [k / buckets for k in range(1, buckets)], 0.5 / buckets)
    return sorted(set(cuts))


def _bucketed(df: DataFrame, value: str, rows: int, rows_per_bucket: int) -> tuple[DataFrame, int]:
    splits = _splits(df, value, rows, rows_per_bucket)
    return bin_index(df, value, "bucket", splits), len(splits) + 1


def _bucket_totals(df: DataFrame, sums: list[str]) -> list[tuple]:
    """(bucket, total of each sum) in bucket order; at most MAX_BUCKETS + 1 rows."""
    rows = df.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in sums]).collect()
    return sorted((r["bucket"], *[r[c] for c in sums]) for r in rows)


def running_totals(
    hist: DataFrame,
    value: str,
    sums: list[str],
    descending: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Adds ``<sum>_upto``: the total over all values up to and including this one.

    ``hist`` has one row per value and must be stable between passes (see ``settle``).
    """
    spark = hist.sparkSession
    binned, n_buckets = _bucketed(hist, value, hist.count(), rows_per_bucket)
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = Window.partitionBy("bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if n_buckets == 1:
        for c in sums:
            binned = binned.withColumn(f"{c}_upto", F.sum(c).over(inside))
        return binned.drop("bucket")
    totals = _bucket_totals(binned, sums)
    if descending:
        totals.reverse()
    before, offsets = [0] * len(sums), []
    for bucket, *values in totals:
        offsets.append((bucket, *before))
        before = [b + v for b, v in zip(before, values, strict=True)]
    kinds = [binned.schema[c].dataType.simpleString() for c in sums]
    kinds = ["bigint" if k in ("int", "bigint") else "double" for k in kinds]
    schema = "bucket int, " + ", ".join(f"before_{c} {k}" for c, k in zip(sums, kinds, strict=True))
    offset_table = spark.createDataFrame(offsets, schema)
    for c in sums:
        binned = binned.withColumn(f"{c}_upto", F.sum(c).over(inside))
    out = binned.join(F.broadcast(offset_table), "bucket")
    for c in sums:
        out = out.withColumn(f"{c}_upto", F.col(f"{c}_upto") + F.col(f"before_{c}"))
    return out.select(*hist.columns, *[f"{c}_upto" for c in sums])


def positions(df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds the 0-based ``position`` of every row in ascending order of a unique numeric key."""
    numbered = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), key, ["_one"], False, rows_per_bucket)
    return numbered.withColumn("position", F.col("_one_upto") - 1).drop("_one", "_one_upto")


def sorted_rows(df: DataFrame, value: str, key: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds the 0-based ``position`` of every row in order of the value, ties in order of a unique numeric key.

    Rows without a value have no position and are left out. Ties are numbered in ranges of the key,
    so a value that most rows share is still the work of many tasks.
    """
    df = df.where(F.col(value).isNotNull())
    hist = settle(histogram(df, value))
    rows = hist.agg(F.sum("n")).first()[0] or 0
    parts = bin_index(df, key, "_part", _splits(df, key, rows, rows_per_bucket))
    upto = running_totals(hist, value, ["n"], False, rows_per_bucket)
    earlier = Window.partitionBy(value).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(value, "_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_within", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    before = counts.join(upto.select(value, (F.col("n_upto") - F.col("n")).alias("_before")), value)
    inside = Window.partitionBy(value, "_part").orderBy(key)
    numbered = parts.join(before.drop("_n"), [value, "_part"])
    place = F.col("_before") + F.col("_within") + F.row_number().over(inside) - 1
    return numbered.withColumn("position", place).select(*df.columns, "position")


def max_rank(hist: DataFrame, score: str) -> Column:
    """The largest descending rank: all rows but those of the lowest value."""
    return hist.agg(F.sum("n") - F.min_by("n", score)).scalar()


def score_rank(df: DataFrame, score: str = "score", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``rank``: 0-based, descending, ties share the lowest position; and the largest rank.

    Rows without a score stay, have no rank and do not count.
    """
    hist = settle(histogram(df.where(F.col(score).isNotNull()), score))
    ranked = (
        running_totals(hist, score, ["n"], True, rows_per_bucket)
        .withColumn("rank", F.col("n_upto") - F.col("n"))
        .select(score, "rank")
    )
    ranked = ranked.withColumn("max_rank", max_rank(hist, score))
    joined = keyed_join(df, ranked, [score], how="left", right_rows=hist.count(), right_width=2)
    return joined.select(*df.columns, "rank", "max_rank")


def score_quantile(df: DataFrame, score: str = "score", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``rank`` and ``quantile`` = rank / largest rank. Fails when all scores are equal."""
    ranked = score_rank(df, score, rows_per_bucket)
    quantile = F.when(F.col("max_rank") > 0, F.col("rank") / F.col("max_rank")).when(
        F.col("rank").isNotNull(), F.raise_error(F.lit("all scores are equal, quantiles are undefined")).cast("double")
    )
    return ranked.withColumn("quantile", quantile).drop("max_rank")


def wanted_positions(rows: int, quantile: float) -> tuple[int, int]:
    """The two 1-based positions whose mean is the order-statistic quantile."""
    if not 0.0 <= quantile <= 1.0:
        raise ValueError("quantile must lie in [0, 1]")
    place = min(max((rows + 1) * quantile, 1), rows)
    return math.floor(place), math.ceil(place)


def values_at(
    df: DataFrame,
    value: str,
    wanted: list[int],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    hist: DataFrame | None = None,
    unique: bool = False,
) -> dict[int, float]:
    """The values at 1-based ascending positions. Only value ranges that hold one are ordered; NULLs do not count.

    ``unique`` values of a stored table need no counting and no shuffle beforehand.
    """
    wanted = sorted(set(wanted))
    if not wanted:
        return {}
    if unique:
        hist = df.where(F.col(value).isNotNull()).select(value, F.lit(1).cast("bigint").alias("n"))
    elif hist is None:
        hist = settle(histogram(df.where(F.col(value).isNotNull()), value))
    binned, n_buckets = _bucketed(hist, value, hist.count(), rows_per_bucket)
    # One range needs no totals: every wanted position is inside it or does not exist.
    totals = _bucket_totals(binned, ["n"]) if n_buckets > 1 else [(0, max(wanted))]
    plan, before = [], 0
    for bucket, total in totals:
        inside = [p for p in wanted if before < p <= before + total]
        if inside:
            plan.append((bucket, before, inside))
        before += total
    if not plan:
        return {}
    plan_table = hist.sparkSession.createDataFrame(plan, "bucket int, before bigint, inside array<bigint>")
    ordered = Window.partitionBy("bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = (
        binned.join(F.broadcast(plan_table), "bucket")
        .withColumn("upto", F.col("before") + F.sum("n").over(ordered))
        .withColumn("last", F.col("upto").cast("double"))
        .withColumn("first", (F.col("upto") - F.col("n")).cast("double"))
    )
    # A value is wanted when more positions lie at or before its last row than before its first.
    marks = [float(p) for p in wanted]
    counted = bin_index(bin_index(reached, "last", "n_last", marks), "first", "n_first", marks)
    hits = F.filter("inside", lambda p: (p <= F.col("upto")) & (p > F.col("upto") - F.col("n")))
    found = (
        counted.where(F.col("n_last") > F.col("n_first"))
        .withColumn("position", F.explode(hits))
        .select("position", value)
    )
    # One row per requested position.
    return {r["position"]: r[value] for r in found.collect()}


def order_statistics(
    df: DataFrame, value: str, quantiles: list[float], rows_per_bucket: int = ROWS_PER_BUCKET
) -> dict[float, float]:
    """The order-statistic quantile of the values that are not NULL for each level, in one ranking pass."""
    hist = settle(histogram(df.where(F.col(value).isNotNull()), value))
    rows = hist.agg(F.sum("n")).first()[0] or 0
    if rows == 0:
        raise ValueError("quantiles of an empty table")
    pairs = {q: wanted_positions(rows, q) for q in quantiles}
    values = values_at(df, value, [p for pair in pairs.values() for p in pair], rows_per_bucket, hist)
    return {
        q: values[low] if low == high else 0.5 * (values[high] + values[low]) for q, (low, high) in pairs.items()
    }


def grouped_order_statistics(
    df: DataFrame, group: str, value: str, quantiles: list[float], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """(group, found): the order-statistic quantiles of each group's values, in the order of ``quantiles``.

    One range partition by (group, value) serves all groups, so neither jobs nor plans grow with their
    number. Ranges that hold no wanted position are not ordered. NULLs do not count, and a group of
    them alone has no row.
    """
    if not all(0.0 <= q <= 1.0 for q in quantiles):
        raise ValueError("quantile must lie in [0, 1]")
    spark = df.sparkSession
    hist = stored(df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n")), "histogram")
    ranges = max(1, math.ceil(hist.count() / rows_per_bucket))
    ranged = hist.repartitionByRange(ranges, group, value).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    # Group and range: as many rows as ranges and groups together.
    parts = ranged.groupBy(group, "part").agg(F.sum("n").alias("inside"))
    every = Window.partitionBy(group)
    earlier = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("inside").over(earlier), F.lit(0)))
    parts = parts.withColumn("rows", F.sum("inside").over(every))
    levels = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(q)).alias("q")) for k, q in enumerate(quantiles)])
    place = lambda q: F.least(F.greatest((F.col("rows") + 1) * q, F.lit(1.0)), F.col("rows").cast("double"))
    ends = F.flatten(
        F.transform(
            levels,
            lambda s: F.array(
                F.struct(s["k"].alias("k"), F.floor(place(s["q"])).alias("at")),
                F.struct(s["k"].alias("k"), F.ceil(place(s["q"])).alias("at")),
            ),
        )
    )
    here = F.filter(ends, lambda e: (e["at"] > F.col("before")) & (e["at"] <= F.col("before") + F.col("inside")))
    plan = stored(parts.select(group, "part", "before", here.alias("here")).where(F.size("here") > 0), "wanted")
    ordered = Window.partitionBy(group, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = keyed_join(ranged, plan, [group, "part"], right_rows=plan.count(), right_width=4)
    upto = F.col("before") + F.sum("n").over(ordered)
    reached = joined.withColumn("upto", upto)
    hit = F.filter("here", lambda e: (e["at"] <= F.col("upto")) & (e["at"] > F.col("upto") - F.col("n")))
    found = reached.select(group, value, F.explode(hit).alias("e"))
    means = found.groupBy(group, F.col("e.k").alias("k")).agg(F.avg(value).alias("v"))
    listed = F.array_sort(F.collect_list(F.struct("k", "v")))
    return means.groupBy(group).agg(F.transform(listed, lambda s: s["v"]).alias("found"))


def shuffled_positions(
    df: DataFrame, key: str, group: str, seed: int, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Adds the 0-based ``position`` of each row within its group in a reproducible random order.

    The order is a hash, so equal slices of the hash range are balanced for a group of any size.
    """
    drawn = df.withColumn("_u", uniform(F.lit(seed), F.col(key)))
    rows = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    slices = max(1, math.ceil(rows / rows_per_bucket), min(cores, rows // 10_000))
    sliced = drawn.withColumn("_slice", F.floor(F.col("_u") * slices).cast("int"))
    inside = Window.partitionBy(group, "_slice").orderBy("_u", key)
    numbered = sliced.withColumn("position", F.row_number().over(inside) - 1)
    if slices > 1:
        counts = sliced.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
        numbered = numbered.join(offsets, [group, "_slice"]).withColumn(
            "position", F.col("position") + F.col("_before")
        )
    return numbered.select(*df.columns, "position")
