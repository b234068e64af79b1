"""Sparse kernel tables (i, j, k) and what is counted on them."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginwise.functions.kernels import DistanceForm, Kernel
from marginwise.operators.joins import keyed_join
from marginwise.operators.ranks import positions, values_at, wanted_positions
from marginwise.operators.sampling import sampled_values
from marginwise.operators.tiles import (
    OverTile,
    emit_adjacency,
    emit_bins,
    emit_column_sums,
    emit_counts,
    emit_pairs,
    emit_signed,
    emit_weighted_sums,
    has_vector,
    tile_join,
)
from marginwise.session import settle

_PAIR_DDL = "i bigint, j bigint, k double"
_PAIR_ARROW = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("k", pa.float64())])
_COUNT_DDL = "n_considered bigint, n_kept bigint"
_COUNT_ARROW = pa.schema([("n_considered", pa.int64()), ("n_kept", pa.int64())])

_SUM_DDL = "id bigint, sums array<double>"
_SUM_ARROW = pa.schema([("id", pa.int64()), ("sums", pa.list_(pa.float64()))])

_SET_DDL = "i bigint, segment bigint, columns array<smallint>"
_SET_ARROW = pa.schema([("i", pa.int64()), ("segment", pa.int64()), ("columns", pa.list_(pa.int16()))])

_BIN_ARROW = pa.schema([("bin", pa.int64()), ("n", pa.int64())])

SEGMENT_IDS = 65_536
# Columns of a strip of index pairs (the longest bit-packed run of a Parquet file), and the most strips of a square.
STRIP_IDS, SQUARE_STRIPS = 504, 8
# Weights of a row from which only one side of a pair of tiles is added up.
WIDE_WEIGHTS = 8
# Expected number of sampled pairs behind the first bounds of a quantile.
BOUND_PAIRS = 100_000
# Bits that its first histogram leaves out, and how many values of one bin are counted one by one.
FIRST_SHIFT, BIN_VALUES = 34, 20_000_000


def upper_triangle(spark: SparkSession, n: int) -> DataFrame:
    """All index pairs 0 <= i < j < n, in no order that a caller may rely on.

    A task makes one square of the triangle, in strips of STRIP_IDS columns that repeat for row after row: all
    values of a written file fit its dictionary and repeat at short distance, so a written pair costs a fraction of a byte.
    """
    wanted = math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism))
    strips = max(1, min(SQUARE_STRIPS, n // (wanted * STRIP_IDS)))
    side = STRIP_IDS * strips
    blocks = math.ceil(n / side)
    squares = blocks * (blocks + 1) // 2 if n > 1 else 0
    # One number for a row of a strip of a square: a row at a time is spread, as Spark buffers what one number becomes.
    numbers = spark.range(0, squares * strips * side, 1, max(1, squares))
    square = F.expr(f"id div {strips * side}")
    # Square s lies in the last column c with c (c + 1) / 2 <= s; roots of squares are exact.
    column = F.floor((F.sqrt(8 * square + 1) - 1) / 2)
    placed = numbers.select("id", square.alias("square"), column.alias("c"))
    row = (F.col("square") - F.expr("c * (c + 1) div 2")) * side + F.col("id") % side
    low = F.col("c") * side + F.expr(f"id div {side}") % strips * STRIP_IDS
    rows = placed.select(row.alias("i"), low.alias("low"))
    rows = rows.select("i", F.greatest("low", F.col("i") + 1).alias("low"), F.least(F.col("low") + STRIP_IDS, F.lit(n)).alias("end"))
    return rows.where("low < end").select("i", F.explode(F.sequence(F.col("low"), F.col("end") - 1)).alias("j"))


def epsilon_filter(pairs: DataFrame, epsilon: float, value: str = "k") -> DataFrame:
    """Strictly above the threshold; NaN (which sorts above every number) is not a similarity."""
    return pairs.where((F.col(value) > epsilon) & ~F.isnan(value))


def mirror(pairs: DataFrame) -> DataFrame:
    """Both directions of every upper-triangle pair, from one scan."""
    return pairs.selectExpr("stack(2, i, j, j, i) AS (i, j)", "k")


def kernel_pairs(
    rows: DataFrame,
    kernel: Kernel,
    epsilon: float,
    tile_rows: int | None = None,
    prune: bool | None = None,
    leaf_rows: int | None = None,
) -> DataFrame:
    """Pairs i < j of one table with kernel above the threshold."""
    emit, options = emit_pairs(True), {"tile_rows": tile_rows, "prune": prune, "leaf_rows": leaf_rows}
    return tile_join(rows, None, kernel, epsilon, emit, _PAIR_DDL, _PAIR_ARROW, **options)


def pairs_evaluated(rows: DataFrame, kernel: Kernel, epsilon: float, leaf_rows: int | None = None) -> DataFrame:
    """One row: all pairs, those that the partition tree lets meet, their share, those above the threshold."""
    counts = tile_join(rows, None, kernel, epsilon, emit_counts, _COUNT_DDL, _COUNT_ARROW, leaf_rows=leaf_rows)
    n = rows.where(has_vector("x")).agg(F.count(F.lit(1))).scalar()
    total = (n * (n - 1) / 2).cast("bigint")
    seen = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_considered", "n_kept")])
    share = F.try_divide("n_considered", "n_pairs").alias("share")
    return seen.select(total.alias("n_pairs"), "n_considered", "n_kept").select("*", share)


def kernel_pairs_between(
    left: DataFrame,
    right: DataFrame,
    kernel: Kernel,
    epsilon: float,
    tile_rows: int | None = None,
    prune: bool | None = None,
) -> DataFrame:
    """Pairs (left i, right j) with kernel above the threshold."""
    return tile_join(
        left, right, kernel, epsilon, emit_pairs(False), _PAIR_DDL, _PAIR_ARROW, tile_rows=tile_rows, prune=prune
    )


def weighted_sums(rows: DataFrame, kernel: Kernel, epsilon: float, n_weights: int, **options) -> DataFrame:
    """(id, sums) per row with a vector: the kernel times the partner's ``weight`` array, added up over the pairs
    above the threshold. Pairs live in the tasks only, so what is moved grows with rows and tiles."""
    # With many weights a sum is wider than its vector: evaluating a pair twice costs less than moving a sum for every tile.
    column = emit_column_sums if n_weights >= WIDE_WEIGHTS else None
    parts = tile_join(rows, None, kernel, epsilon, OverTile(emit_weighted_sums, column), _SUM_DDL, _SUM_ARROW, weights=n_weights, **options)
    sums = F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(n_weights)])
    return parts.groupBy("id").agg(sums.alias("sums"))


def weighted_sums_between(left: DataFrame, right: DataFrame, kernel: Kernel, epsilon: float, n_weights: int, **options) -> DataFrame:
    """(id, sums) per row of ``right``: the kernel times the ``weight`` array of the left rows, added up over the pairs above
    the threshold, none of which leaves its task."""
    listed = F.array(*[F.lit(0.0)] * n_weights)
    emit = OverTile(emit_column_sums, emit_column_sums)
    parts = tile_join(left, right.withColumn("weight", listed), kernel, epsilon, emit, _SUM_DDL, _SUM_ARROW, weights=n_weights, **options)
    sums = F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(n_weights)])
    return parts.groupBy("id").agg(sums.alias("sums"))


def kernel_diagonal(rows: DataFrame, kernel: Kernel) -> DataFrame:
    return rows.select("id", kernel.expr(F.col("x"), F.col("x")).alias("k"))


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.select("id", "x", F.col("label").cast("double").alias("weight"))


def kernel_matrix_signed(
    rows: DataFrame, kernel: Kernel, epsilon: float, signed_filter: bool = False, tile_rows: int | None = None
) -> DataFrame:
    """Entries y_i y_j k(i, j) of the full square, diagonal included, where k exceeds the threshold.

    ``signed_filter`` thresholds the signed value instead, which drops opposite-class pairs.
    """
    upper = tile_join(
        _labelled(rows),
        None,
        kernel,
        epsilon,
        emit_signed(True, signed_filter),
        _PAIR_DDL,
        _PAIR_ARROW,
        tile_rows=tile_rows,
    )
    # y * y = 1 on the diagonal.
    diagonal = rows.select(
        F.col("id").alias("i"), F.col("id").alias("j"), kernel.expr(F.col("x"), F.col("x")).alias("k")
    )
    entries = mirror(upper).unionByName(epsilon_filter(diagonal, epsilon))
    return entries.withColumnRenamed("k", "value")


def block_ends(n: int) -> list[int]:
    """Ends of four blocks whose triangles have equal area: the area below position p grows with p squared."""
    ends = [math.floor(n * math.sqrt(k / 4) + 0.5) for k in (1, 2, 3, 4)]
    if len({0, *ends}) < 5:
        raise ValueError("too few rows for four blocks")
    return ends


def _block_of(position: Column, n: int) -> Column:
    first, second, third, _ = block_ends(n)
    return F.when(position < first, 0).when(position < second, 1).when(position < third, 2).otherwise(3)


def assign_blocks(df: DataFrame, n: int) -> DataFrame:
    """Adds ``block`` 0..3 by position."""
    return df.withColumn("block", _block_of(F.col("position"), n))


def assign_replicates(df: DataFrame, n: int, remainder: bool = False) -> DataFrame:
    """Adds ``replicate`` 0..3 (equal quarters by position) and the block inside the replicate.

    With ``remainder``, up to three rows that fill no quarter are the begin of a replicate 4; else they are an error.
    """
    if n % 4 != 0 and not remainder:
        raise ValueError("the number of rows must be a multiple of four")
    quarter = n // 4
    inside = F.col("position") % quarter
    return df.withColumn("replicate", F.floor(F.col("position") / quarter).cast("int")).withColumn(
        "block", _block_of(inside, quarter)
    )


def kernel_pairs_blocked(
    rows: DataFrame,
    kernel: Kernel,
    epsilon: float,
    evals: DataFrame | None = None,
    tile_rows: int | None = None,
    remainder: bool = False,
) -> DataFrame:
    """Pairs inside the same block only: a stated approximation of the full table.

    With ``evals``, training rows of a block meet the evaluation rows of that block in each of
    four equal replicates (``remainder``: see ``assign_replicates``).
    """
    blocked = assign_blocks(positions(rows, "id"), rows.count())
    others = None
    if evals is not None:
        others = assign_replicates(positions(evals, "id"), evals.count(), remainder)
    return tile_join(
        blocked,
        others,
        kernel,
        epsilon,
        emit_pairs(evals is None),
        _PAIR_DDL,
        _PAIR_ARROW,
        tile_rows=tile_rows,
        group="block",
    )


def kernel_pairs_by_block(rows: DataFrame, kernel: Kernel, epsilon: float) -> DataFrame:
    """All pairs i < j above the threshold with the blocks of both: (i, j, k, block_i, block_j), block_i <= block_j."""
    blocks = settle(assign_blocks(positions(rows, "id"), rows.count()).select("id", "block"))
    found = kernel_pairs(rows, kernel, epsilon)
    n = blocks.count()
    for side in ("i", "j"):
        own = blocks.select(F.col("id").alias(side), F.col("block").alias(f"block_{side}"))
        found = keyed_join(found, own, [side], right_rows=n, right_width=2)
    return found.select("i", "j", "k", "block_i", "block_j")


def nonzero_count_train(rows: DataFrame, kernel: Kernel, epsilon: float) -> DataFrame:
    """Non-zero entries of the square kernel: the diagonal plus twice the pairs above the threshold."""
    counts = tile_join(rows, None, kernel, epsilon, emit_counts, _COUNT_DDL, _COUNT_ARROW)
    n = rows.agg(F.count(F.lit(1))).scalar()
    return counts.agg(F.coalesce(F.sum("n_kept"), F.lit(0)).alias("kept")).select(
        (n + 2 * F.col("kept")).alias("nonzero")
    )


def nonzero_count_eval(train: DataFrame, evals: DataFrame, kernel: Kernel, epsilon: float) -> DataFrame:
    counts = tile_join(train, evals, kernel, epsilon, emit_counts, _COUNT_DDL, _COUNT_ARROW)
    return counts.agg(F.coalesce(F.sum("n_kept"), F.lit(0)).alias("nonzero"))


def adjacency_sets(pairs: DataFrame) -> DataFrame:
    """Row index to its set of column indices, in segments of SEGMENT_IDS columns.

    A segment bounds the size of one set, so a hub row does not become one huge cell.
    """
    segment = F.floor(F.col("j") / SEGMENT_IDS).cast("bigint")
    return (
        pairs.withColumn("segment", segment)
        .groupBy("i", "segment")
        .agg(F.sort_array(F.collect_set("j")).alias("columns"))
    )


def kernel_adjacency(rows: DataFrame, kernel: Kernel, epsilon: float, **options) -> DataFrame:
    """The ``adjacency_sets`` of both directions of ``kernel_pairs``: the sets begin inside the tiles, so a pair moves as two
    numbers of 16 bits."""
    emit = emit_adjacency(SEGMENT_IDS)
    parts = tile_join(rows, None, kernel, epsilon, emit, _SET_DDL, _SET_ARROW, **options)
    places = F.sort_array(F.array_distinct(F.flatten(F.collect_list("columns"))))
    merged = parts.groupBy("i", "segment").agg(places.alias("places"))
    first = F.col("segment") * SEGMENT_IDS + (1 << 15)
    return merged.select("i", "segment", F.transform("places", lambda c: first + c).alias("columns"))


def merge_pair_tables(*tables: DataFrame, disjoint: bool = False) -> DataFrame:
    """Union without duplicate index pairs; ``disjoint`` tables need no comparison."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    return merged if disjoint else merged.dropDuplicates(["i", "j"])


def _sampled_bounds(rows: DataFrame, form: DistanceForm, first: float, last: float, total: int) -> tuple[float, float]:
    """Values that most likely lie below the first and above the last of these shares of all pairs' values, from a sample of
    the pairs."""
    values = settle(sampled_values(rows, form, min(1.0, BOUND_PAIRS / total), seed=1))
    n = values.count()
    low = math.floor(n * first - 4 * math.sqrt(n * first) - 8)
    high = math.ceil(n * last + 4 * math.sqrt(n * last) + 8)
    known = values_at(values, "k", [k for k in (low, high) if 1 <= k <= n])
    return known.get(low, 0.0), known.get(high, math.inf)


def pair_value_quantile(rows: DataFrame, form: DistanceForm, quantile: float) -> float:
    """The exact order-statistic quantile of a distance of all pairs i < j, none of them stored.

    A sample of the pairs gives bounds on the quantile, the upper one a radius, and only pairs that the
    partition tree finds within it are looked at. Their values between the bounds are counted by leading bits inside the
    tasks, those below together. Were fewer or more counted than wanted, the bounds grow; else the bin that holds the wanted
    position is the next bound, counted by all its bits, or by half of them where it holds more than BIN_VALUES. Rows with
    NULL, NaN or infinity don't count.
    """
    odd = F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(has_vector("x") & ~odd).select("id", "x")
    n = rows.count()
    total = n * (n - 1) // 2
    if total == 0:
        raise ValueError("quantiles of an empty table")
    # Wanted position -> its bin so far and its position inside.
    found = {p: (0, p) for p in wanted_positions(total, quantile)}
    above, bound = _sampled_bounds(rows, form, min(found) / total, max(found) / total, total)
    prefixes: dict[int, list[int]] = {}
    shift = FIRST_SHIFT
    while True:
        emit = emit_bins(form, shift, bound, prefixes, above)
        radius = form.distance(bound) if math.isfinite(bound) else None
        counted = tile_join(rows, None, form, float("-inf"), emit, "bin bigint, n bigint", _BIN_ARROW, radius=radius)
        hist = settle(counted.groupBy("bin").agg(F.sum("n").alias("n")))
        if not prefixes:
            seen, below = hist.agg(F.sum("n"), F.sum(F.when(F.col("bin") < 0, F.col("n")))).first()
            if (below or 0) >= min(found):
                above = above / 2 if above > 1e-150 else 0.0
                continue
            if (seen or 0) < max(found):
                bound = 2 * bound if 0 < bound < 1e150 else math.inf
                continue
        for position, (last, inside) in found.items():
            own = settle(hist.where(F.shiftright("bin", last_shift - shift) == last)) if prefixes else hist
            at = values_at(own, "bin", [inside], hist=own)[inside]
            found[position] = (at, inside - (own.where(F.col("bin") < at).agg(F.sum("n")).first()[0] or 0))
        if shift == 0:
            values = np.array([at for at, _ in found.values()], np.int64).view(np.float64)
            return float(values.mean())
        bins = sorted({at for at, _ in found.values()})
        held = hist.where(F.col("bin").isin(bins)).agg(F.sum("n")).first()[0]
        # The largest number that begins with these bits.
        bound = float(np.array([(bins[-1] + 1 << shift) - 1], np.int64).view(np.float64)[0])
        prefixes, last_shift, above = {shift: bins}, shift, 0.0
        shift = 0 if held <= BIN_VALUES else shift // 2


def kernel_scale(
    rows: DataFrame, quantile: float = 0.01, factor: float = math.e / 4, root_distance: bool = True
) -> float:
    """Estimate of the Gaussian gamma from the distances of all pairs."""
    sigma = pair_value_quantile(rows, DistanceForm(root_distance), quantile) * factor
    return 1.0 / (2.0 * sigma * sigma)
