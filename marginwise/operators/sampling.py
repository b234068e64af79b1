"""Bernoulli samples of all pairs of rows, drawn without looking at the pairs that are left out."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginwise.functions.kernels import Kernel
from marginwise.operators.joins import keyed_join
from marginwise.operators.ranks import positions
from marginwise.operators.partition import matrix
from marginwise.operators.tiles import TILE_BYTES, TILE_ROWS, _extent, has_vector
from marginwise.session import settle

# From so many expected draws per row on, rows meet in tiles; fewer draws fetch their vectors by joins.
TILED_DRAWS = 50
# Blocks of draws that are evaluated at once.
BLOCKS_AT_ONCE = 16
# Expected draws of one block of pair numbers.
BLOCK_DRAWS = 1000
# Modulus and multipliers of the sampling hash (fixed values: 2^31 - 1, 48271, 69621).
PAIR_MODULUS, PAIR_FIRST, PAIR_SECOND = 2147483647, 48271, 69621


def pair_uniform(i: np.ndarray, j: np.ndarray, seed: int) -> np.ndarray:
    """Uniform number in [0, 1) of two numbers, in 64-bit integer arithmetic without overflow."""
    h = ((i % PAIR_MODULUS) * PAIR_FIRST + (j % PAIR_MODULUS) * PAIR_SECOND + seed) % PAIR_MODULUS
    for _ in range(2):
        h = (h * ((h + 12345) % PAIR_MODULUS)) % PAIR_MODULUS
    return h / float(PAIR_MODULUS)


def block_size(probability: float) -> int:
    return max(1, math.ceil(BLOCK_DRAWS / probability))


def drawn_numbers(block: int, size: int, total: int, probability: float, seed: int) -> np.ndarray:
    """The drawn numbers of one block: the distance to the next draw is geometric, so draws that fail
    are jumped over. As it has no memory, every block can begin anew."""
    if probability >= 1.0:
        return np.arange(block * size, min(total, (block + 1) * size))
    first, at, found = 0, block * size - 1, []
    end = min(total, (block + 1) * size)
    step = int(size * probability * 1.2) + 20
    while at < end:
        u = 1.0 - pair_uniform(np.int64(block), np.arange(first, first + step, dtype=np.int64), seed)
        skip = np.minimum(np.floor(np.log(u) / math.log1p(-probability)), size)
        places = at + np.cumsum(skip.astype(np.int64) + 1)
        found.append(places[places < end])
        first, at = first + step, int(places[-1])
    return np.concatenate(found)


def unrank(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair i < j of a number: (0, 1), (0, 2), (1, 2), (0, 3), ..."""
    j = np.floor((1.0 + np.sqrt(1.0 + 8.0 * number)) / 2.0).astype(np.int64)
    # The root is rounded: at most one off.
    j -= j * (j - 1) // 2 > number
    j += (j + 1) * j // 2 <= number
    return number - j * (j - 1) // 2, j


def sampled_pairs(
    spark: SparkSession, rows: int, others: int | None, probability: float, seed: int = 0
) -> DataFrame:
    """(i, j) positions of a Bernoulli sample of all pairs: i < j < rows, or i < rows and j < others.

    The work grows with the number of draws. Draws are a function of the seed, not of tasks.
    """
    total = rows * (rows - 1) // 2 if others is None else rows * others
    if not 0.0 <= probability <= 1.0:
        raise ValueError("probability must lie in [0, 1]")
    if total == 0 or probability == 0.0:
        return spark.createDataFrame([], "i bigint, j bigint")
    size = block_size(probability)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                numbers = drawn_numbers(block, size, total, probability, seed)
                i, j = unrank(numbers) if others is None else (numbers // others, numbers % others)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64())], names=["i", "j"])

    return spark.range(-(-total // size)).mapInArrow(draw, "i bigint, j bigint")


def sampled_values(
    rows: DataFrame, kernel: Kernel, probability: float, evals: DataFrame | None = None, seed: int = 0
) -> DataFrame:
    """(k) kernel values of a sample of the pairs, rows numbered in the order of their ids.

    Two equi-joins by position bring the vectors to the drawn pairs only.
    """
    sides = []
    for df in [rows] if evals is None else [rows, evals]:
        placed = settle(positions(df.where(has_vector("x")).select("id", "x"), "id"))
        sides.append((placed, *placed.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(1))).first()))
    (left, n, width), (right, m, _) = sides[0], sides[-1]
    drawn = sampled_pairs(rows.sparkSession, n, None if evals is None else m, probability, seed)
    own = left.select(F.col("position").alias("i"), F.col("x").alias("a"))
    other = right.select(F.col("position").alias("j"), F.col("x").alias("b"))
    cells = 1 + width // 2
    both = keyed_join(keyed_join(drawn, own, ["i"], right_rows=n, right_width=cells), other, ["j"], right_rows=m, right_width=cells)
    return both.select(kernel.expr(F.col("a"), F.col("b")).alias("k"))


def _tile_counter(kernel: Kernel, epsilon: float, size: int, total: int, others: int | None, probability: float, seed: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        sides = []
        for part in (table.filter(table["is_left"]), table.filter(pa.compute.invert(table["is_left"]))):
            if not part.num_rows:
                return
            part = part.combine_chunks().sort_by("position")
            sides.append((part["position"].to_numpy(), matrix(part["x"].combine_chunks())))
        (left, X), (right, Y) = sides
        # Positions of a tile are consecutive, and so are the numbers of a row of it.
        if others is None:
            first, last = right * (right - 1) // 2 + left[0], right * (right - 1) // 2 + np.minimum(left[-1] + 1, right)
        else:
            first, last = left * others + right[0], left * others + right[-1] + 1
        first, last = first[last > first] // size, (last[last > first] - 1) // size
        span = np.arange((last - first).max() + 1) if len(first) else np.zeros(0, np.int64)
        blocks = np.unique(np.concatenate([first[first + k <= last] + k for k in span])) if len(span) else first
        n_sampled = n_above = 0
        for part in range(0, len(blocks), BLOCKS_AT_ONCE):
            drawn = [drawn_numbers(int(b), size, total, probability, seed) for b in blocks[part : part + BLOCKS_AT_ONCE]]
            numbers = np.concatenate(drawn)
            i, j = unrank(numbers) if others is None else (numbers // others, numbers % others)
            own = (i >= left[0]) & (i <= left[-1]) & (j >= right[0]) & (j <= right[-1])
            with np.errstate(all="ignore"):
                values = kernel.rows(X[i[own] - left[0]], Y[j[own] - right[0]])
            n_sampled += len(values)
            n_above += int((values > epsilon).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n_sampled]), pa.array([n_above])], names=["n_sampled", "n_above"])

    return count


def sampled_counts(
    rows: DataFrame, kernel: Kernel, epsilon: float, probability: float, evals: DataFrame | None, seed: int, tile_rows: int | None = None
) -> DataFrame:
    """(n_sampled, n_above) of every pair of tiles of consecutive rows.

    A task draws the numbers of its own tiles anew, so a row is moved once per partner tile and a draw never.
    """
    frames = [df.where(has_vector("x")).select("id", "x") for df in ([rows] if evals is None else [rows, evals])]
    extents = _extent(*frames)
    (n, width), others = extents[0], None if evals is None else extents[1][0]
    total = n * (n - 1) // 2 if others is None else n * others
    tile_rows = tile_rows or max(64, min(TILE_ROWS, TILE_BYTES // (8 * width)))
    tile = F.floor(F.col("position") / tile_rows).cast("int")
    placed = [settle(positions(df, "id")).select("position", "x", tile.alias("tile")) for df in frames]
    own, partners = -(-n // tile_rows), -(-(n if others is None else others) // tile_rows)
    later = F.sequence(F.col("tile") if others is None else F.lit(0), F.lit(partners - 1))
    earlier = F.sequence(F.lit(0), F.col("tile") if others is None else F.lit(own - 1))
    left = placed[0].select(F.col("tile").alias("a"), F.explode(later).alias("b"), F.lit(True).alias("is_left"), "position", "x")
    right = placed[-1].select(F.explode(earlier).alias("a"), F.col("tile").alias("b"), F.lit(False).alias("is_left"), "position", "x")
    pairs = own * (own + 1) // 2 if others is None else own * partners
    counter = _tile_counter(kernel, epsilon, block_size(probability), total, others, probability, seed)
    met = left.unionAll(right).repartition(pairs, "a", "b").groupBy("a", "b")
    return met.applyInArrow(counter, "n_sampled bigint, n_above bigint")


def density_sampled(
    rows: DataFrame,
    kernel: Kernel,
    epsilon: float,
    probability: float = 0.1,
    evals: DataFrame | None = None,
    seed: int = 0,
) -> DataFrame:
    """Share of kernel entries above the threshold, from a Bernoulli sample of the pairs.

    Rows whose vector is NULL or holds a NULL have no pairs; an undefined value is not above. Without
    any draw the share is NULL.
    """
    n = rows.where(has_vector("x")).count()
    m = n if evals is None else evals.where(has_vector("x")).count()
    draws = probability * (n * (n - 1) // 2 if evals is None else n * m)
    if draws > TILED_DRAWS * max(n, m):
        counts = sampled_counts(rows, kernel, epsilon, probability, evals, seed)
        found = counts.agg(F.coalesce(F.sum("n_sampled"), F.lit(0)).alias("n_sampled"), F.sum("n_above").alias("n_above"))
        return found.select("n_sampled", F.try_divide("n_above", "n_sampled").alias("density"))
    above = (F.col("k") > epsilon) & ~F.isnan("k")
    values = sampled_values(rows, kernel, probability, evals, seed)
    return values.agg(F.count(F.lit(1)).alias("n_sampled"), F.avg(F.when(above, 1.0).otherwise(0.0)).alias("density"))
