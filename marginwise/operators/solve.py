"""Symmetric positive systems of any size: Cholesky factors by blocks, as joins of block tables.

A matrix is a table of blocks (p, q, v) of its lower triangle, each a row-major array of at most
``size`` x ``size`` numbers. The right side is one more block row, which the factorisation turns
into the solution of the lower system on its way. One block, one panel sum and the solution itself reach the driver.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginwise.session import discard, stored

BLOCK = 256
_BLOCK = "p int, q int, v array<double>"


def blocks_of(entries: DataFrame, d: int, size: int = BLOCK) -> DataFrame:
    """Lower-triangle blocks from the entries (a, b, value) with a, b < d and the right side in column b = d.

    Missing entries are zero. Block row ceil(d / size) is the right side, one row high.
    """
    last = -(-d // size)
    # The right side lies below the matrix: entry (d, a) instead of (a, d).
    a = F.when(F.col("b") == d, F.lit(last * size)).otherwise(F.col("a"))
    b = F.when(F.col("b") == d, F.col("a")).otherwise(F.col("b"))
    lower = entries.select(a.alias("a"), b.alias("b"), "value").where(F.col("a") >= F.col("b"))
    p, q = F.floor(F.col("a") / size).cast("int"), F.floor(F.col("b") / size).cast("int")
    cell = F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "value")
    # A block has at most size * size cells.
    grouped = lower.groupBy(p.alias("p"), q.alias("q")).agg(F.collect_list(cell).alias("cells"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q, cells in zip(*[c.to_pylist() for c in batch.columns]):
                height, width = (1 if p == last else min(size, d - p * size)), min(size, d - q * size)
                M = np.zeros((height, width))
                for c in cells:
                    M[c["a"] - p * size, c["b"] - q * size] = c["value"]
                if p == q:
                    M = np.tril(M) + np.tril(M, -1).T
                yield _batch(p, q, M)

    found = grouped.mapInArrow(fill, _BLOCK)
    # Blocks without an entry are there as well: the update needs a place for what it adds.
    n = last + 1
    every = entries.sparkSession.range(n * n).select((F.col("id") / n).cast("int").alias("p"), (F.col("id") % n).cast("int").alias("q"))
    every = every.where(f"p >= q AND q < {last}")
    height = F.when(F.col("p") == last, 1).otherwise(F.least(F.lit(size), d - F.col("p") * size))
    zero = F.array_repeat(F.lit(0.0), (height * F.least(F.lit(size), d - F.col("q") * size)).cast("int"))
    return every.join(found, ["p", "q"], "left").select("p", "q", F.coalesce("v", zero).alias("v"))


def _batch(p: int, q: int, M: np.ndarray) -> pa.RecordBatch:
    values = pa.array([M.ravel()], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([q], pa.int32()), values], names=["p", "q", "v"])


def _panel(blocks: DataFrame, k: int, width: int) -> tuple[np.ndarray, DataFrame]:
    """Factor of the diagonal block k and the factor's blocks below it."""
    diagonal = np.array(blocks.where(f"p = {k} AND q = {k}").first()["v"]).reshape(width, width)
    factor = np.linalg.cholesky(diagonal)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, v in zip(batch.column("p").to_pylist(), batch.column("v")):
                M = v.values.to_numpy(zero_copy_only=False).reshape(-1, width)
                yield _batch(p, k, np.linalg.solve(factor, M.T).T)

    return factor, stored(blocks.where(f"q = {k} AND p > {k}").mapInArrow(below, _BLOCK), "factor")


def _update(blocks: DataFrame, panel: DataFrame, k: int, width: int) -> DataFrame:
    """The blocks right of column k without the part that the panel explains."""
    left = panel.select("p", F.col("v").alias("x"))
    right = panel.select(F.col("p").alias("q"), F.col("v").alias("y"))
    rest = blocks.where(f"q > {k}").join(left, "p").join(right, "q").select("p", "q", "v", "x", "y")

    def subtract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = batch.column("p").to_pylist(), batch.column("q").to_pylist()
            for i in range(batch.num_rows):
                v, x, y = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("v", "x", "y"))
                X, Y = x.reshape(-1, width), y.reshape(-1, width)
                yield _batch(p[i], q[i], v.reshape(len(X), len(Y)) - X @ Y.T)

    return stored(rest.mapInArrow(subtract, _BLOCK), "blocks")


def solve_positive(entries: DataFrame, d: int, size: int = BLOCK) -> np.ndarray:
    """The solution of a symmetric positive system given as entries (a, b, value), its right side in column d.

    A system of one block is solved on the driver, a larger one in one round of joins per block column.
    A matrix that is not positive is an error.
    """
    last = -(-d // size)
    widths = [min(size, d - k * size) for k in range(last)]
    blocks = stored(blocks_of(entries, d, size), "blocks")
    factors, panels = [], []
    for k in range(last):
        factor, panel = _panel(blocks, k, widths[k])
        factors.append(factor), panels.append(panel)
        if k + 1 < last:
            before, blocks = blocks, _update(blocks, panel, k, widths[k])
            discard(before)
    weights = np.zeros(d)
    for k in reversed(range(last)):
        solved = weights.copy()

        def explained(batches: Iterator[pa.RecordBatch], width=widths[k], solved=solved) -> Iterator[pa.RecordBatch]:
            # The block row of the right side counts as it is, the others as far as they are solved.
            total = np.zeros(width)
            for batch in batches:
                for p, v in zip(batch.column("p").to_pylist(), batch.column("v")):
                    M = v.values.to_numpy(zero_copy_only=False).reshape(-1, width)
                    total += M[0] if p == last else -(M.T @ solved[p * size : p * size + len(M)])
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], names=["i", "s"])

        sums = panels[k].mapInArrow(explained, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
        right = np.zeros(widths[k])
        for r in sums:
            right[r["i"]] = r["s"]
        weights[k * size : k * size + widths[k]] = np.linalg.solve(factors[k].T, right)
    discard(blocks, *panels)
    return weights
