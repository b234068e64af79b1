"""Metric partition tree: rows in cells such that any two within a radius share exactly one.

Each node of the tree is a set of pivots. A row lives in the cell of its nearest pivot, its home, and
visits as a guest each other cell that its ball of the radius may reach: the distance to the plane
half way between its own pivot and another is at most the distance to any row that lives there. Pairs are then home
with home and home with guest. Pivots are drawn from a sample of the whole table, as many as save
most work on that sample, guests counted; where nothing is saved, a cell stays whole.

Cells, their sizes and their pivots are tables. A round samples every crowded cell, draws its
pivots in a task of their own, and sends them to the rows by an equi-join on the cell, in
chunks of bounded size. A cell that stays crowded (copies, balls that reach everything) is dealt over many tasks by the tile join.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginwise.operators.joins import keyed_join
from marginwise.session import settle, stored

# Cells are cut while they hold more rows than this.
LEAF_ROWS = 2048
# Rows (and bytes) of a cell from which its pivots are drawn, pivots of a cell, rounds.
SAMPLE_ROWS, SAMPLE_BYTES, LEAVES, ROUNDS = 16_384, 32 << 20, 256, 7
# A cut must save this share of a cell's work; a visit costs as much as this many pairs.
SAVING, VISIT_PAIRS = 0.1, 64
CHUNK_BYTES = 32 << 20
# Rows of a chunk, whatever their width; distances of rows to pivots that a task holds at once.
CHUNK_ROWS, STRIP_CELLS = 1 << 17, 1 << 20
# The squares of larger numbers overflow: such rows are near one another or near none.
HUGE = 1e150

_COLUMNS = ["cell", "guest", "id", "x", "weight"]
_ROW = "cell bigint, guest boolean, id bigint, x array<double>, weight "


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _squared(X: np.ndarray, Y: np.ndarray) -> np.ndarray:
    return (X * X).sum(axis=1)[:, None] + (Y * Y).sum(axis=1)[None, :] - 2.0 * (X @ Y.T)


def draw_pivots(H: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` different rows, each drawn in proportion to its squared distance from those before."""
    random = np.random.default_rng(0)
    chosen = [int(random.integers(len(H)))]
    far = ((H - H[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < count and far.max() > 0:
        # Very large sums stay finite, relative to the largest.
        share = np.cumsum(far / far.max())
        chosen.append(min(int(np.searchsorted(share, random.random() * share[-1], "right")), len(H) - 1))
        far = np.minimum(far, ((H - H[chosen[-1]]) ** 2).sum(axis=1))
    return H[chosen]


def visits(D: np.ndarray, pivots: np.ndarray, radius: float, guest: np.ndarray, triangle: bool):
    """(home, mask of the cells visited besides) from the squared distances of rows to the pivots.

    Homes of a triangle visit one way only, so that two cells meet once: of the even sums of their
    numbers the lower visits the higher, of the odd ones the other way round. Guests visit both ways.
    """
    home = D.argmin(axis=1)
    apart = np.sqrt(np.maximum(_squared(pivots, pivots), 0.0))
    size = (pivots * pivots).sum(axis=1)
    # Room for rounding in the products.
    room = 1e-9 * (1.0 + D + 2.0 * size[None, :] + 2.0 * size.max())
    near = D - D[np.arange(len(D)), home][:, None] <= 2.0 * radius * (1 + 1e-9) * apart[home] + room
    near[np.arange(len(D)), home] = False
    number = np.arange(len(pivots))
    if triangle:
        even = (home[:, None] + number[None, :]) % 2 == 0
        near &= guest[:, None] | (even == (home[:, None] < number[None, :]))
    else:
        near &= guest[:, None]
    return home, near


def _work(home: np.ndarray, near: np.ndarray, guest: np.ndarray, cells: int, share: float, triangle: bool) -> float:
    own = np.bincount(home[~guest], minlength=cells) / share
    visiting = (np.bincount(home[guest], minlength=cells) + near.sum(axis=0)) / share
    pairs = own @ visiting + (own @ own / 2 if triangle else 0.0)
    return float(pairs + VISIT_PAIRS * (own.sum() + visiting.sum()))


def grow(
    X: np.ndarray, guest: np.ndarray, radius: float, share: float, leaf_rows: int, triangle: bool, leaves: int = LEAVES
) -> np.ndarray:
    """The pivots of a cell, from a sample of its rows; none where no number of pivots saves enough."""
    H = X[~guest]
    most = min(leaves, len(H) // 2)
    if most < 2:
        return H[:0]
    pivots = draw_pivots(H, most)
    D = _squared(X, pivots)
    nobody = np.zeros((len(X), 1), bool)
    now = _work(np.zeros(len(X), np.int64), nobody, guest, 1, share, triangle)
    best, count, k = (1 - SAVING) * now, 0, 2
    while k < 2 * len(pivots):
        k = min(k, len(pivots))
        home, near = visits(D[:, :k], pivots[:k], radius, guest, triangle)
        work = _work(home, near, guest, k, share, triangle)
        if work < best:
            best, count = work, k
        k *= 2
    return pivots[:count]


def _pivots(
    rows: DataFrame, crowded: DataFrame, n_cells: int, radius: float, leaf_rows: int, triangle: bool, sample: int, leaves: int
) -> DataFrame:
    """(cell, n_pivots, pivots) of the crowded cells (cell, n, home) that are to be cut, from a sample of
    each by the hash of its ids."""
    size = 1 << 20
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n")).alias("share")
    wanted = keyed_join(rows.drop("weight"), crowded.select("cell", share), ["cell"], right_rows=n_cells, right_width=2)
    drawn = wanted.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(size)) < F.col("share") * size)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        if not table.num_rows:
            return
        X, share = matrix(table["x"].chunk(0)), table["share"][0].as_py()
        found = grow(X, table["guest"].to_numpy(), radius, share, leaf_rows, triangle, leaves)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([table["cell"][0].as_py()], pa.int64()),
                pa.array([len(found)], pa.int32()),
                pa.array([found.ravel()], pa.list_(pa.float64())),
            ],
            names=["cell", "n_pivots", "pivots"],
        )

    made = drawn.groupBy("cell").applyInArrow(build, "cell bigint, n_pivots int, pivots array<double>")
    return stored(made.where("n_pivots > 1"), "pivots")


def _route(radius: float, triangle: bool, leaves: int):
    def route(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        rows = rows.select(_COLUMNS).combine_chunks()
        if not rows.num_rows or not pivots.num_rows:
            return rows.slice(0, 0)
        P = np.array(pivots["pivots"][0].as_py()).reshape(pivots["n_pivots"][0].as_py(), -1)
        guest = rows["guest"].to_numpy()
        X, strip = matrix(rows["x"].chunk(0)), max(1, STRIP_CELLS // len(P))
        homes, found = [], []
        for start in range(0, len(X), strip):
            cut = slice(start, start + strip)
            home, near = visits(_squared(X[cut], P), P, radius, guest[cut], triangle)
            at, to = np.nonzero(near)
            homes.append(home)
            found.append((at + start, to))
        home = np.concatenate(homes)
        row, cell = (np.concatenate(part) for part in zip(*found))
        out = rows.take(pa.array(np.concatenate([np.arange(rows.num_rows), row])))
        cell = rows["cell"][0].as_py() * leaves + np.concatenate([home, cell])
        guest = np.concatenate([guest, np.ones(len(row), bool)])
        return out.set_column(0, "cell", pa.array(cell, pa.int64())).set_column(1, "guest", pa.array(guest))

    return route


def partition(
    left: DataFrame,
    right: DataFrame | None,
    radius: float,
    width: int,
    leaf_rows: int = LEAF_ROWS,
    sample: int | None = None,
    leaves: int = LEAVES,
    chunk_rows: int | None = None,
) -> DataFrame:
    """(cell, guest, id, x, weight) of every visit. Rows of ``left`` are homes; ``right`` are guests, or
    None when ``left`` meets itself. Input columns: id, x, weight; vectors of one length. A row with NaN or
    infinity is within no radius and goes. ``leaves`` to the power of ROUNDS must fit 63 bits.
    """
    triangle = right is None
    size = F.array_max(F.transform("x", lambda v: F.abs(v)))
    cell = F.when(size < HUGE, 0).otherwise(-1).cast("bigint").alias("cell")
    sides = [df.where(size < float("inf")).select(cell, F.lit(k > 0).alias("guest"), "id", "x", "weight") for k, df in
             enumerate([left] if triangle else [left, right])]
    rows = stored(reduce(DataFrame.unionAll, sides), "cells")
    sample = sample or max(256, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, width))))
    chunk_rows = chunk_rows or max(1024, min(CHUNK_ROWS, CHUNK_BYTES // (8 * max(1, width))))
    done = []
    for _ in range(ROUNDS):
        counted = rows.groupBy("cell").agg(F.count_if(~F.col("guest")).alias("home"), F.count(F.lit(1)).alias("n"))
        crowded = settle(counted.where((F.col("home") > leaf_rows) & (F.col("cell") >= 0)))
        n_cells = crowded.count()
        found = _pivots(rows, crowded, n_cells, radius, leaf_rows, triangle, sample, leaves) if n_cells else None
        n_cut = found.count() if n_cells else 0
        if not n_cut:
            break
        chunks = F.ceil(F.col("n") / chunk_rows).cast("int").alias("chunks")
        cut = settle(found.join(crowded, "cell").select(*found.columns, chunks))
        marked = keyed_join(rows, cut.select("cell", "chunks"), ["cell"], how="left", right_rows=n_cut, right_width=2)
        done.append(marked.where(F.col("chunks").isNull()).select(*_COLUMNS))
        moving = marked.where(F.col("chunks").isNotNull())
        moving = moving.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")
        sent = cut.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        both = moving.groupBy("cell", "chunk").cogroup(sent.groupBy("cell", "chunk"))
        routed = both.applyInArrow(_route(radius, triangle, leaves), _ROW + rows.schema["weight"].dataType.simpleString())
        rows = stored(routed, "cells")
    done.append(rows.select(*_COLUMNS))
    # Cells of different rounds are different cells, whatever their number.
    named = [d.withColumn("cell", F.struct(F.lit(k).alias("round"), F.col("cell").alias("number"))) for k, d in enumerate(done)]
    return reduce(DataFrame.unionAll, named)
