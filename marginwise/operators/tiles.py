"""Tile join: evaluate a kernel between all rows of two tables, in bounded groups.

Rows are dealt into tiles of a bounded size. Each pair of tiles is one group; a row is copied
once per partner tile, and the group evaluates one matrix product. When the kernel bounds the
distance at which it can exceed the threshold, rows are first placed in the cells of a partition
tree, and only tiles of one cell meet; nothing is lost. A crowded cell simply gets more tiles.

A single cell of many tiles is not copied: its tiles are written once below the shared folder, and a
task reads those it needs, so what is written grows with the rows alone.
"""

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginwise.functions.kernels import DistanceForm, Kernel
from marginwise.operators.joins import keyed_join
from marginwise.operators.partition import CHUNK_BYTES, CHUNK_ROWS, LEAF_ROWS, matrix, partition
from marginwise.session import locate, scratch_table, settle

# Vectors of one side of a tile. A row is copied once per partner tile, so large tiles mean few copies.
TILE_BYTES = 16 << 20
# Rows of one side of a tile, whatever their width: the work of a pair of tiles does not grow with the table.
TILE_ROWS = 8192
# Pairs of rows that are worth a task of their own.
TASK_PAIRS = 1 << 26
# Where a row would be copied to more tiles than this, the tiles are read from files instead.
MOST_COPIES = 6
# Tiles that meet one tile in a task that adds up over them.
RUN_TILES = 32
# Kernel values of one matrix product: a strip of the left side against the whole right side.
STRIP_CELLS = 1 << 20
STRIP_ROWS = 512
# Kernel values this close to the threshold are recomputed by the direct formula.
BAND = 1e-9

# Cells of tables that are pruned although they are small.
SMALL_LEAF_ROWS = 32

_KEYS = ["cell", "a_tile", "b_tile"]


@dataclass(frozen=True)
class Strip:
    """Part of one tile pair: left rows, right rows, kernel values and the surviving mask."""

    left_id: np.ndarray
    right_id: np.ndarray
    values: np.ndarray
    keep: np.ndarray
    considered: np.ndarray
    left_weight: np.ndarray
    right_weight: np.ndarray
    left_x: np.ndarray
    right_x: np.ndarray


Emit = Callable[[Strip], dict[str, np.ndarray]]


@dataclass(frozen=True)
class OverTile:
    """Emits once for a pair of tiles, from all its strips. ``column`` emits for the right rows alone, once for a
    tile and a run of left tiles; a table that meets itself then does so in both directions."""

    emit: Callable[[Iterator[Strip]], dict[str, np.ndarray]]
    column: Callable[[Iterator[Strip]], dict[str, np.ndarray]] | None = None


def keep_mask(kernel: Kernel, epsilon: float, K: np.ndarray, X: np.ndarray, Y: np.ndarray) -> np.ndarray:
    """Where the kernel exceeds the threshold; values near it are first recomputed by the direct formula."""
    if math.isfinite(epsilon):
        band = BAND * max(1.0, abs(epsilon))
        wide, sure = K >= epsilon - band, K > epsilon + band
        if np.count_nonzero(wide) == np.count_nonzero(sure):
            return sure
        i, j = np.nonzero(wide & ~sure)
        for part in range(0, len(i), STRIP_ROWS):
            a, b = i[part : part + STRIP_ROWS], j[part : part + STRIP_ROWS]
            K[a, b] = kernel.rows(X[a], Y[b])
    # NaN compares false, so an undefined kernel value never survives.
    return K > epsilon


def has_vector(x) -> Column:
    """The vector is there and holds no NULL."""
    return F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull())


Side = tuple[np.ndarray, np.ndarray, np.ndarray]


def _side(part: pa.Table) -> Side:
    """(ids, vectors, weights) of the rows of a tile."""
    part = part.combine_chunks()
    weight = part["weight"]
    weight = matrix(weight.chunk(0)) if pa.types.is_list(weight.type) else weight.to_numpy()
    return part["id"].to_numpy(), matrix(part["x"].chunk(0)), weight


def _strips(
    kernel: Kernel, epsilon: float, left: Side, right: Side, order: Callable | None = None, values: Callable | None = None
) -> Iterator[Strip]:
    """The strips of a pair of tiles; ``order`` compares the ids of pairs that count, where not all do."""
    (left_id, X, left_weight), (right_id, Y, right_weight) = left, right
    strip = max(1, min(STRIP_ROWS, STRIP_CELLS // len(right_id)))
    values = values or kernel.against(Y, epsilon)
    for start in range(0, len(left_id), strip):
        cut = slice(start, start + strip)
        K = values(X[cut])
        keep = keep_mask(kernel, epsilon, K, X[cut], Y)
        considered = np.ones_like(keep)
        if order is not None:
            considered = order(left_id[cut][:, None], right_id[None, :])
            keep &= considered
        yield Strip(left_id[cut], right_id, K, keep, considered, left_weight[cut], right_weight, X[cut], Y)


def _batches(emit: Emit | OverTile, found: Iterator[Strip], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for out in [emit.emit(found)] if isinstance(emit, OverTile) else map(emit, found):
        arrays = [pa.array(out[f.name], type=f.type) for f in schema]
        if len(arrays[0]):
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _evaluator(kernel: Kernel, epsilon: float, triangle: bool, emit: Emit | OverTile, schema: pa.Schema):
    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        if table.num_rows == 0:
            return
        left = table.filter(table["is_left"])
        right = table.filter(pa.compute.invert(table["is_left"]))
        if left.num_rows == 0 or right.num_rows == 0:
            return
        one_tile = triangle and table["a_tile"][0] == table["b_tile"][0]
        found = _strips(kernel, epsilon, _side(left), _side(right), np.less if one_tile else None)
        yield from _batches(emit, found, schema)

    return evaluate


class TileFiles:
    """Tiles of one cell, each read when it is asked for; the last one of either side is kept."""

    def __init__(self, files: dict[int, list[str]]):
        self.files, self.held = files, {}

    def __call__(self, side: str, tile: int) -> Side:
        if self.held.get(side, (None,))[0] != tile:
            parts = []
            for uri in self.files[tile]:
                system, path = locate(uri)
                with system.open_input_file(path) as file:
                    parts.append(pq.read_table(file, columns=["id", "x", "weight"]))
            self.held[side] = tile, _side(pa.concat_tables(parts))
        return self.held[side][1]


def _write_tiles(placed: DataFrame, tile: Column, tiles: int) -> dict[int, list[str]]:
    """The files of every tile of (id, x, weight) rows, written below the shared folder."""
    spark = placed.sparkSession
    path = scratch_table(spark, "tiles")
    dealt = placed.select(tile.alias("tile"), "id", "x", "weight").repartition(tiles, "tile")
    dealt.write.partitionBy("tile").parquet(path)
    files: dict[int, list[str]] = {}
    for uri in spark.read.schema(dealt.schema).parquet(path).inputFiles():
        files.setdefault(int(uri.rsplit("/", 2)[1].removeprefix("tile=")), []).append(uri)
    return files


def _from_files(
    placed: DataFrame, tile: Column, own: int, others: int, kernel: Kernel, epsilon: float, emit: Emit | OverTile,
    schema: str, arrow_schema: pa.Schema, triangle: bool, least: int,
) -> DataFrame:
    """The groups of one cell, whose tasks read their tiles. Guests are numbered behind the homes; ``least`` is the
    number of tasks that have something to do at least."""
    spark = placed.sparkSession
    files = _write_tiles(placed, F.when(F.col("guest"), own + tile).otherwise(tile), own + others)
    column = emit.column if isinstance(emit, OverTile) and not (triangle and others) else None
    # A group is a right tile with a run of left tiles; without column sums it is a pair.
    first_right = 0 if triangle else own
    if column is not None:
        # Every row of a table that meets itself is right of all others: twice the kernel values, one sum a row and run.
        rights = range(first_right, own + others)
        runs = max(math.ceil(own / RUN_TILES), min(own, math.ceil(min(least, 3 * spark.sparkContext.defaultParallelism) / len(rights))))
        groups = [(b, own * k // runs, own * (k + 1) // runs) for b in rights for k in range(runs)]
    else:
        groups = [(b, a, a + 1) for b in range(first_right, own + others) for a in range(min(b + 1, own) if triangle else own)]
    table = np.array(groups, np.int32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = TileFiles(files)
        prepared: list = [None, None]
        for batch in batches:
            for b, first, end in table[batch.column(0).to_numpy()].tolist():
                # A hash may leave a tile without rows.
                lefts = [a for a in range(first, end) if a in files]
                if b not in files or not lefts:
                    continue
                right = read("right", b)
                if prepared[0] != b:
                    prepared[:] = b, kernel.against(right[1], epsilon)
                orders = [(np.less if column is None else np.not_equal) if triangle and a == b else None for a in lefts]
                met = ((read("left", a), order) for a, order in zip(lefts, orders))
                found = (s for left, order in met for s in _strips(kernel, epsilon, left, right, order, prepared[1]))
                yield from _batches(emit if column is None else OverTile(column), found, arrow_schema)

    return spark.range(0, len(groups), 1, max(1, min(len(groups), least))).mapInArrow(work, schema)


def _extent(*frames: DataFrame) -> list[tuple[int, int]]:
    """(rows, length of the vectors) of each table; vectors of several lengths are refused by name."""
    size = F.size("x")
    found = [
        df.agg(F.count(F.lit(1)), F.min(size), F.max(size), F.min_by("id", size), F.max_by("id", size)).first() for df in frames
    ]
    known = [f for f in found if f[0]]
    if known:
        short, long = min(known, key=lambda f: f[1]), max(known, key=lambda f: f[2])
        if short[1] != long[2]:
            raise ValueError(f"vectors of different length: row {short[3]} has {short[1]} components, row {long[4]} has {long[2]}")
    return [(f[0], f[2] or 1) for f in found]


def tile_join(
    left: DataFrame,
    right: DataFrame | None,
    kernel: Kernel,
    epsilon: float,
    emit: Emit | OverTile,
    schema: str,
    arrow_schema: pa.Schema,
    tile_rows: int | None = None,
    prune: bool | None = None,
    group: str | None = None,
    leaf_rows: int | None = None,
    radius: float | None = None,
    weights: int = 1,
) -> DataFrame:
    """Run ``emit`` on every strip of every tile pair.

    left, right: (id BIGINT, x ARRAY<DOUBLE>[, weight DOUBLE or ARRAY<DOUBLE> of one length]). ``right=None`` pairs the left table
    with itself, each unordered pair once. A row whose vector is NULL or holds a NULL has no pairs;
    vectors of different length are an error that names two rows.
    ``tile_rows`` is the most rows of a tile's side, TILE_ROWS and TILE_BYTES of vectors by default. ``group`` names an integer column;
    rows then meet only inside equal groups. Otherwise a tree cuts cells of more than ``leaf_rows``
    rows, for kernels that bound the distance (``radius`` gives a bound of one's own, beyond which
    pairs need not be seen): ``prune=False`` has none, ``prune=True`` cuts small tables too. ``weights`` is the length of the
    weight arrays.
    """
    triangle = right is None
    spark = left.sparkSession
    columns = ["id", "x", "weight"] + ([group] if group else [])

    def prepared(df: DataFrame) -> DataFrame:
        if "weight" not in df.columns:
            df = df.withColumn("weight", F.lit(1.0))
        return df.select(*columns).where(has_vector("x"))

    left = prepared(left)
    sides = [left] if triangle else [left, prepared(right)]
    extents = _extent(*sides)
    (n_left, width), n_right = extents[0], extents[-1][0]
    if not n_left or not n_right:
        return spark.createDataFrame([], schema)
    tile_rows = tile_rows or max(64, min(TILE_ROWS, TILE_BYTES // (8 * width)))
    if radius is None:
        radius = kernel.radius(epsilon)
    leaf_rows = leaf_rows or (SMALL_LEAF_ROWS if prune else LEAF_ROWS)
    one_cell = False
    if group:
        parts = [d.select(F.col(group).alias("cell"), F.lit(k > 0).alias("guest"), "id", "x", "weight") for k, d in enumerate(sides)]
    elif prune is not False and radius is not None and n_left > leaf_rows:
        chunk_rows = max(1024, min(CHUNK_ROWS, CHUNK_BYTES // (8 * (width + weights - 1))))
        parts = [partition(left, None if triangle else sides[1], radius, width, leaf_rows, chunk_rows=chunk_rows)]
    else:
        one_cell = True
        parts = [d.select(F.lit(0).alias("cell"), F.lit(k > 0).alias("guest"), "id", "x", "weight") for k, d in enumerate(sides)]
    placed = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])

    cores = spark.sparkContext.defaultParallelism
    guests_of_one = 0 if triangle else n_right
    if one_cell:
        n_cells, cells = 1, None
    else:
        # Groups of the caller and cells of the tree are a table, however many there are.
        counted = placed.groupBy("cell").agg(F.count_if(~F.col("guest")).alias("home"), F.count_if("guest").alias("guests"))
        cells = settle(counted.where("home > 0" if triangle else "home > 0 AND guests > 0"))
        n_cells = cells.count()
        if not n_cells:
            return spark.createDataFrame([], schema)
    # Few cells are cut finer, so that every core has something to do.
    spread = math.ceil(math.sqrt(2 * cores / n_cells))

    def tiles(rows: Column) -> Column:
        return F.greatest(F.ceil(rows / tile_rows), F.least(F.lit(spread), F.ceil(rows / 64))).cast("int")

    lists = [tiles(F.col("home")).alias("own"), tiles(F.col("guests")).alias("others")]
    if one_cell:
        cells = spark.range(1).select(F.lit(0).alias("cell"), F.lit(n_left).alias("home"), F.lit(guests_of_one).alias("guests"))
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n_cells == 1:
        (own, others, homes, guests), = cells.select(*lists, "home", "guests").collect()
        if (own + others + 1 if triangle else max(own, others)) > MOST_COPIES:
            # The cell of the tree may be without some of the rows, but it has all that meet.
            inside = placed if one_cell else placed.join(F.broadcast(cells.select("cell")), "cell", "left_semi")
            tile = F.pmod(F.xxhash64("id"), F.when(F.col("guest"), others).otherwise(own)).cast("int")
            row_pairs = homes * guests + (homes * homes // 2 if triangle else 0)
            least = max(shuffle, 3 * cores, row_pairs // TASK_PAIRS)
            return _from_files(inside, tile, own, others, kernel, epsilon, emit, schema, arrow_schema, triangle, least)
    if one_cell:
        planned = placed.select("*", F.lit(own).alias("own"), F.lit(others).alias("others"))
        tile_pairs = own * others + (own * (own + 1) // 2 if triangle else 0)
        row_pairs = n_left * n_left // 2 if triangle else n_left * n_right
    else:
        plan = cells.select("cell", *lists)
        inside = F.col("own") * (F.col("own") + 1) / 2 if triangle else F.lit(0)
        homes = F.col("home").cast("double")
        work = homes * F.col("guests") + (homes * homes / 2 if triangle else 0)
        tile_pairs = int(plan.agg(F.sum(F.col("own") * F.col("others") + inside)).first()[0])
        row_pairs = int(cells.agg(F.sum(work)).first()[0])
        planned = keyed_join(placed, plan, ["cell"], right_rows=n_cells, right_width=2)
    tile = F.pmod(F.xxhash64("id"), F.when(F.col("guest"), F.col("others")).otherwise(F.col("own"))).cast("int")

    def meet(a: str, b: str, is_left: str, name: str, first: str, last: str) -> str:
        pair = f"named_struct('a_tile', int({a}), 'b_tile', int({b}), 'is_left', {is_left})"
        return f"transform(sequence({first}, {last}), {name} -> {pair})"

    if triangle:
        # A home is left of its own and later tiles and of all guests, and right of earlier tiles and its own.
        later, earlier = meet("tile", "t", "true", "t", "tile", "own + others - 1"), meet("t", "tile", "false", "t", "0", "tile")
        home, visit = f"concat({later}, {earlier})", meet("t", "own + tile", "false", "t", "0", "own - 1")
    else:
        home, visit = meet("tile", "t", "true", "t", "0", "others - 1"), meet("t", "tile", "false", "t", "0", "own - 1")
    met = F.explode(F.expr(f"if(guest, {visit}, {home})"))
    copies = planned.withColumn("tile", tile).select("cell", met.alias("met"), "id", "x", "weight")
    copies = copies.select("cell", "met.a_tile", "met.b_tile", "met.is_left", "id", "x", "weight")
    partitions = max(1, min(tile_pairs, max(shuffle, 3 * cores, tile_pairs // 32, row_pairs // TASK_PAIRS)))
    evaluate = _evaluator(kernel, epsilon, triangle, emit, arrow_schema)
    return copies.repartition(partitions, *_KEYS).groupBy(*_KEYS).applyInArrow(evaluate, schema)


def emit_pairs(triangle: bool) -> Emit:
    def emit(s: Strip) -> dict[str, np.ndarray]:
        i, j = np.nonzero(s.keep)
        a, b = s.left_id[i], s.right_id[j]
        if triangle:
            a, b = np.minimum(a, b), np.maximum(a, b)
        return {"i": a, "j": b, "k": s.values[i, j]}

    return emit


def emit_signed(triangle: bool, signed_filter: bool) -> Emit:
    """The kernel value times both weights (class labels)."""

    def emit(s: Strip) -> dict[str, np.ndarray]:
        i, j = np.nonzero(s.keep)
        a, b = s.left_id[i], s.right_id[j]
        value = s.left_weight[i] * s.right_weight[j] * s.values[i, j]
        if signed_filter:
            positive = s.left_weight[i] * s.right_weight[j] > 0
            a, b, value = a[positive], b[positive], value[positive]
        if triangle:
            a, b = np.minimum(a, b), np.maximum(a, b)
        return {"i": a, "j": b, "k": value}

    return emit


def emit_counts(s: Strip) -> dict[str, np.ndarray]:
    return {"n_considered": np.array([s.considered.sum()]), "n_kept": np.array([s.keep.sum()])}


def emit_adjacency(segment_ids: int) -> OverTile:
    """(i, segment, columns): the partners of every row of a pair of tiles, by segments of at most 65,536 ids; a column is
    its place in the segment, moved into 16 bits."""

    def emit(strips: Iterator[Strip]) -> dict[str, np.ndarray]:
        lefts, keeps, right = [], [], None
        for s in strips:
            lefts.append(s.left_id)
            keeps.append(s.keep)
            right = s.right_id
        left, keep = np.concatenate(lefts), np.concatenate(keeps)
        rows, segments, sizes, columns = [], [], [], []
        for ids, others, mask in ((left, right, keep), (right, left, keep.T)):
            order = np.argsort(others)
            segment, place = np.divmod(others[order], segment_ids)
            place = (place - (1 << 15)).astype(np.int16)
            for start in range(0, len(ids), STRIP_ROWS):
                i, j = np.nonzero(mask[start : start + STRIP_ROWS][:, order])
                if len(i):
                    first = np.flatnonzero(np.append(True, (np.diff(i) != 0) | (np.diff(segment[j]) != 0)))
                    rows.append(ids[start + i[first]])
                    segments.append(segment[j[first]])
                    sizes.append(np.diff(np.append(first, len(i))))
                    columns.append(place[j])
        if not rows:
            return {"i": np.zeros(0, np.int64), "segment": np.zeros(0, np.int64), "columns": pa.array([], pa.list_(pa.int16()))}
        ends = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(columns)))
        return {"i": np.concatenate(rows), "segment": np.concatenate(segments), "columns": listed}

    return OverTile(emit)


def emit_bins(
    form: DistanceForm, shift: int, upto: float, prefixes: dict[int, list[int]] | None = None, above: float = 0.0
) -> Emit:
    """Counts of the leading bits, without the last ``shift``, of the values that are at most ``upto``;
    the order of bits is that of non-negative numbers. ``prefixes`` (old shift -> wanted leading bits) picks the
    values to count. Values below ``above`` are counted together, in bin -1. Values come from the direct formula,
    so they don't depend on who shares a tile.
    """
    reach = form.distance(upto) ** 2 * (1 + 1e-6)
    floor = int(np.float64(above).view(np.int64))
    last: list = [None, None]

    def squares(X: np.ndarray) -> np.ndarray:
        return (X * X).sum(axis=1)

    def emit(s: Strip) -> dict[str, np.ndarray]:
        with np.errstate(over="ignore", invalid="ignore"):
            # The product form may be off by this much.
            if last[0] is not s.right_x:
                last[:] = s.right_x, 1e-10 * squares(s.right_x)
            own, others = 1e-10 * squares(s.left_x), last[1]
            # First by the largest room of the strip, one comparison a pair, then by that of the pair.
            furthest = form.value(math.sqrt(reach + own.max() + others.max()))
            i, j = np.nonzero(s.keep & (s.values <= furthest) if math.isfinite(furthest) else s.keep)
        parts = [np.zeros(0, np.int64)]
        for k in range(0, len(i), STRIP_CELLS // 16):
            a, b = i[k : k + STRIP_CELLS // 16], j[k : k + STRIP_CELLS // 16]
            with np.errstate(over="ignore", invalid="ignore"):
                room = own[a] + others[b]
                near = (form.distance(s.values[a, b]) ** 2 <= reach + room) | ~np.isfinite(room)
                a, b = a[near], b[near]
                values = form.rows(s.left_x[a], s.right_x[b])
            bits = values[values <= upto].view(np.int64)
            for old, wanted in (prefixes or {}).items():
                bits = bits[np.isin(bits >> old, wanted)]
            parts.append(np.where(bits < floor, -1, bits >> shift))
        found, n = np.unique(np.concatenate(parts), return_counts=True)
        return {"bin": found, "n": n}

    return emit


def emit_scores(s: Strip) -> dict[str, np.ndarray]:
    """Partial score of every right row: sum of left weight times kernel."""
    K = np.where(s.keep, s.values, 0.0)
    return {"id": s.right_id, "score": s.left_weight @ K}


def _both_ways(keep: np.ndarray, K: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the kept pairs: of kernel times right weights per left row, of kernel times left weights per right row."""
    kept = np.where(keep, K, 0.0)
    with np.errstate(invalid="ignore", over="ignore"):
        sums = kept @ right, kept.T @ left
    if all(np.isfinite(s).all() for s in sums):
        return sums
    # A zero weight takes no part, whatever the kernel value, nor does a pair that is not kept, whatever its weights.
    i, j = np.nonzero(keep)
    sums = np.zeros(sums[0].shape), np.zeros(sums[1].shape)
    for own, other, weights, total in ((i, j, right, sums[0]), (j, i, left, sums[1])):
        with np.errstate(invalid="ignore", over="ignore"):
            np.add.at(total, own, np.where(weights[other] != 0, K[i, j][:, None] * weights[other], 0.0))
    return sums


def emit_column_sums(strips: Iterator[Strip]) -> dict[str, np.ndarray]:
    """(id, sums) of the right rows alone: kernel times the left rows' weights."""
    right_id, sums = None, 0.0
    for s in strips:
        with np.errstate(invalid="ignore", over="ignore"):
            part = np.where(s.keep, s.values, 0.0).T @ s.left_weight
        if not np.isfinite(part).all():
            part = _both_ways(s.keep, s.values, s.left_weight, np.zeros((len(s.right_id), part.shape[1])))[1]
        right_id, sums = s.right_id, sums + part
    listed = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), sums.shape[1]).cast(pa.list_(pa.float64()))
    return {"id": right_id, "sums": listed}


def emit_weighted_sums(strips: Iterator[Strip]) -> dict[str, np.ndarray]:
    """(id, sums) of the rows of both tiles: kernel times the partner's weights over the pairs of these tiles."""
    left_ids, left_sums, right_id, right_sums = [], [], None, 0.0
    for s in strips:
        own, others = _both_ways(s.keep, s.values, s.left_weight, s.right_weight)
        left_ids.append(s.left_id)
        left_sums.append(own)
        right_id, right_sums = s.right_id, right_sums + others
    sums = np.concatenate([*left_sums, right_sums])
    listed = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), sums.shape[1]).cast(pa.list_(pa.float64()))
    return {"id": np.concatenate([*left_ids, right_id]), "sums": listed}
