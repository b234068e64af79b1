"""Vector code compression: product codes whose nearest entries are found by Orchard's search.

A vector of integers is cut into equal parts, each with a codebook of its own. Per entry of a
codebook there is a list of all entries by distance from it. A search stands at its best entry so
far and goes down that entry's list, a segment at a time; entries it has visited are marked and not
looked at again. When a segment holds a nearer entry, the search goes on with that entry's list; it
ends where the list is more than twice as far from the entry as the vector is, as the triangle
inequality leaves nothing nearer beyond. Vectors that stand at the same place of the same list take
their next segment together. Of entries at one distance the lower index wins.

Each round is one pass over the table: tasks send sums and counts per entry, at most parts x entries
rows each, and only those totals reach the driver (parts x entries x width numbers, no matter how
many vectors). The last pass is written once, then errors are summed by label.

Arithmetic is exact: products of numbers below 2^53 in floating point, else whole numbers of any size. Components beyond
2^62 count as 2^62, sums of errors beyond 2^63 - 1 as that.

Defined results. A vector that is NULL, holds NULL, NaN or infinity, or has another length than that of
the least id (which must be a multiple of the number of parts) is left out. NULL ids come last. Vectors of one id
are taken in the order of their components; repeated rows each get a code, and repeated vectors are repeated entries, of
which the first is used. With fewer vectors than entries the codebook is smaller. Labels of NULL belong together. Only the
three columns named are read, so others don't clash. An empty table gives an empty result.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginwise.session import stored
from marginwise.operators.joins import fits_broadcast, keyed_join

# Vectors searched together, and entries of a list looked at together.
BLOCK_ROWS = 1 << 16
SEGMENT = 128
SPAN = 1 << 62
EXACT = 1 << 53
LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Codebook:
    """Entries of one part, their squared distances, and per entry all entries by distance from it."""

    entries: np.ndarray
    apart: np.ndarray
    order: np.ndarray
    sorted_apart: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(entries: list[list[int]]) -> "Codebook":
        E = whole_numbers(entries)
        apart = np.stack([_squared(E, e) for e in E])
        # Copies of an entry come in order of their index, as the sort is stable.
        order = np.argsort(apart, axis=1, kind="stable")
        # Where searches begin: some entries far from one another.
        starts, far = [0], apart[0]
        while len(starts) < len(E) // 16 and far.max() > 0:
            starts.append(int(far.argmax()))
            far = np.minimum(far, apart[starts[-1]])
        return Codebook(E, apart, order, np.take_along_axis(apart, order, 1), np.array(sorted(starts)))


def whole_numbers(rows) -> np.ndarray:
    """A matrix of integers: as float64 while all squared distances are exact in it, else as objects."""
    exact = np.array(rows, dtype=object)
    largest = max((abs(v) for v in exact.ravel()), default=0)
    return exact.astype(np.float64) if _fits(largest, exact.shape[-1]) else exact


def _fits(largest: int, width: int) -> bool:
    return 8 * width * int(largest) ** 2 < EXACT


def _squared(X: np.ndarray, e: np.ndarray) -> np.ndarray:
    D = X - e
    return (D * D).sum(axis=-1)


def search(X: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, int]:
    """Per row of X the nearest entry and its squared distance, and how many distances that took."""
    E = book.entries
    if X.dtype != E.dtype:
        X, E = X.astype(object), E.astype(object)
    n, m = len(X), len(E)
    rows = np.arange(n)
    own, sizes = (X * X).sum(axis=1), (E * E).sum(axis=1)

    def distances(r: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return own[r, None] + sizes[columns][None, :] - 2 * (X[r] @ E[columns].T)

    first = distances(rows, book.starts)
    k = np.argmin(first, axis=1)
    at, best = book.starts[k], first[rows, k]
    visited = np.zeros((n, m), bool)
    visited[:, book.starts] = True
    place = np.zeros(n, np.int64)
    looked = n * len(book.starts)
    active = rows
    segments = -(-m // SEGMENT)
    while len(active):
        group = at[active] * segments + place[active]
        order = np.argsort(group, kind="stable")
        active, group = active[order], group[order]
        cuts = np.flatnonzero(np.diff(group)) + 1
        going = []
        for r in np.split(active, cuts):
            c, begin = at[r[0]], place[r[0]] * SEGMENT
            apart = book.sorted_apart[c, begin : begin + SEGMENT]
            # d(c, e) > 2 d(x, c) rules e out, here in squares.
            r = r[apart[0] <= 4 * best[r]]
            if not len(r):
                continue
            some = book.order[c, begin : begin + SEGMENT]
            fresh = ~visited[np.ix_(r, some)] & (apart[None, :] <= 4 * best[r, None])
            wanted = fresh.any(axis=0)
            some, fresh = some[wanted], fresh[:, wanted]
            place[r] += 1
            if len(some):
                looked += int(fresh.sum())
                D = distances(r, some)
                visited[np.ix_(r, some)] |= fresh
                # Of equal distances the lower index: columns in order of their index, the first least one.
                by_index = np.argsort(some)
                D = np.where(fresh, D, np.inf)[:, by_index]
                k = np.argmin(D, axis=1)
                near, entry = D[np.arange(len(r)), k], some[by_index][k]
                better = (near < best[r]) | ((near == best[r]) & (entry < at[r]))
                moved = r[better]
                at[moved], best[moved], place[moved] = entry[better], near[better], 0
            going.append(r[place[r] < segments])
        active = np.concatenate(going) if going else rows[:0]
    return at, best, looked


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x) of every component."""
    scaled = np.floor(1024.0 * vectors)
    if not scaled.size or _fits(int(min(np.abs(scaled).max(), SPAN)), max(1, scaled.shape[1])):
        return scaled
    return np.array([[max(-SPAN, min(SPAN, int(v))) for v in row] for row in scaled], dtype=object)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of a task in tables of about BLOCK_ROWS."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _vectors(table: pa.Table) -> np.ndarray:
    flat = table.column("vector").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return integers(values.reshape(table.num_rows, -1))


def _of_part(X: np.ndarray, part: int, width: int) -> np.ndarray:
    return X[:, part * width : (part + 1) * width]


def finite_vector(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~bad


def _means(rows: DataFrame, books: list[Codebook], width: int) -> dict[tuple[int, int], list[int]]:
    """(part, entry) -> mean of its vectors, rounded down, of entries that have any."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}
        for table in _blocks(batches):
            X = _vectors(table)
            for p, book in enumerate(books):
                part = _of_part(X, p, width)
                at, _, _ = search(part, book)
                order = np.argsort(at, kind="stable")
                cuts = np.flatnonzero(np.diff(at[order])) + 1
                for r in np.split(order, cuts):
                    own = totals.setdefault((p, int(at[r[0]])), [0, [0] * width])
                    own[0] += len(r)
                    own[1] = [a + int(b) for a, b in zip(own[1], part[r].sum(axis=0))]
        if totals:
            keys = list(totals)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.int32()),
                    pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([totals[k][0] for k in keys], pa.int64()),
                    pa.array([[str(v) for v in totals[k][1]] for k in keys], pa.list_(pa.string())),
                ],
                names=["part", "entry", "n", "sums"],
            )

    found = rows.select("vector").mapInArrow(sums, "part int, entry int, n bigint, sums array<string>")
    each = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each)
    return {(r["part"], r["entry"]): [int(r[f"s{k}"]) // r["n"] for k in range(width)] for r in total.collect()}


@dataclass(frozen=True)
class Trained:
    """Codebooks as whole numbers: entries[part][entry][position]."""

    entries: list[list[list[int]]]
    dimensions: int

    def digest(self) -> str:
        numbers = (str(v) for part in self.entries for entry in part for v in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def books(self) -> list[Codebook]:
        return [Codebook.of(part) for part in self.entries]


def usable(df: DataFrame, key: str, vector: str, label: str, parts: int) -> tuple[DataFrame, int]:
    """(id, label, vector) of the rows that take part, and the length of their vectors."""
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(finite_vector(F.col("vector")))
    fitting = (F.size("vector") > 0) & (F.size("vector") % parts == 0)
    first = rows.where(fitting).orderBy(F.asc_nulls_last("id"), "vector").select(F.size("vector")).first()
    dimensions = first[0] if first else parts
    return rows.where(F.size("vector") == dimensions), dimensions


def train(rows: DataFrame, dimensions: int, parts: int, entries: int, rounds: int) -> Trained:
    """Codebooks that begin with the vectors of the least ids and move to the means of their vectors."""
    width = dimensions // parts
    seeds = rows.orderBy(F.asc_nulls_last("id"), "vector").select("vector").limit(entries).collect()
    found = []
    if seeds:
        whole = [[int(v) for v in row] for row in integers(np.array([r["vector"] for r in seeds], float))]
        found = [[row[p * width : (p + 1) * width] for row in whole] for p in range(parts)]
    for _ in range(rounds if seeds else 0):
        means = _means(rows, Trained(found, dimensions).books(), width)
        found = [[means.get((p, e), old) for e, old in enumerate(part)] for p, part in enumerate(found)]
    return Trained(found, dimensions)


def encode(rows: DataFrame, model: Trained) -> DataFrame:
    """(id, label, code, error, looked): two hex digits per part, the squared distance, distances computed."""
    books = model.books()
    schema = rows.select("id", "label").schema.add("code", "string").add("error", "long").add("looked", "long")
    digits = max(2, len(f"{max((len(p) for p in model.entries), default=1) - 1:x}"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            X = _vectors(table)
            width = model.dimensions // max(1, len(books))
            found = [search(_of_part(X, p, width), book) for p, book in enumerate(books)]
            codes = ["".join(f"{c:0{digits}x}" for c in row) for row in zip(*[at.tolist() for at, _, _ in found])]
            errors = [min(LONGEST, sum(map(int, e))) for e in zip(*[best.tolist() for _, best, _ in found])]
            looked = np.full(len(codes), sum(n for _, _, n in found) // len(codes), np.int64)
            sides = [table.column(c).combine_chunks() for c in ("id", "label")]
            sides = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in sides]
            columns = [*sides, pa.array(codes, pa.string()), pa.array(errors, pa.int64()), pa.array(looked)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(assign, schema)


def compress(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256, looked) of every usable vector."""
    rows, dimensions = usable(df, key, vector, label, parts)
    model = train(rows, dimensions, parts, entries, rounds)
    named = F.concat(F.lit("="), F.col("label").cast("string"))
    coded = stored(encode(rows, model).withColumn("name", F.coalesce(named, F.lit(""))), "vector-codes")
    totals = coded.groupBy("name").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    label_error = F.least("total", F.lit(LONGEST).cast("decimal(38,0)")).cast("bigint")
    totals = stored(totals.select("name", label_error.alias("label_error")), "label-errors")
    both = keyed_join(coded, totals, ["name"], right_rows=totals.count(), right_width=4)
    return both.select("id", "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"), "looked")
