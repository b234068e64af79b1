"""SimHash near-duplicates by tiled exact comparison.

Texts with one fingerprint form a class, so copies of a text cost one row however many they are.
Two fingerprints that differ in at most r bits agree on at least one of r + 1 groups of bits; those
that share a group of bits form a bucket, and every two of a bucket are compared. Buckets are dealt
into square tiles. A tile is one exclusive-or and bit count in numpy, with rows in order of their
population count: blocks whose counts differ beyond the radius cannot hold a link and are skipped.
Every link is found: neither buckets nor partners have a cap, crowded buckets just get more tiles.
From a tile leaves a spanning forest of its links, which has the same components as all of them.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginwise.llm.components import components
from marginwise.session import stored

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
SEED = 42
TILE_ROWS = 4096
BLOCK = 256


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of the word shingles of a text; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fingerprint) per row; the fingerprint's 64 bits as a bigint."""
    schema = pa.schema([pa.field("fingerprint", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values.view(np.int64))], names=["id", schema.field(0).name]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint bigint")


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each node's component among nodes 0..n-1."""
    parent = np.arange(n)
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            break
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
    return parent


def tile_forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of a tile as (value, least value of its component in the tile)."""
    values = values[np.argsort(np.bitwise_count(values), kind="stable")]
    count = np.bitwise_count(values).astype(np.int64)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(values), BLOCK):
        one = values[i : i + BLOCK]
        for j in range(i, len(values), BLOCK):
            if count[j] - count[i + len(one) - 1] > radius:
                break
            two = values[j : j + BLOCK]
            near = np.bitwise_count(one[:, None] ^ two[None, :]) <= radius
            x, y = np.nonzero(np.triu(near, 1) if i == j else near)
            if len(x):
                # The links of a block pair are reduced at once, so dense groups stay small.
                index = np.concatenate([np.arange(i, i + len(one)), np.arange(j, j + len(two))])
                local = roots_of(x, y + len(one) if i != j else y, len(index))
                moved = np.flatnonzero(local != np.arange(len(index)))
                a.append(index[moved])
                b.append(index[local[moved]])
    roots = roots_of(np.concatenate(a), np.concatenate(b), len(values))
    moved = roots != np.arange(len(values))
    return values[moved], values[roots[moved]]


def small_forest(tile: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many small tiles, rows in order of tile: neighbours at distance 1, 2, ... at once."""
    a, b, rows, step = [], [], np.arange(len(values)), 1
    while True:
        rows = rows[rows + step < len(values)]
        rows = rows[tile[rows] == tile[rows + step]]
        if not len(rows):
            break
        near = rows[np.bitwise_count(values[rows] ^ values[rows + step]) <= radius]
        a.append(near)
        b.append(near + step)
        step += 1
    roots = roots_of(np.concatenate(a), np.concatenate(b), len(values)) if a else rows
    moved = np.flatnonzero(roots != np.arange(len(roots)))
    return values[moved], values[roots[moved]]


def tile_links(tile: np.ndarray, values: np.ndarray, radius: int, small: int = 48) -> pa.RecordBatch:
    """Links (a, b) of whole tiles."""
    edges = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1], [True])))
    sizes = np.diff(edges)
    few = np.repeat(sizes <= small, sizes)
    found = [small_forest(tile[few], values[few], radius)]
    found += [tile_forest(values[s : s + n], radius) for s, n in zip(edges[:-1], sizes) if n > small]
    a, b = (np.concatenate(c).view(np.int64) for c in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of a partition of (tile, fingerprint) in order of tile; the last tile of a batch waits for the next."""
    tile, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        tile = np.concatenate([tile, batch.column(0).to_numpy()])
        values = np.concatenate([values, batch.column(1).to_numpy().view(np.uint64)])
        cut = int(np.searchsorted(tile, tile[-1])) if len(tile) else 0
        if cut:
            yield tile_links(tile[:cut], values[:cut], radius)
            tile, values = tile[cut:], values[cut:]
    if len(tile):
        yield tile_links(tile, values, radius)


def bit_groups(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 1 groups of the 64 bits."""
    bounds = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(low, (1 << (high - low)) - 1) for low, high in zip(bounds, bounds[1:])]


def links(classes: DataFrame, radius: int = 4, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) that join all fingerprints within ``radius`` bits, directly or by way of others."""
    value = F.col("fingerprint")
    keys = F.array(
        *[
            F.struct(F.lit(k).alias("part"), F.shiftrightunsigned(value, low).bitwiseAND(F.lit(mask)).alias("bits"))
            for k, (low, mask) in enumerate(bit_groups(radius))
        ]
    )
    rows = classes.select("fingerprint", F.explode(keys).alias("key")).select("fingerprint", "key.part", "key.bits")
    # One row per crowded bucket: at most (radius + 1) * rows / tile_rows of them.
    crowded = rows.groupBy("part", "bits").count().where(F.col("count") > tile_rows)
    rows = rows.join(crowded, ["part", "bits"], "left")
    slices = F.ceil(F.coalesce("count", F.lit(1)) / tile_rows).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), slices).cast("int")
    others = F.filter(F.sequence(F.lit(0), slices - 1), lambda t: (slices == 1) | (t != own))
    tiles = rows.select("part", "bits", "fingerprint", own.alias("own"), F.explode(others).alias("other")).select(
        F.xxhash64("part", "bits", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "fingerprint"
    )
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(n, "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(lambda batches: compare(batches, radius), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    radius: int = 4,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(id, fingerprint, component_id) per row: the smallest id that links of ``radius`` bits reach.

    NULL and empty texts have fingerprint zero and are linked like any other. Rows with a repeated id
    stay rows of their own; rows with a NULL id take part, and a component of such rows alone has a
    NULL component_id. Other columns are not read. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stored(prints.groupBy("fingerprint").agg(F.min("id").alias("least")), "classes")
    found = components(links(classes, radius, tile_rows)).withColumnRenamed("id", "fingerprint")
    # Classes without a link are their own component.
    rooted = stored(
        classes.join(found, "fingerprint", "left").withColumn("root", F.coalesce("component", "fingerprint")), "rooted"
    )
    named = stored(
        rooted.select("fingerprint", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root"),
        "named",
    )
    return prints.join(named.select("fingerprint", "component_id"), "fingerprint").select(
        "id", "fingerprint", "component_id"
    )
