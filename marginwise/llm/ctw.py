"""Language-model scores by context-tree weighting.

A text is read byte by byte after A-Z are put in lower case, each byte as eight binary decisions, and
a byte that UTF-8 never uses ends it. For each context of up to ``depth`` bytes and each node of the
byte's binary tree the counts of zeros and ones make a Krichevsky-Trofimov estimate, and the weighted
mixture over all depths gives the probability of the next bit. The tree is learnt from the training
texts and then kept fixed, so a text's score does not depend on the other texts to be scored.

What has to meet, meets by key. The texts are written as blocks. Each block counts its own byte
strings and words; counts of one string are summed over the blocks; the tree is computed on ranges
of contexts with the same last two bytes; and every block gets back the values of just the strings
it holds. A task holds a block, its dictionary, or the contexts behind two bytes. Only the first two
levels of the tree, at most 65,280 nodes however large the corpus, pass through the driver.

Edge cases: a NULL or empty text has no words and scores its end alone; repeated rows are texts of
their own; a NULL id counts as the empty text when the folds are drawn; without training texts every
bit has probability one half; an empty table gives an empty result.
"""

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marginwise.llm import files
from marginwise.llm.text import whole
from marginwise.session import scratch_table, stored

DEPTH = 5
EDGE = b"\xff"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CHUNK_BYTES = 1_000_000
BLOCK_ROWS = 50_000
TABLE_CELLS = 8_000_000
LOG_HALF = math.log(0.5)


# Blocks and their strings


def lowered(text: str | None) -> bytes:
    return (text or "").encode().translate(LOWER)


def block_texts(folder: str, block: int) -> Iterator[tuple[object, bool, str]]:
    """(id, train, text) of the rows of a block."""
    system, path = files.locate(f"{folder}/block={block}")
    for info in sorted(system.get_file_info(files.fs.FileSelector(path)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                for batch in pq.ParquetFile(file).iter_batches(512, columns=["id", "train", "text"]):
                    yield from zip(*(c.to_pylist() for c in batch.columns))


def grams(texts: list[bytes], depth: int) -> np.ndarray:
    """For each byte and the end of each text, in order: the bytes before it, the last one first, and itself."""
    data = np.frombuffer(EDGE * depth + (EDGE + EDGE * depth).join(texts) + EDGE, np.uint8).astype(np.uint64)
    key = np.zeros(len(data) - depth, np.uint64)
    for back in range(1, depth + 1):
        key = (key << np.uint64(8)) | data[depth - back : len(data) - back]
    key = (key << np.uint64(8)) | data[depth:]
    # Between two texts stand the bytes of the next one's empty context.
    ends = np.cumsum([len(t) + 1 + depth for t in texts])[:-1]
    if len(ends):
        skip = (ends[:, None] - 1 - np.arange(depth)).ravel()
        keep = np.ones(len(key), bool)
        keep[skip] = False
        key = key[keep]
    return key


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def block_counts(folder: str, block: int, depth: int) -> Iterator[pa.RecordBatch]:
    """(gram, word, n): the strings of a block and their counts in its training texts, which may be zero."""
    words, other = Counter(), set()
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    held: dict[bool, list[bytes]] = {True: [], False: []}
    size = {True: 0, False: 0}

    def flush(train: bool) -> None:
        if held[train]:
            key, n = np.unique(grams(held[train], depth), return_counts=True)
            keys.append(key)
            counts.append(n if train else np.zeros_like(n))
            held[train], size[train] = [], 0
        if len(keys) > 8:
            keys[:], counts[:] = ([x] for x in summed(keys, counts))

    for _, train, text in block_texts(folder, block):
        data = lowered(text)
        words.update(data.split()) if train else other.update(data.split())
        held[train].append(data)
        size[train] += len(data)
        if size[train] > CHUNK_BYTES:
            flush(train)
    flush(True)
    flush(False)
    key, n = summed(keys, counts)
    names = ["block", "gram", "word", "n"]
    for i in range(0, len(key), 100_000):
        k, c = key[i : i + 100_000].view(np.int64), n[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block)), pa.array(k), pa.nulls(len(k), pa.binary()), pa.array(c)], names=names)
    words.update(dict.fromkeys(other - words.keys(), 0))
    del other
    rows = iter(words.items())
    while part := list(islice(rows, 100_000)):
        columns = [pa.array([block] * len(part)), pa.nulls(len(part), pa.int64()), pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part])]
        yield pa.RecordBatch.from_arrays(columns, names=names)


# The tree


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence."""
    shift = np.log(x)
    for k in range(1, 8):
        shift = shift + np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log-probability of so many zeros and ones under the Krichevsky-Trofimov estimate."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


class Level:
    """The nodes of one depth: context and place in the byte's tree -> counts, weight, mixture."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.node, self.zeros, self.ones = node, zeros, ones
        own = log_kt(zeros, ones)
        if below is None:
            self.mixture, self.stop = own, np.ones(len(own))
        else:
            self.mixture = LOG_HALF + np.logaddexp(own, below)
            self.stop = np.exp(LOG_HALF + own - self.mixture)
        self.estimate = (ones + 0.5) / (zeros + ones + 1.0)

    def mix(self, at: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """Probability of a one at the nodes ``at``, given that of the next depth."""
        own = self.estimate[at]
        return own if deeper is None else self.stop[at] * own + (1 - self.stop[at]) * deeper


def levels(key: np.ndarray, n: np.ndarray, depth: int, least: int) -> tuple[list[Level], list[np.ndarray]]:
    """Levels ``least`` to ``depth`` of sorted grams, and for each the node of every gram and bit."""
    byte = (key & np.uint64(255)).astype(np.int64)
    bit_at = np.arange(8)
    place = (1 << bit_at) | (byte[:, None] >> (8 - bit_at))
    bit = (byte[:, None] >> (7 - bit_at)) & 1
    ones = (bit * n[:, None]).ravel().astype(float)
    zeros = ((1 - bit) * n[:, None]).ravel().astype(float)
    found: dict[int, Level] = {}
    index: dict[int, np.ndarray] = {}
    for d in range(depth, least - 1, -1):
        context = (key >> np.uint64(8 * (depth - d + 1))).astype(np.int64)
        node, at = np.unique(((context << 8)[:, None] | place).ravel(), return_inverse=True)
        below = None
        if d < depth:
            child = found[d + 1]
            parent = np.searchsorted(node, (child.node >> 16 << 8) | (child.node & 255))
            below = np.bincount(parent, child.mixture, len(node))
        found[d] = Level(node, np.bincount(at, zeros, len(node)), np.bincount(at, ones, len(node)), below)
        index[d] = at
    order = range(least, depth + 1)
    return [found[d] for d in order], [index[d] for d in order]


def ranges(batches: Iterator[pa.RecordBatch], depth: int, rows: int = 200_000) -> Iterator[pa.Table]:
    """Sorted grams in pieces that hold whole groups of contexts with the same last two bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        group = table.column("gram").to_numpy() >> (8 * (depth - 1))
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def gram_values(counted: DataFrame, depth: int) -> DataFrame:
    """(block, gram, word, value): the log10-probability of each gram's last byte, for each block that holds it."""
    spark = counted.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = F.shiftright("gram", 8 * (depth - 1))
    whole_groups = counted.where("gram IS NOT NULL").repartition(n, group).sortWithinPartitions("gram")

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in ranges(batches, depth):
            (level, *_), _ = levels(table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy(), depth, 2)
            columns = [level.node >> 16 << 8 | level.node & 255, level.zeros, level.ones, level.mixture]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "zeros", "ones", "below"])

    summary = whole_groups.select("gram", "n").mapInArrow(top, "node bigint, zeros double, ones double, below double")
    rows = summary.groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).orderBy("node").collect()
    node, zeros, ones, below = (np.array(c) for c in zip(*rows)) if rows else (np.zeros(0, np.int64), *[np.zeros(0)] * 3)
    first = Level(node.astype(np.int64), zeros, ones, below)
    place, at = np.unique(first.node & 255, return_inverse=True)
    root = Level(place, *(np.bincount(at, c, len(place)) for c in (first.zeros, first.ones, first.mixture)))

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in ranges(batches, depth):
            key = table.column("gram").to_numpy().view(np.uint64)
            below, index = levels(key, table.column("n").to_numpy(), depth, 2)
            one = None
            for level, at in zip(reversed(below), reversed(index)):
                one = level.mix(at, one)
            byte = (key & np.uint64(255)).astype(np.int64)
            place = ((1 << np.arange(8)) | (byte[:, None] >> (8 - np.arange(8)))).ravel()
            last = np.repeat((key >> np.uint64(8 * depth)).astype(np.int64), 8)
            one = first.mix(np.searchsorted(first.node, last << 8 | place), one)
            one = root.mix(np.searchsorted(root.node, place), one)
            bit = ((byte[:, None] >> (7 - np.arange(8))) & 1).ravel()
            total = np.log10(np.where(bit == 1, one, 1 - one)).reshape(-1, 8).sum(axis=1)
            columns = [table.column("gram").combine_chunks(), table.column("blocks").combine_chunks(), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "blocks", "value"])

    valued = whole_groups.select("gram", "n", "blocks").mapInArrow(value, "gram bigint, blocks array<bigint>, value double")
    return valued.select(F.explode("blocks").alias("block"), "gram", F.lit(None).cast("binary").alias("word"), "value")


# Scores


class Table:
    """Gram -> value for the grams of a block, by way of the numbers of their prefixes."""

    def __init__(self, key: np.ndarray, value: np.ndarray, depth: int):
        order = np.argsort(key)
        self.key, self.value, self.depth = key[order], value[order], depth
        columns = self.columns(self.key)
        used = np.unique(np.concatenate(columns)) if len(key) else np.zeros(1, np.int64)
        self.rank = np.zeros(256, np.int64)
        self.rank[used] = np.arange(len(used))
        self.width, self.steps = len(used), []
        number = np.zeros(len(key), np.int64)
        count = 1
        for column in columns:
            codes, number = np.unique(number * self.width + self.rank[column], return_inverse=True)
            # A step is a table of all codes while that is small, and the sorted codes themselves beyond.
            step = codes
            if count * self.width <= TABLE_CELLS:
                step = np.zeros(count * self.width, np.int32)
                step[codes] = np.arange(len(codes))
            self.steps.append((step, count * self.width <= TABLE_CELLS))
            count = len(codes)
        self.by_number = np.zeros(count)
        self.by_number[number] = self.value

    def columns(self, key: np.ndarray) -> list[np.ndarray]:
        """The bytes of each gram in the order of the text."""
        shifts = [8 * k for k in range(1, self.depth + 1)] + [0]
        return [((key >> np.uint64(s)) & np.uint64(255)).astype(np.int64) for s in shifts]

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """The values of all bytes and ends of the texts, and ``depth`` zeros between two texts."""
        d = self.depth
        rank = self.rank[np.frombuffer(EDGE * d + (EDGE + EDGE * d).join(texts) + EDGE, np.uint8)]
        number = 0
        for k, (step, direct) in enumerate(self.steps):
            code = number * self.width + rank[k : len(rank) - d + k]
            number = step[code] if direct else np.minimum(np.searchsorted(step, code), len(step) - 1)
        values = self.by_number[number]
        ends = np.cumsum([len(t) + 1 + d for t in texts])[:-1]
        for k in range(d):
            values[ends - 1 - k] = 0.0
        return values


def block_scores(folder: str, block: int, dictionary: pa.Table, totals: tuple[int, int, int], depth: int) -> Iterator[tuple]:
    """(id, held_out, n_tokens, n_known, base_score, score) of the texts of a block."""
    n, distinct, documents = totals
    is_gram = dictionary.column("gram").is_valid()
    own = dictionary.filter(is_gram)
    table = Table(own.column("gram").to_numpy().view(np.uint64), own.column("value").to_numpy(), depth)
    rest = dictionary.filter(dictionary.column("word").is_valid())
    weights = np.log10((rest.column("value").to_numpy() + 0.5) / (n + 0.5 * (distinct + 1)))
    word = dict(zip(rest.column("word").to_pylist(), weights.tolist()))
    unseen = float(np.log10(0.5 / (n + 0.5 * (distinct + 1))))
    end = float(np.log10((documents + 0.5) / (n + 0.5 * (distinct + 1))))
    rows: list[tuple] = []
    texts: list[bytes] = []

    def scored() -> Iterator[tuple]:
        gap = np.array([len(t) + 1 + depth for t in texts])
        sums = np.add.reduceat(table(texts), np.concatenate([[0], np.cumsum(gap)[:-1]])) if texts else []
        yield from ((*row, float(s)) for row, s in zip(rows, sums))

    size = 0
    for key, train, text in block_texts(folder, block):
        data = lowered(text)
        parts = [word[w] for w in data.split()]
        known = len(parts) - parts.count(unseen) + (documents > 0)
        rows.append((key, not train, len(parts) + 1, known, n, math.fsum(parts) + end))
        texts.append(data)
        size += len(data)
        if size > CHUNK_BYTES:
            yield from scored()
            rows, texts, size = [], [], 0
    yield from scored()


def score(
    docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    ``train`` is the condition that a row is learnt from. ``base_score`` sums smoothed word
    frequencies, ``score`` is the log10-probability of the text under the tree; both include the end.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must lie between 2 and 6 bytes")
    spark = docs.sparkSession
    folder = scratch_table(spark, "lm-texts")
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), whole(F.col(text_col)).alias("text"),
        F.spark_partition_id().cast("bigint").alias("block"),
    )
    rows.write.option("maxRecordsPerFile", BLOCK_ROWS).partitionBy("block").parquet(folder)
    kind = rows.schema["id"].dataType.simpleString()
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    blocks = listed.select(F.regexp_extract("path", r"/block=(\d+)/", 1).cast("bigint").alias("block")).distinct()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                yield from block_counts(folder, block, depth)

    # By range, as a hash of the block would be dropped after distinct() and its partitions merged into one.
    strings = blocks.repartitionByRange(n, "block").mapInArrow(count, "block bigint, gram bigint, word binary, n bigint")
    counted = strings.groupBy("gram", "word").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks"))
    counted = stored(counted, "lm-counts")
    written = spark.read.schema(StructType([*rows.schema.fields])).parquet(folder)
    trained = written.where("train").count()
    sums = counted.where("word IS NOT NULL").agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    totals = ((sums[0] or 0) + trained, sums[1] + (trained > 0), trained)
    words = counted.where("word IS NOT NULL").select(
        F.explode("blocks").alias("block"), F.lit(None).cast("bigint").alias("gram"), "word", F.col("n").cast("double").alias("value")
    )
    schema = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    names = StructType.fromDDL(schema).names

    def finish(key: tuple[pa.Scalar, ...], dictionary: pa.Table) -> pa.Table:
        found = list(block_scores(folder, key[0].as_py(), dictionary, totals, depth))
        return pa.table({name: [row[k] for row in found] for k, name in enumerate(names)}, schema=target)

    target = to_arrow_schema(StructType.fromDDL(schema))
    return words.unionByName(gram_values(counted, depth)).groupBy("block").applyInArrow(finish, schema)

