"""Token counts of flat, unindexed token files by a separator scan.

A token file is nothing but ids, two bytes each, with an end-of-document id behind each document.
Files are read in blocks of fixed size, each block is searched for the separator in one vector
comparison, and a prefix scan over the blocks of a file (documents ended so far, place of the last
end) stitches documents that cross blocks. No block waits for another and no file is read twice.

Edge cases: a NULL or empty text is a document of no tokens; repeated rows are documents of their
own; ids behind the last separator are a document without an end; an empty file has no document.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginwise.llm import files, pieces

BLOCK_TOKENS = 4_000_000
#: The end-of-sequence piece of the default vocabulary.
SEPARATOR = 2


def write_token_files(
    docs: DataFrame, folder: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR
) -> DataFrame:
    """Writes one token file per partition of ``docs``; (path, ordinal, id) for each document.

    The result is a plan: store it once, as every run of it writes the files anew.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stream, uri, ordinal = pieces.Encoder(model), None, None, 0
        for batch in batches:
            if stream is None and batch.num_rows:
                uri, stream = files.create(folder, ".tokens")
            begin, chars, texts = 0, 0, []
            for row, value in enumerate(batch.column(1)):
                texts.append(value.as_py() or "")
                chars += len(texts[-1])
                if chars < pieces.CHUNK_CHARS and row + 1 < batch.num_rows:
                    continue
                for ids in encoder.ids(texts):
                    stream.write(np.append(ids, separator).astype("<u2").tobytes())
                n = row + 1 - begin
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0).slice(begin, n)],
                    names=["path", "ordinal", "id"],
                )
                ordinal, begin, chars, texts = ordinal + n, row + 1, 0, []
        if stream is not None:
            stream.close()

    return rows.mapInArrow(run, f"path string, ordinal bigint, id {rows.schema['id'].dataType.simpleString()}")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, n_tokens) of the token files of a folder; their content is not read."""
    listed = spark.read.format("binaryFile").load(folder).select("path", "length")
    return listed.select("path", F.expr("length div 2").alias("n_tokens"))


def block_ends(blocks: DataFrame, separator: int) -> DataFrame:
    """(path, block, begin, size, ends): places of the separators of each block, from the file's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = files.Reader()
        for batch in batches:
            for path, block, begin, size in zip(*(c.to_pylist() for c in batch.columns)):
                reader.open(path)
                ids = np.frombuffer(reader.read(2 * begin, 2 * size), "<u2")
                ends = np.flatnonzero(ids == separator) + begin
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block]), pa.array([begin]), pa.array([size]), pa.array([ends], pa.list_(pa.int64()))],
                    names=["path", "block", "begin", "size", "ends"],
                )
        reader.close()

    return blocks.mapInArrow(run, "path string, block bigint, begin bigint, size bigint, ends array<bigint>")


def scan(token_files: DataFrame, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, ordinal, begin, n_tokens, ended) of each document in the files (path, n_tokens).

    ``n_tokens`` counts the ids of the document without its separator, ``begin`` is the place of the first.
    """
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.lit(block_tokens).cast("bigint")))
    blocks = token_files.where(F.col("n_tokens") > 0).select("path", "n_tokens", first.alias("begin")).select(
        "path",
        F.expr(f"begin div {block_tokens}").alias("block"),
        "begin",
        F.least(F.lit(block_tokens).cast("bigint"), F.col("n_tokens") - F.col("begin")).alias("size"),
    )
    n = int(token_files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = block_ends(blocks.repartition(n, "path", "block"), separator)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    stitched = found.select(
        "path",
        "begin",
        "size",
        "ends",
        F.coalesce(F.sum(F.size("ends").cast("bigint")).over(before), F.lit(0)).alias("documents"),
        (F.coalesce(F.max(F.element_at("ends", F.when(F.size("ends") > 0, F.lit(-1)))).over(before), F.lit(-1)) + 1).alias("open"),
        (F.max("block").over(whole) == F.col("block")).alias("last"),
    )
    # The last block of a file ends whatever is open.
    stop = F.col("begin") + F.col("size")
    last_end = F.coalesce(F.element_at("ends", F.when(F.size("ends") > 0, F.lit(-1))) + 1, F.col("open"))
    stitched = stitched.withColumn("all", F.when(F.col("last") & (last_end < stop), F.concat("ends", F.array(stop))).otherwise(F.col("ends")))
    rows = stitched.select("path", "documents", "open", "ends", "all", F.posexplode_outer("all").alias("at", "end"))
    begin = F.when(F.col("at") == 0, F.col("open")).otherwise(F.get("all", F.col("at") - 1) + 1)
    rows = rows.where(F.col("end").isNotNull())
    return rows.select(
        "path",
        (F.col("documents") + F.col("at")).alias("ordinal"),
        begin.alias("begin"),
        (F.col("end") - begin).alias("n_tokens"),
        (F.col("at") < F.size("ends")).alias("ended"),
    )
