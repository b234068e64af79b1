"""Scoring of arriving files against a stored model, as a stream without a server."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from marginwise.functions.kernels import Kernel
from marginwise.plans.evaluation import score_rows


def score_stream(
    spark: SparkSession,
    source: str,
    schema: str,
    support: DataFrame,
    kernel: Kernel,
    epsilon: float,
    output: str,
    checkpoint: str,
    bias: float = 0.0,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Scores every Parquet file (id, x, ...) that lies in ``source`` and is not scored yet, then ends.

    The model (id, x, z) is the static side. Offsets are kept below ``checkpoint`` and the file sink
    commits whole batches, so a run that is started again goes on where the last one ended and no row of
    (id, score) is written twice. The model must fit a broadcast.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    scored = score_rows(reader.parquet(source).select("id", "x"), support, kernel, epsilon, bias)
    writer = scored.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
