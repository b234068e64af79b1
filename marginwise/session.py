"""Session construction and durable intermediate tables."""

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marginwise", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the engine relies on; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="marginwise-"))
        current = context.getCheckpointDir()
    return current


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable checkpoint storage and cut its lineage.

    Later passes read one fixed set of rows, also after an executor is lost.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table below the shared folder: for large tables that are read many times."""
    path = scratch_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a URI: local, HDFS or an object store."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def discard(*tables: DataFrame) -> None:
    """Deletes ``stored`` tables that nothing will read again; anything else is left alone."""
    for table in tables:
        spark = table.sparkSession
        root = shared_folder(spark).rstrip("/").split(":")[-1].lstrip("/")
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            parent, name = folder.rsplit("/", 1)
            if parent.split(":")[-1].lstrip("/").endswith(root) and re.search("-[0-9a-f]{32}$", name):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BUCKET_ROWS = 8_000_000


def bucketed(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` as a table bucketed by ``keys`` below the shared folder: joins on them do not move it."""
    spark = df.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffle, spark.sparkContext.defaultParallelism, rows // BUCKET_ROWS)
    name = f"bucketed_{uuid.uuid4().hex}"
    # Partitioned like the buckets, so every task writes one file.
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys)
    writer.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
