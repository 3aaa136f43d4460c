"""Session settings, the shared work folder, and bounded dimension tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # lets row_number() <= n prune before the shuffle for per-era samples
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def local_session(cores: int | str = "*", app: str = "panelspark", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own."""
    parallelism = os.cpu_count() if cores == "*" else cores
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parallelism))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session without that setting, as in tests, gets a temporary folder: on a
    cluster every machine would have its own, so there the missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="panelspark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, cutting its lineage."""
    path = shared_dir(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES, BATCH_ROWS = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def uncounted(spark: SparkSession, numbers: int):
    """Inside, rows of so many numbers go to Python without their batch's bytes being added up at every row.

    The limit of bytes is lifted only if full batches stay below it, so batches are the same.
    """
    limit, rows = spark.conf.get(BATCH_BYTES), int(spark.conf.get(BATCH_ROWS))
    plain = limit.lower().removesuffix("b")
    if not plain.isdigit() or rows <= 0 or rows * numbers * 9 > int(plain):
        yield
        return
    spark.conf.set(BATCH_BYTES, str(2**31 - 1))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, limit)


def bounded(dim: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Reads a dimension table once and marks it for broadcast, if it is small.

    At most ``max_rows`` rows reach the driver. A larger table is returned as it
    is, so that the join stays a shuffle join.
    """
    table = dim.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return dim
    return F.broadcast(dim.sparkSession.createDataFrame(table, schema=dim.schema))


#: Sides of joins are hashed above the first number of rows, up to the second number of rows for each task.
HASHED = (100_000, 1 << 19)


def hashed(side: DataFrame, rows: int) -> DataFrame:
    """Asks a join to hash ``side`` of about ``rows`` rows, if tasks can hold them.

    The other side's rows are then not sorted. Small sides stay to be broadcast, larger ones are sorted and may spill.
    """
    tasks = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fewest, most = HASHED
    return side.hint("shuffle_hash") if fewest < rows <= most * tasks else side


def all_rows(df: DataFrame, most: int = 10_000) -> list:
    """The rows of a table that must be small, on the driver; more than ``most`` are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; choose some first, for example with orderBy and limit")
    return rows


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions a scan that has fewer splits than the session has cores.

    One small file is one task however many cores there are. A large table has
    more splits than cores and is left alone, so it is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
