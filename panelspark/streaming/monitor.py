"""Watching live predictions for a change of regime."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelspark.functions.correlation import spearman
from panelspark.session import shared_dir, written

RESULT_SCHEMA = "window_start timestamp, corr double, n long, regime_change boolean"


def window_counts(
    rows: DataFrame, ts: str, prediction: str, target: str, window: str = "1 day"
) -> DataFrame:
    """(window_start, prediction, target, n): what a rank correlation needs, already summed.

    The state is keyed by value pair, so a busy window is spread over all tasks.
    """
    return (
        rows.groupBy(
            F.window(ts, window).alias("_w"),
            F.col(prediction).cast("double").alias("prediction"),
            F.col(target).cast("double").alias("target"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("_w.start").alias("window_start"), "prediction", "target", "n")
    )


def regime_change(counts: DataFrame) -> DataFrame:
    """Flags windows in which predictions rank against the target."""
    corr = spearman(counts, ["window_start"], "prediction", "target", weight="n")
    return corr.select(
        "window_start",
        "corr",
        "n",
        F.coalesce(F.col("corr") < 0, F.lit(False)).alias("regime_change"),
    )


def regime_change_batch(
    rows: DataFrame, ts: str, prediction: str, target: str, window: str = "1 day"
) -> DataFrame:
    return regime_change(window_counts(rows, ts, prediction, target, window))


def start_monitor(
    stream: DataFrame,
    path: str,
    ts: str = "ts",
    prediction: str = "prediction",
    target: str = "target",
    window: str = "1 day",
    late: str = "1 hour",
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Appends one row per closed window to ``path``.

    Append mode hands all sums of a window to the same micro-batch once the watermark
    has passed it. A repeated micro-batch overwrites its own folder.
    """
    counts = window_counts(stream.withWatermark(ts, late), ts, prediction, target, window)

    def save(batch: DataFrame, batch_id: int) -> None:
        # written first, as a micro-batch would otherwise be run again for every use
        closed = written(batch, "closed-windows")
        regime_change(closed).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = (
        counts.writeStream.outputMode("append")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint or shared_dir(stream.sparkSession, "monitor"))
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_results(spark, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).parquet(f"{path}/batch=*")
