"""Two-pass external shuffle of records into shards.

Pass one scatters: a record's shard comes from its key by rendezvous hashing, and its bucket
inside the shard from a seeded hash of its place in the input, so buckets are near equal
whatever keys or texts repeat. The number of buckets follows from the shard's bytes, so a
bucket fits in a task's memory. Pass two shuffles: every bucket is put in input order, then
Fisher-Yates shuffled by a generator seeded with (seed, shard, bucket), and written.

The scatter is repeatable for the same input files and split settings. A lost task rebuilds
its buckets from the scan in the same order, so retries write the same rows.

Edge cases, all defined: a null key is a key like any other (all null keys share a shard, cut
into as many buckets as it needs); a null text has no bytes; a text larger than a bucket is
alone in exceeding it; repeated rows each keep a slot of their own; an empty table gives no
rows. Input columns named like the added ones (``shard``, ``bucket``, ``place``, ``slot``,
``grown_shard``) are refused with an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import texts
from panelspark.session import bounded, shared_dir

ADDED = ("shard", "bucket", "place")


def shard_of(key: Column, n_shards: int, seed: int) -> Column:
    """The shard whose hash with the key is highest: one more shard only takes rows into itself."""
    bids = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("bid"), F.lit(s).alias("shard"))
            for s in range(n_shards)]
    return (F.greatest(*bids) if n_shards > 1 else bids[0])["shard"]


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _fisher_yates(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def shuffled():
            whole = pa.Table.from_batches(held)
            order = np.arange(whole.num_rows)
            np.random.default_rng([seed & 0xFFFFFFFF, *at]).shuffle(order)
            out = whole.take(pa.array(order)).set_column(
                whole.schema.get_field_index("place"), pa.field("place", pa.int64()),
                pa.array(np.arange(len(order), dtype=np.int64)))
            yield from out.to_batches(max_chunksize=2_000)

        for batch in batches:
            shard, bucket = (batch.column(c).to_numpy() for c in ("shard", "bucket"))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(bucket) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(shard)]):
                if hi == lo:
                    continue
                here = (int(shard[lo]), int(bucket[lo]))
                if at is not None and here != at:
                    yield from shuffled()
                    held = []
                at = here
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from shuffled()

    return run


def write_shards(docs: DataFrame, n_shards: int = 16, seed: int = 17, key: str = "doc_id",
                 text: str = "text", bucket_bytes: int = 32 << 20, path: str | None = None) -> str:
    """Writes ``docs`` as shuffled shards (``shard=k/`` folders) and returns the path."""
    if clash := {c.lower() for c in docs.columns} & {*ADDED, "slot", "grown_shard"}:
        raise ValueError(f"columns named like added ones: {sorted(clash)}")
    spark = docs.sparkSession
    texts.small_batches(spark)
    placed = docs.withColumn("shard", shard_of(F.col(key), n_shards, seed))
    held = {r["shard"]: r["bytes"] for r in
            placed.groupBy("shard").agg(F.sum(size_of(F.col(text))).alias("bytes")).collect()}
    buckets = [max(1, math.ceil(held.get(s, 0) / bucket_bytes)) for s in range(n_shards)]
    count = F.array(*map(F.lit, buckets))[F.col("shard")]
    scattered = (
        placed.withColumn("place", F.monotonically_increasing_id())
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "place"), count).cast("int"))
        .repartition(sum(buckets), "shard", "bucket")
        .sortWithinPartitions("shard", "bucket", "place"))
    path = path or shared_dir(spark, "shards")
    (scattered.mapInArrow(_fisher_yates(seed), T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in scattered.schema.fields]))
     .sortWithinPartitions("shard", "bucket", "place")
     .write.partitionBy("shard").parquet(path))
    return path


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """What ``write_shards`` made of ``docs``, which gives the schema here: the rows of ``write_shards`` with ``slot``, their place in the shard, gapless from 0.

    The table of bucket starts is broadcast up to 100,000 buckets; the texts are not shuffled then.
    """
    written = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType() if c == "place" else T.IntegerType()) for c in ADDED)])
    rows = docs.sparkSession.read.schema(written).parquet(path)
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("_n")).select(
        "shard", "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(bounded(starts), ["shard", "bucket"]).withColumn(
        "slot", F.col("_start") + F.col("place")).drop("_start", "place", "bucket")
