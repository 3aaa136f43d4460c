"""Token-budget batches inside length buckets of least padding.

Lengths are counted into a global histogram. Dynamic programming over it picks the bucket
boundaries with the least padding, when every text of a bucket is padded to the bucket's
longest. Inside a bucket, texts are dealt in seeded order into batches of as many rows as the
token budget holds at the padded length.

The histogram has one row for every length that occurs, so its size follows the longest text, not the
rows, and the boundaries are the best there are. As the best earlier boundary never falls when texts get
longer, a layer of the programme is settled by halving, in time n log n. Places in a bucket come from ranges
of the seeded order, so neither a bucket nor a mass of equal rows is ever sorted in one task.

Edge cases, all defined: a null text has no tokens and an empty one neither; texts longer than the
budget get batches of one row; ties in padding go to the smaller boundary; equal rows take
neighbouring places; null ids take part like others; an empty table gives an empty result. Columns
of the input beyond id and text play no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.mixing import WORD
from panelspark.llm.places import indexed
from panelspark.session import written

#: Most distinct lengths; more are an error.
LENGTHS = 5_000_000
BUCKETS = 16
TOKEN_BUDGET = 65_536


def length_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _layer(cost: np.ndarray, longest: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more bucket: for every last length the least padded size, and the first boundary before it that gives it.

    Places are settled middle first; a place between two settled ones looks only between their picks.
    """
    n = len(longest)
    fresh, pick = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
    fresh[0] = cost[0]
    spans = np.array([[1, n - 1, 0, n - 2]], dtype=np.int64) if n > 1 else np.zeros((0, 4), np.int64)
    while len(spans):
        first, last, low, high = spans.T
        middle = (first + last) // 2
        high_here = np.minimum(high, middle - 1)
        sizes = high_here - low + 1
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        owner = np.repeat(np.arange(len(spans)), sizes)
        tried = np.arange(sizes.sum()) - starts[owner] + low[owner]
        at = middle[owner]
        through = cost[tried] + longest[at] * (before[at + 1] - before[tried + 1])
        least = np.minimum.reduceat(through, starts)
        hits = np.flatnonzero(through == least[owner])
        _, one = np.unique(owner[hits], return_index=True)
        fresh[middle], pick[middle] = least, tried[hits[one]]
        halves = np.concatenate([np.stack([first, middle - 1, low, pick[middle]], axis=1),
                                 np.stack([middle + 1, last, pick[middle], high], axis=1)])
        spans = halves[halves[:, 0] <= halves[:, 1]]
    return fresh, pick


def best_boundaries(longest: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Longest lengths of the buckets; lengths come in order, each with its count."""
    cells = len(longest)
    buckets = min(buckets, cells)
    longest = longest.astype(np.int64)
    before = np.concatenate([[0], np.cumsum(counts)])
    # the lengths' sum is the same for every choice, so padded size alone decides
    cost = longest * before[1:]
    picks = []
    for _ in range(1, buckets):
        cost, pick = _layer(cost, longest, before)
        picks.append(pick)
    out, at = [], cells - 1
    for pick in reversed(picks):
        out.append(int(longest[at]))
        if at == 0:
            break
        at = int(pick[at])
    else:
        out.append(int(longest[at]))
    return sorted(set(out))


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, seed: int = 31, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_to, batch, place): place counts from 0 in the batch."""
    content = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), content).cast("binary"))
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), length_of(F.col(text)).alias("n_tokens"), order.alias("at")), "lengths")
    table = rows.groupBy("n_tokens").count().orderBy("n_tokens").limit(LENGTHS + 1).toArrow()
    if table.num_rows > LENGTHS:
        raise ValueError(f"more than {LENGTHS} distinct lengths")
    lengths, counts = (table.column(c).to_numpy() for c in ("n_tokens", "count"))
    ends = best_boundaries(lengths, counts, buckets) if len(lengths) else [0]
    bucket = sum(((F.col("n_tokens") > e).cast("int") for e in ends[:-1]), F.lit(0))
    padded = F.element_at(F.array(*(F.lit(e).cast("long") for e in ends)), F.col("bucket") + 1)
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("padded_to", F.lit(1)))).cast("long")
    placed = indexed(rows.withColumn("bucket", bucket).withColumn("padded_to", padded), "bucket", ["at", "doc_id"], "packing")
    return placed.select(
        "doc_id", "n_tokens", "bucket", "padded_to", F.floor(F.col("idx") / per_batch).cast("long").alias("batch"),
        F.pmod("idx", per_batch).cast("long").alias("place"))
