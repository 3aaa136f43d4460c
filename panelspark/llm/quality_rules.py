"""Quality rules: base limits, and boosted trees over document statistics.

Trees are fitted on the statistics of all labelled documents that may be learned from, from
histograms that tasks add up, level by level; only histograms reach the driver. Up to ``most``
documents are added up on the driver itself. Trees are kept as flat node arrays and score whole batches at once. Features whose growth can only mean
worse text have monotonic constraints.

Edge cases, all defined: a null text is an empty one, has zero counts and fails the base
limits; a document's label counts once however often it repeats; a document with conflicting
labels is not learned from; without labels of both kinds no trees are fitted, the score is 1
and the base limits alone decide; an empty table gives an empty result. Kept columns may have
any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import doc_stats, trees
from panelspark.session import written

MIN_WORDS = 50
#: Sign of the score in each feature that is constrained.
SIGNS = {
    "symbols_per_word": -1, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "bangs_per_word": -1, "bars_per_word": -1,
}
#: Documents whose histograms are added up on the driver.
MAX_LOCAL = 20_000
#: Bins and labels of some thousand documents.
CHUNK = "codes binary, y binary"
#: At most this share of the good documents learned from may be rejected.
MAX_LOSS = 0.002


def base_failed(counts: np.ndarray) -> np.ndarray:
    n_words, repeated = counts[:, 0], counts[:, 4]
    return (n_words < MIN_WORDS) | (100 * repeated > 50 * n_words)


def _binned(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Chunks of rows: (codes, a line for each feature; y)."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                codes = trees.codes_of(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1), edges)
                y = (batch.column("y").to_numpy() > 0).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m.tobytes()], pa.binary()) for m in (codes, y)], names=["codes", "y"])

    return rows.mapInArrow(run, CHUNK)


def _unpacked(codes: bytes, y: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(y, np.uint8)
    return np.frombuffer(codes, np.uint8).reshape(-1, len(found)), found


def _summed(state: DataFrame, most: int, n: int):
    """``sums`` for ``trees.grow`` over all chunks, on the driver if there are few rows."""
    if n <= most:
        parts = [_unpacked(*r) for r in state.collect()]
        codes, y = np.concatenate([c for c, _ in parts], axis=1), np.concatenate([y for _, y in parts])
        return lambda grown, tree, level: grown.sums(codes, y, tree, level)

    def sums(grown: trees.Grown, tree: int, level: int) -> np.ndarray:
        def run(batches):
            total = 0
            for batch in batches:
                for codes, y in zip(batch.column("codes").to_pylist(), batch.column("y").to_pylist()):
                    total = total + grown.sums(*_unpacked(codes, y), tree, level)
            if not isinstance(total, int):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

        parts = state.mapInArrow(run, "s binary").toArrow().column("s").to_pylist()
        return np.sum([np.frombuffer(s) for s in parts], axis=0).reshape(2, 2**level, -1, trees.BINS)

    return sums


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LOCAL) -> tuple[trees.Forest | None, float]:
    """(trees, least probability to keep)."""
    rows = written(doc_stats.features_of(docs, doc_stats.trusted(labels)), "labelled-features")
    n, good = rows.agg(F.count("*"), F.count_if(F.col("y") > 0)).first()
    if not 0 < good < n:
        return None, 0.0
    ends: dict[int, list[float]] = {}
    shares = [k / trees.BINS for k in range(1, trees.BINS)]
    for r in doc_stats.quantiles(rows.select(F.posexplode("x").alias("j", "v")), ["j"], "v", shares).collect():
        ends.setdefault(r["j"], []).append(r["v"])
    edges = [np.unique(ends[j]) for j in range(len(doc_stats.FEATURES))]
    state = written(_binned(rows, edges), "binned-features")
    signs = np.array([SIGNS.get(f, 0) for f in doc_stats.FEATURES])
    forest, grown = trees.grow(edges, signs, good / n, _summed(state, most, n))

    def scores(batches):
        for batch in batches:
            for codes, y in zip(batch.column("codes").to_pylist(), batch.column("y").to_pylist()):
                codes, y = _unpacked(codes, y)
                margin = grown.margin(codes, len(grown.value))[y > 0]
                yield pa.RecordBatch.from_arrays([pa.array(1 / (1 + np.exp(-np.clip(margin, -40, 40))))], names=["p"])

    kept = state.mapInArrow(scores, "p double").withColumn("all", F.lit(0))
    return forest, float(min(0.5, doc_stats.quantiles(kept, ["all"], "p", [MAX_LOSS]).first()["p"]))


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], text: str = "text",
          most: int = MAX_LOCAL, learn: DataFrame | None = None) -> DataFrame:
    """The struct ``_row`` of ``keep`` columns, with the counts, base_failed, score and kept of every document.

    The trees are fitted on ``learn`` (doc_id, text), or else on the documents themselves.
    """
    forest, least = fit(docs if learn is None else learn, labels, most)

    def run(counts: np.ndarray, features: np.ndarray) -> dict[str, np.ndarray]:
        failed = base_failed(counts)
        score = forest.probability(features) if forest else np.ones(len(counts))
        return dict(zip(doc_stats.COUNTS, counts.T.copy())) | {
            "base_failed": failed, "score": score, "kept": ~failed & (score >= least)}

    result = T.StructType([
        *doc_stats.long(*doc_stats.COUNTS), T.StructField("base_failed", T.BooleanType()),
        T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return doc_stats.mapped(docs, text, keep, result, run)
