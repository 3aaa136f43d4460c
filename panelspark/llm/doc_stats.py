"""Counts and ratios of whole texts, computed a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.ranking import counted, distribution
from panelspark.llm import texts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the models see: ratios that do not depend on language.
FEATURES = (
    "log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share",
    "digit_share", "bangs_per_word", "bars_per_word", "punctuation_per_word", "distinct_share",
    "words_per_line", "non_ascii_share", "symbol_share",
)
SYMBOLS = list(b"#*$%&|<>")
PUNCTUATION = list(b".,;:!?\"'()-")


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(COUNTS as integers, FEATURES as doubles), one row for each text; a null text counts as empty."""
    data, bounds = texts.buffers(column)
    n = len(bounds) - 1
    bytes_of = texts.byte_counts(data, bounds)
    hashes, rows = texts.words(data, bounds)
    n_words = np.bincount(rows, minlength=n)
    white = bytes_of[:, list(texts.WHITE)].sum(axis=1)
    chars = bytes_of.sum(axis=1) - bytes_of[:, 0x80:0xC0].sum(axis=1)
    word_chars = chars - white
    symbols = bytes_of[:, SYMBOLS].sum(axis=1)

    shingles, first = texts.shingles(hashes, rows)
    own = texts.mix(shingles + rows[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own)
    same = own[order[1:]] == own[order[:-1]]
    twice = np.zeros(len(own), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), dtype=bool)
    for shift in range(3):
        covered[first[twice] + shift] = True
    repeated = np.bincount(rows[covered], minlength=n)
    distinct = _distinct(hashes, rows, n)

    dup, lines = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    raw = data.tobytes()
    for i in range(n):
        full = [x for x in raw[bounds[i]: bounds[i + 1]].split(b"\n") if x.strip()]
        lines[i] = len(full)
        dup[i] = len(full) - len(set(full))

    per_word, per_line, per_char = (np.maximum(x, 1).astype(float) for x in (n_words, lines, word_chars))
    upper, lower = bytes_of[:, 65:91].sum(axis=1), bytes_of[:, 97:123].sum(axis=1)
    features = np.column_stack([
        np.log1p(n_words), word_chars / per_word, symbols / per_word, dup / per_line, repeated / per_word,
        upper / np.maximum(upper + lower, 1), bytes_of[:, 48:58].sum(axis=1) / per_char,
        bytes_of[:, 33] / per_word, bytes_of[:, 124] / per_word,
        bytes_of[:, PUNCTUATION].sum(axis=1) / per_word, distinct / per_word, n_words / per_line,
        bytes_of[:, 0xC0:].sum(axis=1) / per_char, symbols / per_char,
    ])
    return np.column_stack([n_words, word_chars, symbols, dup, repeated]).astype(np.int64), features


def _distinct(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Distinct words of every row; words come grouped by row."""
    cuts = np.searchsorted(rows, np.arange(n + 1))
    return np.array([len(np.unique(hashes[lo:hi])) for lo, hi in zip(cuts, cuts[1:])], dtype=np.int64)


def mapped(docs: DataFrame, text: str, keep: list[str], result: T.StructType,
           run: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """The struct ``_row`` of ``keep``, and what ``run(counts, features)`` returns: a column for each field of ``result``."""
    texts.small_batches(docs.sparkSession)
    source = docs.select(F.struct(*keep).alias("_row"), *([] if text in keep else [F.col(text).alias("text")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("_row")
            body = row.field(text) if text in keep else batch.column("text")
            for piece in texts.pieces(pa.RecordBatch.from_arrays([row, body], names=["_row", "text"]), "text"):
                found = run(*statistics(piece.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("_row"), *(pa.array(found[f.name]) for f in result.fields)],
                    names=["_row", *(f.name for f in result.fields)])

    schema = T.StructType([T.StructField("_row", source.schema["_row"].dataType), *result.fields])
    return source.mapInArrow(work, schema)


def long(*names: str) -> list[T.StructField]:
    return [T.StructField(x, T.LongType()) for x in names]


def trusted(labels: DataFrame, label: str = "quality", doc_id: str = "doc_id") -> DataFrame:
    """(id, y) of the labels that models may learn from; a document with conflicting ones has none."""
    return (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~texts.held_out(doc_id))
        .groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("_high"))
        .where("y = _high").select("id", F.col("y").cast("int").alias("y")))


def likely(rows: DataFrame, most: int, hashed: Column) -> DataFrame:
    """Rows whose hash is below a threshold that leaves hardly more than ``most``, and fewer with a chance of 1e-9.

    It goes before a sort with a limit, which else would gather ``most`` rows of every partition.
    """
    n = rows.count()
    share = (most + 6 * most**0.5 + 6) / max(n, 1)
    return rows if share >= 1 else rows.where(hashed < int(share * 2**64) - 2**63)


def smallest(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows, those whose ids have the smallest hashes."""
    hashed = F.xxhash64(F.lit(seed), "id")
    return likely(ids, most, hashed).orderBy(hashed, "id").limit(most)


def once(docs: DataFrame, sample: DataFrame, keep: list[str]) -> DataFrame:
    """(id, ``keep``, text), one row for each id in ``sample`` however often ``docs`` (id, text) repeats it: the least text."""
    return docs.join(F.broadcast(sample), "id").groupBy("id", *keep).agg(F.min("text").alias("text"))


def features_of(docs: DataFrame, known: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, y, x) of all documents in ``known`` (id, y), one row for each id: its least text."""
    named = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    found = named.join(known, "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    return mapped(
        found, "text", ["id", "y"], T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))]),
        lambda _, x: {"x": list(x)}).select("_row.*", "x")


def quantiles(df: DataFrame, groups: list[str], value: str, shares: list[float]) -> DataFrame:
    """(groups, k, ``value``): the exact quantile of every group for each share, interpolated as numpy does."""
    ranked = distribution(counted(df, groups, value), groups, value)
    every = F.array(*[F.struct(F.lit(k).alias("k"), ((F.col("total") - 1) * share).alias("at")) for k, share in enumerate(shares)])
    inside = lambda rank: (F.col("below") <= rank) & (rank < F.col("below") + F.col("weight"))
    hits = ranked.select(*groups, value, "below", "weight", F.inline(F.filter(
        every, lambda x: inside(F.floor(x["at"])) | inside(F.ceil(x["at"])))))
    ends = hits.groupBy(*groups, "k").agg(
        F.max(F.when(inside(F.floor("at")), F.col(value))).alias("low"),
        F.max(F.when(inside(F.ceil("at")), F.col(value))).alias("high"), F.first(F.col("at") - F.floor("at")).alias("part"))
    gap, part = F.col("high") - F.col("low"), F.col("part")
    return ends.select(*groups, "k", F.when(part >= 0.5, F.col("high") - gap * (1 - part)).otherwise(
        F.col("low") + gap * part).alias(value))


def sample_features(docs: DataFrame, sample: DataFrame, text: str = "text",
                    doc_id: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """(features, y) of the sampled documents, on the driver; the sample's bound is the caller's."""
    found = once(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), sample, ["y"])
    table = mapped(
        found, "text", ["id", "y"], T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))]),
        lambda _, x: {"x": list(x)}).select("_row.*", "x").toArrow().sort_by("id")
    if not table.num_rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0, dtype=int)
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return x, table.column("y").to_numpy()
