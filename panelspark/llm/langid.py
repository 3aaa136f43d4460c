"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts become symbols: lower-case letters, and one space for every run of anything else. Four
symbols make a gram, packed into 64 bits. Grams of all documents that may be learned from are
counted in the tasks and added up per (language, gram). From the whole table of counts Spark sums the
continuation counts of the lower orders, the totals of the contexts and the discounts: for each order
a table of grams and one of contexts, with a number for each language. No gram is left out.

The negative log probabilities of the most frequent grams, ``HEAD`` numbers at most, are broadcast.
A task adds up those, and hands on a text's other grams, which are joined with the tables. The sums
are integers, in units of 1 / ``UNIT``, so results depend neither on ``HEAD`` nor on the order of rows.

The language with the lowest cross-entropy per symbol wins. On all documents
learned from, a temperature is fitted that turns cross-entropies into probabilities, and each
language gets the largest cross-entropy that its own documents show (up to a small share):
texts beyond it are marked as rejected.

Edge cases, all defined: a text that is null or has no letter is ``und`` with score 0; documents
with null language or id-hash held out are not learned from; without anything to learn from every
text is ``und``; ties between languages go to the first in order; repeated rows get equal results;
an empty table gives an empty result. Kept columns may have any name but those of the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import doc_stats, texts
from panelspark.session import written

ORDER = 4
#: Distinct grams that a task holds before it hands them on.
MAX_GRAMS = 1 << 21
#: Most numbers (grams times languages) that are broadcast for scoring; other grams are joined.
HEAD = 1 << 22
UNIT = 1 << 24
#: Temperatures that are tried.
TEMPERATURES = np.geomspace(0.005, 2, 25)
#: Share of a language's own documents that may lie beyond its limit.
MAX_REJECTED = 0.001
UNKNOWN = "und"
SPACE = 0x20
FLUSH = 4 << 20


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Symbol of every code point; letters beyond 16 bits share the private range."""
    out = np.full(0x110000, SPACE, dtype=np.uint16)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            low = letter.lower()
            point_low = ord(low) if len(low) == 1 else point
            out[point] = point_low if point_low < 0x10000 else 0xE000 + point_low % 6400
    return out


def grams(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(packed grams, their rows), some millions at a time; a gram ends at every symbol of a text."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for lo, hi in texts.windows(data, bounds):
        part = data[lo:hi]
        points = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
        first = int(np.searchsorted(bounds, lo, "right")) - 1
        last = int(np.searchsorted(bounds, hi, "left"))
        heads = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        lengths = np.diff(heads[np.clip(bounds[first: last + 1], lo, hi) - lo])
        rows = np.repeat(np.arange(first, last, dtype=np.int32), lengths)
        s = symbols()[points]
        fresh = np.ones(len(s), dtype=bool)
        fresh[1:] = (s[1:] != SPACE) | (s[:-1] != SPACE) | (rows[1:] != rows[:-1])
        s, rows = s[fresh].astype(np.uint64), rows[fresh]
        packed = s.copy()
        for back in range(1, ORDER):
            before = np.full(len(s), SPACE, dtype=np.uint64)
            if len(s) > back:
                same = rows[back:] == rows[:-back]
                before[back:][same] = s[:-back][same]
            packed |= before << np.uint64(16 * back)
        held.append((packed, rows))
        if sum(len(p) for p, _ in held) >= FLUSH:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n), summed over the task as far as memory allows."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def flushed():
        for lang, found in held.items():
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*found)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)],
                names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for piece in texts.pieces(batch, "text"):
            codes = piece.column("lang").dictionary_encode()
            names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            for packed, rows in grams(*texts.buffers(piece.column("text"))):
                lang = code[rows]
                for k, name in enumerate(names):
                    held.setdefault(name, []).append(np.unique(packed[lang == k], return_counts=True))
        for name, found in held.items():
            held[name] = [_summed(*(np.concatenate(x) for x in zip(*found)))]
        if sum(len(x[0][0]) for x in held.values()) > MAX_GRAMS:
            yield from flushed()
    yield from flushed()


@dataclass(frozen=True)
class Order:
    """Sorted hashes of grams and of contexts with a value each."""

    grams: np.ndarray
    shares: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


def _hashed(keys: np.ndarray, values: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    keys = texts.mix(keys + np.uint64(order))
    at = np.argsort(keys)
    return keys[at], values[at].astype(np.float32)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, order: int, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default, dtype=np.float32)
    wanted = texts.mix(wanted + np.uint64(order))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.float32(default))


def kneser_ney(keys: np.ndarray, counts: np.ndarray) -> list[Order]:
    """The orders of one language, lowest first, from its distinct grams of the highest order."""
    orders: list[Order] = []
    counts = counts.astype(np.float64)
    for order in range(ORDER, 0, -1):
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context = keys >> np.uint64(16)
        heads, at, kinds = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(at, counts)
        orders.append(Order(
            *_hashed(keys, (counts - np.minimum(counts, discount)) / total[at], order),
            *_hashed(heads, np.minimum(1.0, discount * kinds / total), order)))
        if order > 1:
            suffix = keys & np.uint64((1 << 16 * (order - 1)) - 1)
            keys, counts = np.unique(suffix, return_counts=True)
            counts = counts.astype(np.float64)
    return orders[::-1]


@dataclass(frozen=True)
class Model:
    """The model in the memory of one machine: what the tables of ``Fitted`` are compared with."""

    langs: list[str]
    orders: list[list[Order]]
    floor: float

    def surprise(self, packed: np.ndarray) -> np.ndarray:
        """(languages, grams): negative log probability of every gram's last symbol."""
        out = np.zeros((len(self.langs), len(packed)))
        for k, orders in enumerate(self.orders):
            p = np.full(len(packed), self.floor)
            for order, level in enumerate(orders, 1):
                key = packed & np.uint64((1 << 16 * order) - 1) if order < 4 else packed
                p = _found(level.grams, level.shares, key, order, 0.0) + p * _found(
                    level.contexts, level.weights, key >> np.uint64(16), order, 1.0)
            out[k] = -np.log(p)
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per symbol by text and language, whether the text has a letter)."""
        data, bounds = texts.buffers(column)
        n = len(bounds) - 1
        sums, lengths, letters = np.zeros((n, len(self.langs))), np.zeros(n), np.zeros(n)
        for packed, rows in grams(data, bounds):
            distinct, at = np.unique(packed, return_inverse=True)
            for k, values in enumerate(self.surprise(distinct)):
                sums[:, k] += np.bincount(rows, values[at], n)
            lengths += np.bincount(rows, minlength=n)
            letters += np.bincount(rows, (distinct & np.uint64(0xFFFF) != SPACE)[at], n)
        return sums / np.maximum(lengths, 1)[:, None], letters > 0


def probabilities(entropy: np.ndarray, temperature: float) -> np.ndarray:
    z = -entropy / temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _taught(text: str, lang: str, doc_id: str) -> Column:
    return F.coalesce(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~texts.held_out(doc_id), F.lit(False))


def _learnable(docs: DataFrame, text: str, lang: str, doc_id: str) -> DataFrame:
    return docs.where(_taught(text, lang, doc_id)).select(
        F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))


def count_grams(known: DataFrame) -> DataFrame:
    """(lang, gram, n) over all of ``known`` (lang, text)."""
    return known.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """Each language's grams from a count on that leaves at most its equal share of ``most``; for the broadcast."""
    level = F.when(F.col("n") < 64, F.col("n")).otherwise((64 + 16 * (F.log2("n") - 6)).cast("long"))
    counts = counts.withColumn("level", level)
    sizes: dict[str, list[tuple[int, int]]] = {}
    for r in counts.groupBy("lang", "level").count().collect():
        sizes.setdefault(r["lang"], []).append((r["level"], r["count"]))
    keep = F.lit(False)
    for lang, levels in sizes.items():
        left, least = most // len(sizes), None
        for at, n in sorted(levels, reverse=True):
            left -= n
            if left < 0:
                break
            least = at
        if least is not None:
            keep = keep | ((F.col("lang") == lang) & (F.col("level") >= least))
    return counts.where(keep).select("lang", "gram", "n")


def _suffix(key: str, order: int) -> Column:
    return F.col(key).bitwiseAND(F.lit((1 << 16 * order) - 1))


@dataclass(frozen=True)
class Level:
    """One order: (key, c) of its grams, (context, total, kinds) of their contexts; a number for each language."""

    order: int
    grams: DataFrame
    contexts: DataFrame
    discounts: tuple[float, ...]


def levels(counts: DataFrame, langs: list[str]) -> list[Level]:
    """The orders, lowest first, from all counts (lang, gram, n)."""
    each = range(len(langs))
    found = []
    table = counts.groupBy(F.col("gram").alias("key")).agg(
        F.array(*(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)) for x in langs)).alias("c"))
    for order in range(ORDER, 0, -1):
        table = written(table, f"grams-{order}")
        sums = table.agg(*(F.count_if(F.col("c")[k] == n) for n in (1, 2) for k in each)).first()
        once, twice = sums[:len(langs)], sums[len(langs):]
        contexts = table.groupBy(F.shiftrightunsigned("key", 16).alias("context")).agg(
            F.array(*(F.sum(F.col("c")[k]) for k in each)).alias("total"),
            F.array(*(F.count_if(F.col("c")[k] > 0) for k in each)).alias("kinds"))
        found.append(Level(order, table, written(contexts, f"contexts-{order}"), tuple(
            a / (a + 2 * b) if a and b else 0.5 for a, b in zip(once, twice))))
        if order > 1:
            table = table.groupBy(_suffix("key", order - 1).alias("key")).agg(
                F.array(*(F.count_if(F.col("c")[k] > 0) for k in each)).alias("c"))
    return found[::-1]


@dataclass(frozen=True)
class Fitted:
    langs: list[str]
    levels: list[Level]
    floor: float
    head: tuple[np.ndarray, np.ndarray]
    temperature: float = 1.0
    limits: tuple[float, ...] = ()

    def surprise(self, keys: DataFrame) -> DataFrame:
        """(key, s): negative log probabilities of distinct grams, in units, for each language."""
        asked = [keys]
        for order in range(ORDER - 1, 0, -1):
            asked.append(asked[-1].select(_suffix("key", order).alias("key")).distinct())
        lower = None
        for level, wanted in zip(self.levels, asked[::-1]):
            # At most 65,536 keys of one symbol; tables of longer keys are joined as their sizes allow.
            one = lambda table, order: F.broadcast(table) if order < 2 else table
            rows = wanted.withColumn("context", F.shiftrightunsigned("key", 16)).withColumn(
                "suffix", _suffix("key", level.order - 1))
            rows = rows.join(one(level.grams, level.order), "key", "left").join(
                one(level.contexts, level.order - 1), "context", "left")
            if lower is not None:
                rows = rows.join(one(lower.select(F.col("key").alias("suffix"), "p"), level.order - 1), "suffix")
            p = []
            for k, discount in enumerate(level.discounts):
                c = F.coalesce(F.col("c")[k], F.lit(0)).cast("double")
                total, kinds = F.col("total")[k].cast("double"), F.col("kinds")[k]
                below = F.lit(self.floor) if lower is None else F.col("p")[k]
                p.append(F.when(total > 0, (c - F.least(c, F.lit(discount))) / total
                                + F.least(F.lit(1.0), discount * kinds / total) * below).otherwise(below))
            lower = rows.select("key", F.array(*p).alias("p"))
        return lower.select("key", F.transform("p", lambda x: F.round(-F.log(x) * UNIT).cast("long")).alias("s"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Fitted | None:
    known = _learnable(docs, text, lang, doc_id)
    model = _tables(known)
    if model is None:
        return None
    found = written(_entropies(known, model, ["lang"], "text"), "known-entropies")
    return _calibrated(model, found.where("letters").select("_row.lang", "h"))


def _tables(known: DataFrame) -> Fitted | None:
    """The grams of all of ``known`` (lang, text), without temperature and limits."""
    texts.small_batches(known.sparkSession)
    counts = written(count_grams(known), "gram-counts")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    orders = levels(counts, langs)
    none = np.zeros(0, dtype=np.uint64), np.zeros((0, len(langs)), dtype=np.int64)
    model = Fitted(langs, orders, 1 / (orders[0].grams.count() + 1), none)
    often = frequent(counts, HEAD // len(langs)).select(F.col("gram").alias("key")).distinct()
    table = model.surprise(often).toArrow().combine_chunks()
    if table.num_rows:
        keys = table.column("key").to_numpy().view(np.uint64)
        values = pa.concat_arrays(table.column("s").chunks).flatten().to_numpy().reshape(-1, len(langs))
        at = np.argsort(keys)
        model = replace(model, head=(keys[at], values[at]))
    return model


def _entropies(docs: DataFrame, model: Fitted, keep: list[str] | list[Column], text: str) -> DataFrame:
    """The struct ``_row`` of ``keep``, with h, cross-entropies by language, and letters, whether there are any."""
    source = docs.select(
        F.monotonically_increasing_id().alias("_key"), F.struct(*keep).alias("_row"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model.head)
    n_langs = len(model.langs)

    def work(batches):
        keys, values = shared.value
        for batch in batches:
            for piece in texts.pieces(batch, "text"):
                n = piece.num_rows
                data, bounds = texts.buffers(piece.column("text"))
                sums, lengths, letters = np.zeros((n, n_langs), dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n)
                others = []
                for packed, rows in grams(data, bounds):
                    distinct, at = np.unique(packed, return_inverse=True)
                    place = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
                    there = keys[place] == distinct if len(keys) else np.zeros(len(distinct), dtype=bool)
                    for k in range(n_langs):
                        own = np.where(there, values[place, k], 0) if len(keys) else np.zeros(len(distinct))
                        # Sums below 2^53 are exact: a few million grams of at most some 2^29 units.
                        sums[:, k] += np.bincount(rows, own[at], n).astype(np.int64)
                    lengths += np.bincount(rows, minlength=n)
                    letters += np.bincount(rows, (distinct & np.uint64(0xFFFF) != SPACE)[at], n)
                    left = ~there[at]
                    if left.any():
                        others.append((rows[left], packed[left]))
                row, gram = (np.concatenate(x) for x in zip(*others)) if others else (
                    np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint64))
                order = np.lexsort((gram, row))
                row, gram = row[order], gram[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
                starts = np.flatnonzero(new)
                times = np.diff(np.append(starts, len(row)))
                cuts = pa.array(np.searchsorted(row[starts], np.arange(n + 1)), pa.int32())
                lists = lambda x: pa.ListArray.from_arrays(cuts, pa.array(x))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("_key"), piece.column("_row"), pa.array(list(sums), pa.list_(pa.int64())),
                     pa.array(lengths), pa.array(letters > 0), lists(gram[starts].view(np.int64)), lists(times)],
                    names=["_key", "_row", "sums", "length", "letters", "grams", "times"])

    numbers = T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("_key", T.LongType()), T.StructField("_row", source.schema["_row"].dataType),
        T.StructField("sums", numbers), T.StructField("length", T.LongType()), T.StructField("letters", T.BooleanType()),
        T.StructField("grams", numbers), T.StructField("times", numbers)])
    part = written(source.mapInArrow(work, schema), "entropies")
    rest = part.select("_key", F.explode(F.arrays_zip("grams", "times")).alias("x")).select(
        "_key", F.col("x.grams").alias("key"), F.col("x.times").alias("times"))
    more = rest.join(model.surprise(rest.select("key").distinct()), "key").groupBy("_key").agg(
        F.array(*(F.sum(F.col("times") * F.col("s")[k]) for k in range(n_langs))).alias("more"))
    whole = part.where(F.size("grams") == 0).select("_row", "sums", "length", "letters")
    joined = part.where(F.size("grams") > 0).join(more, "_key").select(
        "_row", F.zip_with("sums", "more", lambda a, b: a + b).alias("sums"), "length", "letters")
    return whole.unionAll(joined).select("_row", F.transform(
        "sums", lambda x: x / F.lit(float(UNIT)) / F.greatest("length", F.lit(1))).alias("h"), "letters")


def _calibrated(model: Fitted, found: DataFrame) -> Fitted:
    """With the temperature and the limits that all rows of ``found`` (lang, h) give."""
    langs = model.langs

    def losses(batches):
        sums = np.zeros(len(TEMPERATURES), dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            entropy = batch.column("h").flatten().to_numpy().reshape(n, -1)
            truth = np.searchsorted(langs, batch.column("lang").to_pylist())
            for k, t in enumerate(TEMPERATURES):
                p = probabilities(entropy, t)[np.arange(n), truth]
                # whole units, so that the order of rows does not matter
                sums[k] += np.rint(-np.log(np.maximum(p, 1e-12)) * UNIT).astype(np.int64).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["k", "loss"])

    loss = dict(found.mapInArrow(losses, "k int, loss long").groupBy("k").agg(F.sum(F.col("loss").cast("decimal(38,0)"))).collect())
    place = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int")
    own = found.select("lang", F.element_at("h", place).alias("x"))
    limit = dict(doc_stats.quantiles(own, ["lang"], "x", [1 - MAX_REJECTED]).select("lang", "x").collect())
    if not limit:
        return model
    return replace(model, temperature=float(TEMPERATURES[min(loss, key=lambda k: (loss[k], k))]),
                   limits=tuple(limit.get(x, np.inf) for x in langs))


def identify(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """``predict`` of the documents that the model is fitted on; each text is scored once for limits and prediction."""
    model = _tables(_learnable(docs, text, lang, doc_id))
    if model is None:
        return predict(docs, None, keep, text)
    own = [F.struct(*keep).alias("own"), F.col(lang).cast("string").alias("lang"), _taught(text, lang, doc_id).alias("taught")]
    found = written(_entropies(docs, model, own, text), "scored")
    model = _calibrated(model, found.where("letters and _row.taught").select("_row.lang", "h"))
    return _judged(found.select(F.col("_row.own").alias("_row"), "h", "letters"), model)


def predict(docs: DataFrame, model: Fitted | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred, score (its probability) and rejected (unlike its language)."""
    texts.small_batches(docs.sparkSession)
    if model is None:
        return docs.select(F.struct(*keep).alias("_row")).select(
            "_row.*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"))
    return _judged(_entropies(docs, model, keep, text), model)


def _judged(source: DataFrame, model: Fitted) -> DataFrame:
    """``_row`` with lang_pred, score and rejected, from cross-entropies."""
    langs, temperature, limits = np.array(model.langs, dtype=object), model.temperature, np.array(model.limits)

    def work(batches):
        for batch in batches:
            n = batch.num_rows
            names, score, beyond = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.zeros(n, dtype=bool)
            if n:
                letters = batch.column("letters").to_numpy(zero_copy_only=False)
                entropy = batch.column("h").flatten().to_numpy().reshape(n, -1)
                best, rows = entropy.argmin(axis=1), np.arange(n)
                names[letters] = langs[best[letters]]
                score = np.where(letters, probabilities(entropy, temperature)[rows, best], 0.0)
                if len(limits):
                    beyond = letters & (entropy[rows, best] > limits[best])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(names, pa.string()), pa.array(score), pa.array(beyond)],
                names=["_row", "lang_pred", "score", "rejected"])

    schema = T.StructType([
        T.StructField("_row", source.schema["_row"].dataType), T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return source.mapInArrow(work, schema).select("_row.*", "lang_pred", "score", "rejected")
