"""Exact rank correlations from sorted runs: tasks sort their own rows, only runs are shuffled.

A run holds the distinct values of one column in one group, in order, with how often each occurs and
the sums of what goes with it. Runs are dealt by group, column and range of values, so neither a
group nor a mass of equal values has to fit in a task, and merged there; ranks inside a range count
from its middle, so that the range's place among the others enters the sums as one number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Values of a column that a range should hold; ranges of a column at most, and sampled rows for each.
RANGE_ROWS = 1 << 18
MAX_CUTS, SAMPLE_PER_CUT = 8_000, 20
#: Numbers that a task sorts at once.
HELD = 1 << 19
RUN = "_pos int, _range int, v binary, w binary, s binary, q binary, bad double"
PART = "_pos int, _range int, n double, bad double, s_y double, s_yy double, s_ly double, s_ll double"


def _codes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's group, a row of every group); nulls are a value like others."""
    n = len(columns[0]) if columns else 0
    code = np.zeros(n, dtype=np.int64)
    for column in columns:
        coded = column.dictionary_encode()
        own = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        _, code = np.unique(code * (len(coded.dictionary) + 1) + own, return_inverse=True)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code.ravel(), first


def _lines(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary array whose items are the stretches of ``values`` between starts."""
    offsets = np.concatenate([starts, [len(values)]]).astype(np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, "<f8"))])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, how many each item holds) of a binary array."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]].copy().view("<f8") if data is not None else np.zeros(0)
    return flat, np.diff(offsets) // 8


def _places(v: np.ndarray, code: np.ndarray, own: list[np.ndarray | None]) -> np.ndarray:
    """The range of each value; values are sorted by group, ``own`` has the ends of every group's ranges."""
    at = np.zeros(len(v), np.int64)
    for g in np.flatnonzero([ends is not None and len(ends) > 0 for ends in own]):
        lo, hi = np.searchsorted(code, [g, g + 1])
        at[lo:hi] = np.searchsorted(own[g], v[lo:hi], "left")
    return at


def sorted_runs(groups: list[str], schema: pa.Schema, p: int, cuts: dict[int, list[np.ndarray]]):
    """Batches with group columns, ``_h``, ``_x``, ``_ry`` and ``_w`` to runs."""

    def emit(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        keys = [table.column(g).combine_chunks() for g in groups]
        code, first = _codes(keys) if keys else (np.zeros(table.num_rows, np.int64), np.zeros(1, np.int64))
        x = table.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, p)
        ry, weight = (table.column(c).to_numpy().astype(np.float64) for c in ("_ry", "_w"))
        ends = [cuts.get(h) for h in table.column("_h").combine_chunks().take(pa.array(first)).to_pylist()] if cuts else []
        for k in range(p):
            good = ~(np.isnan(x[:, k]) | np.isnan(ry))
            bad = np.bincount(code[~good], weight[~good], len(first))
            order = np.flatnonzero(good)[np.lexsort((x[good, k], code[good]))]
            c, v, w, y = code[order], x[order, k], weight[order], ry[order]
            if len(v):
                new = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (v[1:] != v[:-1])]))
                c, v = c[new], v[new]
                w, s, q = (np.add.reduceat(z, new) for z in (w, w * y, w * y * y))
                at = _places(v, c, [e and e[k] for e in ends])
                starts = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (at[1:] != at[:-1])]))
                yield pa.RecordBatch.from_arrays(
                    [*(key.take(pa.array(first[c[starts]])) for key in keys), pa.array(np.full(len(starts), k, np.int32)),
                     pa.array(at[starts].astype(np.int32)), *(_lines(z, starts) for z in (v, w, s, q)),
                     pa.array(np.zeros(len(starts)))], schema=schema)
            lost = np.flatnonzero(bad)
            if len(lost):
                none = pa.array([b""] * len(lost), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(key.take(pa.array(first[lost])) for key in keys), pa.array(np.full(len(lost), k, np.int32)),
                     pa.array(np.zeros(len(lost), np.int32)), none, none, none, none, pa.array(bad[lost])], schema=schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows * (p + 2)
            if size > HELD:
                yield from emit(held)
                held, size = [], 0
        if size:
            yield from emit(held)

    return run


def merged_runs(groups: list[str], schema: pa.Schema):
    """Runs, sorted by group, column and range, to sums of ranks."""

    def sums(table: pa.Table, code: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        (v, size), (w, _), (s, _), (q, _) = (_numbers(table.column(c).combine_chunks()) for c in "vwsq")
        own, many = np.repeat(code, size), len(first)
        bad = np.bincount(code, table.column("bad").to_numpy(), many)
        n, s_y, s_yy = (np.bincount(own, z, many) for z in (w, s, q))
        order = np.lexsort((v, own))
        c, v, w, s = own[order], v[order], w[order], s[order]
        s_ly, s_ll = np.zeros(many), np.zeros(many)
        if len(v):
            new = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (v[1:] != v[:-1])]))
            c, w, s = c[new], np.add.reduceat(w, new), np.add.reduceat(s, new)
            before = np.concatenate([[0.0], np.cumsum(n)])[c]
            rank = np.cumsum(w) - before - (w - 1) / 2 - (n[c] + 1) / 2
            s_ly, s_ll = np.bincount(c, rank * s, many), np.bincount(c, rank * rank * w, many)
        rows = pa.array(first)
        return pa.RecordBatch.from_arrays(
            [*(table.column(k).combine_chunks().take(rows) for k in [*groups, "_pos", "_range"]),
             *map(pa.array, (n, bad, s_y, s_yy, s_ly, s_ll))], schema=schema)

    def run(batches):
        held, size = [], 0

        def settle(last: bool):
            """Everything but the last group, which may go on in the next batch."""
            table = pa.Table.from_batches(held).combine_chunks()
            code, first = _codes([table.column(k).combine_chunks() for k in [*groups, "_pos", "_range"]])
            end = table.num_rows if last else int(np.flatnonzero(code == code[-1])[0])
            held.clear()
            if end < table.num_rows:
                held.extend(table.slice(end).combine_chunks().to_batches())
            if end:
                code, first = _codes([table.column(k).combine_chunks().slice(0, end) for k in [*groups, "_pos", "_range"]])
                return [sums(table.slice(0, end).combine_chunks(), code, first)]
            return []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += sum(len(b) for b in batch.column("v").to_pylist()) // 2
                if size > HELD:
                    yield from settle(False)
                    size = sum(sum(map(len, b.column("v").to_pylist())) // 2 for b in held)
        if held:
            yield from settle(True)

    return run


def _cuts(df: DataFrame, groups: list[str], features: list[str], n: int) -> dict[int, list[np.ndarray]]:
    """Ends of the ranges of every column, by the hash of a group; they decide balance only, never a result.

    They come from a bounded sample. A group gets as many ranges as its share of the sample asks for, so runs do
    not get shorter as groups get more; groups that the sample hardly holds have one range.
    """
    count = min(MAX_CUTS, -(-n // RANGE_ROWS) - 1)
    if count < 1:
        return {}
    most = SAMPLE_PER_CUT * (count + 1)
    drawn = F.pmod(F.xxhash64(*features), F.lit(1 << 30))
    share = min(1.0, 2 * most / n)
    table = df.select(_hash(groups).alias("_h"), *[F.col(f).cast("double").alias(f"_c{i}") for i, f in enumerate(features)]).where(
        drawn < int(share * (1 << 30))).limit(4 * most).toArrow()
    code = table.column("_h").to_numpy()
    order = np.argsort(code, kind="stable")
    names, starts = np.unique(code[order], return_index=True)
    found: dict[int, list[np.ndarray]] = {}
    for name, rows in zip(names.tolist(), np.split(order, starts[1:])):
        own = -(-len(rows) * (count + 1) // len(order)) - 1
        if own:
            columns = (table.column(f"_c{i}").take(pa.array(rows)).drop_null().to_numpy() for i in range(len(features)))
            found[name] = [
                np.unique(np.quantile(v, np.arange(1, own + 1) / (own + 1), method="lower")) if len(v) else np.zeros(0) for v in columns]
    return found


def _hash(groups: list[str]):
    return F.xxhash64(*groups) if groups else F.lit(0).cast("long")


def run_correlations(
    ranked: DataFrame, groups: list[str], features: list[str], rows: int, weight: str | None = None,
    sampled: DataFrame | None = None,
) -> DataFrame:
    """(groups, _pos, corr, n): correlation of each column's ranks with ``_ry``, the other side's centred ranks.

    A group with a missing value on either side has no correlation. ``rows`` tells about how many rows there are,
    ``sampled`` has the same rows without the rank, so that the sample needs no join.
    """
    spark = ranked.sparkSession
    own = [f"_g{i}" for i in range(len(groups))]
    source = ranked.select(
        *[F.col(g).alias(o) for g, o in zip(groups, own)], _hash(groups).alias("_h"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"),
        F.col("_ry").cast("double").alias("_ry"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    kept = "".join(f"{o} {source.schema[o].dataType.simpleString()}, " for o in own)
    arrow = lambda text: to_arrow_schema(spark.createDataFrame([], text).schema)
    runs = source.mapInArrow(
        sorted_runs(own, arrow(kept + RUN), len(features), _cuts(sampled if sampled is not None else ranked, groups, features, rows)), kept + RUN)
    keys = [*own, "_pos", "_range"]
    parts = runs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged_runs(own, arrow(kept + PART)), kept + PART)
    whole = Window.partitionBy(*own, "_pos")
    before = F.coalesce(F.sum("n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("n").over(whole)
    middle = before + (F.col("n") + 1) / 2 - (total + 1) / 2
    top = F.sum(F.col("_m") * F.col("s_y") + F.col("s_ly"))
    spread = F.sum(F.col("n") * F.col("_m") * F.col("_m") + F.col("s_ll"))
    found = parts.withColumn("_m", middle).groupBy(*own, "_pos").agg(
        F.when(F.sum("bad") == 0, F.try_divide(top, F.sqrt(spread * F.sum("s_yy")))).alias("corr"),
        F.sum(F.col("n") + F.col("bad")).cast("long").alias("n"))
    return found.select(*[F.col(o).alias(g) for g, o in zip(groups, own)], "_pos", "corr", "n")
