"""Feature relationships learned from walks over the feature graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.expr import finite
from panelspark.functions.ranking import draw_of
from panelspark.session import written

# Learning constants and the two parameter sets.
LEARNING_RATE, REINFORCEMENT, DECAY = 0.05, 0.02, 0.95
MAX_STRENGTH, MIN_STEP, CLOSE_ENOUGH, NOISE = 3.0, 0.1, 0.1, 0.01
START_STRENGTH = (0.01, 0.1)
ERROR_SCALE, MIN_WEIGHT, FORGET_BELOW = 2.0, 1e-6, 0.01
NORMAL = {"n_paths": 8, "max_length": 4, "cap": 60, "min_strength": 0.25, "top_k": 20}
YOLO = {"n_paths": 16, "max_length": 6, "cap": 120, "min_strength": 0.2, "top_k": 80}

WALK_SCHEMA = "kind string, i int, j int, path array<int>, value double"
#: Paths and edges that a task holds before it hands them on, and bytes of the index that is broadcast.
MAX_HELD_PATHS, MAX_INDEX = 100_000, 512 << 20


@dataclass
class Mined:
    edges: DataFrame  # f1_idx, f2_idx, feature1, feature2, strength (all pairs)
    importance: DataFrame  # idx, feature, importance
    paths: DataFrame  # path (sorted feature positions), success


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix constants): equal input, equal draw, anywhere."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(rows: np.ndarray, *keys: int) -> np.ndarray:
    h = rows
    for k in keys:
        h = _mix(h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF))
    return h


def _columns(n: int) -> np.ndarray:
    return np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)


def start_strengths(i: int, n: int, seed: int) -> np.ndarray:
    """The strengths from feature ``i`` before anything is learned: drawn by hashing, so never stored."""
    h = _uniform(np.array([seed], dtype=np.uint64), i)
    share = (_mix(h + _columns(n)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    low, high = START_STRENGTH
    return low + (high - low) * share


def strengths_of(i: int, n: int, seed: int, at: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """All strengths from feature ``i``; gains of learned edges are added to what it started with."""
    s = start_strengths(i, n, seed)
    s[at] = np.minimum(MAX_STRENGTH, s[at] + gain)
    return s


@dataclass
class Index:
    """For every feature its neighbours that a walk can ever choose, strongest first."""

    first: np.ndarray  # where a feature's neighbours begin, and the end of all
    to: np.ndarray
    strength: np.ndarray


def reachable(s: np.ndarray, i: int, max_length: int) -> np.ndarray:
    """Features that can be the strongest but for noise when up to ``max_length`` others are visited."""
    s = s.copy()
    s[i] = -1.0
    order = np.argsort(-s, kind="stable")
    least = max(MIN_STEP, s[order[min(max_length, len(s)) - 1]]) - NOISE
    return order[: int(np.searchsorted(-s[order], -least, "right"))]


def walk(x: np.ndarray, y: np.ndarray, rows: np.ndarray, index: Index, path_no: int, max_length: int):
    """One walk per row, all rows at once: (positions with -1 after the end, success).

    A step goes to the strongest neighbour that is not on the path yet, with a little noise. Only
    neighbours in the index are looked at, as no other can win.
    """
    n_rows, n = x.shape
    columns = _columns(n)
    base = _uniform(rows, path_no)
    current = (base % np.uint64(n)).astype(np.int64)
    steps = np.full((n_rows, max_length), -1, dtype=np.int64)
    steps[:, 0] = current
    total = x[np.arange(n_rows), current].copy()
    weight = np.ones(n_rows)
    alive = np.ones(n_rows, dtype=bool)
    for step in range(1, max_length):
        count = index.first[current + 1] - index.first[current]
        going = np.flatnonzero(alive & (count > 0))
        alive[:] = False
        if not len(going):
            break
        size = count[going]
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        owner = np.repeat(np.arange(len(going)), size)
        flat = np.arange(size.sum()) - starts[owner] + index.first[current[going]][owner]
        to, row = index.to[flat], going[owner]
        draw = _mix(_uniform(base[row], step) + columns[to])
        noise = (draw >> np.uint64(11)).astype(np.float64) * (NOISE / 2.0**53)
        seen = (steps[row] == to[:, None]).any(axis=1)
        strength = np.where(seen, 0.0, index.strength[flat]) + noise
        best = np.maximum.reduceat(strength, starts)
        hits = np.flatnonzero(strength == best[owner])
        _, one = np.unique(owner[hits], return_index=True)
        place = hits[one]
        good = best >= MIN_STEP
        going, place = going[good], place[good]
        nxt, w = to[place], index.strength[flat[place]]
        total[going] += x[going, nxt] * w
        weight[going] += w
        steps[going, step] = nxt
        current[going] = nxt
        close = np.abs(total[going] / np.maximum(weight[going], MIN_WEIGHT) - y[going]) < CLOSE_ENOUGH
        alive[going[~close]] = True
    error = np.abs(total / np.maximum(weight, MIN_WEIGHT) - y)
    success = np.maximum(0.0, np.nan_to_num(1.0 - ERROR_SCALE * error, nan=0.0))
    return steps, np.where(steps[:, 1] >= 0, success, 0.0)


def _walker(shared, n: int, n_paths: int, max_length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        edges: dict[int, float] = {}
        importance = np.zeros(n)
        held: dict[tuple, float] = {}

        def out():
            if held:
                yield pd.DataFrame({"kind": "path", "i": -1, "j": -1, "path": [list(k) for k in held], "value": list(held.values())})
            if edges:
                code = np.fromiter(edges, np.int64, len(edges))
                yield pd.DataFrame({"kind": "edge", "i": code // n, "j": code % n, "path": [[] for _ in code], "value": list(edges.values())})
            held.clear()
            edges.clear()

        for batch in batches:
            if not len(batch):
                continue
            x = np.array(batch["x"].tolist(), dtype=np.float64).reshape(len(batch), n)
            y = batch["y"].to_numpy(dtype=np.float64)
            rows = batch["h"].to_numpy(dtype=np.int64).view(np.uint64)
            for p in range(n_paths):
                steps, success = walk(x, y, rows, index, p, max_length)
                won = success > 0
                steps, success = steps[won], success[won]
                if not len(steps):
                    continue
                ok = steps[:, 1:] >= 0
                code, value = (steps[:, :-1] * n + steps[:, 1:])[ok], np.broadcast_to(success[:, None], ok.shape)[ok]
                keys, where = np.unique(code, return_inverse=True)
                for key, add in zip(keys.tolist(), np.bincount(where, value, len(keys)).tolist()):
                    edges[key] = edges.get(key, 0.0) + add
                on = steps >= 0
                importance += np.bincount(steps[on], np.broadcast_to(success[:, None], on.shape)[on], n)
                keys, where = np.unique(np.sort(steps, axis=1), axis=0, return_inverse=True)
                for key, add in zip(keys.tolist(), np.bincount(where.ravel(), success, len(keys)).tolist()):
                    k = tuple(v for v in key if v >= 0)
                    held[k] = held.get(k, 0.0) + add
            if len(held) + len(edges) > MAX_HELD_PATHS:
                yield from out()
        yield from out()
        c = np.nonzero(importance)[0]
        if len(c):
            yield pd.DataFrame({"kind": "node", "i": c, "j": -1, "path": [[] for _ in c], "value": importance[c]})

    return run


EDGE = "i int, j int, gain double"


def _rows_of_gains(spark, gains: DataFrame, n: int) -> DataFrame:
    """(i, at, gain): every feature with its learned edges as arrays."""
    lists = gains.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "gain"))).alias("e"))
    return spark.range(n).select(F.col("id").cast("int").alias("i")).join(lists, "i", "left").select(
        "i", F.coalesce(F.col("e.j"), F.array().cast("array<int>")).alias("at"),
        F.coalesce(F.col("e.gain"), F.array().cast("array<double>")).alias("gain"))


def neighbour_index(spark, gains: DataFrame, n: int, seed: int, max_length: int) -> Index:
    """The index of all features, each made from its own learned edges in a task."""

    def run(batches):
        for batch in batches:
            to, strength = [], []
            for i, at, gain in zip(batch["i"], batch["at"], batch["gain"]):
                s = strengths_of(int(i), n, seed, np.asarray(at, dtype=np.int64), np.asarray(gain, dtype=np.float64))
                near = reachable(s, int(i), max_length)
                to.append(near.tolist())
                strength.append(s[near].tolist())
            yield pd.DataFrame({"i": batch["i"], "to": to, "strength": strength})

    table = written(_rows_of_gains(spark, gains, n).mapInPandas(run, "i int, to array<int>, strength array<double>"), "neighbours")
    size = table.agg(F.sum(F.size("to"))).first()[0] or 0
    if 16 * size > MAX_INDEX:
        raise ValueError(f"{size} neighbours are too many to broadcast; choose features first")
    rows = table.orderBy("i").toArrow()
    to, strength = (rows.column(c).combine_chunks() for c in ("to", "strength"))
    first = np.concatenate([[0], np.cumsum(to.value_lengths().to_numpy())]).astype(np.int64)
    return Index(first, to.flatten().to_numpy().astype(np.int64), strength.flatten().to_numpy())


def mine_relationships(
    df: DataFrame,
    features: list[str],
    target: str,
    n_paths: int = NORMAL["n_paths"],
    max_length: int = NORMAL["max_length"],
    cap: int | None = None,
    batches: int = 4,
    seed: int = 42,
    keys: list[str] | None = None,
) -> Mined:
    """Learns edge strengths in a few rounds over hash-chosen parts of the rows.

    Within a round the strengths are fixed, so rows are walked independently and their summed
    successes become gains in a table of edges. What features start with is hashed, so only learned
    edges are kept anywhere, and the walks get an index of the neighbours that can win: no matrix
    of all pairs exists. Draws are hashes of the row, or of ``keys``, so the result does
    not depend on the number of partitions.
    """
    features = features if cap is None else features[:cap]
    n, spark = len(features), df.sparkSession
    x = F.array(*[F.coalesce(finite(F.col(f)), F.lit(float("nan"))) for f in features])
    y = F.coalesce(finite(F.col(target)), F.lit(float("nan")))
    h = draw_of([F.col(k) for k in keys], seed) if keys else F.xxhash64(F.lit(seed), "x", "y")
    rows = df.select(x.alias("x"), y.alias("y"), *(keys or [])).select("x", "y", h.alias("h"))
    # one write lets each round read only its own part
    parts = written(
        rows.withColumn("part", F.pmod("h", F.lit(batches)).cast("int")), "walk", ["part"]
    )
    gains, tables = spark.createDataFrame([], EDGE), []
    for part in range(batches):
        shared = spark.sparkContext.broadcast(neighbour_index(spark, gains, n, seed, max_length))
        found = (
            parts.where(F.col("part") == part)
            .select("x", "y", "h")
            .mapInPandas(_walker(shared, n, n_paths, max_length), WALK_SCHEMA)
        )
        summed = written(
            found.groupBy("kind", "i", "j", "path").agg(F.sum("value").alias("value")), "walked"
        )
        tables.append(summed)
        delta = summed.where("kind = 'edge'").select("i", "j", (LEARNING_RATE * REINFORCEMENT * F.col("value")).alias("gain"))
        back = delta.select(F.col("j").alias("i"), F.col("i").alias("j"), "gain")
        gains = written(
            gains.unionByName(delta).unionByName(back).groupBy("i", "j").agg(F.sum("gain").alias("gain")), "gains")
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table)
    names = F.array(*[F.lit(f) for f in features])
    memory = (
        every.where("kind = 'path'").groupBy("path")
        .agg((F.sum("value") * DECAY).alias("success"))
        .where(F.col("success") >= FORGET_BELOW)
    )
    sums = every.where("kind = 'node'").groupBy("i").agg(F.sum("value").alias("value"))
    importance = spark.range(n).select(F.col("id").cast("int").alias("i")).join(sums, "i", "left").select(
        F.col("i").alias("idx"), names[F.col("i")].alias("feature"),
        (F.coalesce("value", F.lit(0.0)) * LEARNING_RATE * DECAY).alias("importance"))

    def all_edges(batches):
        for batch in batches:
            for i, at, gain in zip(batch["i"], batch["at"], batch["gain"]):
                i = int(i)
                s = strengths_of(i, n, seed, np.asarray(at, dtype=np.int64), np.asarray(gain, dtype=np.float64))
                yield pd.DataFrame({"f1_idx": i, "f2_idx": np.arange(i + 1, n, dtype=np.int32), "strength": s[i + 1:] * DECAY})

    edges = _rows_of_gains(spark, gains, n).mapInPandas(all_edges, "f1_idx int, f2_idx int, strength double").select(
        "f1_idx", "f2_idx", names[F.col("f1_idx")].alias("feature1"), names[F.col("f2_idx")].alias("feature2"), "strength")
    return Mined(edges, importance, memory)


def top_relationships(
    edges: DataFrame, min_strength: float = NORMAL["min_strength"], k: int = NORMAL["top_k"]
) -> DataFrame:
    keep = (F.col("f1_idx") < F.col("f2_idx")) & (F.col("strength") >= min_strength)
    return edges.where(keep).orderBy(F.col("strength").desc(), "f1_idx", "f2_idx").limit(k)


def relationship_sanity(
    edges: DataFrame, min_strength: float = NORMAL["min_strength"], k: int = NORMAL["top_k"]
) -> DataFrame:
    """Kept edges, strongest off-diagonal edge, and whether both are good enough."""
    upper = F.col("f1_idx") < F.col("f2_idx")
    kept = F.least(F.count_if(upper & (F.col("strength") >= min_strength)), F.lit(k))
    return edges.where(F.col("f1_idx") != F.col("f2_idx")).agg(
        kept.alias("relationships"), F.max("strength").alias("max_strength")
    ).withColumn(
        "passed",
        (F.col("relationships") > 0) & (F.col("max_strength") >= 0.8 * min_strength),
    )
