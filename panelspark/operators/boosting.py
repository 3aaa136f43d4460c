"""Boosted regression trees from histograms, many models at once.

Every row belongs to one segment (all rows, a regime, an era), and every segment has one or more
models (seeds, target blends). All models grow level by level together: a level is one pass over
the rows, in which tasks add up gradient histograms by (model, node, feature, bin), one shuffle
of histograms, and the choice of the best split of every node. Rows never leave their task, so a
segment may have any size; only tree nodes reach the driver, or histograms while they are few
(their size is known beforehand), which saves the shuffle.

Features are binned once, exactly where they have few distinct values. Rows with their bins, targets and
predictions so far are written to the shared folder and anew every few rounds, so lost executors
cost a pass, and a pass adds up no more than those rounds' trees.

Trees tell rows apart by their bins only, so rows of the same bins (a cell) always have the same prediction, and
what they were drawn for does not depend on trees. Without held-out rows, and while a segment cannot have more cells than
a task holds, rows are therefore read once: they are added up by (model, sample of rows, cell), and every model grows
all its trees from these sums in one task. Otherwise a level is a pass over the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.correlation import to_long
from panelspark.session import bounded, uncounted, written

BINS = 64
#: Features in one shuffled histogram; numbers a task holds before it hands histograms on.
BLOCK, HELD = 64, 1 << 22
#: Levels whose nodes are told apart by masks; deeper ones look up the split of every row.
MASKED = 3
#: Rows of a task, about, once there are more than the cores take at once.
TASK_ROWS = 1 << 19
#: Up to so many segments, rows without held-out ones are not sorted by them.
FEW_SEGMENTS = 8
#: Cells of a model that a task holds, sums of all models, samples and cells that are shuffled, cells at a time.
CELLS, SUMS, BLOCK_CELLS = 1 << 24, 1 << 29, 1 << 16
#: Up to so many predictions of all segments and cells are looked up instead of adding up trees.
LOOKED_UP = 1 << 21
#: Rounds between writings of the rows' predictions, and rounds that share a sample of rows.
STATE_ROUNDS, BAG_ROUNDS = 10, 5
MAX_MODELS = 100_000
#: Up to this many bytes of histograms from all tasks go to the driver as they are; more are shuffled first.
DIRECT = 64 << 20
#: What is summed over held-out rows: count, y, f, yy, ff, yf, squared error.
CHECKS = 7


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    depth: int = 6
    step: float = 0.05
    row_share: float = 0.8
    feature_share: float = 0.8
    min_rows: int = 20
    bins: int = BINS


@dataclass(frozen=True)
class ModelKey:
    """One model: its segment, the weights of its target, its seed, and the features it may use (all if None)."""

    segment: object
    weights: tuple[float, ...]
    seed: int = 0
    features: tuple[int, ...] | None = None


@dataclass
class Boosted:
    """Trees of all models; node k of a tree has the children 2k + 1 and 2k + 2."""

    features: list[str]
    cuts: list[np.ndarray]
    models: list[ModelKey]
    base: np.ndarray
    settings: Settings
    n_rows: int = 0
    feature: list[np.ndarray] = field(default_factory=list)
    bin: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    checks: list[np.ndarray] = field(default_factory=list)

    def of_segment(self) -> dict:
        found: dict = {}
        for k, model in enumerate(self.models):
            found.setdefault(model.segment, []).append(k)
        return found


def _places(feature: np.ndarray, bin_: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """Each row's place among the nodes of level ``depth``; ``x`` has a line for each feature.

    Rows of a node without a split stay in the first of the places below it; nothing below it is split.
    """
    n = x.shape[1]
    place, reach = np.zeros(n, dtype=np.intp), {0: None}
    for _ in range(min(depth, MASKED)):
        right, below = np.zeros(n, dtype=bool), {}
        for node, here in reach.items():
            f = feature[node]
            if f < 0:
                continue
            over = x[f] > bin_[node]
            if here is None:
                below[1], below[2] = ~over, over
            else:
                over &= here
                below[2 * node + 1], below[2 * node + 2] = here ^ over, over
            right |= over
        place += place
        place += right
        reach = below
    if depth > MASKED:
        # no bin is above the highest, so rows of a node without a split never go right
        flat, row = x.ravel(), np.arange(n)
        start = np.where(feature >= 0, feature, 0).astype(np.intp) * n
        end = np.where(feature >= 0, bin_, np.iinfo(x.dtype).max).astype(x.dtype)
        for level in range(MASKED, depth):
            nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
            at = start[nodes].take(place)
            at += row
            right = flat.take(at) > end[nodes].take(place)
            place += place
            place += right
    return place


def _leaves(feature: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    """The value of every place that ``_places`` gives."""
    out = np.zeros(2**depth)
    here = {0: 0}
    for level in range(depth + 1):
        below = {}
        for node, place in here.items():
            if level < depth and feature[node] >= 0:
                below[2 * node + 1], below[2 * node + 2] = 2 * place, 2 * place + 1
            else:
                out[place << (depth - level)] = value[node]
        here = below
    return out


def _leaf_values(feature: np.ndarray, bin_: np.ndarray, value: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """A tree's value for every row; ``x`` has a line of bins for each feature."""
    if feature[0] < 0:
        return np.full(x.shape[1], value[0])
    return _leaves(feature, value, depth).take(_places(feature, bin_, x, depth))


def _grown_nodes(feature: np.ndarray, level: int) -> np.ndarray:
    """Which nodes of a level hang from nodes that were all split."""
    alive = np.ones(1, dtype=bool)
    for k in range(level):
        alive = np.repeat(alive & (feature[2**k - 1: 2 ** (k + 1) - 1] >= 0), 2)
    return alive


def feature_cuts(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of all bins but the last: every value of coarse features, quantiles of others."""
    counts = df.agg(*[F.approx_count_distinct(f).alias(f"c{i}") for i, f in enumerate(features)]).first()
    coarse = [f for i, f in enumerate(features) if counts[i] <= 1.5 * bins]
    found: dict[str, list[float]] = {}
    if coarse:
        values = to_long(df, [], coarse).distinct()
        for r in values.groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("v")).collect():
            found[r["feature"]] = r["v"]
    fine = [f for f in features if f not in coarse or len(found.get(f, ())) > bins]
    if fine:
        places = [k / bins for k in range(1, bins)]
        row = df.agg(*[F.percentile_approx(f, places, 100 * bins).alias(f"q{i}") for i, f in enumerate(fine)]).first()
        for i, f in enumerate(fine):
            found[f] = sorted(set(row[i] or [])) + [float("inf")]
    return [np.array(found.get(f, [0.0])[:-1], dtype=np.float64) for f in features]


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, dtype=np.uint8)
    for k, ends in enumerate(cuts):
        out[:, k] = np.searchsorted(ends, x[:, k], "left")
    return out


#: A chunk of rows of one segment; x, y and f have a line for each feature, target and model.
STATE = "seg int, row binary, train binary, x binary, y binary, f binary"
STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]


def _chunk(seg: int, *parts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([seg], pa.int32()), *(pa.array([np.ascontiguousarray(m).tobytes()], pa.binary()) for m in parts)],
        names=STATE_NAMES)


def _chunks(batches, p: int):
    """(segment, row, train, x, y, f) of every chunk."""
    for batch in batches:
        for k in range(batch.num_rows):
            row, train, x, y, f = (
                np.frombuffer(batch.column(c)[k].as_buffer(), kind)
                for c, kind in zip(STATE_NAMES[1:], ("<i8", np.bool_, np.uint8, "<f8", "<f8")))
            n = len(row)
            yield batch.column("seg")[k].as_py(), row, train, x.reshape(p, n), y.reshape(-1, n), f.reshape(-1, n)


def _segments(batch: pa.RecordBatch):
    """(segment, its part) of a batch."""
    seg = batch.column("seg").to_numpy()
    order = np.argsort(seg, kind="stable")
    cuts = np.flatnonzero(np.diff(seg[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(seg[rows[0]]), batch if len(rows) == len(seg) else batch.take(pa.array(rows))


def _strides(cuts: list[np.ndarray]) -> list[int]:
    """What each feature's bin counts in the number of a cell; at last, how many cells there can be."""
    out = [1]
    for ends in cuts:
        out.append(out[-1] * (len(ends) + 1))
    return out


def _bins_of(cells: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bins of numbered cells, a line for each feature."""
    return np.stack([(cells // size % (len(ends) + 1)).astype(np.uint8) for size, ends in zip(_strides(cuts), cuts)])


def _cells_of(x: np.ndarray, strides: list[int]) -> np.ndarray:
    """The number of every row's cell; ``x`` has a line of bins for each feature."""
    cell = np.zeros(x.shape[1], dtype=np.int64)
    for size, column in zip(strides, x):
        cell += size * column.astype(np.int64)
    return cell


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h


def _drawn(row: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Which rows take part, by a hash of row, seed and turn."""
    if share >= 1:
        return np.ones(len(row), dtype=bool)
    mask = (1 << 64) - 1
    h = _mixed(row.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & mask))
    return (h >> np.uint64(11)) < np.uint64(int(share * (1 << 53)))


def chosen_features(own: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """The share of a model's features that its tree of this turn may split on."""
    if share >= 1:
        return own
    return np.random.default_rng([seed, turn]).choice(own, max(1, round(share * len(own))), replace=False)


HISTOGRAM = "model int, node int, block int, sums binary, counts binary"
SPLIT = "model int, node int, feature int, bin int, gain double, left_sum double, left_n double, total double, n double, checks binary"


def _level_pass(shared, turn: int, level: int, checking: bool):
    """Rows to histograms of one level; ``shared`` holds what the tasks need of the model."""

    def run(batches):
        job = shared.value
        p, settings, pending = job["p"], job["settings"], job["pending"]
        bins, first, width = settings.bins, 2**level - 1, 2**level
        held: dict = {}
        checks: dict = {}

        def hand_on():
            rows = []
            for (model, block), (sums, counts) in held.items():
                for node in np.flatnonzero(counts.any(axis=(1, 2))):
                    rows.append((model, int(node), block, sums[node].tobytes(), counts[node].tobytes()))
            rows += [(model, -1, 0, line.tobytes(), b"") for model, line in checks.items()]
            held.clear()
            checks.clear()
            for at in range(0, len(rows), 256):
                part = list(zip(*rows[at: at + 256]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.int32()),
                     pa.array(part[3], pa.binary()), pa.array(part[4], pa.binary())],
                    names=[c.split()[0] for c in HISTOGRAM.split(", ")])

        for seg, rows, train, x, y, f in _chunks(batches, p):
            drawn: dict = {}
            for slot, model in enumerate(job["of_segment"][seg]):
                goal, now = job["weights"][model] @ y, f[slot].copy()
                for tree in pending:
                    now += _leaf_values(tree[0][model], tree[1][model], tree[2][model], x, settings.depth)
                if checking and level == 0:
                    out = ~train
                    if out.any():
                        u, v = goal[out] - job["base"][model], now[out] - job["base"][model]
                        line = np.array([len(u), u.sum(), v.sum(), u @ u, v @ v, u @ v, ((u - v) ** 2).sum()])
                        checks[model] = checks.get(model, 0) + line
                if job["grown"] is None:
                    continue
                feature, bin_ = job["grown"][0][model], job["grown"][1][model]
                alive = _grown_nodes(feature, level)
                seed = job["seeds"][model]
                if seed not in drawn:
                    drawn[seed] = train & _drawn(rows, seed, turn // BAG_ROUNDS, settings.row_share)
                if not alive.any() or not drawn[seed].any():
                    continue
                # rows that take no part go to a place of their own behind the last
                place = np.where(drawn[seed], _places(feature, bin_, x, level), width) * bins
                left, size = goal - now, (width + 1) * bins
                for block in range(-(-p // job["block"])):
                    columns = x[block * job["block"]: (block + 1) * job["block"]]
                    if (model, block) not in held:
                        held[model, block] = (np.zeros((width, len(columns), bins)), np.zeros((width, len(columns), bins)))
                    sums, counts = held[model, block]
                    for k, column in enumerate(columns):
                        code = place + column
                        for total, add in ((sums, np.bincount(code, left, size)), (counts, np.bincount(code, minlength=size))):
                            total[alive, k] += add[:-bins].reshape(width, bins)[alive]
                if sum(h[0].size for h in held.values()) > HELD:
                    yield from hand_on()
        yield from hand_on()

    return run


def _added(parts: list[bytes]) -> np.ndarray:
    return np.sum([np.frombuffer(b, "<f8") for b in parts], axis=0)


def best_split(job: dict, turn: int, model: int, node: int, block: int, sums: list[bytes], counts: list[bytes]) -> tuple:
    """The split of a node with the largest gain among one block of features, from the tasks' histograms."""
    settings = job["settings"]
    if node < 0:
        return model, node, -1, -1, 0.0, 0.0, 0.0, 0.0, 0.0, _added(sums).tobytes()
    sums, counts = (_added(x).reshape(-1, settings.bins) for x in (sums, counts))
    total, n = sums[0].sum(), counts[0].sum()
    own = np.arange(len(sums)) + block * job["block"]
    mine = np.arange(job["p"]) if job["features"][model] is None else np.array(job["features"][model])
    allowed = np.isin(own, chosen_features(mine, job["seeds"][model], turn, settings.feature_share))
    left, left_n = np.cumsum(sums, axis=1)[:, :-1], np.cumsum(counts, axis=1)[:, :-1]
    good = allowed[:, None] & (left_n >= settings.min_rows) & (n - left_n >= settings.min_rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(good, left**2 / left_n + (total - left) ** 2 / (n - left_n) - total**2 / n, -np.inf)
    best = int(np.argmax(gain))
    f, b = divmod(best, gain.shape[1])
    if not good.flat[best]:
        return model, node, -1, -1, -1.0, 0.0, 0.0, total, n, b""
    return model, node, int(own[f]), b, gain.flat[best], left.flat[best], left_n.flat[best], total, n, b""


def _split_of_parts(shared, turn: int):
    def run(key, parts):
        model, node, block = (k.as_py() for k in key)
        row = best_split(shared.value, turn, model, node, block, parts.column("sums").to_pylist(), parts.column("counts").to_pylist())
        schema = pa.schema([(c.split()[0], {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}[c.split()[1]])
                            for c in SPLIT.split(", ")])
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

    return run


def _splits_here(job: dict, turn: int, histograms: pa.Table) -> pd.DataFrame:
    """The same on the driver, for histograms that are few."""
    found: dict[tuple, tuple[list, list]] = {}
    for model, node, block, sums, counts in zip(*(histograms.column(c).to_pylist() for c in histograms.column_names)):
        both = found.setdefault((model, node, block), ([], []))
        both[0].append(sums)
        both[1].append(counts)
    rows = [best_split(job, turn, *key, *found[key]) for key in sorted(found)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SPLIT.split(", ")])


SCATTERED = "bucket int, seg int, row binary, cell binary, y binary"
CELL_SUMS = "model int, bag int, chunk int, counts binary, sums binary"
TREES = "model int, feature binary, bin binary, value binary"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(part, types[kind]) for part, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields])


def _scatter(shared, buckets: int):
    """Rows with their cells, dealt by cell; of a cell that many rows share, only some go to its own bucket."""

    def run(batches):
        cuts = shared.value["cuts"]
        sizes = _strides(cuts)
        held: dict[int, list] = {}

        def deal(seg):
            row, cell, y = (np.concatenate(part, axis=-1) for part in zip(*held.pop(seg)))
            order = np.lexsort((row, cell))
            row, cell, y = row[order], cell[order], y[:, order]
            own = np.arange(len(row)) - np.searchsorted(cell, cell, "left")
            turn = (own // max(64, len(row) // (4 * buckets))).astype(np.uint64)
            salt = np.where(turn > 0, turn + np.uint64((int(row[0]) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)), np.uint64(0))
            bucket = (_mixed(_mixed(cell.astype(np.uint64)) + salt) >> np.uint64(11)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                yield int(bucket[rows[0]]), seg, row[rows].tobytes(), cell[rows].tobytes(), np.ascontiguousarray(y[:, rows]).tobytes()

        def batched(rows):
            part = []
            for r in rows:
                part.append(r)
                if len(part) == 64:
                    yield _batch(SCATTERED, part)
                    part = []
            if part:
                yield _batch(SCATTERED, part)

        for seg, row, _, x, y, _ in _chunks(batches, len(cuts)):
            held.setdefault(seg, []).append((row, _cells_of(x, sizes), y))
            if sum(len(part[0]) for part in held[seg]) >= TASK_ROWS:
                yield from batched(deal(seg))
        for seg in sorted(held):
            yield from batched(deal(seg))

    return run


def _bags(settings: Settings) -> int:
    """How many samples of rows the rounds take."""
    return -(-settings.rounds // BAG_ROUNDS) if settings.row_share < 1 else 1


def _cell_sums(shared):
    """Counts and sums of targets by (model, sample of rows, cell) of a task's rows; first, as sample -1, which cells."""

    def run(batches):
        job, chunk = shared.value, TaskContext.get().partitionId()
        settings = job["settings"]
        held: dict[int, list] = {}
        for batch in batches:
            for k, seg in enumerate(batch.column("seg").to_pylist()):
                row, cell, y = (np.frombuffer(batch.column(c)[k].as_buffer(), kind)
                                for c, kind in (("row", "<i8"), ("cell", "<i8"), ("y", "<f8")))
                held.setdefault(seg, []).append((row, cell, y.reshape(-1, len(row))))
        for seg in sorted(held):
            row, cell, y = (np.concatenate(part, axis=-1) for part in zip(*held.pop(seg)))
            # the order of sums does not hang on the order in which blocks arrive
            order = np.lexsort((row, cell))
            row, y = row[order], y[:, order]
            cells, at = np.unique(cell[order], return_inverse=True)
            for model in job["of_segment"][seg]:
                yield _batch(CELL_SUMS, [(model, -1, chunk, cells.astype("<i8").tobytes(), b"")])
                goal = job["weights"][model] @ y
                for bag in range(_bags(settings)):
                    goes = _drawn(row, job["seeds"][model], bag, settings.row_share)
                    here = at[goes]
                    counts, sums = np.bincount(here, minlength=len(cells)), np.bincount(here, goal[goes], len(cells))
                    yield _batch(CELL_SUMS, [(model, bag, chunk, counts.astype("<i4").tobytes(), sums.tobytes())])

    return run


def _tree(job: dict, model: int, turn: int, x: np.ndarray, n: np.ndarray, y: np.ndarray, f: np.ndarray) -> tuple:
    """The tree of one turn from cells: their bins, drawn rows, those rows' sums of targets, and predictions, which it changes."""
    settings, size = job["settings"], len(n)
    nodes, bins, p = 2 ** (settings.depth + 1) - 1, settings.bins, len(x)
    feature, bin_, value = np.full(nodes, -1, np.int16), np.zeros(nodes, np.uint8), np.zeros(nodes)
    place = np.zeros(size, np.int32)
    blocks = [slice(at, min(at + BLOCK_CELLS, size)) for at in range(0, size, BLOCK_CELLS)]
    for level in range(settings.depth):
        first, width = 2**level - 1, 2**level
        alive = _grown_nodes(feature, level)
        if alive.any():
            sums, counts = np.zeros((p, width * bins)), np.zeros((p, width * bins))
            for block in blocks:
                start, times = place[block].astype(np.intp) * bins, n[block].astype(np.float64)
                left = y[block] - times * f[block]
                for k in range(p):
                    code = start + x[k, block]
                    sums[k] += np.bincount(code, left, width * bins)
                    counts[k] += np.bincount(code, times, width * bins)
            sums, counts = sums.reshape(p, width, bins), counts.reshape(p, width, bins)
            for node in np.flatnonzero(alive & counts[0].any(axis=1)):
                _, _, own, cut, gain, left_sum, left_n, total, taught, _ = best_split(
                    job, turn, model, int(node), 0, [sums[:, node].tobytes()], [counts[:, node].tobytes()])
                at = first + node
                if level == 0:
                    value[at] = settings.step * total / taught
                if own >= 0 and gain > 0:
                    feature[at], bin_[at] = own, cut
                    value[2 * at + 1] = settings.step * left_sum / left_n
                    value[2 * at + 2] = settings.step * (total - left_sum) / (taught - left_n)
        # no bin is above the highest, so cells of a node without a split never go right
        split = feature[first: first + width] >= 0
        if split.any():
            own = np.where(split, feature[first: first + width], 0).astype(np.intp)
            end = np.where(split, bin_[first: first + width], np.iinfo(x.dtype).max).astype(x.dtype)
            for block in blocks:
                here, part = place[block], x[:, block]
                at = own.take(here) * part.shape[1]
                at += np.arange(part.shape[1])
                place[block] = 2 * here + (part.ravel().take(at) > end.take(here))
        else:
            place *= 2
    leaves = _leaves(feature, value, settings.depth)
    for block in blocks:
        f[block] += leaves.take(place[block])
    return feature, bin_, value


def _grow(shared):
    """All trees of each model, from its sums in the order of samples."""

    def read(batches):
        for batch in batches:
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("model", "bag", "chunk")))):
                yield *key, batch.column("counts")[k].as_buffer(), batch.column("sums")[k].as_buffer()

    def run(batches):
        job = shared.value
        settings, bags = job["settings"], _bags(job["settings"])
        for model, own in groupby(read(batches), itemgetter(0)):
            trees = []
            for bag, parts in groupby(own, itemgetter(1)):
                if bag < 0:
                    found = {chunk: np.frombuffer(cells, "<i8").copy() for _, _, chunk, cells, _ in parts}
                    cells = np.unique(np.concatenate(list(found.values())))
                    at = {chunk: np.searchsorted(cells, some).astype(np.int32) for chunk, some in found.items()}
                    x, f = _bins_of(cells, job["cuts"]), np.full(len(cells), job["base"][model])
                    del found, cells
                    continue
                n, y = np.zeros(len(f), np.int64 if job["many"] else np.int32), np.zeros(len(f))
                for _, _, chunk, counts, sums in parts:
                    n[at[chunk]] += np.frombuffer(counts, "<i4")
                    y[at[chunk]] += np.frombuffer(sums, "<f8")
                turns = range(bag * BAG_ROUNDS, min(settings.rounds, (bag + 1) * BAG_ROUNDS)) if bags > 1 else range(settings.rounds)
                trees += [_tree(job, model, turn, x, n, y, f) for turn in turns]
            yield _batch(TREES, [(model, *(np.stack(part).tobytes() for part in zip(*trees)))])

    return run


def _grown_from_cells(state: DataFrame, fixed: dict, out: Boosted, buckets: int) -> Boosted:
    """Adds the trees of all models, each grown in one task."""
    models, settings = len(out.models), out.settings
    shared = state.sparkSession.sparkContext.broadcast(fixed)
    tasks = min(models, 4 * max(1, state.sparkSession.sparkContext.defaultParallelism))
    dealt = state.mapInArrow(_scatter(shared, buckets), SCATTERED).repartitionById(buckets, F.col("bucket"))
    sums = dealt.mapInArrow(_cell_sums(shared), CELL_SUMS).repartitionById(tasks, F.col("model") % tasks)
    trees = sums.sortWithinPartitions("model", "bag", "chunk").mapInArrow(_grow(shared), TREES).toArrow()
    shared.unpersist()
    nodes = 2 ** (settings.depth + 1) - 1
    # a model without rows has no sums
    whole = [np.full((settings.rounds, models, nodes), -1, np.int16), np.zeros((settings.rounds, models, nodes), np.uint8),
             np.zeros((settings.rounds, models, nodes))]
    for model, *parts in zip(*(trees.column(c).to_pylist() for c in trees.column_names)):
        for all_, part in zip(whole, parts):
            all_[:, model] = np.frombuffer(part, all_.dtype).reshape(settings.rounds, nodes)
    out.feature, out.bin, out.value = (list(part) for part in whole)
    return out


def boost(df: DataFrame, features: list[str], targets: list[str], models: list[ModelKey], segment: str,
          settings: Settings, train: str | None = None, least: int = 0) -> Boosted:
    """Trains all models at once; ``segment`` names the column that tells rows' models.

    Rows of other segments are left out. With ``train``, only rows where that column is true teach, and
    the others are checked after every round (``Boosted.checks``). Segments of fewer than ``least`` rows get no
    model. Missing features count as 0, rows without a target are for the caller to drop. Deterministic for given rows and seeds.
    """
    if len(models) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models at once; train them in turns")
    spark, p = df.sparkSession, len(features)
    if not models:
        return Boosted(features, [], [], np.zeros(0), settings)
    columns, goals = [f"_x{i}" for i in range(p)], [f"_y{t}" for t in range(len(targets))]
    cells = df.select(
        F.col(segment).alias("_seg"), (F.col(train) if train else F.lit(True)).alias("train"),
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(c) for c, f in zip(columns, features)],
        *[F.col(t).cast("double").alias(c) for c, t in zip(goals, targets)])
    # written once: sizes, cuts, means and rows would each work out ``df`` anew
    cells = written(cells.withColumn("row", F.monotonically_increasing_id()), "boosting-cells")
    if least:
        sizes = {r["_seg"]: r["count"] for r in cells.groupBy("_seg").count().collect()}
        models = [m for m in models if sizes.get(m.segment, 0) >= least]
        if not models:
            return Boosted(features, [], [], np.zeros(0), settings)
    names = list(dict.fromkeys(m.segment for m in models))
    places = {s: k for k, s in enumerate(names)}
    cuts = feature_cuts(cells, columns, settings.bins)
    few = len(names) <= (FEW_SEGMENTS if train is None else min(FEW_SEGMENTS, 1))
    if few:
        number = F.coalesce(*[F.when(F.col("_seg") == F.lit(s), F.lit(k)) for s, k in places.items()])
        kept = cells.withColumn("seg", number).where("seg IS NOT NULL")
    else:
        numbers = spark.createDataFrame([(s, k) for s, k in places.items()], T.StructType(
            [T.StructField("_seg", cells.schema["_seg"].dataType), T.StructField("seg", T.IntegerType())]))
        kept = cells.join(bounded(numbers), "_seg")
    kept = kept.select("seg", "row", "train", *columns, *goals)
    slots = np.bincount([places[m.segment] for m in models], minlength=len(names))

    def first(batches):
        for batch in batches:
            for seg, part in _segments(batch):
                n = part.num_rows
                x = np.stack([part.column(c).to_numpy() for c in columns], axis=1)
                y = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in goals])
                train = part.column("train").to_numpy(zero_copy_only=False)
                f = np.zeros((0 if from_cells else slots[seg], n))
                yield _chunk(seg, part.column("row").to_numpy(), train, _binned(x, cuts).T, y, f)

    sums = kept.groupBy("seg").agg(
        F.count("*").alias("n"), F.count_if("train").alias("taught"),
        *[F.avg(F.when(F.col("train"), F.col(c))).alias(c) for c in goals]).collect()
    size_of = {r["seg"]: r["n"] for r in sums}
    cell_counts = [min(size_of.get(k, 0), _strides(cuts)[-1]) for k in range(len(names))]
    from_cells = (
        train is None and _strides(cuts)[-1] < 1 << 62 and max(cell_counts) <= CELLS
        and sum(n * slots[k] for k, n in enumerate(cell_counts)) * _bags(settings) <= SUMS)
    mean_of = {r["seg"]: np.array(r[3:], dtype=np.float64) for r in sums if r["taught"]}
    # every wave of tasks fills all cores
    cores = max(1, spark.sparkContext.defaultParallelism)
    waves = max(1, -(-sum(r["n"] for r in sums) // (cores * TASK_ROWS)))
    # rows of few segments stay in the tasks of their files, if there are files for all cores
    sorted_ = not few or train is not None or len(cells.inputFiles()) < cores
    if sorted_:
        kept = kept.repartitionByRange(cores * waves, "seg", "row").sortWithinPartitions("seg", "row")
    with uncounted(spark, len(kept.columns)):
        state = written(kept.mapInArrow(first, STATE), "boosting-rows")
    weights = np.array([m.weights for m in models])
    base = np.array([float(weights[k] @ mean_of.get(places[m.segment], np.zeros(len(targets)))) for k, m in enumerate(models)])
    out = Boosted(features, cuts, models, base, settings, sum(size_of.values()))
    of_segment: list[list[int]] = [[] for _ in names]
    for k, m in enumerate(models):
        of_segment[places[m.segment]].append(k)
    nodes = 2 ** (settings.depth + 1) - 1
    fixed = {"p": p, "block": BLOCK, "settings": settings, "of_segment": of_segment, "weights": weights, "base": base,
             "seeds": [m.seed for m in models], "features": [m.features for m in models]}
    if from_cells:
        return _grown_from_cells(state, fixed | {"cuts": cuts, "many": out.n_rows >= 1 << 31}, out, cores * waves)
    # the first predictions are the means
    pending = [(np.full((len(models), nodes), -1, np.int16), np.zeros((len(models), nodes), np.uint8),
                np.repeat(base[:, None], nodes, axis=1))]

    tasks = state.rdd.getNumPartitions()
    pairs = tasks * len(models)
    if sorted_:
        # a task holds neighbouring segments, so few pairs of a task and a model have a histogram
        pairs = min(pairs, (2 * tasks + len(names)) * int(slots.max()))

    def one_pass(grown, turn, level):
        job = fixed | {"pending": pending, "grown": grown}
        shared = spark.sparkContext.broadcast(job)
        parts = state.mapInArrow(_level_pass(shared, turn, level, train is not None), HISTOGRAM)
        if pairs * 2**level * p * settings.bins * 16 <= DIRECT:
            found = _splits_here(job, turn, parts.toArrow())
        else:
            found = parts.groupBy("model", "node", "block").applyInArrow(_split_of_parts(shared, turn), SPLIT).toPandas()
        shared.unpersist()
        if train is not None and level == 0:
            line = np.zeros((len(models), CHECKS))
            for r in found[found["node"] < 0].itertuples():
                line[r.model] = np.frombuffer(r.checks, "<f8")
            out.checks.append(line)
        found = found[found["node"] >= 0]
        return found.sort_values(["model", "node", "gain", "feature"], ascending=[True, True, False, True]).drop_duplicates(["model", "node"])

    for turn in range(settings.rounds):
        feature = np.full((len(models), nodes), -1, np.int16)
        bin_, value = np.zeros((len(models), nodes), np.uint8), np.zeros((len(models), nodes))
        for level in range(settings.depth):
            best = one_pass((feature, bin_), turn, level)
            m, node = best["model"].to_numpy(), best["node"].to_numpy() + 2**level - 1
            n, total = best["n"].to_numpy(), best["total"].to_numpy()
            if level == 0:
                value[m, node] = settings.step * total / n
            split = (best["feature"].to_numpy() >= 0) & (best["gain"].to_numpy() > 0)
            if not split.any():
                break
            m, node, n, total = m[split], node[split], n[split], total[split]
            left, left_n = best["left_sum"].to_numpy()[split], best["left_n"].to_numpy()[split]
            feature[m, node], bin_[m, node] = best["feature"].to_numpy()[split], best["bin"].to_numpy()[split]
            value[m, 2 * node + 1] = settings.step * left / left_n
            value[m, 2 * node + 2] = settings.step * (total - left) / (n - left_n)
        out.feature.append(feature)
        out.bin.append(bin_)
        out.value.append(value)
        pending.append((feature, bin_, value))
        if len(pending) > STATE_ROUNDS and turn + 1 < settings.rounds:
            state, pending = _rewritten(spark, state, fixed, pending), []
    if train is not None:
        one_pass(None, settings.rounds, 0)
    return out


def _rewritten(spark, state: DataFrame, fixed: dict, pending: list) -> DataFrame:
    """The rows with the pending trees added to their predictions."""
    shared = spark.sparkContext.broadcast(fixed | {"pending": pending})

    def run(batches):
        job = shared.value
        for seg, row, train, x, y, f in _chunks(batches, job["p"]):
            f = f.copy()
            for slot, model in enumerate(job["of_segment"][seg]):
                for tree in job["pending"]:
                    f[slot] += _leaf_values(tree[0][model], tree[1][model], tree[2][model], x, job["settings"].depth)
            yield _chunk(seg, row, train, x, y, f)

    return written(state.mapInArrow(run, STATE), "boosting-rows")


def _mean_of_models(fitted: tuple, segment: int, x: np.ndarray) -> np.ndarray:
    """The mean prediction of a segment's models; ``x`` has a line of bins for each feature."""
    of_segment, _, base, feature, bin_, value, settings = fitted
    total = np.zeros(x.shape[1])
    for m in of_segment[segment]:
        total += base[m]
        for f, b, v in zip(feature, bin_, value):
            total += _leaf_values(f[m], b[m], v[m], x, settings.depth)
    return total / len(of_segment[segment])


def _cell_means(spark, shared, segments: int, cells: int) -> np.ndarray:
    """The prediction of every segment and cell."""

    def run(batches):
        for batch in batches:
            number = batch.column("id").to_numpy()
            for k in np.unique(number // cells):
                own = number[number // cells == k] % cells
                mean = _mean_of_models(shared.value, k, _bins_of(own, shared.value[1]))
                yield _batch("id long, mean binary", [(int(k * cells + own[0]), mean.tobytes())])

    parts = spark.range(segments * cells).mapInArrow(run, "id long, mean binary").toArrow()
    in_order = sorted(zip(parts.column("id").to_pylist(), parts.column("mean").to_pylist()))
    return np.frombuffer(b"".join(mean for _, mean in in_order), "<f8").reshape(segments, cells)


def predict(df: DataFrame, model: Boosted, segment, out: str = "prediction", missing: float = 0.0) -> DataFrame:
    """Adds the mean prediction of the models of each row's segment; ``missing`` where it has none.

    ``segment`` is a column expression. Missing features count as 0, as in training.
    """
    spark = df.sparkSession
    places = {s: k for k, s in enumerate(model.of_segment())}
    number = F.lit(-1)
    if places:
        table = F.create_map(*[F.lit(v) for s, k in places.items() for v in (s, k)])
        number = F.coalesce(F.try_element_at(table, segment), F.lit(-1))
    shared = spark.sparkContext.broadcast(
        (list(model.of_segment().values()), model.cuts, model.base, model.feature, model.bin, model.value, model.settings))
    sizes = _strides(model.cuts)
    # trees of fewer cells than there are rows are added up once for each cell
    looked_up = len(places) * sizes[-1] <= min(LOOKED_UP, model.n_rows)
    table = spark.sparkContext.broadcast(_cell_means(spark, shared, len(places), sizes[-1]) if looked_up and places else None)

    @F.pandas_udf("double")
    def score(seg: pd.Series, *x: pd.Series) -> pd.Series:
        cuts, means = shared.value[1], table.value
        found = np.full(len(seg), missing)
        seg = seg.to_numpy()
        if len(seg):
            bins = np.ascontiguousarray(_binned(np.stack([c.to_numpy() for c in x], axis=1), cuts).T)
            for k in np.unique(seg[seg >= 0]):
                rows = np.flatnonzero(seg == k)
                own = bins if len(rows) == len(seg) else np.ascontiguousarray(bins[:, rows])
                found[rows] = _mean_of_models(shared.value, k, own) if means is None else means[k].take(_cells_of(own, sizes))
        return pd.Series(found)

    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in model.features]
    return df.withColumn(out, score(number, *x))
