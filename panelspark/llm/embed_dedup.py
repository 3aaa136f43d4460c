"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors become unit vectors, rotated to the principal axes of a sample and split into blocks
of axes. Two vectors with cosine c differ by 2 - 2c in squared distance; shared out over the
blocks in proportion to their variance, some block must stay within its share. So each block
is range-joined under its own budget: a k-d tree cuts it into cells, a vector belongs to the
cell it lies in, and visits every cell within the block's radius. Cells are dealt in chunks of
owners and visitors, so a tile is bounded however many vectors lie close together. In a tile,
pairs within the block's budget that no earlier block has found are checked exactly with the
whole vectors. A tile gives link counts and a spanning forest of its links, never pairs.

Equal vectors of a label form one class with a multiplicity before all this. The sample (at
most ``SAMPLE`` classes and ``SAMPLE_BYTES``) only steers rotation, budgets, cells and chunks; results are exact
for any. The trees are bounded by the sample: eight of its vectors for a leaf at least.

Edge cases, all defined: a vector that is null, empty, zero or holds null or non-finite
components, or has a null label or id, links with nothing and is its own component; vectors of
different lengths never link; rows that repeat an id count as vectors of their own; an empty
table gives an empty result. Other columns of the input play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.components import Forest, components
from panelspark.llm.doc_stats import likely
from panelspark.session import written

#: Most vectors that the plan is made from, and bytes of them on the driver.
SAMPLE, SAMPLE_BYTES = 50_000, 64 << 20
BLOCK = 16
CHUNK = 4096
SLACK = 1e-9


@dataclass(frozen=True)
class Space:
    """Rotation, blocks (lists of axes) and squared radius of each, for vectors of one length."""

    axes: np.ndarray
    blocks: list[slice]
    budgets: np.ndarray

    def turned(self, x: np.ndarray) -> np.ndarray:
        return x @ self.axes


@dataclass(frozen=True)
class Cells:
    """A k-d tree over one block. nodes: (axis, cut, left, right); a leaf is ~number."""

    nodes: list[tuple[int, float, int, int]]
    chunks: np.ndarray  # (leaves, 2): chunks of owners and of visitors

    def visits(self, x: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf within the squared distance of a row."""
        rows, leaves = [], []
        stack = [(0 if self.nodes else ~0, np.arange(len(x)), np.zeros_like(x))]
        while stack:
            node, at, off = stack.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), ~node))
                continue
            axis, cut, left, right = self.nodes[node]
            gap = x[at, axis] - cut
            for child, outside in ((left, gap > 0), (right, gap <= 0)):
                moved = off.copy()
                moved[outside, axis] = np.maximum(moved[outside, axis], np.abs(gap[outside]))
                near = (moved**2).sum(axis=1) <= budget + SLACK
                stack.append((child, at[near], moved[near]))
        return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(leaves or [np.zeros(0, int)])

    def owner(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        stack = [(0 if self.nodes else ~0, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            if node < 0:
                out[at] = ~node
                continue
            axis, cut, left, right = self.nodes[node]
            below = x[at, axis] <= cut
            stack += [(left, at[below]), (right, at[~below])]
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def make_space(x: np.ndarray, least: float) -> Space:
    dim = x.shape[1]
    variance, axes = np.linalg.eigh(np.cov(x.T).reshape(dim, dim) if len(x) > 1 else np.eye(dim))
    axes = axes[:, ::-1]
    # every block takes axes of high and of low variance alike
    count = max(1, dim // BLOCK)
    order = np.concatenate([np.arange(k, dim, count) for k in range(count)])
    cuts = np.linspace(0, dim, count + 1).astype(int)
    blocks = [slice(int(a), int(b)) for a, b in zip(cuts, cuts[1:])]
    axes, spread = axes[:, order], np.maximum(variance[::-1][order], 1e-6)
    share = np.array([spread[b].sum() for b in blocks])
    return Space(axes, blocks, (2 - 2 * least) * share / share.sum())


def make_cells(x: np.ndarray, scale: float, budget: float) -> Cells:
    """x: the block's coordinates of the sample; scale: vectors for each sampled one."""
    nodes: list[tuple[int, float, int, int]] = []
    leaves = 0

    def split(at: np.ndarray) -> int:
        nonlocal leaves
        part = x[at]
        spread = part.max(axis=0) - part.min(axis=0) if len(at) else np.zeros(x.shape[1])
        axis = int(np.argmax(part.std(axis=0))) if len(at) else 0
        if len(at) * scale <= CHUNK or len(at) < 16 or spread[axis] ** 2 <= budget:
            leaves += 1
            return ~(leaves - 1)
        cut = float(np.median(part[:, axis]))
        below = part[:, axis] <= cut
        if below.all():
            leaves += 1
            return ~(leaves - 1)
        me = len(nodes)
        nodes.append((axis, cut, 0, 0))
        nodes[me] = (axis, cut, split(at[below]), split(at[~below]))
        return me

    split(np.arange(len(x)))
    cells = Cells(nodes, np.ones((leaves, 2), dtype=np.int64))
    for column, found in ((0, cells.owner(x)), (1, cells.visits(x, budget)[1])):
        cells.chunks[:, column] = np.maximum(1, np.ceil(np.bincount(found, minlength=leaves) * scale / CHUNK))
    return cells


def classes_of(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the key of their class, null if they cannot link; the classes)."""
    fit = (
        F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull()
        & F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(embedding, lambda v: v != 0))
    v = F.col(embedding)
    rows = vectors.select(
        F.col(vec_id).alias("id"), v.cast("array<double>").alias("v"),
        F.when(F.coalesce(fit, F.lit(False)), F.struct(
            F.col(label).alias("label"), F.size(v).alias("dim"), F.xxhash64(v).alias("h"), F.hash(v).alias("g"))).alias("key"))
    classes = rows.where("key is not null").groupBy("key").agg(
        F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))
    return rows.select("id", "key"), classes


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _plan(classes: DataFrame, least: float) -> tuple[dict, dict]:
    """({dim: Space}, {(label, dim, block): Cells}) from the sample."""
    total, widest = classes.agg(F.count("*"), F.max("key.dim")).first()
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * (widest or 1))))
    picked = classes.select(
        F.col("key.label").cast("string").alias("label"), F.col("key.dim").alias("dim"), "v",
        F.xxhash64("key").alias("at"))
    table = likely(picked, most, F.col("at")).orderBy("at").limit(most).toArrow()
    scale = max(1.0, total / max(1, table.num_rows))
    labels, dims = np.array(table.column("label").to_pylist(), dtype=object), table.column("dim").to_numpy()
    spaces, cells = {}, {}
    for dim in np.unique(dims):
        here = dims == dim
        x = unit(matrix(table.filter(pa.array(here)).column("v"), int(dim)))
        space = spaces[int(dim)] = make_space(x, least)
        x = space.turned(x)
        names, codes = np.unique(labels[here], return_inverse=True)
        for k, name in enumerate(names):
            part = x[codes == k]
            if len(part) * scale > CHUNK:
                for b, (block, budget) in enumerate(zip(space.blocks, space.budgets)):
                    cells[name, int(dim), b] = make_cells(part[:, block], scale, budget)
    return spaces, cells


def _deal(shared, least: float):
    """Rows of classes to rows of tiles."""

    def run(batches):
        spaces, cells = shared.value
        whole = Cells([], np.ones((1, 2), dtype=np.int64))
        for batch in batches:
            keys = np.array([f"{d}\0{x}" for d, x in zip(batch.column("dim").to_pylist(), batch.column("label").to_pylist())])
            for key in np.unique(keys):
                part = batch.filter(pa.array(keys == key))
                dim, name = key.split("\0", 1)
                dim = int(dim)
                space = spaces.get(dim) or make_space(np.zeros((0, dim)), least)
                x = space.turned(unit(matrix(part.column("v"), dim)))
                ids = np.arange(part.num_rows)
                deal = np.abs(part.column("spread").to_numpy().astype(np.int64) >> 1)
                for b, (block, budget) in enumerate(zip(space.blocks, space.budgets)):
                    tree = cells.get((name, dim, b), whole)
                    for role, (rows, leaves) in enumerate(((ids, tree.owner(x[:, block])), tree.visits(x[:, block], budget))):
                        own = deal[rows] % tree.chunks[leaves, role]
                        copies = tree.chunks[leaves, 1 - role]
                        at = np.repeat(np.arange(len(rows)), copies)
                        other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                        for lo in range(0, len(at), 20_000):
                            pick = at[lo: lo + 20_000]
                            mine, theirs = own[pick], other[lo: lo + 20_000]
                            taken = part.take(pa.array(rows[pick]))
                            n = len(pick)
                            yield pa.RecordBatch.from_arrays(
                                [taken.column("label"), taken.column("dim"), pa.array(np.full(n, b, np.int32)),
                                 pa.array(leaves[pick].astype(np.int32)),
                                 pa.array((mine if role == 0 else theirs).astype(np.int32)),
                                 pa.array((theirs if role == 0 else mine).astype(np.int32)),
                                 pa.array(np.full(n, role == 0)), taken.column("id"), taken.column("n"), taken.column("v")],
                                names=["label", "dim", "block", "cell", "owners", "visitors", "owns", "id", "n", "v"])

    return run


def tile_links(space: Space, b: int, least: float, ids_a, a, ids_b, n_b, v_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of every owner, then pairs (x, y) of ids that span the tile's links)."""
    a, v_b = unit(a), unit(v_b)
    ta, tb = space.turned(a), space.turned(v_b)
    links = np.zeros(len(a), dtype=np.int64)
    forest = Forest(ids_a, ids_b)
    for lo in range(0, len(a), 256):
        hi = min(lo + 256, len(a))
        found = None
        for e in range(b, -1, -1):
            x, y = ta[lo:hi, space.blocks[e]], tb[:, space.blocks[e]]
            gap = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T
            within = gap <= space.budgets[e] + SLACK
            found = within if found is None else found & ~within
            if not found.any():
                break
        else:
            found &= ids_a[lo:hi, None] != ids_b
            found &= a[lo:hi] @ v_b.T >= least
            links[lo:hi] = found @ n_b
            forest.add(lo, found)
    return links, *forest.pairs()


def _tile(shared, least: float):
    def run(key, tile):
        dim, b = key[1].as_py(), key[2].as_py()
        space = shared.value[0].get(dim) or make_space(np.zeros((0, dim)), least)
        owns = tile.column("owns").to_numpy(zero_copy_only=False)
        a, v = tile.filter(pa.array(owns)), tile.filter(pa.array(~owns))
        ids = a.column("id").to_numpy()
        if a.num_rows and v.num_rows:
            links, xs, ys = tile_links(
                space, b, least, ids, matrix(a.column("v"), dim), v.column("id").to_numpy(),
                v.column("n").to_numpy(), matrix(v.column("v"), dim))
        else:
            links, xs, ys = np.zeros(len(ids), np.int64), ids[:0], ids[:0]
        some = links > 0
        none = np.zeros(len(xs), np.int64)
        return pa.table({"id": np.concatenate([ids[some], xs]), "links": np.concatenate([links[some], none]),
                         "other": np.concatenate([ids[some], ys])})

    return run


def dedup(vectors: DataFrame, least: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding",
          label: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row; ids are integers."""
    rows, classes = classes_of(vectors, vec_id, embedding, label)
    classes = written(classes, "vector-classes")
    shared = vectors.sparkSession.sparkContext.broadcast(_plan(classes, least))
    source = classes.select(
        F.col("key.label").cast("string").alias("label"), F.col("key.dim").alias("dim"),
        F.col("id").cast("long").alias("id"), F.col("n").cast("long").alias("n"),
        F.xxhash64(F.lit(7), "key").alias("spread"), "v")
    tiles = source.mapInArrow(
        _deal(shared, least), "label string, dim int, block int, cell int, owners int, visitors int, "
        "owns boolean, id long, n long, v array<double>")
    found = written(
        tiles.groupBy("label", "dim", "block", "cell", "owners", "visitors").applyInArrow(
            _tile(shared, least), "id long, links long, other long"), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    judged = (
        classes.select("key", F.col("id").cast("long").alias("id"), "n")
        .join(links, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
        .select(F.col("key").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("found"),
                F.coalesce("component", "id").alias("component")))
    return rows.join(judged, F.col("key") == F.col("class"), "left").select(
        "id", F.coalesce("found", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", F.col("id").cast("long")).alias("component_id"),
        F.coalesce(F.coalesce("component", F.col("id").cast("long")) == F.col("id"), F.lit(False)).alias("kept"))
