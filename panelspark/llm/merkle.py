"""Merkle manifest of a dataset: digests of rows, runs, groups and the whole, and proofs of rows.

Leaves are digests of rows. In every group they ascend by an order column; while a group has more
than one node, each run of ``arity`` neighbours becomes one parent, the digest of their digests. What
remains is the group's subroot; subroots, ascending by group, are combined likewise to the root.

1. A leaf's index in its group comes from ranges of (group, order): rows are cut into near equal
   ranges, sorted and written once with their place; a range's start in the group is a running sum
   over ranges. No group has to fit in a task, however many rows it holds.
2. Every level is a self-join: the row in slot zero of a run computes the indices of its siblings
   (index XOR 1 for binary trees, else slot offsets) and equijoins the nodes with them; it then emits the parent,
   and keeps the run's digests beside it. A run is looked up once, not once for each member.
3. Proofs come from the top down: a node's path is its own siblings, cut out of its parent's run,
   followed by the parent's path. Each level joins nodes with a sixteenth as many parents, and
   only the last step makes paths of leaves, which are used in the same task.

Levels are written to the shared folder; their sizes fall by the arity, so there are about
log(rows) of them and no row table is shuffled whole: texts are hashed in the scan.

Edge cases, all defined: nulls have a code of their own in a digest, so a null and an empty text
differ; a null group is a group, and comes first; rows with a null or repeated order value are
placed before others, and by digest, and equal rows each have a leaf; a group of one row has its leaf as
subroot, one group's subroot is the root; an empty table has no rows and root None. Only named
columns are read, and columns kept travel in a struct, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.places import indexed
from panelspark.session import written

ENTRY = "array<struct<before:string,after:string>>"
HEX = 64


def coded(value: Column) -> Column:
    """``-`` for a null, else the UTF-8 byte count, a colon and the value as text."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated; parts are strings."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def siblings(idx: Column, arity: int) -> Column:
    """Indices of the others in the run of ``idx``, some of which may lie beyond the group's end."""
    if arity == 2:
        return F.array(idx.bitwiseXOR(F.lit(1).cast("long")))
    slot = idx % arity
    return F.transform(F.sequence(F.lit(1), F.lit(arity - 1)), lambda k: idx - slot + (slot + k) % arity)


def _parents(nodes: DataFrame, arity: int) -> DataFrame:
    """The next level of all groups with more than one node."""
    nodes = nodes.where("n > 1").select("grp", "idx", "n", "digest")
    shifted = F.concat(F.array("idx"), F.filter(siblings(F.col("idx"), arity), lambda i: i < F.col("n")))
    asked = nodes.where(F.col("idx") % arity == 0).select(
        "grp", (F.col("idx") / arity).cast("long").alias("up"), "n", F.explode(shifted).alias("idx"))
    found = asked.join(nodes.select("grp", "idx", "digest"), ["grp", "idx"])
    run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]), "")
    return found.groupBy("grp", F.col("up").alias("idx")).agg(
        F.ceil(F.first("n") / arity).cast("long").alias("n"), run.alias("run")).withColumn(
        "digest", F.sha2(F.col("run").cast("binary"), 256))


def _levels(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """(grp, idx, n, digest, run) of every level, leaves first; runs are the digests below a node."""
    found = [leaves.withColumn("run", F.lit(None).cast("string"))]
    size = leaves.agg(F.max("n")).first()[0] or 0
    while size > 1:
        found.append(written(_parents(found[-1], arity), "merkle-level"))
        size = -(-size // arity)
    return found


def _paths(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """Leaves with ``path`` and ``subroot``; ``tops`` has both for every group's last node."""
    above = None
    for nodes in reversed(levels):
        here = nodes.where("n = 1").join(tops, "grp") if tops is not None else nodes.where("n = 1").withColumns(
            {"path": F.array().cast(ENTRY), "subroot": F.col("digest")})
        if above is not None:
            up = above.select("grp", F.col("idx").alias("_up"), F.col("run").alias("_run"),
                              F.col("path").alias("_path"), "subroot")
            slot = (F.col("idx") % arity).cast("int")
            entry = F.struct(
                F.substring("_run", F.lit(1), slot * HEX).alias("before"),
                F.substring(F.col("_run"), (slot + 1) * HEX + 1, F.lit(arity * HEX)).alias("after"))
            inner = nodes.where("n > 1").withColumn("_up", (F.col("idx") / arity).cast("long")).join(
                up, ["grp", "_up"]).withColumn("path", F.concat(F.array(entry), "_path")).drop("_up", "_run", "_path")
            here = here.unionByName(inner)
        above = here
    return above


def manifest(rows: DataFrame, keep: list[str], group: str, order: str, leaf: str,
             arity: int = 16) -> DataFrame:
    """(row, leaf, subroot, root, path) for every row; ``row`` is a struct of the columns in ``keep``.

    ``leaf`` names the column with a row's digest. ``path`` has, for every level from the leaf up
    to the root, the digests of its siblings before and after it.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    name = F.col(group).cast("string")
    leaves = indexed(rows.select(
        F.coalesce(F.concat(F.lit("="), name), F.lit("-")).alias("grp"), F.col(order).alias("_order"),
        F.col(leaf).alias("digest"), F.struct(*keep).alias("row")), "grp", ["_order", "digest"], "merkle-leaves")
    levels = _levels(leaves, arity)
    subroots = None
    for nodes in levels:
        last = nodes.where("n = 1").select(F.lit("").alias("grp"), F.col("grp").alias("row"), "digest")
        subroots = last if subroots is None else subroots.unionByName(last)
    over = _levels(indexed(subroots, "grp", ["row"], "merkle-subroots"), arity)
    root = over[-1].where("n = 1").select("digest").first()
    tops = _paths(over, None, arity).select(F.col("row").alias("grp"), "path", F.col("digest").alias("subroot"))
    return _paths(levels, written(tops, "merkle-tops"), arity).select(
        "row", F.col("digest").alias("leaf"), "subroot",
        F.lit(root[0] if root else None).cast("string").alias("root"), "path")


def proof(path: Column) -> Column:
    """All sibling digests of a path as one text, level by level and left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(
        F.concat(x["before"], node, x["after"]).cast("binary"), 256))
