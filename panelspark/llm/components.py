"""Connected components by alternating star contraction, in DataFrame operations only.

Every round replaces the edges of a node by edges to the smallest node next to it. The
edge count never grows, chains halve, and stars are a fixed point. Each half round writes
the minima to the shared folder, so that both sides of the join are plain shuffles and
adaptive execution can split a hub, whatever share of the edges it holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import written


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).distinct()


def _to_minimum(links: DataFrame) -> DataFrame:
    """(a, b): every b of a is tied to the smallest node among a and its b's."""
    minima = written(
        links.groupBy("a").agg(F.min("b").alias("low"))
        .select(F.col("a").alias("node"), F.least("a", "low").alias("low")), "component-minima")
    return links.join(minima, F.col("a") == F.col("node"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _distinct(
        _to_minimum(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come in as (larger, smaller)."""
    tied = _to_minimum(edges)
    return _distinct(
        tied.select(F.col("b").alias("a"), F.col("low").alias("b"))
        .unionByName(tied.select("a", F.col("low").alias("b"))))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Null ends and loops are ignored; repeated edges and either direction count once. An
    empty edge table gives an empty result. Raises if ``max_rounds`` do not suffice, which
    would need a path of about 2 ** max_rounds nodes.
    """
    edges = written(_distinct(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null")), "component-edges")
    seen = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        seen = state
        edges = written(_small_star(_large_star(edges)), "component-edges")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


class Forest:
    """Spanning pairs of the links that a block of comparisons finds, inside a task."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        self.group = np.arange(len(right))
        self.tied = np.full(len(left), -1)

    def add(self, start: int, linked: np.ndarray) -> None:
        """linked: a row for each left id from ``start`` on, a column for each right id."""
        for i in np.flatnonzero(linked.any(axis=1)):
            reached = np.flatnonzero(linked[i])
            kinds = np.unique(self.group[reached])
            if len(kinds) > 1:
                self.group[np.isin(self.group, kinds)] = kinds[0]
            self.tied[start + i] = reached[0]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(x, y): no more than one pair for each id, with the connectivity of all links."""
        low = np.full(len(self.right), np.iinfo(np.int64).max)
        np.minimum.at(low, self.group, self.right)
        shared = np.bincount(self.group, minlength=len(self.right))[self.group] > 1
        some = self.tied >= 0
        return (np.concatenate([self.right[shared], self.left[some]]),
                np.concatenate([low[self.group[shared]], low[self.group[self.tied[some]]]]))
