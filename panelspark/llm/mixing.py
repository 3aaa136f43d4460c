"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by (source, language, topic). A budget says how many tokens to take. Each margin deals it
out to its values in proportion to the targets; a value that has fewer tokens than its part gives all it
has, and what it lacks goes to the others (water-filling). Raking then multiplies the cells' expected
tokens until their margins meet these goals alike, and no cell ever gives more than it has. A cell's
rate is its expected tokens for each token; a document is taken when a number drawn from its content
lies below its cell's rate. So the expected tokens are the budget, sources, languages and topics are in
proportion to the targets as far as their tokens reach, and no document is repeated.

Targets are the margins' own token shares raised to ``TEMPER``, or are given. Every value is a class of
its own, however rare: it takes no more than its own tokens from the budget. Up to ``CELLS`` cells are raked on the driver; more stay a Spark table, which takes
the same steps as grouped sums that are joined back. Both ways give the same rates.

Edge cases, all defined: a null value is a class of its own, a null text has no tokens and the draw
of an empty text; documents without tokens count one token, so every cell has weight; targets of
classes that do not occur are left out and the others scaled to one; values that given targets do not
name get the rate 0; if targets contradict each other
on empty cells, fitting ends after ``MAX_ROUNDS`` with the last margin met; equal rows share one draw; an
empty table gives an empty result. Columns of the input may have any names but ``_mix``, which is refused.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.session import written

MARGINS = ("source", "lang", "topic")
TEMPER = 0.9
#: Most cells that are raked on the driver and broadcast.
CELLS = 100_000
#: Share of all tokens that is taken.
BUDGET = 0.6
#: Raking ends when no cell moves by more than this share of the largest; sums of doubles differ by their order.
STILL = 1e-10
MAX_ROUNDS = 500
MISSING = "(none)"
WORD = r"[^\x20\x09-\x0D]+"
#: Topics stand in for a topic column, which documents lack: the form that the length gives a text.
FORMS = ((100, "note"), (400, "article"), (1500, "essay"))
LONGEST = "book"


def tokens_of(text: Column) -> Column:
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)), F.lit(1)).cast("long")


def form_of(n_tokens: Column) -> Column:
    out = None
    for below, name in FORMS:
        out = F.when(n_tokens < below, name) if out is None else out.when(n_tokens < below, name)
    return out.otherwise(LONGEST)


def draw_of(doc_id: Column, text: Column, seed: int) -> Column:
    """A number from 0 to 1 from the row's id and text."""
    content = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), content).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def dealt(tokens: np.ndarray, share: np.ndarray, budget: float) -> np.ndarray:
    """``budget`` in proportion to ``share``, but no more than ``tokens`` to anyone: the rest goes to the others."""
    with np.errstate(divide="ignore", invalid="ignore"):
        fills = np.where(share > 0, tokens / share, np.inf)
        order = np.argsort(fills, kind="stable")
        full = np.concatenate([[0.0], np.cumsum(np.where(share > 0, tokens, 0)[order])[:-1]])
        open_ = np.cumsum(share[order][::-1])[::-1]
        level = np.max(np.where(open_ > 0, (budget - full) / open_, 0))
    return np.minimum(tokens, share * max(0.0, level))


def rake(cells: list[tuple], targets: list[dict[str, float]], budget: float = BUDGET) -> np.ndarray:
    """Expected tokens of cells (a value for each margin, then tokens) that meet the margins' goals."""
    tokens = np.array([c[-1] for c in cells], dtype=np.float64)
    weight, margins = tokens.copy(), []
    for k, target in enumerate(targets):
        names, at = np.unique([c[k] for c in cells], return_inverse=True)
        share = np.array([target.get(x, 0.0) for x in names])
        margins.append((at, dealt(np.bincount(at, tokens), share, budget * tokens.sum())))
    for _ in range(MAX_ROUNDS):
        before = weight.copy()
        for at, goal in margins:
            sums = np.bincount(at, weight, len(goal))
            weight = np.minimum(tokens, weight * (goal / np.where(sums > 0, sums, 1))[at])
        if np.abs(weight - before).max() <= STILL * weight.max():
            break
    return weight


def tempered(shares: dict[str, int], power: float = TEMPER) -> dict[str, float]:
    return {k: float(v) ** power for k, v in shares.items()}


def raked(cells: DataFrame, goals: dict[str, DataFrame]) -> DataFrame:
    """``rake`` for cells of any number: ``cells`` with weight; goals: (value, goal) of every value of a margin."""
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(MAX_ROUNDS):
        after = now.withColumn("before", F.col("weight"))
        for m in MARGINS:
            total = F.col("total")
            factors = after.groupBy(m).agg(F.sum("weight").alias("total")).join(goals[m], m).select(
                m, (F.col("goal") / F.when(total > 0, total).otherwise(1.0)).alias("factor"))
            after = after.join(factors, m).withColumn(
                "weight", F.least(F.col("tokens").cast("double"), F.col("weight") * F.col("factor"))).drop("factor")
        after = written(after, "mixing-weights")
        moved, largest = after.agg(F.max(F.abs(F.col("weight") - F.col("before"))), F.max("weight")).first()
        now = after.drop("before")
        if moved <= STILL * largest:
            break
    return now


def _goals(cells: DataFrame, margin: str, target: dict[str, float] | None, budget: float) -> DataFrame:
    """``dealt`` for values of any number: those that give all they have are found in a few passes."""
    values = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("tokens"))
    share = F.pow(F.col("tokens"), F.lit(TEMPER))
    if target:
        named = cells.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in target.items()], f"{margin} string, named double")
        values, share = values.join(named, margin, "left"), F.coalesce("named", F.lit(0.0))
    values = written(values.select(margin, "tokens", share.alias("share")), "mixing-values")
    level, whole = 0.0, values.agg(F.sum("tokens")).first()[0] or 0.0
    while True:
        full = F.col("tokens") <= F.col("share") * F.lit(level)
        given, rest = values.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("share")))).first()
        found = max(level, (budget * whole - given) / rest) if rest else level
        if found <= level * (1 + STILL):
            break
        level = found
    return written(values.select(margin, F.least("tokens", F.col("share") * F.lit(level)).alias("goal")), "mixing-goals")


def rates(measured: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """(source, lang, topic, rate), one row for each cell; measured: the margins and n_tokens."""
    spark = measured.sparkSession
    targets = targets or {}
    cells = written(measured.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "mixing-cells")
    if cells.count() > CELLS:
        table = raked(cells, {m: _goals(cells, m, targets.get(m), budget) for m in MARGINS})
        return table.select(*MARGINS, (F.col("weight") / F.col("tokens")).alias("rate"))
    rows = [tuple(r) for r in cells.orderBy(*MARGINS).collect()]
    goals = []
    for k, m in enumerate(MARGINS):
        sums: dict[str, int] = {}
        for r in rows:
            sums[r[k]] = sums.get(r[k], 0) + r[-1]
        goals.append(targets.get(m) or tempered(sums))
    schema = T.StructType([T.StructField(m, T.StringType()) for m in MARGINS] + [T.StructField("rate", T.DoubleType())])
    if not rows:
        return spark.createDataFrame([], schema)
    rate = rake(rows, goals, budget) / np.array([r[-1] for r in rows])
    return F.broadcast(spark.createDataFrame([(*r[:-1], float(x)) for r, x in zip(rows, rate)], schema))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
             topic: str | None = None, seed: int = 23) -> DataFrame:
    """``docs`` with the struct ``_mix``: source, lang, topic, n_tokens and draw.

    ``topic`` names a column; without one, the form that the length gives a text stands in.
    """
    if "_mix" in {c.lower() for c in docs.columns}:
        raise ValueError("a column is named like the added one: _mix")
    n = tokens_of(F.col(text))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    return docs.withColumn("_mix", F.struct(
        named(source).alias("source"), named(lang).alias("lang"), (named(topic) if topic else form_of(n)).alias("topic"),
        n.alias("n_tokens"), draw_of(F.col(doc_id), F.col(text), seed).alias("draw")))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, **columns) -> DataFrame:
    """``docs`` with the struct ``_mix``, which then holds rate and taken as well."""
    rows = measured(docs, **columns)
    table = rates(rows.select("_mix.*"), targets, budget)
    on = [F.col(f"_mix.{m}") == F.col(f"_cell_{m}") for m in MARGINS]
    cells = table.select(*(F.col(m).alias(f"_cell_{m}") for m in MARGINS), F.col("rate").alias("_cell_rate"))
    return rows.join(cells, on, "left").withColumn("_mix", F.struct(
        "_mix.*", F.col("_cell_rate").alias("rate"), (F.col("_mix.draw") < F.col("_cell_rate")).alias("taken"))).drop(*cells.columns)
