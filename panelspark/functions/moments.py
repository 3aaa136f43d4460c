"""Means and covariances of many columns per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Up to this many columns the covariances are plain aggregates.
MAX_AGGREGATED = 12
# Numbers that a task holds before it hands them on, and numbers in a row that is shuffled.
MAX_HELD = 1 << 23
TILE = 1024


def schema_of(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {dict(df.dtypes)[n]}" for n in names)


def second_moments(df: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """(groups, n, mean array, cov array): population covariances, row by row.

    A missing value makes its column's covariances NaN. Few columns are aggregated
    directly. For many, tasks add up shifted products of their own rows and hand them on in
    tiles whenever they hold too many groups. So a group may be larger than any task, and only
    tiles are shuffled.
    """
    if len(columns) <= MAX_AGGREGATED:
        gaps = {c: F.count(c) < F.count(F.lit(1)) for c in columns}
        nan = F.lit(float("nan"))

        def cov(a, b):
            return F.when(gaps[a] | gaps[b], nan).otherwise(F.covar_pop(a, b))

        half = {(a, b): cov(a, b) for i, a in enumerate(columns) for b in columns[: i + 1]}
        return df.groupBy(*groups).agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.when(gaps[c], nan).otherwise(F.avg(c)) for c in columns]).alias("mean"),
            F.array(*[half.get((a, b), half.get((b, a))) for a in columns for b in columns]).alias(
                "cov"
            ),
        )
    return _by_task(df, columns, groups)


def _by_task(df: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    p = len(columns)
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    shift = np.array([row[i] or 0.0 for i in range(p)])
    group_schema = schema_of(df, groups)

    def tiles(held):
        """A group's sums as one line of numbers (n, sums, products), cut into tiles."""
        for key, (n, s, q) in held.items():
            line = np.concatenate([[float(n)], s, q.ravel()])
            rows = [(*key, at // TILE, line[at : at + TILE].tolist()) for at in range(0, len(line), TILE)]
            yield pd.DataFrame(rows, columns=[*groups, "tile", "v"])

    def partial(batches):
        held: dict = {}
        for batch in batches:
            for key, part in batch.groupby(groups, dropna=False):
                x = part[columns].to_numpy(dtype=np.float64) - shift
                n, s, q = held.get(key, (0, 0.0, 0.0))
                held[key] = (n + len(x), s + x.sum(axis=0), q + x.T @ x)
                if len(held) * (p + 1) ** 2 > MAX_HELD:
                    yield from tiles(held)
                    held = {}
        yield from tiles(held)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        out["v"] = [np.sum(np.stack(pdf["v"].to_list()), axis=0).tolist()]
        return out

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        line = np.concatenate(pdf.sort_values("tile")["v"].to_list())
        n, s, q = line[0], line[1 : p + 1], line[p + 1 :].reshape(p, p)
        out = pdf[groups].iloc[:1].copy()
        out["n"], out["mean"] = int(n), [(s / n + shift).tolist()]
        out["cov"] = [(q / n - np.outer(s / n, s / n)).ravel().tolist()]
        return out

    cells = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns])
    tiled = f"{group_schema}, tile int, v array<double>"
    sums = cells.mapInPandas(partial, tiled).groupBy(*groups, "tile").applyInPandas(total, tiled)
    return sums.groupBy(*groups).applyInPandas(
        finish, f"{group_schema}, n long, mean array<double>, cov array<double>"
    )
