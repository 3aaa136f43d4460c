"""Column expressions: regimes, weights, costs and vector similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regime labels of both vocabularies, thresholds and weights.
LONG_LABELS = ("high_vol_crisis", "low_vol_grind", "transition", "unknown")
SHORT_LABELS = ("crisis", "grind", "transition", None)
LOW_LEVEL, HIGH_LEVEL = 15.0, 25.0
REGIME_BASE_WEIGHTS = {
    "crisis": {"crisis": 0.7, "transition": 0.2, "grind": 0.1},
    "grind": {"grind": 0.7, "transition": 0.2, "crisis": 0.1},
    "transition": {"transition": 0.7, "grind": 0.15, "crisis": 0.15},
}
POSITION_FACTOR = {"crisis": 0.5, "transition": 0.75, "grind": 1.0}
OTHER_POSITION_FACTOR = 0.5
TRANSACTION_COST_BPS = 25.0
ANNUAL_VOLATILITY = 0.15


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def regime_by_level(
    vix: Column, low: float = LOW_LEVEL, high: float = HIGH_LEVEL, labels=LONG_LABELS
) -> Column:
    crisis, grind, middle, missing = labels
    return (
        F.when(vix.isNull(), F.lit(missing))
        .when(vix > high, crisis)
        .when(vix < low, grind)
        .otherwise(middle)
    )


def one_hot(label: Column, labels: list[str], prefix: str = "regime") -> dict[str, Column]:
    return {f"{prefix}_{name}": (label.eqNullSafe(F.lit(name))).cast("int") for name in labels}


def equal_weights(n: int) -> Column:
    return F.array(*[F.lit(1.0 / n)] * n)


def plain_dot(values: list[Column], weights: Column) -> Column:
    return total([v.cast("double") * weights[i] for i, v in enumerate(values)])


def renormalised_dot(values: list[Column], weights: Column) -> Column:
    """Weighted mean over the finite values with finite weights; 0.0 when there are none."""
    cells = [(finite(v), finite(weights[i])) for i, v in enumerate(values)]
    usable = [v.isNotNull() & w.isNotNull() for v, w in cells]
    count = total([ok.cast("int") for ok in usable])
    weight = total([F.when(ok, w).otherwise(0.0) for ok, (_, w) in zip(usable, cells)])
    dot = total([F.when(ok, v * w).otherwise(0.0) for ok, (v, w) in zip(usable, cells)])
    plain = total([F.when(ok, v).otherwise(0.0) for ok, (v, _) in zip(usable, cells)])
    return (
        F.when(count == 0, 0.0)
        .when(weight > 0, F.try_divide(dot, weight))
        .otherwise(F.try_divide(plain, count))
    )


def cost_impact(bps: float = TRANSACTION_COST_BPS, volatility: float = ANNUAL_VOLATILITY) -> float:
    return bps / 10000.0 / volatility


def dynamic_weights(vix: Column, performance: dict[str, Column]) -> dict[str, Column]:
    """Share of each regime model given the indicator and recent performance per regime."""
    label = regime_by_level(vix, labels=SHORT_LABELS)
    raw = {}
    for regime in ("crisis", "transition", "grind"):
        base = F.when(label == "crisis", REGIME_BASE_WEIGHTS["crisis"][regime]).when(
            label == "grind", REGIME_BASE_WEIGHTS["grind"][regime]
        ).otherwise(REGIME_BASE_WEIGHTS["transition"][regime])
        score = F.coalesce(performance.get(regime, F.lit(0.0)), F.lit(0.0))
        raw[regime] = F.greatest(F.lit(0.0), base * (1 + score))
    whole = total(list(raw.values()))
    return {k: F.when(whole > 0, F.try_divide(v, whole)).otherwise(0.0) for k, v in raw.items()}


def position_size(prediction: Column, confidence: Column, regime: Column) -> Column:
    factor = F.lit(OTHER_POSITION_FACTOR)
    for name, value in POSITION_FACTOR.items():
        factor = F.when(regime == name, value).otherwise(factor)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), prediction * confidence * factor))


def tversky(
    a: Column, b: Column, alpha: float = 0.7, beta: float = 0.3, theta: float = 1.0
) -> Column:
    """Similarity of two boolean arrays from the sizes of their overlap and differences."""
    return F.aggregate(
        F.zip_with(
            a,
            b,
            lambda x, y: F.when(x & y, theta).when(x, -alpha).when(y, -beta).otherwise(0.0),
        ),
        F.lit(0.0),
        lambda acc, s: acc + s,
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 1 when both are zero or ``b`` is NULL, 0 when one is zero."""
    def norm(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))

    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na, nb = norm(a), norm(b)
    return (
        F.when(b.isNull(), 1.0)
        .when((na > 0) & (nb > 0), F.try_divide(dot, na * nb))
        .when((na == 0) & (nb == 0), 1.0)
        .otherwise(0.0)
    )


def array_median(values: Column) -> Column:
    """Median of a short array without NULLs; NULL when empty."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    low = F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(ordered, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def array_mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values))
