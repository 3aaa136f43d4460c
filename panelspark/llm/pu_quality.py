"""Quality classifier from positive and unlabelled text.

Trusted positives are documents labelled 1; unlabelled are documents without a label.
Negative labels are never used. The classifier is additive: each document statistic is cut
into quantile bins of the unlabelled sample, and each bin has a weight.

1. A first fit separates positives from unlabelled text as if the latter were negative.
2. The class prior is estimated from its scores: the smallest ratio, over score thresholds,
   of the unlabelled to the positive share scoring at or above it, with a confidence margin
   (best-bin estimation), on the halves of both samples that the first fit did not see.
3. The final fit minimises the non-negative unbiased risk
   prior * R+(pos) + max(0, R-(unl) - prior * R-(pos)) with the logistic loss; whenever the
   inner part falls below zero on a batch, the step goes up its gradient instead.

At most ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED`` unlabelled documents are learned
from, those with the smallest hashes among documents not held out: a documented bound.

Edge cases, all defined: a null text is an empty one and is scored like any other; repeated
rows get equal scores; a document with conflicting labels is not learned from but not
unlabelled either; without positives or without unlabelled text every score is the prior 0.5;
an empty table gives an empty result. Kept columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import doc_stats, texts

MAX_POSITIVE = 20_000
MAX_UNLABELLED = 40_000
BINS = 24


@dataclass(frozen=True)
class Additive:
    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Position of every feature's bin in the one weight vector."""
        return codes(self.edges, x)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[self.codes(x)].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def codes(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    offsets = np.cumsum([0, *(len(e) + 1 for e in edges[:-1])])
    return np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]) + offsets


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """Upper estimate of the share of positives in unlabelled text, from classifier scores."""
    cuts = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    margin = sum(np.sqrt(np.log(4 / doubt) / (2 * len(s))) for s in (positive, unlabelled))
    usable = p > 0
    best = np.argmin((u[usable] + margin) / p[usable])
    return float(np.clip(u[usable][best] / p[usable][best], 0.01, 0.99))


def _descend(pos: np.ndarray, unl: np.ndarray, size: int, prior: float, positive_unlabelled: bool,
             rounds: int = 30, batch: int = 512, rate: float = 0.03, ridge: float = 1e-4,
             seed: int = 5) -> tuple[np.ndarray, float]:
    """Adam on minibatches of rows of bin positions."""
    rng = np.random.default_rng(seed)
    w = np.zeros(size + 1)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    batches = max(1, (len(pos) + len(unl)) // batch)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(rounds):
        parts = zip(np.array_split(rng.permutation(len(pos)), batches), np.array_split(rng.permutation(len(unl)), batches))
        for a, b in parts:
            if not len(a) or not len(b):
                continue
            zp, zu = w[pos[a]].sum(axis=1) + w[-1], w[unl[b]].sum(axis=1) + w[-1]
            sp, su = sigmoid(zp), sigmoid(zu)
            up = prior * (sp - 1) / len(a)  # gradient of prior * R+(pos)
            if positive_unlabelled:
                inner = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                gp, gu = -prior * sp / len(a), su / len(b)
                if inner < 0:
                    gp, gu = -gp, -gu
                else:
                    gp = gp + up
            else:
                gp, gu = up, (1 - prior) * su / len(b)
            grad = np.bincount(np.concatenate([pos[a].ravel(), unl[b].ravel()]),
                               np.repeat(np.concatenate([gp, gu]), pos.shape[1]), size + 1)
            grad[-1] = gp.sum() + gu.sum()
            grad[:-1] += ridge * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit_arrays(pos: np.ndarray, unl: np.ndarray) -> tuple[Additive, float] | None:
    """(classifier, estimated prior) from feature rows of positives and of unlabelled text."""
    if len(pos) < 2 or len(unl) < 2:
        return None
    edges = [np.unique(np.quantile(np.concatenate([pos[:, j], unl[:, j]]), np.linspace(0, 1, BINS + 1)[1:-1]))
             for j in range(pos.shape[1])]
    size = sum(len(e) + 1 for e in edges)
    cp, cu = codes(edges, pos), codes(edges, unl)
    first = Additive(edges, *_descend(cp[::2], cu[::2], size, 0.5, False))
    prior = best_bin_prior(first.score(pos[1::2]), first.score(unl[1::2]))
    return Additive(edges, *_descend(cp, cu, size, prior, True)), prior


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Additive, float] | None:
    positive = doc_stats.smallest(doc_stats.trusted(labels).where("y = 1"), MAX_POSITIVE, 3)
    labelled = labels.select(F.col("doc_id").alias("id")).where("id is not null").distinct()
    unlabelled = (
        docs.select(F.col("doc_id").alias("id")).where(F.col("id").isNotNull() & ~texts.held_out("id")).distinct()
        .join(labelled, "id", "left_anti").select("id", F.lit(0).alias("y")))
    unlabelled = doc_stats.smallest(unlabelled, MAX_UNLABELLED, 4)
    x, y = doc_stats.sample_features(docs, positive.unionByName(unlabelled))
    return fit_arrays(x[y == 1], x[y == 0])


def score(docs: DataFrame, labels: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The struct ``_row`` of ``keep`` columns, with score (0 to 1, higher is likelier good) and predicted (0 or 1)."""
    found = fit(docs, labels)

    def run(_, features: np.ndarray) -> dict[str, np.ndarray]:
        p = found[0].score(features) if found else np.full(len(features), 0.5)
        return {"score": p, "predicted": (p >= 0.5).astype(np.int32)}

    result = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return doc_stats.mapped(docs, text, keep, result, run)
