"""Logistic calibration on one or two variables from a histogram that Spark gathers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 200   # on either side of the origin, in every variable


def fit_logistic(scored: DataFrame, xs: Sequence[str], label: str, widths: Sequence[float],
                 anchors: Sequence[tuple]) -> np.ndarray:
    """Coefficients (intercept, one slope per variable) of P(label = 1 | xs).

    Only a histogram with class counts reaches the driver — bins of the given widths, a
    bounded grid — so every labelled row counts at any size.  ``anchors`` are
    pseudo-observations (*xs, label, weight) that hold the fit where labels are few.
    """
    bins = [F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.round(F.col(x) / w))).cast("int").alias(f"b{i}")
            for i, (x, w) in enumerate(zip(xs, widths, strict=True))]
    rows = scored.groupBy(*bins, F.col(label).cast("int").alias("y")).count().collect()
    k = len(xs)
    seen = [(*[r[f"b{i}"] * widths[i] for i in range(k)], r["y"], r["count"]) for r in rows] + list(anchors)
    data = np.array(seen, dtype=float)
    v = np.column_stack([np.ones(len(data)), data[:, :k]])
    y, w = data[:, k], data[:, k + 1]
    beta = np.zeros(k + 1)
    ridge = np.full(k + 1, 1e-3)
    for _ in range(200):   # Newton steps with a light ridge
        p = 1 / (1 + np.exp(-np.clip(v @ beta, -30, 30)))
        g = v.T @ (w * (y - p)) - ridge * beta
        h = (v * (w * p * (1 - p))[:, None]).T @ v + np.diag(ridge)
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def logistic(beta: Sequence[float], *xs: str) -> Column:
    """The fitted probability as a column."""
    z = F.lit(float(beta[0]))
    for b, x in zip(beta[1:], xs, strict=True):
        z = z + F.lit(float(b)) * F.col(x)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
