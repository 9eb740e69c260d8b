"""Logistic calibration of a few statistics, fitted on a bounded sample in the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(name: str) -> Column:
    """Whether crc32 of the doc_id as text is divisible by 5 (false without doc_id)."""
    found = F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0
    return F.coalesce(found, F.lit(False))


def fit_logistic(inputs: np.ndarray, labels: np.ndarray, share: float, ridge: float = 1.0) -> dict:
    """Weights for standardised inputs, by Newton steps on the penalised likelihood.

    Classes weigh so that label 1 has the given share, which a sample balanced between the
    classes would hide. Order of rows does not matter beyond rounding.
    """
    order = np.lexsort([*inputs.T, labels])
    inputs, labels = inputs[order], labels[order].astype(float)
    ones = labels.sum()
    if not len(labels) or ones in (0, len(labels)):
        return {"mean": np.zeros(inputs.shape[1]), "scale": np.ones(inputs.shape[1]),
                "weights": np.zeros(inputs.shape[1]), "bias": float(np.log(share / (1 - share)))}
    mean, scale = inputs.mean(axis=0), inputs.std(axis=0) + 1e-12
    x = np.column_stack([(inputs - mean) / scale, np.ones(len(labels))])
    mass = np.where(labels == 1, share / ones, (1 - share) / (len(labels) - ones)) * len(labels)
    weights, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (mass * (p - labels)) + penalty * weights
        curve = (x * (mass * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-9:
            break
    return {"mean": mean, "scale": scale, "weights": weights[:-1], "bias": float(weights[-1])}


def logistic(model: dict, names: list[str]) -> Column:
    """Probability of label 1 as a column; null if an input is null."""
    total = F.lit(model["bias"])
    for i, name in enumerate(names):
        total = total + (F.col(name) - float(model["mean"][i])) / float(model["scale"][i]) * float(model["weights"][i])
    return 1 / (1 + F.exp(-total))
