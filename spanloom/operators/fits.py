"""Robust fits from many starts: starts are rows, and run apart."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import stable_hash


def _residuals(p: np.ndarray, sense: int, winding: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    cy, cx, log_dr, phase = p
    theta = np.mod(sense * (np.arctan2(y - cy, x - cx) - phase), 2 * np.pi)
    return np.hypot(y - cy, x - cx) - (winding + theta / (2 * np.pi)) * math.exp(log_dr)


def soft_l1_fit(residuals, start: np.ndarray, scale: float, rounds: int = 200) -> np.ndarray:
    """Damped Gauss-Newton steps on the sum of 2 (sqrt(1 + (r / scale)^2) - 1), slopes by differences."""

    def cost(p):
        return float(np.sum(np.sqrt(1 + (residuals(p) / scale) ** 2) - 1))

    p, damp = start.astype(float), 1e-3
    now = cost(p)
    for _ in range(rounds):
        r = residuals(p)
        slope = np.stack([(residuals(p + h) - r) / h[k] for k, h in enumerate(np.diag(1e-6 * np.maximum(1.0, np.abs(p))))], axis=1)
        slope[np.abs(slope) > 1e6] = 0  # a point at the seam jumps by a turn
        weight = 1 / np.sqrt(1 + (r / scale) ** 2)
        square, pull = (slope * weight[:, None]).T @ slope, slope.T @ (weight * r)
        for _ in range(12):
            step = np.linalg.lstsq(square + damp * np.diag(np.diag(square) + 1e-12), -pull, rcond=None)[0]
            new = cost(p + step)
            if new < now:
                break
            damp *= 4
        else:
            return p
        p, damp, gain, now = p + step, max(damp / 8, 1e-12), now - new, new
        if gain < 1e-12 * max(1.0, now):
            return p
    return p


def fit_spiral(points: DataFrame, per_turn: list[float], scale: float, most: int = 2000, seed: str = "fit", phases: int = 8) -> DataFrame:
    """cy, cx, dr, phase, sense, error: the spiral r = (winding + theta / 2 pi) dr around (cy, cx) that fits points (winding, y, x) best.

    theta is the angle from ``phase`` on, one way round (sense 1) or the other (-1). The loss is soft-L1 with ``scale``, so that
    stray points count little. Starts are both senses, two centres, all of ``per_turn`` and ``phases`` angles; the one whose
    mean absolute residual ends least wins. Fitted on at most ``most`` points, those first by a seeded hash.
    """
    n = points.select(F.col("winding").cast("double"), F.col("y").cast("double"), F.col("x").cast("double"))
    sample = n.orderBy(stable_hash("winding", "y", "x", seed=seed), "winding", "y", "x").limit(most).collect()
    w, y, x = (np.array(c) for c in zip(*sample, strict=True)) if sample else (np.zeros(0),) * 3
    inner = w <= np.min(w, initial=np.inf) + 3
    centres = [(float(np.median(y)), float(np.median(x))), (float(y[inner].mean()), float(x[inner].mean()))] if sample else []
    starts = list(itertools.product((1, -1), range(len(centres)), per_turn, range(phases)))
    spark = points.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k in batch["id"].tolist():
                sense, centre, dr, phase = starts[k]
                at = np.array([*centres[centre], math.log(dr), 2 * math.pi * phase / phases])
                p = soft_l1_fit(lambda q, sense=sense: _residuals(q, sense, w, y, x), at, scale)
                out.append((k, *p[:2], math.exp(p[2]), p[3] % (2 * math.pi), sense, float(np.abs(_residuals(p, sense, w, y, x)).mean())))
            yield pd.DataFrame(out, columns=["id", "cy", "cx", "dr", "phase", "sense", "error"])

    done = spark.range(0, len(starts), 1, max(1, min(64, len(starts)))).mapInPandas(run, "id bigint, cy double, cx double, dr double, phase double, sense int, error double")
    best = F.min_by(F.struct("cy", "cx", "dr", "phase", "sense", "error"), F.struct(F.round("error", 9), "id")).alias("r")
    return done.agg(best).where("r is not null").select("r.*")
