"""Profiles of numbers: smoothing, peaks, and how well a gap fits a range."""

from __future__ import annotations

import math

import numpy as np


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian mean, cut at four sigma; beyond its ends the profile is mirrored."""
    reach = int(4 * sigma + 0.5)
    if reach == 0 or len(x) == 0:
        return x.astype(float)
    at = np.arange(-reach, reach + 1)
    weight = np.exp(-0.5 * (at / sigma) ** 2)
    place = np.arange(-reach, len(x) + reach) % (2 * len(x))
    mirrored = x[np.where(place < len(x), place, 2 * len(x) - 1 - place)]
    return np.convolve(mirrored, weight / weight.sum(), "valid")


def peaks(x: np.ndarray, apart: int, prominence: float) -> np.ndarray:
    """Places of the peaks of x (the middle of a flat one), the higher first, none nearer than ``apart`` to one taken, that
    stand out: above the higher of the two lowest points between them and higher ground by ``prominence`` or more."""
    found, k, n = [], 1, len(x)
    while k < n - 1:
        end = k
        while end + 1 < n and x[end + 1] == x[k]:
            end += 1
        if x[k - 1] < x[k] and end + 1 < n and x[end + 1] < x[k]:
            found.append((k + end) // 2)
        k = end + 1
    kept: list[int] = []
    for p in sorted(found, key=lambda p: (-x[p], -p)):
        if all(abs(p - q) >= apart for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        higher_left, higher_right = np.flatnonzero(x[:p] > x[p]), np.flatnonzero(x[p + 1 :] > x[p])
        left = x[(higher_left[-1] + 1 if len(higher_left) else 0) : p + 1].min()
        right = x[p : (p + 1 + higher_right[0] if len(higher_right) else n)].min()
        if x[p] - max(left, right) >= prominence:
            out.append(p)
    return np.array(out, int)


def conformity(gap: float, low: float, high: float, width: float = 0.22) -> float:
    """1 inside [low, high], falling as a Gaussian of the log ratio outside."""
    off = math.log(low / gap) if gap < low else math.log(gap / high) if gap > high else 0.0
    return math.exp(-0.5 * (off / width) ** 2)
