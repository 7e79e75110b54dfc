"""Soft alignment of pairs of sequences: matches, gaps with opening and extending costs, all alignments weighed at once.

A pair is two arrays of places. Its alignments are paths over three states: a match of an item of each, a model item without a
partner (missing), an observed item without one (extra). Sums over all paths (forward, backward) give how probable each
match and gap is; the best path comes from the same recursions with maxima. A task takes its pairs in batches of about one
size and runs each recursion for a whole batch, row by row, in log space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a batch's tables: bounds the memory of a worker. A longer pair is a batch of its own.
CELLS = 1 << 20
_NONE = -np.inf


@dataclass(frozen=True)
class Costs:
    """Costs of a gap's first and further items, by kind; what two matched places may differ by at most; the temperature."""

    missing_open: float = 2.0
    missing_extend: float = 1.0
    extra_open: float = 2.0
    extra_extend: float = 1.0
    reach: float = float("inf")
    temperature: float = 1.0


def _logsum(*parts: np.ndarray) -> np.ndarray:
    out = parts[0]
    for p in parts[1:]:
        out = np.logaddexp(out, p)
    return out


class Batch:
    """Tables (pairs, rows 0..n, columns 0..m) of pairs padded to one size; ``fold`` is a sum or a maximum in log space."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], costs: Costs):
        t = costs.temperature
        self.n, self.m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        rows, columns = int(self.n.max(initial=0)), int(self.m.max(initial=0))
        self.shape = (len(a), rows + 1, columns + 1)
        self.match = np.full((len(a), rows, columns), _NONE)
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            apart = np.abs(x[:, None] - y[None, :])
            self.match[k, : len(x), : len(y)] = np.where(apart <= costs.reach, -apart / t, _NONE)
        self.mo, self.me, self.eo, self.ee = -costs.missing_open / t, -costs.missing_extend / t, -costs.extra_open / t, -costs.extra_extend / t

    def _extras(self, source: np.ndarray, add) -> np.ndarray:
        """Column by column: extra items after what ``source`` holds, opened or extended."""
        out = np.full(source.shape, _NONE)
        steps = np.arange(source.shape[1]) * self.ee
        # A run that opened after column j costs eo + (k - j - 1) ee at column k: a running fold of what does not depend on k.
        if source.shape[1] > 1:
            begun = add.accumulate(source[:, :-1] + self.eo - steps[1:], axis=1)
            out[:, 1:] = begun + steps[1:]
        return out

    def forward(self, add=np.logaddexp) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of all paths (or of the best) to each cell, that end in a match, a missing or an extra item."""
        m, x, y = (np.full(self.shape, _NONE) for _ in range(3))
        m[:, 0, 0] = 0
        y[:, 0] = self._extras(m[:, 0], add)
        for i in range(1, self.shape[1]):
            into = add(add(m[:, i - 1], x[:, i - 1]), y[:, i - 1])
            m[:, i, 1:] = into[:, :-1] + self.match[:, i - 1]
            x[:, i] = add(add(m[:, i - 1], y[:, i - 1]) + self.mo, x[:, i - 1] + self.me)
            y[:, i] = self._extras(add(m[:, i], x[:, i]), add)
        return m, x, y

    def backward(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of all paths from each cell and state to the pair's end."""
        m, x, y = (np.full(self.shape, _NONE) for _ in range(3))
        pairs, columns = np.arange(self.shape[0]), self.shape[2]
        for i in range(self.shape[1] - 1, -1, -1):
            end = np.full((self.shape[0], columns), _NONE)
            last = pairs[self.n == i]
            end[last, self.m[last]] = 0
            go, to_x = np.full((self.shape[0], columns), _NONE), np.full((self.shape[0], columns), _NONE)
            if i + 1 < self.shape[1]:
                go[:, :-1] = m[:, i + 1, 1:] + self.match[:, i]
                to_x = x[:, i + 1]
            leave = _logsum(go, to_x + self.mo, end)
            steps = np.arange(columns) * self.ee
            # Extended up to a column and left there; from the right.
            y[:, i] = np.logaddexp.accumulate((leave + steps)[:, ::-1], axis=1)[:, ::-1] - steps
            open_ = np.full((self.shape[0], columns), _NONE)
            open_[:, :-1] = y[:, i, 1:] + self.eo
            m[:, i] = _logsum(leave, open_)
            x[:, i] = _logsum(go, to_x + self.me, end, open_)
        return m, x, y

    def posteriors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log of the sum over all paths; probabilities of each match, each missing and each extra item)."""
        forward, backward = self.forward(), self.backward()
        pairs = np.arange(self.shape[0])
        total = _logsum(*[f[pairs, self.n, self.m] for f in forward])
        with np.errstate(invalid="ignore"):
            share = [np.exp(np.where(np.isfinite(total)[:, None, None], f + b - total[:, None, None], _NONE)) for f, b in zip(forward, backward, strict=True)]
        return total, share[0][:, 1:, 1:], share[1][:, 1:].sum(axis=2), share[2][:, :, 1:].sum(axis=1)

    def best(self) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """(score of the best path, its matches): of equal ways into a cell, from a match, then from a missing item."""
        tables = self.forward(np.maximum)
        pairs = np.arange(self.shape[0])
        ends = np.array([f[pairs, self.n, self.m] for f in tables])
        return ends.max(axis=0), [self._traced(k, tables, int(ends[:, k].argmax())) if np.isfinite(ends[:, k]).any() else [] for k in pairs.tolist()]

    def _traced(self, k: int, tables: tuple[np.ndarray, ...], state: int) -> list[tuple[int, int]]:
        m, x, y = (t[k] for t in tables)
        i, j, out = int(self.n[k]), int(self.m[k]), []
        while i or j:
            if state == 0:
                out.append((i - 1, j - 1))
                i, j = i - 1, j - 1
                state = int(np.argmax((m[i, j], x[i, j], y[i, j])))
            elif state == 1:
                i -= 1
                state = int(np.argmax((m[i, j] + self.mo, x[i, j] + self.me, y[i, j] + self.mo)))
            else:
                # Back to where the run of extra items opened.
                steps = np.arange(j) * self.ee
                offers = np.maximum(m[i, :j], x[i, :j]) + self.eo - np.append(steps[1:], j * self.ee)
                j = int(np.flatnonzero(offers == offers.max())[-1])
                state = 0 if m[i, j] >= x[i, j] else 1
        return out[::-1]


def batches(sizes: np.ndarray, cells: int) -> list[np.ndarray]:
    """Rows of each batch: pairs of like size together, so that little is padded, of ``cells`` cells at most."""
    order = np.lexsort((sizes[:, 1], sizes[:, 0]))
    out, begin, rows, columns = [], 0, 0, 0
    for k, i in enumerate(order):
        r, c = max(rows, sizes[i, 0] + 1), max(columns, sizes[i, 1] + 1)
        if k > begin and r * c * (k - begin + 1) > cells:
            out.append(order[begin:k])
            begin, r, c = k, sizes[i, 0] + 1, sizes[i, 1] + 1
        rows, columns = r, c
    if begin < len(order):
        out.append(order[begin:])
    return out


def aligned(pairs: DataFrame, model: str, observed: str, costs: Costs = Costs(), cells: int = CELLS) -> DataFrame:
    """``pairs`` with log_sum, score, matches, expected_matches, missing and extra, for each pair of arrays of places.

    log_sum is over all alignments, score that of the best one; matches are its pairs of positions (i, j, from 0), each with its probability.
    expected_matches is the mean number of matches, missing and extra have the probability of each item to be without a
    partner. ``cells`` bounds the tables of a batch. A match costs the distance of its places (over the temperature), and is none beyond the reach. Null arrays are
    empty; null items are left out before they are numbered; two empty arrays have one alignment, of weight 1.
    """
    own, kinds = pairs.columns, dict(pairs.dtypes)
    made = "log_sum: double, score: double, matches: array<struct<i: int, j: int, p: double>>, expected_matches: double, missing: array<double>, extra: array<double>"
    clean = lambda c: F.coalesce(F.filter(F.col(c), lambda v: v.isNotNull()), F.array()).cast("array<double>")
    ready = pairs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), clean(model).alias("__a"), clean(observed).alias("__b"))

    def run(found):
        for batch in found:
            a, b = ([np.array(v, float) for v in batch.column(c).to_pylist()] for c in ("__a", "__b"))
            result: list = [None] * len(a)
            sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
            for rows in batches(sizes, cells):
                one = Batch([a[i] for i in rows], [b[i] for i in rows], costs)
                total, match, missing, extra = one.posteriors()
                score, paths = one.best()
                for k, i in enumerate(rows.tolist()):
                    n, m = sizes[i]
                    path = [{"i": p, "j": q, "p": float(match[k, p, q])} for p, q in paths[k]]
                    result[i] = {"log_sum": float(total[k]), "score": float(score[k]), "matches": path, "expected_matches": float(match[k].sum()), "missing": missing[k, :n].tolist(), "extra": extra[k, :m].tolist()}
            kind = pa.struct([("log_sum", pa.float64()), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("p", pa.float64())]))), ("expected_matches", pa.float64()), ("missing", pa.list_(pa.float64())), ("extra", pa.list_(pa.float64()))])
            yield pa.record_batch([batch.column("__row"), pa.array(result, kind)], names=["__row", "__made"])

    row = ", ".join(f"`{c}`: {kinds[c]}" for c in own)
    out = ready.mapInArrow(run, f"__row struct<{row}>, __made struct<{made}>")
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in own], "__made.*")
