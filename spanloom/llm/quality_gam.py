"""Quality: a generalised additive model with pairwise interactions, trained by cyclic boosting.

Each feature of a text is binned at quantiles of the training rows. Round after round, feature after feature, a tree of
depth two over the feature's bins is fitted to what the log loss still asks for, and its leaves are added to the
feature's lookup table. Then the pairs of features whose joint bins still explain most get tables of their own, by
trees that cut each of the two features once. A score is the sum of table entries at the text's bins.

Null and empty texts have features like others (all counts 0). Very long texts are measured whole. Without labelled rows
of both classes all scores are 0. Repeated rows repeat; a value equal to a cut is in the bin above it, and cuts of equal
gain go to the first; an empty table gives an empty result; columns other than doc_id and text are not looked at,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, text_bytes
from .toxicity import _language_hashes
from .training import held_out, labelled_sample, sigmoid, text_parts, word_hashes

FOLDS, HELD = 3, 1
BINS, PAIR_BINS, PAIRS = 32, 8, 12
ROUNDS, PAIR_ROUNDS, RATE, LEAST_WEIGHT, SHRINK = 60, 40, 0.2, 4.0, 2.0
FEATURES = (
    "words log_words word_length longest_word upper digits symbols exclamation punctuation other_bytes spaces distinct_words top_word "
    "same_as_before function_words log_lines line_length duplicate_lines short_words words_in_duplicate_pairs sentence_length"
).split()
_KIND = np.zeros(256, np.uint8)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>@^_~=+\\/{}[]", "!", ".,;:?'\"()-", " \t\n\x0b\x0c\r"), 1):
    for _c in _chars:
        _KIND[ord(_c)] = _i
_KIND[128:] = 7


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _per_text(keys: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: how many different keys it has, the count of its most frequent one, and how many keys come once."""
    n = len(edges) - 1
    doc = np.repeat(np.arange(n), np.diff(edges))
    order = np.lexsort((keys, doc))
    d, k = doc[order], keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(k)))
    owner = d[at]
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, size)
    return np.bincount(owner, minlength=n), top, np.bincount(owner[size == 1], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) of whole texts."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    h, edges, start, length = word_hashes(data, offsets)
    words = np.diff(edges)
    per_word = np.maximum(words, 1)
    kind = _KIND[data]
    share = [_sums(kind == k, offsets) / size for k in range(1, 8)]
    distinct, top, _ = _per_text(h, edges)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[edges[:-1][edges[:-1] < len(h)]] = False
    longest = np.zeros(n, np.int64)
    doc = np.repeat(np.arange(n), words)
    np.maximum.at(longest, doc, length)
    pair = h * np.uint64(3) + np.roll(h, -1) * np.uint64(7)
    _, _, once = _per_text(pair, edges)
    keys, _ = _language_hashes()
    function = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
    # A line's hash: its words' hashes, weighed by their place in it. Lines without a word are left out.
    line_start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 10) + 1]))
    line_start = line_start[line_start < len(data)]
    line_edges = np.searchsorted(line_start, offsets)
    word_line = np.searchsorted(line_start, start, "right") - 1
    place = np.arange(len(h)) - np.searchsorted(word_line, word_line)
    line_hash = np.zeros(len(line_start), np.uint64)
    np.add.at(line_hash, word_line, h * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
    has = np.bincount(word_line, minlength=len(line_start)) > 0
    kept = np.concatenate([[0], np.cumsum(has)])[line_edges]
    different, _, _ = _per_text(line_hash[has], kept)
    lines = np.diff(kept)
    ends = _sums((data == 46) | (data == 33) | (data == 63), offsets)
    out = [
        words, np.log1p(words), _sums(length, edges) / per_word, longest, *share[:6], share[6], distinct / per_word, top / per_word,
        _sums(same, edges) / per_word, _sums(function, edges) / per_word, np.log1p(lines), words / np.maximum(lines, 1), (lines - different) / np.maximum(lines, 1),
        _sums(length <= 2, edges) / per_word, 1 - once / per_word, words / np.maximum(ends, 1),
    ]
    return np.stack(out, axis=1).astype(np.float64)


@dataclass
class Model:
    cuts: list[np.ndarray]  # of each feature
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]  # cuts of each feature in pairs
    pair_tables: list[np.ndarray]
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.log_odds(x))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += table[np.searchsorted(cut, x[:, f], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return z


def _quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower"))


def _leaf(g, w):
    return g / (w + SHRINK)


def _split(g: np.ndarray, w: np.ndarray) -> tuple[float, int]:
    """Best single cut of ordered bins with gradient sums g and weights w: gain, first bin of the right part (0: none)."""
    gl, wl = np.cumsum(g)[:-1], np.cumsum(w)[:-1]
    gr, wr = g.sum() - gl, w.sum() - wl
    gain = gl**2 / (wl + SHRINK) + gr**2 / (wr + SHRINK) - g.sum() ** 2 / (w.sum() + SHRINK)
    gain[(wl < LEAST_WEIGHT / 4) | (wr < LEAST_WEIGHT / 4)] = 0
    if len(gain) == 0 or gain.max() <= 1e-9:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def _shallow_tree(g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Leaf values of a tree of depth two, bin by bin."""
    _, k = _split(g, w)
    parts = [(0, k), (k, len(g))] if k else [(0, len(g))]
    out = np.zeros(len(g))
    for lo, hi in parts:
        _, j = _split(g[lo:hi], w[lo:hi]) if k else (0, 0)
        for a, b in [(lo, lo + j), (lo + j, hi)] if j else [(lo, hi)]:
            out[a:b] = _leaf(g[a:b].sum(), w[a:b].sum())
    return out


def _pair_tree(g: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of each of two features at once: gain, and leaf values of the four quadrants, cell by cell."""
    G, W = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(w, 0), 1)
    if min(G.shape) < 2:
        return 0.0, np.zeros_like(g)
    quads = []
    for A in (G, W):
        a = A[:-1, :-1]
        b, c, d = A[:-1, -1:] - a, A[-1:, :-1] - a, A[-1, -1] - A[:-1, -1:] - A[-1:, :-1] + a
        quads.append((a, b, c, d))
    gain = sum(x**2 / (y + SHRINK) for x, y in zip(*quads, strict=True)) - G[-1, -1] ** 2 / (W[-1, -1] + SHRINK)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    leaves = [_leaf(x[i, j], y[i, j]) for x, y in zip(*quads, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaves
    return float(gain[i, j]), out


def train(x: np.ndarray, y: np.ndarray) -> Model | None:
    """Newton boosting of the log loss, classes weighing the same."""
    if len(set(y.tolist())) < 2:
        return None
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    cuts, coarse = [_quantile_cuts(v, BINS) for v in x.T], [_quantile_cuts(v, PAIR_BINS) for v in x.T]
    bins = [np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)]
    tables, z = [np.zeros(len(c) + 1) for c in cuts], np.zeros(len(y))
    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            p = sigmoid(z)
            g = np.bincount(b, weight * (y - p), len(tables[f]))
            w = np.bincount(b, weight * p * (1 - p), len(tables[f]))
            step = RATE * _shallow_tree(g, w)
            tables[f] += step
            z += step[b]
    small = [np.searchsorted(c, v, "right") for c, v in zip(coarse, x.T, strict=True)]
    shape = lambda a, b: (len(coarse[a]) + 1, len(coarse[b]) + 1)

    def cells(a, b, z):
        p, at, (n, m) = sigmoid(z), small[a] * shape(a, b)[1] + small[b], shape(a, b)
        return np.bincount(at, weight * (y - p), n * m).reshape(n, m), np.bincount(at, weight * p * (1 - p), n * m).reshape(n, m)

    every = [(a, b) for a in range(x.shape[1]) for b in range(a)]
    gains = [_pair_tree(*cells(a, b, z))[0] for a, b in every]
    pairs = [every[i] for i in sorted(range(len(every)), key=lambda i: -gains[i])[:PAIRS]]
    pair_tables = [np.zeros(shape(a, b)) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(pairs):
            step = RATE * _pair_tree(*cells(a, b, z))[1]
            pair_tables[k] += step
            z += step[small[a], small[b]]
    return Model(cuts, tables, pairs, coarse, pair_tables, 0.0)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score for each row."""

    def kernel(t: pa.Table):
        data, offsets = text_bytes(t.column("text"))
        score = np.zeros(len(offsets) - 1) if model is None else model.score(features(data, offsets))
        yield t.drop_columns(["text"]).append_column("score", pa.array(score))

    return arrow_map(docs.select("doc_id", "text"), kernel, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; the model is trained on rows that are not held out."""
    texts, y = labelled_sample(docs, labels, "quality", folds, held)
    out = scored(docs, train(np.concatenate([features(*p) for p in text_parts(texts)]), y) if texts else None)
    return out.select("doc_id", held_out(out["doc_id"], folds, held).alias("held_out"), "score", (out["score"] >= 0.5).cast("int").alias("predicted"))
