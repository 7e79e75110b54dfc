"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy.

A word has two hashes; its vector is made of a row of each of two tables, so that a collision in one is not a match.
Only words that the training texts of one class hold more often, beyond chance, get a vector; all others are unknown. Filters of several
widths slide over the words, the largest value of each is kept (over the whole text, whatever its length; stretches
without a known word are nothing), and a logistic unit gives the log-odds. A threshold for each language, which is told from the text's own function words,
is set on the training rows, and taken off the log-odds: 0.5 is the threshold in every language.

Null and empty texts have no words and get the score of silence, as all texts do that hold no known word. Very long
texts are scored whole. Without labelled rows of both classes all scores are 0. Repeated rows repeat; ties (of windows,
of languages, of thresholds) go to the first; an empty table gives an empty result; columns other than doc_id and text
are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, text_bytes
from .training import flat_bytes, held_out, labelled_sample, sigmoid, text_parts, word_hashes

FOLDS, HELD = 5, 0
BITS, HALF, FILTERS, WIDTHS = 18, 4, 8, (1, 2, 3)
BATCH, RATE, DECAY = 64, 0.01, 1e-4
#: Epochs, more where there are few rows: STEPS steps at least. Words that get a vector: those whose shares of toxic and of other training texts differ by so many standard errors.
STANDARD_ERRORS, EPOCHS, STEPS = 3.5, 12, 500
#: What calling a share of the clean texts toxic costs against missing a like share of the toxic ones.
WRONG = 3
#: Function words that tell a language. Fixed values.
LANGUAGES = {
    "en": "the of and to in is that for with on are was this by from".split(),
    "de": "der die und das von zu mit den ist nicht sich ein eine auf".split(),
    "fr": "le les et des un une est dans pour qui sur par du au".split(),
    "es": "el los las y en con del se una para al lo su por".split(),
}


@dataclass
class Model:
    rows: tuple[np.ndarray, np.ndarray]  # trained rows of the two tables, ascending
    vectors: tuple[np.ndarray, np.ndarray]
    filters: list[np.ndarray]  # (FILTERS, width * 2 * HALF)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray  # by language, the last for none


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BITS) - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(40) & mask).astype(np.int64)


def _language_hashes() -> np.ndarray:
    """(hashes, language) of the function words, by hash."""
    words = [(w, k) for k, ws in enumerate(LANGUAGES.values()) for w in ws]
    h, *_ = word_hashes(*flat_bytes([w for w, _ in words]))
    order = np.argsort(h)
    return h[order], np.array([k for _, k in words])[order]


def languages(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Each text's language by number: the one with most function words; len(LANGUAGES) if there are none."""
    keys, of = _language_hashes()
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = keys[at] == h
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    n = len(LANGUAGES)
    counts = np.bincount(doc[hit] * n + of[at[hit]], minlength=(len(edges) - 1) * n).reshape(-1, n)
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), n) if len(counts) else np.zeros(0, np.int64)


def _windows(known: np.ndarray, edges: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the stretches of w words that hold a known word and lie in one text, and their texts."""
    if len(known) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    any_ = known[: len(known) - w + 1].copy()
    for j in range(1, w):
        any_ |= known[j : len(known) - w + 1 + j]
    start = np.flatnonzero(any_)
    doc = np.searchsorted(edges, start, "right") - 1
    fits = start + w <= edges[doc + 1]
    return start[fits], doc[fits]


def gradients(params: list[np.ndarray], spans, ids: np.ndarray, a: np.ndarray, b: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean weighted log loss of the texts ``ids``, and its gradient for each of the parameters.

    ``spans``: for each width the starts of windows and the place of each text's first one. a, b: rows of the words.
    """
    tables, filters, bias, out, out_bias = params[:2], params[2 : 2 + len(WIDTHS)], params[2 + len(WIDTHS) : -2], params[-2], params[-1]
    kind = out.dtype
    pooled = np.zeros((len(ids), len(WIDTHS) * FILTERS), kind)
    place = np.full(pooled.shape, -1)
    for k, (w, (start, at)) in enumerate(zip(WIDTHS, spans, strict=True)):
        own = [start[at[d] : at[d + 1]] for d in ids]
        p = np.concatenate(own)
        seen = np.concatenate([t[r[p + j]] for j in range(w) for t, r in zip(tables, (a, b), strict=True)], axis=1) @ filters[k].T + bias[k]
        lo = 0
        for r, q in enumerate(own):
            if len(q):
                part = seen[lo : lo + len(q)]
                top = part.argmax(axis=0)
                value = part[top, np.arange(FILTERS)]
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                pooled[r, cols], place[r, cols] = np.maximum(value, 0), np.where(value > 0, q[top], -1)
                lo += len(q)
    z = pooled @ out + out_bias
    loss = float((weight[ids] * np.logaddexp(0, np.where(y[ids] == 1, -z, z))).sum() / len(ids))
    error = (sigmoid(z) - y[ids]) * weight[ids] / len(ids)
    grads = [np.zeros_like(x) for x in params]
    grads[-2], grads[-1] = (pooled.T @ error).astype(kind), np.array([error.sum()], kind)
    back = (error[:, None] * out[None, :]).astype(kind)
    for k, w in enumerate(WIDTHS):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        d, n = np.nonzero(place[:, cols] >= 0)
        p, g = place[:, cols][d, n], back[:, cols][d, n]
        for j in range(w):
            part = slice(j * 2 * HALF, (j + 1) * 2 * HALF)
            vector = np.concatenate([tables[0][a[p + j]], tables[1][b[p + j]]], axis=1)
            np.add.at(grads[2 + k][:, part], n, g[:, None] * vector)
            pull = g[:, None] * filters[k][n, part]
            np.add.at(grads[0], a[p + j], pull[:, :HALF])
            np.add.at(grads[1], b[p + j], pull[:, HALF:])
        np.add.at(grads[2 + len(WIDTHS) + k], n, g)
    return loss, grads


def spans_of(known: np.ndarray, edges: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for w in WIDTHS:
        start, doc = _windows(known, edges, w)
        out.append((start, np.searchsorted(doc, np.arange(len(edges)))))
    return out


def _fit(texts: int, edges, a, b, y, params, epochs: int, rng, moments) -> None:
    """Adam epochs over the words whose rows a, b are not 0; rows, filters and the output change in place."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    spans = spans_of(a > 0, edges)
    for _ in range(epochs):
        order = rng.permutation(texts)
        for i in range(0, len(order), BATCH):
            _, grads = gradients(params, spans, order[i : i + BATCH], a, b, y, weight)
            moments["t"] += 1
            for x, g, m, v in zip(params, grads, moments["m"], moments["v"], strict=True):
                g = g + DECAY * x
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= RATE * (m / (1 - 0.9 ** moments["t"])) / (np.sqrt(v / (1 - 0.999 ** moments["t"])) + 1e-6)
            params[0][0] = params[1][0] = 0


def telling_words(h: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes (signed, ascending) of the words that more toxic than other texts hold, or the other way, beyond chance."""
    both = np.unique(np.stack([h.view(np.int64), doc], axis=1), axis=0)
    word, at = np.unique(both[:, 0], return_inverse=True)
    toxic = y[both[:, 1]] == 1
    n1, n0 = (np.bincount(at[k], minlength=len(word)) for k in (toxic, ~toxic))
    t1, t0 = (y == 1).sum(), (y == 0).sum()
    # Some seen and unseen texts more: a word of only a few texts tells nothing.
    share = (n1 + n0 + 8) / (t1 + t0 + 16)
    z = (n1 / t1 - n0 / t0) / np.sqrt(share * (1 - share) * (1 / t1 + 1 / t0))
    return np.sort(word[np.abs(z) >= STANDARD_ERRORS])


def train(texts: list[str], y: np.ndarray, seed: int = 5) -> Model | None:
    """Log loss over the telling words, classes weighing the same, then the thresholds."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    parts = [word_hashes(*p)[:2] for p in text_parts(texts)]
    h = np.concatenate([p[0] for p in parts])
    edges = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
    doc = np.repeat(np.arange(len(texts)), np.diff(edges))
    word = telling_words(h, doc, y)
    places = _places(word.view(np.uint64))
    rows = tuple(np.unique(p) for p in places)
    # Row 0 of a trained table is the zero vector of all other words.
    ra, rb = (np.searchsorted(r, p) + 1 for r, p in zip(rows, places, strict=True))
    at = np.searchsorted(word, h.view(np.int64))
    at[at == len(word)] = 0
    number = np.where(word[at] == h.view(np.int64), at, -1) if len(word) else np.full(len(h), -1)
    params = [np.concatenate([np.zeros((1, HALF)), rng.normal(0, 0.1, (len(r), HALF))]).astype(np.float32) for r in rows]
    params += [rng.normal(0, 0.5 / np.sqrt(w), (FILTERS, w * 2 * HALF)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    params += [rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), np.zeros(1, np.float32)]
    moments = {"m": [np.zeros_like(x) for x in params], "v": [np.zeros_like(x) for x in params], "t": 0}
    a, b = (np.where(number >= 0, r[number], 0) if len(word) else np.zeros(len(h), np.int64) for r in (ra, rb))
    _fit(len(texts), edges, a, b, y, params, max(EPOCHS, -(-STEPS * BATCH // len(texts))), rng, moments)
    model = Model(rows, (params[0][1:], params[1][1:]), params[2 : 2 + len(WIDTHS)], params[2 + len(WIDTHS) : -2], params[-2], float(params[-1][0]), np.zeros(len(LANGUAGES) + 1))
    z, lang = Scorer(model).raw(h, edges)
    model.thresholds[:] = threshold(z, y)
    for k in range(len(LANGUAGES)):
        own = lang == k
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= 20:
            model.thresholds[k] = threshold(z[own], y[own])
    return model


def threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest stretch of log-odds that parts the classes with least error: shares missed, and WRONG times shares wrongly called toxic."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    missed = np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum())
    wrong = 1 - np.concatenate([[0], np.cumsum(y == 0)]) / max(1, (y == 0).sum())
    edge = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    gap = np.concatenate([[0], np.diff(z), [0]])
    cost = missed + WRONG * wrong
    cost[1:-1][gap[1:-1] < 1e-6] = np.inf  # equal log-odds can't be parted
    return float(edge[np.lexsort((-gap, np.round(cost, 9)))[0]])


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        # For each hash value the place of its row, 0 if it has none.
        self.place = [np.zeros(1 << BITS, np.int32) for _ in model.rows]
        for p, r in zip(self.place, model.rows, strict=True):
            p[r] = np.arange(1, len(r) + 1)
        self.tables = [np.concatenate([np.zeros((1, HALF), np.float32), v]) for v in model.vectors]

    def raw(self, h: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds before thresholds, and languages. A word is known only if both of its rows are."""
        m = self.model
        a, b = (p[q] for p, q in zip(self.place, _places(h), strict=True))
        known = (a > 0) & (b > 0)
        a, b = np.where(known, a, 0), np.where(known, b, 0)
        z = np.full(len(edges) - 1, m.out_bias, np.float64)
        for k, w in enumerate(WIDTHS):
            p, doc = _windows(known, edges, w)
            if len(p) == 0:
                continue
            seen = np.concatenate([t[r[p + j]] for j in range(w) for t, r in zip(self.tables, (a, b), strict=True)], axis=1) @ m.filters[k].T + m.bias[k]
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            z[doc[first]] += np.maximum(np.maximum.reduceat(seen, first, axis=0), 0) @ m.out[k * FILTERS : (k + 1) * FILTERS]
        return z, languages(h, edges)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        h, edges, *_ = word_hashes(data, offsets)
        z, lang = self.raw(h, edges)
        return sigmoid(z.astype(np.float64) - self.model.thresholds[lang])


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score for each row."""
    scorer = []

    def kernel(t: pa.Table):
        data, offsets = text_bytes(t.column("text"))
        if model is None:
            score = np.zeros(len(offsets) - 1)
        else:
            if not scorer:
                scorer.append(Scorer(model))
            score = scorer[0].score(data, offsets)
        yield t.drop_columns(["text"]).append_column("score", pa.array(score))

    return arrow_map(docs.select("doc_id", "text"), kernel, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; the model is trained on rows that are not held out."""
    model = train(*labelled_sample(docs, labels, "toxic", folds, held))
    out = scored(docs, model)
    return out.select("doc_id", held_out(out["doc_id"], folds, held).alias("held_out"), "score", (out["score"] >= 0.5).cast("int").alias("predicted"))
