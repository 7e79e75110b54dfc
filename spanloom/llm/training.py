"""What the trained classifiers share: folds, bounded samples of labelled rows, hashed words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold
from .near_dup import _mix

#: Labelled rows of each class, and bytes of a row's text, that a classifier is fitted on at most.
ROWS_PER_CLASS, ROW_BYTES = 3000, 32_768
_U = np.uint64
_BYTE = np.random.default_rng(97).integers(1, 1 << 63, 256, dtype=np.uint64)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_BASE = _U(0x9E3779B97F4A7C15)
#: Bytes of words: ASCII letters and digits, and all of UTF-8 beyond ASCII.
WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def held_out(doc_id: Column, folds: int, held: int) -> Column:
    return fold(doc_id, folds) == held


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, held: int, per_class: int = ROWS_PER_CLASS, row_bytes: int = ROW_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels: of each class the ``per_class`` ids that come first by a hash of the id, held-out ids never.

    Texts over ``row_bytes`` are for scoring only. Ids with two different labels are left out; of an id's rows the text
    with the least hash is taken, so that 2 * per_class texts are the most that the driver gets.
    """
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, held))
    known = known.groupBy("doc_id").agg(F.min(target).alias("y"), F.max(target).alias("z")).where("y = z").drop("z")
    short = docs.where(F.octet_length("text") <= row_bytes).select("doc_id")
    pool = short.join(known, "doc_id").select("doc_id", "y").distinct()
    picked = None
    for y in (0, 1):
        part = pool.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * per_class ids: a bounded broadcast.
    own = docs.where(F.octet_length("text") <= row_bytes).join(F.broadcast(picked), "doc_id")
    one = own.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("r"))
    rows = one.select("doc_id", "r.text", "r.y").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in rows], np.array([r.y for r in rows], np.float64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased), the range of words of each text (edges), words' starts and sizes."""
    inside = WORD_BYTE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = inside[first]
    start = np.flatnonzero(begins)
    if len(start) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), start, start
    stretch = np.diff(np.append(start, len(data)))
    power = np.cumprod(np.concatenate([[_U(1)], np.full(int(stretch.max()), _BASE)]))
    value = _BYTE[data]
    value[~inside] = 0
    at = np.arange(start[0], len(data)) - np.repeat(start, stretch)
    h = _mix(np.add.reduceat(value[start[0] :] * power[at], start - start[0]))
    size = np.add.reduceat(inside[start[0] :].astype(np.int64), start - start[0])
    return h, np.searchsorted(start, offsets), start, size


def flat_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def text_parts(texts: list[str], part: int = 1 << 20):
    """The texts' bytes and offsets, about ``part`` bytes at a time: bounds the memory of what is computed on the driver."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= part or i == len(texts) - 1:
            yield flat_bytes(texts[lo : i + 1])
            lo, size = i + 1, 0
