"""Near-duplicates by MinHash bands, odd sketches and a check of the full shingle sets.

A document's set is its distinct shingles of ``words`` words (A-Z lower-cased); with fewer words, all of them as one
shingle; without words, nothing. Documents with one set are a class, whose set is looked at once. Among classes that agree in
a band of MinHash values, the exclusive or of two odd sketches (parity bitmaps of the MinHash samples) estimates the
similarity; pairs not clearly below the threshold make families, as a spanning forest of each bucket. A family's full
sets then decide: in blocks, products of its bit matrix give all intersections, and a spanning forest of the links goes
out, never all pairs. A link needs 100 * intersection >= percent * union.

Null and empty texts have no words and link to nothing. Very long texts have one signature from their whole set, and are
compared whole. Null doc_ids take part, but are never a component's id unless all are null; rows that repeat are one
document, all kept if its id is the least: ties of ids stay together. An empty table gives an empty result. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, give_back, in_batches, text_bytes
from .components import connected_components
from .suffix_dedup import with_text_hash

BANDS, ROWS, SAMPLES, SKETCH_BITS = 24, 4, 128, 1024
#: Estimates below this are left out: over five standard deviations under a similarity of 0.8.
FLOOR = 0.6
#: Members of a bucket whose sketches are compared in one part of a block, and members of a family whose full sets are.
SKETCHES, BLOCK = 2048, 512
_U = np.uint64
_RNG = np.random.default_rng(41)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_BASE, _LEN = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_PLACE = _RNG.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_A = _RNG.integers(1 << 62, 1 << 63, SAMPLES, dtype=np.uint64) * _U(2) + _U(1)
_B = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    n = len(offsets) - 1
    if len(data) == 0:
        return [np.zeros(0, np.uint64)] * n
    gap = _SPACE[data]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins = ~gap
    begins[1:] &= gap[:-1]
    begins[first] = ~gap[first]
    start = np.flatnonzero(begins)
    if len(start) == 0:
        return [np.zeros(0, np.uint64)] * n
    # A word's hash: a polynomial over its bytes; white space counts nothing and so ends it.
    size = np.diff(np.append(start, len(data)))
    power = np.cumprod(np.concatenate([[_U(1)], np.full(int(size.max()), _BASE)]))
    value = _BYTE[data]
    value[gap] = 0
    at = np.arange(start[0], len(data)) - np.repeat(start, size)
    word = _mix(np.add.reduceat(value[start[0] :] * power[at], 0 * start[:1] if len(start) == 0 else start - start[0]))
    edge = np.searchsorted(start, offsets)
    total = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for j in range(words):
        total += word[j : len(word) - words + 1 + j] * _PLACE[j % 64]
    total = _mix(total)
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(total[a : b - words + 1]))
        elif b > a:
            short = (word[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(_mix(short + np.array([b - a], np.uint64) * _LEN))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhashes(s: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, ~_U(0))
    for i in range(0, len(s), 2048):
        part = s[None, i : i + 2048] * _A[:, None]
        part += _B[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def band_keys(mh: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys of a (documents, SAMPLES) matrix."""
    rows = mh[:, : BANDS * ROWS].reshape(len(mh), BANDS, ROWS)
    return _mix((rows * _PLACE[:ROWS]).sum(axis=2, dtype=np.uint64) + _PLACE[ROWS : ROWS + BANDS]).view(np.int64)


def odd_sketches(mh: np.ndarray) -> np.ndarray:
    """(documents, SKETCH_BITS / 64) words: bit i is the parity of the samples that hash to i."""
    bit = (_mix(mh + np.arange(1, SAMPLES + 1, dtype=np.uint64) * _BASE) % _U(SKETCH_BITS)).astype(np.int64)
    flat = (np.arange(len(mh))[:, None] * SKETCH_BITS + bit).ravel()
    parity = (np.bincount(flat, minlength=len(mh) * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity).reshape(len(mh), SKETCH_BITS // 8).view(np.int64)


def most_odd_bits(floor: float = FLOOR) -> int:
    """Population count of the exclusive or that an estimated similarity of ``floor`` has."""
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * SAMPLES * (1 - floor))))


def _signature_kernel(words: int):
    import xxhash

    def kernel(t: pa.Table):
        sets = shingle_sets(*text_bytes(t.column("text")), words)
        mh = np.array([minhashes(s) for s in sets]).reshape(len(sets), SAMPLES)
        node = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        lists = lambda m: pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel()))
        out = t.drop_columns(["text"]).append_column("n_shingles", pa.array([len(s) for s in sets], pa.int64()))
        out = out.append_column("node", pa.array(node, pa.binary()))
        yield out.append_column("bands", lists(band_keys(mh))).append_column("sketch", lists(odd_sketches(mh)))

    return kernel


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, th1, th2, n_shingles, node (hash of the set; null without words), bands, sketch."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, th1 bigint, th2 bigint, n_shingles bigint, node binary, bands array<bigint>, sketch array<bigint>"
    return arrow_map(with_text_hash(docs.select("doc_id", "text")).select("doc_id", "th1", "th2", "text"), _signature_kernel(words), schema)


class Forest:
    """Union-find over the rows of a block, some of which are already together."""

    def __init__(self, labels: list):
        first: dict = {}
        self.root = [first.setdefault(x, i) if x is not None else i for i, x in enumerate(labels)]
        self.before = sorted(set(self.root))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def unite(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def stars(self, node: list) -> list[tuple]:
        """Pairs that connect what was united: one node of each part that was apart before, with the least of them."""
        least: dict = {}
        for i in self.before:
            r = self.find(i)
            least[r] = min(least.get(r, node[i]), node[i])
        return [(least[self.find(i)], node[i]) for i in self.before if node[i] != least[self.find(i)]]


def _plausible_kernel(keys: tuple[str, ...], percent: int, most: int):
    """Rows (keys, node, n, sketch) sorted by keys -> edges that connect what sizes and odd sketches let be linked."""

    def edges(group):
        node, n, sketch = zip(*group, strict=True)
        n, sketch, label, out = np.array(n), np.array(sketch, np.int64).view(np.uint64), np.arange(len(group)), []
        for i in range(len(group) - 1):
            # Those that are connected with it already need no look.
            j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            odd = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1)
            for k in j[(odd <= most) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))].tolist():
                if label[k] != label[i]:
                    label[label == label[k]] = label[i]
                    out.append((node[i], node[k]))
        return out

    return _by_group(keys, ("node", "n", "sketch"), edges)


def _by_group(keys: tuple[str, ...], values: tuple[str, ...], edges):
    """mapInArrow function over rows sorted by ``keys``: what ``edges`` makes of each group's values, as pairs a, b."""

    def batch(pairs):
        pairs = sorted({(max(p), min(p)) for p in pairs})
        return pa.record_batch([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])

    def run(batches):
        key, group, out = None, [], []
        for rows in batches:
            own = zip(*(rows.column(c).to_pylist() for c in keys), strict=True)
            for k, row in zip(own, zip(*(rows.column(c).to_pylist() for c in values), strict=True), strict=True):
                if k != key:
                    if len(group) > 1:
                        out += edges(group)
                    key, group = k, []
                    if len(out) > 10_000:
                        yield batch(out)
                        out = []
                group.append(row)
        if len(group) > 1:
            out += edges(group)
        if out:
            yield batch(out)
        give_back()

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of the sets' bit matrix, some thousands of shared shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    column = (np.cumsum(count > 1) - 1)[place[shared]]
    owner, order = owner[shared], np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        bits = np.zeros((len(sets), 4096), np.float32)
        bits[owner[lo:hi], column[lo:hi] - at] = 1
        out += bits @ bits.T
    return out.astype(np.int64)


def _link_kernel(words: int, percent: int):
    """Rows (k1, k2, k3, node, text, label) sorted by key -> links that connect what the full sets of a block link."""

    def edges(group):
        node, text, label = zip(*group, strict=True)
        forest = Forest(list(label))
        sets = shingle_sets(*text_bytes(pa.array(text, pa.large_string())), words)
        common, size = common_counts(sets), np.array([len(x) for x in sets])
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
            forest.unite(int(i), int(j))
        return forest.stars(node)

    return _by_group(("k1", "k2", "k3"), ("node", "text", "label"), edges)


_PAIR = "a binary, b binary"


def _linked(rows: DataFrame, words: int, percent: int) -> DataFrame:
    blocks = rows.repartition("k1", "k2", "k3").sortWithinPartitions("k1", "k2", "k3")
    return in_batches(blocks, _link_kernel(words, percent), _PAIR).distinct()


def classes_and_links(docs: DataFrame, words: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(per row: doc_id, th1, th2, n_shingles, node; links between different sets that connect all that is connected)."""
    sig = scratch.put(signatures(docs, words), "signatures")
    reps = scratch.put(sig.where("n_shingles > 0").dropDuplicates(["node"]).drop("doc_id"), "classes")
    rows = sig.select("doc_id", "th1", "th2", "n_shingles", "node")
    banded = reps.select("node", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    member = scratch.put(banded.join(buckets, "bucket"), "members")
    # What may be linked, by sketches within a bucket. A large one is looked at in blocks of two of its parts.
    parts = F.ceil(F.col("members") / SKETCHES).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.struct(F.least(own, q).alias("k2"), F.greatest(own, q).alias("k3")))
    met = member.withColumn("k", F.explode(blocks)).join(reps.select("node", F.col("n_shingles").alias("n"), "sketch"), "node")
    keys = ("bucket", "k2", "k3")
    met = met.select("bucket", "k.k2", "k.k3", "node", "n", "sketch").repartition(*keys).sortWithinPartitions(*keys)
    maybe = scratch.put(in_batches(met, _plausible_kernel(keys, percent, most_odd_bits()), _PAIR).distinct(), "maybe")
    return rows, confirmed_links(docs, reps, maybe, words, percent, scratch)


def confirmed_links(docs: DataFrame, reps: DataFrame, maybe: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links a, b between the nodes of ``reps`` (node, th1, th2) that full sets confirm, among what ``maybe`` (a, b) connects: a spanning forest."""
    family = connected_components(maybe, scratch, "family")
    # Written first: Spark then knows how small it is, and need not deal a large family by its root.
    sizes = scratch.put(family.groupBy("root").agg(F.count("*").alias("m")), "sizes")
    family = family.join(sizes, "root").join(reps.select("node", "th1", "th2"), "node")
    # The families' texts, one for each class, by the text's hash: a copy meets only itself.
    texts = with_text_hash(docs.select("text")).join(family, ["th1", "th2"]).groupBy("node").agg(*[F.first(c).alias(c) for c in ("text", "root", "m")])
    texts = scratch.put(texts, "texts")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    chunk = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    none = F.lit(None).cast("binary")
    rows_a = texts.select(F.col("root").alias("k1"), F.explode(chunk).alias("k2"), F.lit(0).alias("k3"), "node", "text", none.alias("label"))
    links = scratch.put(_linked(rows_a, words, percent), "links")
    large = texts.where(f"m > {BLOCK}")
    if large.isEmpty():
        return links
    # A large family was looked at in parts, each with the family's first member. What is not in its largest component by
    # now (few, where copies are near) meets all others of the family, in blocks of two parts.
    label = connected_components(links, scratch, "label").select("node", F.col("root").alias("l"))
    large = large.join(label, "node", "left").withColumn("label", F.coalesce("l", "node")).drop("l", "m")
    counts = large.groupBy("root", "label").agg(F.count("*").alias("c"))
    whole = counts.groupBy("root").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("all"))
    whole = whole.select("root", F.col("most.label").alias("main"), F.ceil((F.col("all") - F.col("most.c")) / BLOCK).cast("int").alias("outer"), F.ceil(F.col("most.c") / BLOCK).cast("int").alias("inner"))
    large = large.join(whole.where("outer > 0"), "root")
    out = F.col("label") != F.col("main")
    place = F.pmod(F.xxhash64("node"), F.when(out, F.col("outer")).otherwise(F.col("inner"))).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    among = F.transform(every(F.col("outer")), lambda q: F.struct(F.least(F.col("place"), q).alias("k2"), F.greatest(F.col("place"), q).alias("k3")))
    against = F.transform(every(F.col("inner")), lambda q: F.struct(F.col("place").alias("k2"), (-1 - q).alias("k3")))
    met = F.transform(every(F.col("outer")), lambda q: F.struct(q.alias("k2"), (-1 - F.col("place")).alias("k3")))
    rows_b = large.withColumn("place", place).withColumn("k", F.explode(F.when(out, F.array_distinct(F.concat(among, against))).otherwise(met)))
    rows_b = rows_b.select(F.col("root").alias("k1"), "k.k2", "k.k3", "node", "text", "label")
    return links.unionByName(scratch.put(_linked(rows_b, words, percent), "links2"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, th1, th2 (hash of the text), n_shingles, component_id, kept: one row for each row of ``docs``. Reads ``scratch``."""
    found = Scratch(docs.sparkSession, "neardup")
    rows, links = classes_and_links(docs, words, percent, found)
    return with_components(rows, links, found, scratch or Scratch(docs.sparkSession, "neardup-ids"))


def with_components(rows: DataFrame, links: DataFrame, found: Scratch, scratch: Scratch) -> DataFrame:
    """Rows (doc_id, th1, th2, n_shingles, node) with component_id and kept. Clears ``found``; the result reads ``scratch``."""
    root = connected_components(links, found, "links")
    # Written tables on both sides: Spark can then split a join task that a component with very many rows makes large.
    rooted = scratch.put(rows.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    found.clear()
    least = scratch.put(rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    out = rooted.join(least, "root", "left").withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "th1", "th2", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each component, with their own columns; of rows that repeat id and text, one."""
    ids = Scratch(docs.sparkSession, "neardup-ids")
    names = [F.col("doc_id").alias("__id"), F.col("th1").alias("__1"), F.col("th2").alias("__2")]
    kept = near_duplicates(docs, words, percent, ids).where("kept").groupBy(*names).agg(F.count("*").alias("__rows"))
    kept = Scratch(docs.sparkSession, "neardup-kept").put(kept, "kept")
    ids.clear()
    own = [F.col(f"`{c}`") for c in docs.columns]
    t = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("__h1", F.xxhash64(t)).withColumn("__h2", F.xxhash64(F.lit(11), t))
    same = (F.col("__h1") == F.col("__1")) & (F.col("__h2") == F.col("__2")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    out = keyed.join(kept.where("__rows = 1"), same, "left_semi").select(*own)
    again = kept.where("__rows > 1")
    if again.isEmpty():
        return out
    # Rows that repeat, id and text: one of each, found by partial aggregates.
    twice = keyed.join(again, same, "left_semi").groupBy("doc_id", "__h1", "__h2").agg(F.first(F.struct(*own)).alias("__row"))
    return out.unionByName(twice.select("__row.*"))
