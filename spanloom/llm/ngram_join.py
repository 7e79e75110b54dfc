"""Jaccard join of word n-gram sets, size-aware: subsets of small sets, inverted lists for large ones.

A document's set is its distinct shingles of ``words`` words (A-Z lower-cased); with fewer words, all of them as one
shingle; without words, nothing. Two documents link when 100 * intersection >= percent * union. Documents with one set are
a class, whose set is looked at once.

* Small sets (up to a boundary): sizes n and m need a common subset of c = ceil(percent * (n + m) / (100 + percent))
  shingles, and those that have one are linked. All subsets of that size are enumerated as hashes; who shares one is
  hung on one set of it, by partial aggregates and a join.
* Large sets (beyond the boundary, and those that one of them may link to): the inverted lists of each set's rarest
  shingles are scanned, as many as a linked set can't all lack. Rare is what a count sketch of fixed size says: any order
  is right, this one keeps lists short. Within a list, sizes and parity bitmaps of the whole sets (whose exclusive or never has more bits
  than the sets differ in shingles) leave out what can't be linked; lists with the same sets are scanned once, long ones
  in blocks of two parts.
* The boundary is the size at which enumerated subsets and scanned postings cost least together, by the numbers of sets
  of each size.

What both parts connect is confirmed on the full sets, in blocks; only links that span it go out, never all pairs.

Null and empty texts have no words and link to nothing. Very long texts are compared whole. Null doc_ids take part, but
are never a component's id unless all are null; rows that repeat are in one class, and ties of ids stay together. An empty
table gives an empty result. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, cuts, give_back, in_batches, lengths, text_bytes
from .near_dup import Forest, _by_group, _mix, confirmed_links, shingle_sets, with_components
from .suffix_dedup import with_text_hash

#: Sets of more shingles are never enumerated: the numbers of subsets grow beyond any list.
MOST_SMALL = 40
#: What a posting costs against an enumerated subset: it is written with its set's size, and its list meets bitmaps.
POSTING = 8
#: Rows and cells of the count sketch that orders shingles by how rare they are.
SKETCH_ROWS, SKETCH_CELLS = 4, 1 << 16
#: Members of a list that are compared in one part of a block.
LIST_PART = 2048
#: Bits of a set's bitmap, by its size: the first of these with at least half a bit a shingle, or the last.
WIDTHS = (1024, 4096, 16384, 65536)
_U = np.uint64
_ODD = np.random.default_rng(53).integers(1 << 62, 1 << 63, SKETCH_ROWS + 3, dtype=np.uint64) * _U(2) + _U(1)


def prefix_length(n, percent: int):
    """Of how many of its n shingles (in any order that all sets share) a linked set has at least one."""
    return n - -(-percent * n // 100) + 1


def common_subset(n: int, m: int, percent: int) -> int:
    """Size of the intersection that sets of n and m shingles need; more than the smaller has where they can't link."""
    return -(-percent * (n + m) // (100 + percent))


@cache
def partners(n: int, boundary: int, percent: int) -> tuple[tuple[int, int], ...]:
    """(m, shingles of the n that a common subset leaves out) for each size m up to the boundary that can link to n."""
    sizes = range(-(-percent * n // 100), min(boundary, 100 * n // percent) + 1)
    return tuple((m, n - common_subset(n, m, percent)) for m in sizes if common_subset(n, m, percent) <= min(n, m))


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest size that is enumerated: least cost of all subsets and postings of ``sizes`` (size -> sets)."""

    def cost(x: int) -> int:
        subsets = sum(c * sum(comb(n, d) for _, d in partners(n, x, percent)) for n, c in sizes.items() if n <= x)
        return subsets + POSTING * sum(c * prefix_length(n, percent) for n, c in sizes.items() if 100 * n >= percent * (x + 1))

    return min(range(MOST_SMALL + 1), key=cost)


def _cells(h: np.ndarray) -> np.ndarray:
    """(SKETCH_ROWS, shingles) cells of the count sketch."""
    return ((h[None, :] * _ODD[:SKETCH_ROWS, None]) >> _U(48)).astype(np.int64) + (np.arange(SKETCH_ROWS) * SKETCH_CELLS)[:, None]


def _statistics(docs: DataFrame, words: int) -> tuple[np.ndarray, dict[int, int]]:
    """(counts of the sketch's cells, sets of each size up to MOST_SMALL / 0.9): at most SKETCH_ROWS * SKETCH_CELLS + 64 numbers."""

    def run(batches):
        cells, sizes = np.zeros(SKETCH_ROWS * SKETCH_CELLS, np.int64), np.zeros(64, np.int64)
        for batch in batches:
            for lo, hi in cuts(lengths(batch.column("text")), 1 << 18):
                sets = shingle_sets(*text_bytes(batch.column("text").slice(lo, hi - lo)), words)
                if len(every := np.concatenate(sets)):
                    cells += np.bincount(_cells(every).ravel(), minlength=len(cells))
                sizes += np.bincount([len(s) for s in sets if len(s) < 64], minlength=64)[:64]
        for kind, counts in ((0, cells), (1, sizes)):
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["kind", "at", "c"])
        give_back()

    rows = in_batches(docs.select("text"), run, "kind int, at int, c bigint").groupBy("kind", "at").agg(F.sum("c").alias("c")).toArrow()
    kind, at, c = (rows.column(k).to_numpy() for k in ("kind", "at", "c"))
    cells = np.zeros(SKETCH_ROWS * SKETCH_CELLS, np.int64)
    cells[at[kind == 0]] = c[kind == 0]
    return cells, {int(a): int(n) for a, n in zip(at[kind == 1], c[kind == 1], strict=True) if a > 0}


def width(n: int) -> int:
    return next((w for w in WIDTHS if n <= 2 * w), WIDTHS[-1])


def bitmap(s: np.ndarray) -> bytes:
    """Parities of how many shingles hash to each bit."""
    w = width(len(s))
    counts = np.bincount((_mix(s * _ODD[-1]) & _U(w - 1)).astype(np.int64), minlength=w)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


@cache
def _left_out(n: int, d: int) -> np.ndarray:
    return np.array(list(combinations(range(n), d)), np.int64).reshape(comb(n, d), d)


def subset_keys(sets: np.ndarray, most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sides) of all subsets that rows of ``sets``, of one size, may share with sets of sizes up to ``most``.

    A side is 0 for the smaller size of a pair of sizes, 1 for the larger and 2 where both are alike.
    """
    n, keys, sides = sets.shape[1], [], []
    value = _mix(sets * _ODD[-2])
    whole = value.sum(axis=1, dtype=np.uint64)
    for m, d in partners(n, most, percent):
        kept = whole[:, None] - value[:, _left_out(n, d)].sum(axis=2, dtype=np.uint64)
        pair = np.array([min(n, m) * 1000 + max(n, m)], np.uint64) * _ODD[-3]
        keys.append(_mix(kept + pair))
        sides.append(np.full(kept.shape, 2 if n == m else int(n > m), np.int8))
    return np.hstack(keys).view(np.int64), np.hstack(sides)


def _signature_kernel(words: int, percent: int, cells: np.ndarray, most: int):
    import xxhash

    def ragged(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts), kind))

    def kernel(t: pa.Table):
        sets = shingle_sets(*text_bytes(t.column("text")), words)
        size = np.array([len(s) for s in sets])
        none = np.zeros(0, np.int64)
        postings, keys, sides = [none] * len(sets), [none] * len(sets), [none.astype(np.int8)] * len(sets)
        for i in np.flatnonzero(100 * size >= percent * (most + 1)).tolist():
            s = sets[i]
            often = cells[_cells(s)].min(axis=0)
            postings[i] = s[np.lexsort((s, often))[: prefix_length(len(s), percent)]].view(np.int64)
        for n in np.unique(size[(size > 0) & (size <= most)]).tolist():
            rows = np.flatnonzero(size == n)
            k, side = subset_keys(np.array([sets[i] for i in rows]), most, percent)
            for j, i in enumerate(rows.tolist()):
                keys[i], sides[i] = k[j], side[j]
        out = t.drop_columns(["text"]).append_column("n_shingles", pa.array(size, pa.int64()))
        out = out.append_column("node", pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()))
        out = out.append_column("bits", pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()))
        yield out.append_column("postings", ragged(postings, pa.int64())).append_column("keys", ragged(keys, pa.int64())).append_column("sides", ragged(sides, pa.int8()))

    return kernel


def _scan_kernel(keys: tuple[str, ...], percent: int):
    """Rows (keys, node, n, bits) sorted by keys -> edges that connect what sizes and bitmaps let be linked."""

    def edges(group):
        group = sorted(group, key=lambda r: r[1])
        node, n = [r[0] for r in group], np.array([r[1] for r in group])
        most = 100 * n // percent
        words = [np.frombuffer(r[2], np.uint64) for r in group]
        folded = {}
        for w in {len(x) for x in words}:
            # A bitmap is folded to that of a smaller width: parities of parities.
            at = next(i for i, x in enumerate(words) if len(x) == w)
            folded[w] = at, np.array([x if len(x) == w else np.bitwise_xor.reduce(x.reshape(-1, w), axis=0) for x in words[at:]])
        label, forest = np.arange(len(group)), Forest([None] * len(group))
        for i in range(len(group) - 1):
            # Those that are connected with it already need no look.
            hi = int(np.searchsorted(n, most[i], "right"))
            j = np.flatnonzero(label[i + 1 : hi] != label[i]) + i + 1
            at, bits = folded[len(words[i])]
            differ = np.bitwise_count(bits[j - at] ^ words[i]).sum(axis=1, dtype=np.int64)
            for k in j[(100 + percent) * differ <= (100 - percent) * (n[i] + n[j])].tolist():
                if label[k] != label[i]:
                    label[label == label[k]] = label[i]
                    forest.unite(i, k)
        return forest.stars(node)

    return _by_group(keys, ("node", "n", "bits"), edges)


def _from_subsets(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges a, b: each small set that shares a subset with others, with one of them."""
    rows = reps.select("node", F.explode(F.arrays_zip("keys", "sides")).alias("s")).select("node", F.col("s.keys").alias("key"), F.col("s.sides").alias("side"))
    rows = scratch.put(rows, "subsets")
    least = [F.min(F.when(F.col("side") == i, F.col("node"))).alias(f"least{i}") for i in range(3)]
    shared = rows.groupBy("key").agg(F.count("*").alias("c"), *least).where("c > 1 and (least2 is not null or least0 is not null and least1 is not null)")
    other = F.when(F.col("side") == 0, F.col("least1")).when(F.col("side") == 1, F.col("least0")).otherwise(F.col("least2"))
    met = rows.join(scratch.put(shared, "shared"), "key").withColumn("other", other).where("node != other")
    return met.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"))


def _from_lists(reps: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Edges a, b that connect what the inverted lists and bitmaps let be linked."""
    postings = scratch.put(reps.select("node", F.explode("postings").alias("token")), "postings")
    lists = postings.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("t"))
    lists = scratch.put(lists.where("c > 1").groupBy("c", "s", "t").agg(F.min("token").alias("token")).drop("s", "t"), "lists")
    member = scratch.put(postings.join(lists, "token"), "members")
    scratch.drop("postings")
    parts = F.ceil(F.col("c") / LIST_PART).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.struct(F.least(own, q).alias("k2"), F.greatest(own, q).alias("k3")))
    met = member.withColumn("k", F.explode(blocks)).join(reps.select("node", F.col("n_shingles").alias("n"), "bits"), "node")
    keys = ("token", "k2", "k3")
    met = met.select("token", "k.k2", "k.k3", "node", "n", "bits").repartition(*keys).sortWithinPartitions(*keys)
    return in_batches(met, _scan_kernel(keys, percent), "a binary, b binary")


def joined(docs: DataFrame, words: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, th1, th2 (hash of the text), n_shingles, component_id: one row for each row of ``docs``. Reads ``scratch``."""
    found = Scratch(docs.sparkSession, "ngramjoin")
    cells, sizes = _statistics(docs, words)
    most = boundary(sizes, percent)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, th1 bigint, th2 bigint, n_shingles bigint, node binary, bits binary, postings array<bigint>, keys array<bigint>, sides array<tinyint>"
    hashed = with_text_hash(docs.select("doc_id", "text")).select("doc_id", "th1", "th2", "text")
    sig = found.put(arrow_map(hashed, _signature_kernel(words, percent, cells, most), schema), "signatures")
    reps = found.put(sig.where("n_shingles > 0").dropDuplicates(["node"]).drop("doc_id"), "classes")
    rows = sig.select("doc_id", "th1", "th2", "n_shingles", "node")
    maybe = found.put(_from_subsets(reps, found).unionByName(_from_lists(reps, percent, found)).distinct(), "maybe")
    found.drop("subsets", "shared", "members", "lists")
    links = confirmed_links(docs, reps, maybe, words, percent, found)
    out = with_components(rows, links, found, scratch or Scratch(docs.sparkSession, "ngramjoin-ids"))
    return out.drop("kept")
