"""Removal of every byte covered by a string of at least ``min_bytes`` bytes that also starts anywhere else.

Plan. Each window of ``min_bytes`` has an anchor, the least hash of its short substrings, so equal windows have equal
anchors. Neighbouring windows with one anchor form a run; its bytes are the run's hull. Only (anchor, hull hash, text
hash, place) rows are shuffled. Anchors that occur once are done. Where all hulls of an anchor are equal, all windows
repeat. The other anchors' different hulls go, whole groups together, into blocks of bounded size. In a block, a
breadth-first backward extension on the Burrows-Wheeler transform sets the common prefix lengths of neighbouring
suffixes by increasing value and stops at ``min_bytes``: what is not set by then repeats. An anchor with more than
``max_hulls`` different hulls (a passage that very many documents share) is first divided by the place of the window
against the anchor and by what the windows there have in common, so that no group is ever gathered whole.

Before a block is sorted, strings that share nothing beside their anchors with others of their group are left out: they
hold no window that repeats.

Texts are known by a 128-bit hash; equal texts get equal results, and their copies never meet in one group.
Null text is empty; texts under ``min_bytes`` lose nothing; very long texts are read whole, and their runs are shuffled
as others' are; repeated rows repeat each other's strings, and so lose all of them; of strings that repeat each other
none comes first: all go; doc_id plays no part; an empty table gives an empty result; other columns are kept, but
n_bytes, n_removed, spans, kept_bytes and kept_text are the operator's.

With ``min_words``, strings of at least so many words go too, however few bytes they have: the same plan runs over the
texts with each word in place of its hash, and counts only the starts that are a word's first byte. Words are compared
by 56 bits, white space between them is not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, SPACE_CHARS, Scratch, arrow_map, give_back, in_batches, packed_row, text_bytes, unpacked_row

MIN_BYTES = 400
#: Words that make a passage in the pipeline: over 50. Bytes that stand for a word.
MIN_WORDS, WORD_BYTES = 51, 8
#: Bytes of a Burrows-Wheeler block, and different hulls of one anchor that may share a block.
BLOCK_BYTES, MAX_HULLS = 1 << 18, 1500
#: Widths of the places against the anchor by which a larger group is divided, in turn.
DIVISIONS = (16, 1)
_U = np.uint64


# ---------------------------------------------------------------- anchors


def _mults(n: int) -> np.ndarray:
    rng = np.random.default_rng(20240607)
    return rng.integers(1 << 62, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)


def anchor_length(min_bytes: int) -> int:
    """A power of two of about a sixth of the window."""
    return 1 << max(0, (min_bytes // 4).bit_length() - 1)


def substring_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all substrings of length k, a power of two (shorter ones at the end are left out)."""
    h, step = _BYTE[data], 1
    for m in _mults(k.bit_length()):
        if step == k:
            break
        h = h[:-step] * m + h[step:]
        step *= 2
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    m, span = h, 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return m if span == w else np.minimum(m[: len(m) - (w - span)], m[w - span :])


def runs(data: np.ndarray, offsets: np.ndarray, min_bytes: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor: text number, start, count, anchor, hull hash, anchor occurs twice."""
    import xxhash

    k = anchor_length(min_bytes)
    w = min_bytes - k + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, bool))
    if len(data) < min_bytes:
        return none
    h = substring_hashes(data, k)
    least = sliding_min(h, w)
    sizes = np.diff(offsets)
    valid = np.arange(len(least)) + min_bytes <= np.repeat(offsets[1:], sizes)[: len(least)]
    edge = np.ones(len(least) + 1, bool)
    edge[1:-1] = (least[1:] != least[:-1]) | ~valid[1:] | ~valid[:-1]
    first = offsets[:-1][sizes > 0]
    edge[first[first < len(least)]] = True
    at = np.flatnonzero(edge)
    start, count = at[:-1], np.diff(at)
    ok = valid[start]
    start, count = start[ok], count[ok]
    # A long run (one anchor again and again) is cut, so that a hull is at most about twice a window.
    pieces = -(-count // (2 * w))
    rep = np.repeat(np.arange(len(start)), pieces)
    nth = np.arange(len(rep)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, count = start[rep] + nth * 2 * w, np.minimum(2 * w, count[rep] - nth * 2 * w)
    text = np.searchsorted(offsets, start, "right") - 1
    view, hull, twice = memoryview(data), np.empty(len(start), np.uint64), np.empty(len(start), bool)
    value = least[start]
    for i, (s, n) in enumerate(zip(start.tolist(), count.tolist(), strict=True)):
        hull[i] = xxhash.xxh3_64_intdigest(view[s : s + n + min_bytes - 1])
        twice[i] = np.count_nonzero(h[s : s + n + w - 1] == value[i]) > 1
    return text, start - offsets[text], count, value.view(np.int64), hull.view(np.int64), twice


def _anchor_kernel(min_bytes: int):
    def kernel(t: pa.Table):
        data, offsets = text_bytes(t.column("text"))
        text, start, count, anchor, hull, twice = runs(np.ascontiguousarray(data), offsets, min_bytes)
        th1, th2 = (t.column(c).to_numpy()[text] for c in ("th1", "th2"))
        yield pa.table({"th1": th1, "th2": th2, "pos": start, "starts": count.astype(np.int32), "anchor": anchor, "hull": hull, "twice": twice})

    return kernel


# ---------------------------------------------------------------- words

_SPACE = np.isin(np.arange(256), list(SPACE_CHARS.encode()))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last; words end with their text."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = edge[[0, -1]] = True
    space = _SPACE[data]
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word as eight bytes under 128, so that a block has symbols to spare."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    sizes = end - start
    first = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(first, sizes)
    power = np.multiply.accumulate(np.full(sizes.max(), 0x9E3779B97F4A7C15, np.uint64))
    h = np.add.reduceat(_BYTE[data[place + np.repeat(start, sizes)]] * power[place], first)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h & _U(0x7F7F7F7F7F7F7F7F)


def _word_kernel(t: pa.Table):
    data, offsets = text_bytes(t.column("text"))
    start, end = word_bounds(data, offsets)
    raw, at = memoryview(word_codes(data, start, end).tobytes()), (np.searchsorted(start, offsets) * WORD_BYTES).tolist()
    codes = pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
    yield pa.table({"th1": t.column("th1"), "th2": t.column("th2"), "text": codes})


# ---------------------------------------------------------------- Burrows-Wheeler block


def suffix_array(sym: np.ndarray, bits: int, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places by suffix; which of them begin a group of equal strings of q symbols; and q. sym ends with its only 0.

    The first sort is by as many symbols as fit a word. Each later one sorts what is not yet single by the ranks of three
    (in large blocks two) parts, each as long as what was sorted before. Suffixes that agree in ``depth`` symbols or more
    stay in any order among themselves: intervals of strings up to that length hold all of them or none.
    """
    n, per = len(sym), 64 // bits
    padded = np.zeros(n + per, np.uint64)
    padded[:n] = sym
    key = np.zeros(n, np.uint64)
    for j in range(per):
        key = (key << _U(bits)) | padded[j : j + n]
    sa = np.argsort(key)
    key = key[sa]
    q = min(per, depth - 1)
    short = key >> _U(bits * (per - q))
    begins = np.ones(n, bool)
    begins[1:] = short[1:] != short[:-1]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    sa = sa.astype(np.int32)  # half the memory to run over; a block has far fewer symbols than 2**31
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
    h, width = per, (n + 1).bit_length()
    parts = 3 if 3 * width < 64 else 2
    while True:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if len(tied) == 0 or h >= depth:
            return sa, begins, q
        of = sa[tied]
        key = rank[of].astype(np.int64)
        for j in range(1, parts):
            key <<= width
            key |= rank[np.minimum(of + j * h, n)] + 1
        order = np.argsort(key)
        of, key = of[order], key[order]
        sa[tied] = of
        fresh = np.ones(len(tied), bool)
        fresh[1:] = key[1:] != key[:-1]
        head[tied] = fresh
        rank[of] = np.maximum.accumulate(np.where(fresh, tied, 0))
        h *= parts


def repeated_starts(hulls: list[bytes], min_bytes: int) -> list[np.ndarray]:
    """For each string, which places start a substring of min_bytes that also starts elsewhere in the strings."""
    if not hulls:
        return []
    lens = np.array([len(x) for x in hulls])
    flat = np.frombuffer(b"".join(hulls), np.uint8)
    kinds = np.zeros(256, bool)
    kinds[flat] = True
    bits = 8 if kinds.sum() <= 253 else 16
    code = np.zeros(256, np.uint16)
    code[kinds] = np.arange(1, kinds.sum() + 1)
    # text, separator, text, separator, ..., 0: the separator is the largest symbol, so no window that counts has it.
    begin = np.concatenate([[0], np.cumsum(lens + 1)])
    sym = np.full(begin[-1] + 1, kinds.sum() + 1, np.uint8 if bits == 8 else np.uint16)
    sym[np.arange(len(flat)) + np.repeat(np.arange(len(lens)), lens)] = code[flat]
    sym[-1] = 0
    sa, begins, q = suffix_array(sym, bits, min_bytes + 1)
    n = len(sa)
    bwt = sym[sa - 1]
    order = np.argsort(bwt, kind="stable")
    last_to_first = np.empty(n, np.int64)
    last_to_first[order] = np.arange(n) << 32
    first_symbol = bwt[order]
    # known[i]: the common prefix of suffixes i - 1 and i is set, to the number of the round that set it. The first q
    # rounds are those that the first sort stands for: intervals of all strings of q symbols.
    known = np.append(begins, True)
    lo = np.flatnonzero(begins)
    hi = np.append(lo[1:], n)
    for _ in range(q, min_bytes):
        size = hi - lo
        owner = np.repeat(np.arange(len(lo)), size)
        inside = np.arange(len(owner)) + np.repeat(lo - (np.cumsum(size) - size), size)
        key = last_to_first[inside] | owner
        key.sort()
        at, owner = key >> 32, key & 0xFFFFFFFF
        cut = np.ones(len(at) + 1, bool)
        cut[1:-1] = (np.diff(at) != 1) | (np.diff(owner) != 0) | (first_symbol[at[1:]] != first_symbol[at[:-1]])
        cut = np.flatnonzero(cut)
        lo, hi = at[cut[:-1]], at[cut[1:] - 1] + 1
        new = ~known[hi]
        lo, hi = lo[new], hi[new]
        if len(lo) == 0:
            break
        known[hi] = True
    same = ~known
    flag = np.zeros(n, bool)
    flag[sa] = same[:-1] | same[1:]
    return [flag[b : b + m] for b, m in zip(begin[:-1].tolist(), np.maximum(lens - min_bytes + 1, 0).tolist(), strict=True)]


def _ranges(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def may_repeat(group: np.ndarray, anchor: np.ndarray, hulls: list[bytes], min_bytes: int) -> np.ndarray:
    """Which strings may hold a window that repeats: those that share with their group, beside an anchor, what a window has there.

    A window of min_bytes has its anchor somewhere in it, and on one side of that at least half of the other bytes. Strings
    whose neighbourhoods of all anchors are single, on both sides, have no window in common with any other place.
    """
    k = anchor_length(min_bytes)
    side = 1 << max(0, (min_bytes - k + 1) // 2).bit_length() >> 1
    if side == 0:
        return np.ones(len(hulls), bool)
    lens = np.array([len(x) for x in hulls])
    end = np.cumsum(lens)
    flat = np.frombuffer(b"".join(hulls), np.uint8)
    owner = np.repeat(np.arange(len(hulls)), lens)
    at = np.flatnonzero(substring_hashes(flat, k).view(np.int64) == anchor[owner[: len(flat) - k + 1]])
    at = at[at + k <= end[owner[at]]]
    near = substring_hashes(flat, side)
    own = owner[at]
    left, right = at - side >= end[own] - lens[own], at + k + side <= end[own]
    of = np.concatenate([own[left], own[right]])
    key = np.concatenate([near[at[left] - side], ~near[at[right] + k]]) + group[of].astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    out = np.zeros(len(hulls), bool)
    out[of[count[place] > 1]] = True
    return out


_FOUND = "anchor bigint, hull bigint, off int, starts int"


def _block_kernel(min_bytes: int, block_bytes: int):
    """Rows (grp, anchor, hull, off, bytes) sorted by grp -> repeated starts; whole groups, about block_bytes at once."""

    def found(rows):
        group = np.cumsum([False, *(a[0] != b[0] for a, b in zip(rows[:-1], rows[1:], strict=True))])
        may = may_repeat(group, np.array([r[1] for r in rows], np.int64), [r[4] for r in rows], min_bytes)
        rows = [r for r, m in zip(rows, may.tolist(), strict=True) if m]
        flags = repeated_starts([r[4] for r in rows], min_bytes)
        out = {"anchor": [], "hull": [], "off": [], "starts": []}
        for (_, anchor, hull, off, _), flag in zip(rows, flags, strict=True):
            for s, n in zip(*(x.tolist() for x in _ranges(flag)), strict=True):
                for c, v in zip(out, (anchor, hull, off + s, n), strict=True):
                    out[c].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("grp", "anchor", "hull", "off", "bytes")]
            for row in zip(*cols, strict=True):
                if size >= block_bytes and row[0] != rows[-1][0]:
                    yield found(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield found(rows)
        give_back()

    return run


def _divide_kernel(min_bytes: int, width: int):
    """Parts of a hull by place against the anchor: group key of the place and of what its windows share, and bytes."""
    import xxhash

    k = anchor_length(min_bytes)
    w = min_bytes - k + 1

    def kernel(t: pa.Table):
        out = {c: [] for c in ("grp", "anchor", "hull", "part", "off", "bytes", "n")}
        for anchor, hull, off, b, n in zip(*(t.column(c).to_pylist() for c in ("anchor", "hull", "off", "bytes", "n")), strict=True):
            data = np.frombuffer(b, np.uint8)
            places = np.flatnonzero(substring_hashes(data, k).view(np.int64) == anchor)
            starts = np.arange(len(data) - min_bytes + 1)
            at = places[np.searchsorted(places, starts)]
            rel = (starts - at) // width
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(rel) != 0) | (np.diff(at) != 0), [True]]))
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                base = int(at[s] + rel[s] * width)  # the first window that this place may have, in this hull or another
                shared = b[base + width - 1 : base + min_bytes]
                part = b[s : e - 1 + min_bytes]
                key = xxhash.xxh3_64_intdigest(shared, anchor & (2**64 - 1)) ^ (int(rel[s]) * 0x9E3779B97F4A7C15 & (2**64 - 1))
                whole = e - s == width
                values = (key, anchor, hull, xxhash.xxh3_64_intdigest(part, whole), off + s, part, n)
                for c, v in zip(out, values, strict=True):
                    out[c].append(v)
        signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
        yield pa.table({"grp": signed(out["grp"]), "anchor": pa.array(out["anchor"], pa.int64()), "hull": pa.array(out["hull"], pa.int64()), "part": signed(out["part"]), "off": pa.array(out["off"], pa.int32()), "bytes": pa.array(out["bytes"], pa.binary()), "n": pa.array(out["n"], pa.int64())})

    return kernel


# ---------------------------------------------------------------- plan


def with_text_hash(docs: DataFrame, text: str = "text") -> DataFrame:
    """th1, th2: a 128-bit hash of the text, by two seeds."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("th1", F.xxhash64(t)).withColumn("th2", F.xxhash64(F.lit(11), t))


def repeated_spans(texts: DataFrame, min_bytes: int = MIN_BYTES, block_bytes: int = BLOCK_BYTES, max_hulls: int = MAX_HULLS, words: bool = False) -> DataFrame:
    """texts (th1, th2, text) -> th1, th2, spans: byte ranges [lo, hi) to remove, unmerged; texts without any are absent.

    With ``words``, bytes are those of the texts' word codes.
    """
    spark = texts.sparkSession
    scratch = Scratch(spark, "suffix")
    schema = "th1 bigint, th2 bigint, pos bigint, starts int, anchor bigint, hull bigint, twice boolean"
    anchors = _anchor_kernel(min_bytes)
    if words:
        # Codes and anchors in one pass: one Python worker a task. A word has a byte and, but for the last, a space.
        raw = texts.where(F.octet_length("text") >= min_bytes // WORD_BYTES * 2 - 1)
        occ = arrow_map(raw.select("th1", "th2", "text"), lambda t: (out for codes in _word_kernel(t) for out in anchors(codes)), schema, chunk=CHUNK_BYTES >> 1)
        texts = arrow_map(raw.select("th1", "th2", "text"), _word_kernel, "th1 bigint, th2 bigint, text binary", chunk=CHUNK_BYTES >> 1)
    else:
        texts = texts.where(F.octet_length("text") >= min_bytes)
        occ = arrow_map(texts.select("th1", "th2", "text"), anchors, schema)
    occ = scratch.put(occ, "runs")
    per = occ.groupBy("anchor").agg(F.count("*").alias("c"), F.min("hull").alias("h0"), F.max("hull").alias("h1"), F.max("twice").alias("self"))
    per = per.where("c > 1 or self").select("anchor", ((F.col("h0") != F.col("h1")) | (F.col("c") == 1)).alias("mixed"))
    rep = scratch.put(occ.drop("twice").join(per, "anchor"), "repeated")
    scratch.drop("runs")
    mixed = rep.where("mixed").groupBy("anchor", "hull").agg(F.count("*").alias("n"), F.min(F.struct("th1", "th2", "pos", "starts")).alias("s"))
    hulls = mixed.select("anchor", "hull", "n", "s.*")
    # One copy of each text that has a hull to look at; the bytes of a hull are cut out on the spot.
    lists = hulls.groupBy("th1", "th2").agg(F.collect_list(F.struct("anchor", "hull", "n", "pos", "starts")).alias("hulls"))
    one = texts.groupBy("th1", "th2").agg(F.first("text").alias("text"))
    h = one.join(lists, ["th1", "th2"]).select("text", F.explode("hulls").alias("h")).select("text", "h.*")
    cut = F.substring(F.col("text").cast("binary"), (F.col("pos") + 1).cast("int"), F.col("starts") + (min_bytes - 1))
    hulls = scratch.put(h.select("anchor", "hull", "n", F.lit(0).alias("off"), F.col("starts"), cut.alias("bytes")), "hulls")
    found = [hulls.where("n > 1").select("anchor", "hull", "off", "starts")]
    work = hulls.withColumn("grp", F.col("anchor"))
    for level in (None, *DIVISIONS):
        if level is not None:
            parts = arrow_map(work.select("anchor", "hull", "off", "bytes", "n"), _divide_kernel(min_bytes, level), "grp bigint, anchor bigint, hull bigint, part bigint, off int, bytes binary, n bigint", "bytes", 1 << 18)
            parts = scratch.put(parts, f"parts{level}")
            # Equal parts repeat each other; one of each goes on, with the count of all.
            same = parts.groupBy("grp", "part").agg(F.sum("n").alias("total"), F.min(F.struct("hull", "off")).alias("one"))
            pairs = parts.drop("n").join(same, ["grp", "part"])
            found.append(scratch.put(pairs.where("total > 1").select("anchor", "hull", "off", (F.octet_length("bytes") - (min_bytes - 1)).alias("starts")), f"equal{level}"))
            if level == 1:
                break
            work = pairs.where((F.col("one.hull") == F.col("hull")) & (F.col("one.off") == F.col("off"))).select("grp", "anchor", "hull", F.col("total").alias("n"), "off", "bytes")
        groups = scratch.put(work.groupBy("grp").agg(F.count("*").alias("m"), F.min("n").alias("least")), f"groups{level}")
        small = groups.where(f"m <= {max_hulls} and least = 1" + (" and m > 1" if level else "")).select("grp")
        block = work.join(small, "grp").select("grp", "anchor", "hull", "off", "bytes").repartition("grp").sortWithinPartitions("grp")
        found.append(scratch.put(in_batches(block, _block_kernel(min_bytes, block_bytes), _FOUND), f"found{level}"))
        large = groups.where(f"m > {max_hulls}").select("grp")
        if large.isEmpty():
            break
        work = scratch.put(work.join(large, "grp").select("anchor", "hull", "off", "bytes", "n"), f"large{level}")
    all_found = found[0]
    for f in found[1:]:
        all_found = all_found.unionByName(f)
    lo = F.col("pos") + F.col("off")
    here = rep.where("mixed").select("anchor", "hull", "th1", "th2", "pos").join(all_found, ["anchor", "hull"]).select("th1", "th2", lo.alias("lo"), (lo + F.col("starts") + (min_bytes - 1)).alias("hi"))
    whole = rep.where("not mixed").select("th1", "th2", F.col("pos").alias("lo"), (F.col("pos") + F.col("starts") + (min_bytes - 1)).alias("hi"))
    spans = here.unionByName(whole).groupBy("th1", "th2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    # A written table, not a shuffle that the next join would share: its task for a text with very many copies can be split.
    return scratch.put(spans, "spans")


def _word_spans(data: np.ndarray, spans: list[dict], min_words: int) -> list[dict]:
    """Bytes of the words that a text's spans of word codes cover from starts that are a word's first."""
    start, end = word_bounds(data, np.array([0, len(data)]))
    out = []
    for x in spans:
        first, last = -(-x["lo"] // WORD_BYTES), x["hi"] // WORD_BYTES - min_words
        if first <= last:
            out.append({"lo": int(start[first]), "hi": int(end[last + min_words - 1])})
    return out


def _remove_kernel(t: pa.Table, as_text: bool, min_words: int | None):
    data, offsets = text_bytes(t.column("__text"))
    raw = memoryview(np.ascontiguousarray(data))
    n_bytes, removed, spans, kept = np.diff(offsets), [], [], []
    by_words = t.column("__word_spans").to_pylist() if min_words else [None] * len(t)
    for b, n, s, ws in zip(offsets[:-1].tolist(), n_bytes.tolist(), t.column("__spans").to_pylist(), by_words, strict=True):
        merged, rest, at = [], [], 0
        s = (s or []) + (_word_spans(data[b : b + n], ws, min_words) if ws else [])
        for x in sorted(s, key=lambda x: x["lo"]):
            if merged and x["lo"] <= merged[-1]["hi"]:
                merged[-1]["hi"] = max(merged[-1]["hi"], x["hi"])
            else:
                merged.append(dict(x))
        for x in merged:
            rest.append(raw[b + at : b + x["lo"]])
            at = x["hi"]
        rest.append(raw[b + at : b + n])
        kept.append(b"".join(rest))
        spans.append(merged)
        removed.append(sum(x["hi"] - x["lo"] for x in merged))
    out = t.drop_columns(["__text", "__spans"] + ["__word_spans"] * bool(min_words))
    out = out.append_column("n_bytes", pa.array(n_bytes)).append_column("n_removed", pa.array(removed, pa.int64()))
    out = out.append_column("spans", pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))))
    if as_text:
        # A run may end inside a character; the bytes of it that are left form none and go too.
        yield out.append_column("kept_text", pa.array([k.decode(errors="ignore") for k in kept], pa.string()))
    else:
        yield out.append_column("kept_bytes", pa.array(kept, pa.binary()))


def deduplicated(docs: DataFrame, min_bytes: int = MIN_BYTES, as_text: bool = False, min_words: int | None = None, **bounds) -> DataFrame:
    """``docs`` without text, with n_bytes, n_removed, spans (maximal removed runs, in order) and kept_bytes, or kept_text."""
    made = {"n_bytes", "n_removed", "spans", "kept_bytes", "kept_text", "th1", "th2"}
    own = [c for c in docs.columns if c != "text" and c not in made]
    hashed = with_text_hash(docs.select(*[F.col(f"`{c}`") for c in own], "text"))
    texts = hashed.select("th1", "th2", "text")
    spans = repeated_spans(texts, min_bytes, **bounds)
    if min_words:
        by_words = repeated_spans(texts, min_words * WORD_BYTES, words=True, **bounds).withColumnRenamed("spans", "word_spans")
        # Written for the same reason as the spans themselves.
        spans = Scratch(docs.sparkSession, "suffix").put(spans.join(by_words, ["th1", "th2"], "full"), "both")
    found = [F.col(c).alias(f"__{c}") for c in ["spans"] + ["word_spans"] * bool(min_words)]
    joined = hashed.join(spans, ["th1", "th2"], "left").select(*[F.col(f"`{c}`") for c in own], F.coalesce("text", F.lit("")).alias("__text"), *found)
    kinds = dict(joined.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in own] + ["n_bytes bigint, n_removed bigint, spans array<struct<lo: bigint, hi: bigint>>", "kept_text string" if as_text else "kept_bytes binary"])
    return arrow_map(joined, lambda t: _remove_kernel(t, as_text, min_words), schema, "__text")


def cleaned_documents(docs: DataFrame, min_bytes: int = MIN_BYTES, min_words: int = MIN_WORDS) -> DataFrame:
    """All documents, with their own columns and the text that is left of each."""
    out = deduplicated(docs.select(packed_row(docs, "text"), "text"), min_bytes, as_text=True, min_words=min_words)
    made = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("kept_text").cast(dict(docs.dtypes)["n_chars"])
    return unpacked_row(out, docs.columns, made)
