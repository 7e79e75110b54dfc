"""Phrase collocations: exact counts from suffix automata of shards, scored and thinned by their links.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``; phrases
never cross pieces. A shard (some MB of one language) gets a generalised suffix automaton, bounded to phrases of
``LONGEST`` words: its states are the classes of phrases that end at the same places (endpos), its suffix links lead from
a phrase to the one without its first word. Here the automaton is made by ranking, level by level, not word by word: a
phrase of k + 1 words is the pair of a phrase of k words and the word before it.

Shards give 64-bit hashes of the phrases of their states and the sizes of the endpos sets; Spark adds them up. What can't
reach ``least`` occurrences is left out on the way, exactly: a phrase is only as frequent as its parts. One and two words
are counted first, then three, then four and more, each only where the parts passed: those with at least ``least`` are
marked in a filter of a fixed number of bits. A filter has no false negatives: one that is too full only leaves more to count.

Only what is frequent gets its words, and not from each shard that has it: a first look takes one in ``SPARE`` pairs of phrase
and shard, by hash; a second one takes, from all shards, what is still without. A phrase that many shards share so costs
few rows, and none is left out.

Subsumption goes along the links: a phrase is dropped if one that is a word longer, in front (suffix link) or at the end
(its mirror), has ``percent`` of its occurrences or more. One word is enough: what lies between a phrase and a longer one
is at least as frequent as the longer one.

Null and empty texts have no words, a null lang is ``und``. Repeated rows count each time. Ties of scores are ordered by
count and phrase. Very long texts are cut between pieces; a piece is held whole. An empty table, or one without frequent
phrases, gives an empty result. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, in_batches, text_bytes

LONGEST = 5
#: Bytes of text of a shard.
SHARD_BYTES = 4 << 20
#: Of how many pairs of phrase and shard one gives the phrase's words at first.
SPARE = 16
#: Bits of a filter, and of how many of them a phrase has. A filter is what tasks are sent: 4 MB, whatever the input.
FILTER_BITS, MARKS = 1 << 25, 2
_U = np.uint64
_RNG = np.random.default_rng(67)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = _RNG.integers(1 << 62, 1 << 63, LONGEST + 1, dtype=np.uint64) * _U(2) + _U(1)
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Words:
    """The words of a shard: ``at``, ``size`` (bytes of ``data``), ``hash``, and ``run``, the words up to this one in its piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        none = np.zeros(0, np.int64)
        self.at, self.size, self.hash, self.run = none, none, none.view(np.uint64), none
        if len(data) == 0:
            return
        gap = _GAP[data]
        begins = ~gap
        begins[1:] &= gap[:-1]
        first = offsets[:-1][np.diff(offsets) > 0]
        begins[first] = ~gap[first]
        ends = ~gap
        ends[:-1] &= gap[1:]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        ends[last] = ~gap[last]
        self.at = np.flatnonzero(begins)
        self.size = (np.flatnonzero(ends) + 1 - self.at).astype(np.int32)
        if len(self.at) == 0:
            return
        power = np.cumprod(np.concatenate([[_U(1)], np.full(int(self.size.max()), _BASE)]))
        value = _BYTE[data]
        value[gap] = 0
        start = self.at[0]
        # White space after a word counts nothing: its power is that of the word's own last byte.
        length = np.diff(np.append(self.at, len(data)))
        place = np.minimum(np.arange(start, len(data)) - np.repeat(self.at, length), np.repeat(self.size, length))
        self.hash = _mix(np.add.reduceat(value[start:] * power[place], self.at - start))
        # Pieces end at breaks and at the ends of texts.
        cut = np.concatenate([[0], np.cumsum(_BREAK[data])])[self.at] + np.searchsorted(offsets, self.at, "right") * (1 + len(data))
        new = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]]))
        self.run = (np.arange(len(self.at)) - np.repeat(new, np.diff(np.append(new, len(self.at)))) + 1).astype(np.int32)

    def hashes(self, seed: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """k, ends of phrases of k words (indices of words), their hashes; the language is the seed."""
        total = np.full(len(self.hash), _U(seed & (2**64 - 1)))
        ends = np.arange(len(self.hash))
        for k in range(1, longest + 1):
            ends = ends[self.run[ends] >= k]
            total[ends] = total[ends] + self.hash[ends - k + 1] * _STEP[k]
            yield k, ends, _mix(total[ends] + _U(k))

    def text(self, i: int) -> str:
        return _LOWER[self.data[self.at[i] : self.at[i] + self.size[i]]].tobytes().decode()


class Filter:
    """A set of hashes as bits: ``has`` may say yes to a few more."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        for i in range(MARKS):
            yield _mix(h * _STEP[i]) % _U(bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for place in self.places(h, 64 * len(self.words)):
            out &= (self.words[(place >> _U(6)).astype(np.int64)] >> (place & _U(63)) & _U(1)).astype(bool)
        return out


def shards(batches, most: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Arrow batches (lang, text) -> (lang, bytes, offsets) of shards: texts of one language, about ``most`` bytes; longer texts are cut between pieces."""
    held: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}

    def shard(key):
        parts = held.pop(key)
        del size[key]
        return key, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for key, a, b in zip(batch.column("lang").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            while a < b:
                end = b
                if b - a > most:
                    breaks = np.flatnonzero(_BREAK[data[a + most : b]])
                    end = a + most + int(breaks[0]) if len(breaks) else b
                held.setdefault(key, []).append(data[a:end].copy())
                size[key] = size.get(key, 0) + end - a
                # Shards of all languages together are bounded, too: the largest goes.
                if sum(size.values()) >= most:
                    yield shard(max(size, key=size.get))
                a = end
    for key in list(held):
        yield shard(key)


def _seed(lang: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(lang.encode())


def plausible(words: Words, seed: int, longest: int, filters: dict[int, Filter]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """k, ends, hashes of the phrases that may be frequent: where there is a filter of k words, both parts of k - 1 words and the phrase pass."""
    good = np.ones(len(words.hash), bool)
    for k, ends, h in words.hashes(seed, longest):
        ok = good[ends] & good[ends - 1] if k > 1 else np.ones(len(ends), bool)
        if k in filters:
            ok[ok] = filters[k].has(h[ok])
        good = np.zeros(len(words.hash), bool)
        good[ends[ok]] = True
        yield k, ends[ok], h[ok]


def _counts_kernel(lengths: tuple[int, ...], filters: dict[int, Filter], shard_bytes: int):
    def run(batches):
        for lang, data, offsets in shards(batches, shard_bytes):
            words, seed = Words(data, offsets), _seed(lang)
            made = [(0, np.array([seed], np.uint64), np.array([len(words.hash)]))] if 1 in lengths else []
            made += [(k, level["hash"], level["count"]) for k, level in enumerate(Automaton(words, seed, max(lengths), filters).levels, 1) if k in lengths]
            for k, h, c in made:
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(np.full(len(h), k, np.int8))], names=["h", "c", "k"])
        give_back()

    return run


def _marked(hashes: DataFrame, bits: int) -> dict[int, Filter]:
    """Filters of ``hashes`` (k, h), by k."""

    def places(batches):
        for b in batches:
            h, k = b.column("h").to_numpy().view(np.uint64), b.column("k").to_numpy()
            for place in Filter.places(h, bits):
                yield pa.record_batch([pa.array(k), pa.array((place >> _U(6)).astype(np.int32)), pa.array((_U(1) << (place & _U(63))).view(np.int64))], names=["k", "at", "bits"])

    # At most bits / 64 rows for each k, whatever the input.
    rows = in_batches(hashes.select("k", "h"), places, "k tinyint, at int, bits bigint").groupBy("k", "at").agg(F.bit_or("bits").alias("bits")).toArrow()
    k, at, marks = (rows.column(c).to_numpy() for c in ("k", "at", "bits"))
    out = {}
    for n in np.unique(k).tolist():
        words = np.zeros(bits // 64, np.uint64)
        words[at[k == n]] = marks[k == n].view(np.uint64)
        out[n] = Filter(words)
    return out


def _none(bits: int) -> Filter:
    return Filter(np.zeros(bits // 64, np.uint64))


class Automaton:
    """The suffix automaton of a shard, bounded to ``longest`` words, of the phrases that ``plausible`` leaves.

    Level k has the phrases of k words: ``hash``, ``end`` (a word where it ends), ``count`` (size of the endpos set), ``link``
    (phrase of level k - 1: its suffix link) and ``top``, whether it is the longest of its state: no phrase with a word
    before it has its endpos set.
    """

    def __init__(self, words: Words, seed: int, longest: int, filters: dict[int, Filter]):
        self.levels = []
        below = np.zeros(len(words.hash), np.int64)  # by word: the phrase of k - 1 words that ends there
        for _, ends, h in plausible(words, seed, longest, filters):
            kinds, first, own, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            level = {"hash": kinds, "end": ends[first], "count": count, "link": below[ends[first]], "top": np.ones(len(first), bool)}
            if self.levels:
                under = self.levels[-1]
                same = level["count"] == under["count"][level["link"]]
                under["top"][level["link"][same]] = False
            self.levels.append(level)
            below[ends] = own

    def states(self) -> Iterator[tuple[int, int, int, int]]:
        """(end, longest, shortest, count) of each state: its phrases are the suffixes with from ``shortest`` to ``longest`` words."""
        low: list[np.ndarray] = []
        for k, level in enumerate(self.levels, 1):
            # The shortest of a state is one word longer than its link's phrase.
            if k == 1:
                low.append(np.ones(len(level["end"]), np.int64))
            else:
                same = level["count"] == self.levels[k - 2]["count"][level["link"]]
                low.append(np.where(same, low[-1][level["link"]], k))
            top = np.flatnonzero(level["top"])
            yield from zip(level["end"][top].tolist(), [k] * len(top), low[-1][top].tolist(), level["count"][top].tolist(), strict=True)


def _words_kernel(longest: int, filters: dict[int, Filter], wanted: dict[int, Filter] | None, shard_bytes: int):
    """Rows h, lang, phrase of frequent phrases: one in SPARE of each shard's, or all that are ``wanted``."""
    import pyarrow.compute as pc

    def run(batches):
        for lang, data, offsets in shards(batches, shard_bytes):
            words, seed = Words(data, offsets), _seed(lang)
            own = _mix(np.array([words.hash.sum(dtype=np.uint64)]))[0]
            yield pa.record_batch([pa.array(np.array([seed], np.uint64).view(np.int64)), pa.array([lang]), pa.array([""])], names=["h", "lang", "phrase"])
            for k, level in enumerate(Automaton(words, seed, longest, filters).levels, 1):
                h = level["hash"]
                take = np.flatnonzero(_mix(h ^ own) % _U(SPARE) == 0 if wanted is None else wanted[k].has(h) if k in wanted else np.zeros(len(h), bool))
                if len(take) == 0:
                    continue
                end = level["end"][take]
                # Each word is decoded once.
                at, place = np.unique((end[:, None] + np.arange(1 - k, 1)).ravel(), return_inverse=True)
                names, place = pa.array([words.text(i) for i in at.tolist()], pa.string()), place.reshape(-1, k)
                parts = [names.take(pa.array(place[:, j])) for j in range(k)]
                phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
                yield pa.record_batch([pa.array(h[take].view(np.int64)), pa.repeat(lang, len(take)), phrase], names=["h", "lang", "phrase"])
        give_back()

    return run


def phrase_counts(docs: DataFrame, scratch: Scratch, least: int = 100, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, phrase, k (words), f: all phrases of up to ``longest`` words that occur at least ``least`` times; and '' (k = 0) with all words of a lang."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    filters: dict[int, Filter] = {}
    counts = None
    for lengths in [(1, 2), (3,), tuple(range(4, longest + 1))]:
        if lengths and lengths[0] <= longest:
            c = in_batches(docs, _counts_kernel(lengths, filters, shard_bytes), "h bigint, c int, k tinyint").groupBy("k", "h").agg(F.sum("c").alias("f"))
            c = scratch.put(c.where((F.col("f") >= least) | (F.col("k") == 0)), f"counts-{lengths[0]}")
            filters |= {k: _none(filter_bits) for k in lengths} | _marked(c, filter_bits)
            counts = c if counts is None else counts.unionByName(c)
    look = lambda wanted: in_batches(docs, _words_kernel(longest, filters, wanted, shard_bytes), "h bigint, lang string, phrase string").groupBy("h").agg(F.min(F.struct("lang", "phrase")).alias("p"))
    named = scratch.put(look(None), "named")
    rest = _marked(counts.where("k > 0").join(named, "h", "left_anti"), filter_bits)
    if rest:
        named = named.unionByName(scratch.put(look(rest), "named-late").join(named, "h", "left_anti"))
    return counts.join(named, "h").select("p.lang", "p.phrase", F.col("k").cast("int").alias("k"), "f")


def _without(words, first: int, last: int):
    """The phrase without its first and last so many words."""
    return F.array_join(F.slice(words, first + 1, F.size(words) - first - last), " ")


def collocations(docs: DataFrame, least: int = 100, percent: int = 100, top: int = 2000, longest: int = LONGEST, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` of each language, by score, count and phrase; ``sizes``: shard_bytes, filter_bits."""
    scratch = Scratch(docs.sparkSession, "collocations")
    counts = scratch.put(phrase_counts(docs, scratch, least, longest, **sizes), "counts")
    phrases = scratch.put(counts.where("k > 0"), "phrases")
    candidate = phrases.where("k > 1").withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    # Along the links: what one word more in front or behind has at most.
    linked = candidate.where("k > 2").withColumn("sub", F.explode(F.array(_without(words, 1, 0), _without(words, 0, 1))))
    longer = scratch.put(linked.groupBy("lang", F.col("sub").alias("phrase")).agg(F.max("a").alias("most")), "longer")
    candidate = candidate.join(longer, ["lang", "phrase"], "left").where(f"most is null or 100 * most < {percent} * a").drop("most")
    part = phrases.select("lang", F.col("phrase").alias("part"), "f")
    cut = candidate.withColumn("w", words).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.withColumn("left", _without(F.col("w"), 0, F.col("k") - F.col("cut"))).withColumn("right", _without(F.col("w"), F.col("cut"), 0))
    # Written before each join: a word that is part of very many phrases makes a large task, which Spark can then split.
    cut = scratch.put(cut.select("lang", "phrase", "a", "cut", "left", "right"), "cuts")
    cut = cut.join(part.withColumnRenamed("part", "left").withColumnRenamed("f", "l"), ["lang", "left"])
    cut = scratch.put(cut.drop("left"), "cuts-left").join(part.withColumnRenamed("part", "right").withColumnRenamed("f", "r"), ["lang", "right"])
    total = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    cut = scratch.put(cut.drop("right"), "cuts-both").join(scratch.put(total, "totals"), "lang")
    score = F.expr("cast(1000 * cast(a as decimal(15,0)) * cast(n as decimal(15,0)) as decimal(38,0)) div cast(cast(l as decimal(15,0)) * cast(r as decimal(15,0)) as decimal(38,0))")
    cut = cut.withColumn("score", score)
    scored = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    scored = scored.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
