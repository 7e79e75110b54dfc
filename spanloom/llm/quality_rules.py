"""Quality rules: a table of thresholds compiled into one Spark projection; no user functions.

Null or empty text has no words: all counts are 0 and it fails the base rule. Very long texts are judged whole; windows
of texts whose hashes clash are compared by their words. Rows are judged alone, so repeated rows, ties and extra columns
(also ones named as the counts; the rules' values win) have no influence on each other. A value equal to a threshold
passes. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish. Fixed values.
STOP_WORDS = (
    "the of and to in that is for with this on are was it as by "
    "der die und das von zu mit den ist nicht sich des ein eine auf "
    "de la le et les des un une est que dans pour qui sur par du "
    "el los las en y por con del se una para al lo su no"
).split()
#: Low bits of a packed window, for its place; the others are its hash. Words of a text that places can tell apart.
_IDX = 24
_HIGH = ~((1 << _IDX) - 1)
_MASK = (1 << _IDX) - 1


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= 1000 * numerator / denominator <= high (in thousandths); no denominator, no ratio: passes."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None


#: The threshold table. Ratios are compared as whole numbers, so that every engine gets the same verdict.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=2000, high=15000),
    Rule("symbols_per_word", "n_symbols", "n_words", high=200),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=500),
    Rule("capital_letters", "n_upper", "word_chars", high=400),
    Rule("kinds_of_stop_words", "n_stop_kinds", "one", low=2000),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")


def _packed(words: str) -> Column:
    """Of each three-word window its hash (high bits) and place (low bits), sorted: equal windows are neighbours."""
    at = lambda i: F.get(words, i)
    window = lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)).bitwiseAND(F.lit(_HIGH)).bitwiseOR(i.cast("long"))
    return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))


def _alike(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b).bitwiseAND(F.lit(_HIGH)) == 0


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << _IDX) - 1)).cast("int")


def _differ(words: str, hits: str) -> Column:
    """Whether neighbours among the windows with equal hashes have different words. If none have, all of a hash are equal."""
    at, q = lambda i: F.get(words, i), F.col(hits)

    def other(x: Column, k: Column) -> Column:
        i, j = _place(F.get(q, k - 1)), _place(x)
        return (k > 0) & _alike(F.get(q, k - 1), x) & ((at(i) != at(j)) | (at(i + 1) != at(j + 1)) | (at(i + 2) != at(j + 2)))

    return F.size(F.filter(q, other)) > 0


def _sorted_by_words(words: str) -> Column:
    """Places of windows that occur twice or more, by a sort of the words themselves."""
    w, n = F.col(words), F.size(words)
    texts = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(" ", F.slice(w, i + 1, 3)))
    pairs = F.array_sort(F.arrays_zip(texts.alias("w"), F.sequence(F.lit(0), n - 3).alias("i")))
    # Bound to a name, so that the lambdas read the sorted array and do not sort it.
    twin = lambda z: F.filter(z, lambda x, k: ((k > 0) & (F.get(z, k - 1)["w"] == x["w"])) | ((k < F.size(z) - 1) & (F.get(z, k + 1)["w"] == x["w"])))
    found = F.get(F.transform(F.array(pairs), twin), F.lit(0))
    return F.sort_array(F.transform(found, lambda x: x["i"]))


def _covered(places: str) -> Column:
    r = F.col(places)
    gaps = F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.least(F.lit(3), b - a).cast("long"))
    return F.when(F.size(r) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(3).cast("long"), lambda s, x: s + x))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_kinds, n_upper, one (long)."""
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_kinds", "n_upper", "one"]
    keep = [c for c in docs.columns if c not in made]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    stop = F.array(*[F.lit(w) for s in sorted(set(STOP_WORDS)) for w in (s, s.capitalize())])
    lines = F.filter(F.split(t, "\n", -1), lambda line: F.rlike(line, F.lit(f"[^{SPACE_CLASS}]")))
    # Staged so that an array is computed once and then read by name inside lambdas.
    d = docs.select(*[F.col(f"`{c}`") for c in keep], t.alias("__t"), _words(t).alias("__w"), lines.alias("__l"))
    n, none = F.size("__w"), F.array().cast("array<bigint>")
    d = d.withColumn("__p", F.when((n >= 4) & (n <= _MASK), _packed("__w")).otherwise(none))
    p = F.col("__p")
    d = d.withColumn("__q", F.filter(p, lambda x, k: ((k > 0) & _alike(x, F.get(p, k - 1))) | ((k < F.size(p) - 1) & _alike(x, F.get(p, k + 1)))))
    # Few texts go the long way: those with a clash of hashes, and those of more words than a place has bits for.
    d = d.withColumn("__long", (n > _MASK) | _differ("__w", "__q"))
    d = d.withColumn("__r", F.when(F.col("__long"), _sorted_by_words("__w")).otherwise(F.sort_array(F.transform("__q", _place))))
    t, w = F.col("__t"), F.col("__w")
    return d.select(
        *[F.col(f"`{c}`") for c in keep],
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _covered("__r").alias("n_repeat_words"),
        F.size(F.array_intersect(w, stop)).cast("long").alias("n_stop_kinds"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.lit(1).cast("long").alias("one"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True if a measured row passes every rule of the table."""
    out = F.lit(True)
    for r in rules:
        num, den = F.col(r.numerator) * 1000, F.col(r.denominator)
        if r.low is not None:
            out = out & (num >= den * r.low)
        if r.high is not None:
            out = out & (num <= den * r.high)
    return out


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the counts, base_failed and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    m = measured(docs.drop("base_failed", "kept"), text)
    return m.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns only. They are written with their verdicts, and then filtered: a
    filter over the counts themselves would be moved below them, and hold their expressions one within the other."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    j = judged(docs.select(F.struct(*own).alias("__row"), F.col("text").alias("__judged")), rules, "__judged")
    return Scratch(docs.sparkSession, "rules").put(j.select("__row", "kept"), "judged").where("kept").select("__row.*")
