import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import collocations as m

SCHEMA = "lang string, text string, phrase string, score string, c string"


def brute(rows, least, percent=100, top=2000, longest=5):
    """lang, rank, phrase, a, l, r, n, score by plain counting."""
    total, f = Counter(), Counter()
    for lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda x: x[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    candidates = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    for (lang, p), a in candidates.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(o == lang and len(q) > len(p) and inside(q) and 100 * b >= percent * a for (o, q), b in candidates.items()):
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], total[lang], score))
    ranked = []
    for lang in sorted({r[0] for r in out}):
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(own[:top], 1)]
    return ranked


def got(spark, rows, **options):
    return sorted(tuple(r) for r in m.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect())


def fixture(seed):
    rng, rows = random.Random(seed), []
    common = ["new York city", "as well as", "a a a a a a", "the end of the", "é É ß"]
    for _ in range(150):
        words = [rng.choice([*"abcdefg", "the", "éa", "x-y", *common]) for _ in range(rng.randint(0, 40))]
        text = rng.choice([" ", "  ", "\t"]).join(w + rng.choice(["", "", "", ".", ",", "\n", "; "]) for w in words)
        rows.append((rng.choice(["en", "de", None]), text, "p", "s", "c"))
    return [*rows, rows[0], rows[0], ("en", None, "", "", ""), ("xx", "", "", "", ""), ("en", " .,; \n", "", "", "")]


@pytest.mark.parametrize(("seed", "least", "percent"), [(1, 5, 100), (2, 12, 100), (3, 8, 60)])
def test_phrases_match_brute_force(spark, seed, least, percent):
    rows = fixture(seed)
    want = brute(rows, least, percent)
    assert len(want) > 20
    assert got(spark, rows, least=least, percent=percent) == want


def test_small_shards_and_a_full_filter_change_nothing(spark):
    """Texts cut between pieces over many shards; filters of 64 bits, which let everything through."""
    rows = fixture(4)
    assert got(spark, rows, least=5, shard_bytes=40, filter_bits=64) == brute(rows, 5)


def test_the_first_of_each_language(spark):
    rows = fixture(5)
    assert got(spark, rows, least=5, top=7) == brute(rows, 5, top=7)


def test_scores_past_64_bits(spark, monkeypatch):
    """1000 * a * n and l * r of counts in the billions: what the shards count is multiplied."""
    whole = m.phrase_counts
    monkeypatch.setattr(m, "phrase_counts", lambda *a: whole(*a).withColumn("f", m.F.col("f") * 3_000_000_019))
    rows = [("en", "one two " * 60 + "three one", "", "", "")]
    found = m.collocations(spark.createDataFrame(rows, SCHEMA), least=5).collect()
    assert found and all(p.score == 1000 * p.a * p.n // (p.l * p.r) and p.l * p.r > 2**64 for p in found)


def test_nothing_is_frequent(spark):
    assert got(spark, []) == []
    assert got(spark, fixture(6), least=100_000) == []


def test_states_of_the_automaton_are_classes_of_ends():
    """States against plain sets of ends, over all phrases of up to five words."""
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 12))) + rng.choice(["", ". a b c a", ", b b"]) for _ in range(25)]
    data, offsets = m.text_bytes(pa.array(texts))
    words = m.Words(data, offsets)
    names, want = [words.text(i) for i in range(len(words.at))], {}
    for e in range(len(names)):
        for k in range(1, min(5, int(words.run[e])) + 1):
            want.setdefault(tuple(names[e - k + 1 : e + 1]), set()).add(e)
    classes = {}
    for phrase, ends in want.items():
        classes.setdefault(frozenset(ends), []).append(phrase)
    states = {}
    for end, longest, shortest, count in m.Automaton(words, 5, 5, {}).states():
        phrase = tuple(names[end - longest + 1 : end + 1])
        states[frozenset(want[phrase])] = sorted((phrase[longest - k :] for k in range(shortest, longest + 1)), key=len)
        assert count == len(want[phrase])
    assert states == {e: sorted(p, key=len) for e, p in classes.items()}


def test_words_are_told_apart():
    data, offsets = m.text_bytes(pa.array(["Ab  ab\tAB.ab", "", "ab", "b a", "ba", None, "é"]))
    words = m.Words(data, offsets)
    assert [words.text(i) for i in range(len(words.at))] == ["ab", "ab", "ab", "ab", "ab", "b", "a", "ba", "é"]
    assert len(np.unique(words.hash)) == 5 and words.run.tolist() == [1, 2, 3, 1, 1, 1, 2, 1, 1]
