import random
import re

import numpy as np

from spanloom.llm import near_dup as m
from spanloom.llm.components import connected_components

SCHEMA = "doc_id bigint, text string, node string, n_shingles string"


def sets_of(texts, words):
    out = []
    for t in texts:
        t = re.sub("[A-Z]", lambda x: x[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append(frozenset(zip(*(w[i:] for i in range(words)))) if len(w) >= words else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, words):
    ids, sets = [r[0] for r in rows], sets_of([r[1] for r in rows], words)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    comp = [least.get(find(i)) for i in range(len(rows))]
    return sorted((d is None, d or 0, len(s), c is None, c or 0, d == c) for d, s, c in zip(ids, sets, comp))


def fixture(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=3)) for _ in range(300)]
    texts = []
    for _ in range(25):
        w = rng.choices(vocab, k=rng.randint(1, 90))
        for _ in range(rng.randint(1, 8)):
            v = list(w)
            for _ in range(rng.randint(0, 5)):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            texts.append(rng.choice([" ", "\n", "\t "]).join(v).title() if rng.random() < 0.2 else " ".join(v))
    texts += [None, "", "  \n", "one", "ONE", "one two", "é", "É", texts[0], texts[0]]
    rng.shuffle(texts)
    return [(None if i % 29 == 7 else i - (i % 31 == 5), t, "x", "y") for i, t in enumerate(texts)]


def test_sets_and_sketches():
    a = m.shingle_sets(*m.text_bytes(__import__("pyarrow").array(["a b c d e", "A b\tc D e ", None, "", "x", " a b c d "])), 4)
    assert [len(s) for s in a] == [2, 2, 0, 0, 1, 1] and (a[0] == a[1]).all()
    rng = np.random.default_rng(1)
    for j in (0.7, 0.8, 0.95):
        u = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        part = int(2000 * (1 - j) / 2)
        mh = np.array([m.minhashes(u[: 2000 - part]), m.minhashes(u[part:])])
        s = m.odd_sketches(mh).view(np.uint64)
        z = int(np.bitwise_count(s[0] ^ s[1]).sum())
        estimate = 1 + m.SKETCH_BITS / (4 * m.SAMPLES) * np.log(1 - 2 * z / m.SKETCH_BITS)
        assert abs(estimate - j) < 0.17


def test_components_match_brute_force(spark):
    for seed, words in ((1, 4), (2, 5)):
        rows = fixture(seed)
        got = m.near_duplicates(spark.createDataFrame(rows, SCHEMA), words).collect()
        have = sorted((g.doc_id is None, g.doc_id or 0, g.n_shingles, g.component_id is None, g.component_id or 0, g.doc_id == g.component_id) for g in got)
        assert have == brute(rows, words)
        assert all(g.kept == (g.doc_id == g.component_id) for g in got)


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 3)
    monkeypatch.setattr(m, "SKETCHES", 2)
    rows = fixture(4)
    got = m.near_duplicates(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert sorted((g.doc_id is None, g.doc_id or 0, g.n_shingles, g.component_id is None, g.component_id or 0, g.doc_id == g.component_id) for g in got) == brute(rows, 4)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert m.near_duplicates(df).count() == 0 and m.kept_documents(df).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    assert sorted(tuple(r) for r in connected_components(edges).collect()) == [(i, 0) for i in range(41)] + [(100, 100), (101, 100)]


def test_very_long_texts(spark):
    """Texts of 120,000 words: copies with one word in ten changed are linked or not by their whole sets."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(50_000)}" for _ in range(120_000)]
    far, near = list(base), list(base)
    for i in range(0, 120_000, 50):
        near[i] = f"n{i}"
    for i in range(60_000, 120_000, 4):
        far[i] = f"f{i}"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, "\n".join(base)), (5, "other words here and there")]
    sets = sets_of([t for _, t in rows], 4)
    assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]) > 0 and len(sets[0] & sets[2]) < 0.7 * len(sets[0] | sets[2])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect()}
    assert got == {i + 1: (len(s), c) for i, (s, c) in enumerate(zip(sets, (1, 1, 3, 1, 5)))}
