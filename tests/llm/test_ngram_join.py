import random
from itertools import combinations

import numpy as np
import pytest

from spanloom.llm import ngram_join as m
from tests.llm.test_near_dup import sets_of

SCHEMA = "doc_id bigint, text string, node string, bits string, component_id string"


def brute(rows, words, percent):
    """(doc_id, set size, component) of each row, by all pairs."""
    sets, root = sets_of([r[1] for r in rows], words), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(map(repr, ((r[0], len(s), least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets)))))


def got(spark, rows, words, percent):
    out = m.joined(spark.createDataFrame(rows, SCHEMA), words, percent).collect()
    return sorted(repr((g.doc_id, g.n_shingles, g.component_id)) for g in out)


def fixture(seed, longest):
    """Families of near copies with sizes on both sides of every boundary."""
    rng, texts = random.Random(seed), []
    vocab = ["".join(rng.choices("abcdeé", k=3)) for _ in range(300)]
    for _ in range(30):
        w = rng.choices(vocab, k=rng.randint(1, longest))
        for _ in range(rng.randint(1, 8)):
            v = list(w)
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                edit = rng.randrange(3)
                at = rng.randrange(len(v))
                v[at : at + (edit > 0)] = [] if edit == 2 and len(v) > 1 else [rng.choice(vocab)]
            texts.append(rng.choice([" ", "\n", "\t "]).join(v).title() if rng.random() < 0.2 else " ".join(v))
    texts += [None, "", "  \n", "one", "ONE", "one two", "é", "É", texts[0], texts[0]]
    rng.shuffle(texts)
    return [(None if i % 29 == 7 else i - (i % 31 == 5), t, "x", "y", "z") for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "words", "percent", "longest"), [(1, 3, 90, 60), (2, 5, 80, 40), (3, 1, 90, 25)])
def test_components_match_brute_force(spark, seed, words, percent, longest):
    rows = fixture(seed, longest)
    assert got(spark, rows, words, percent) == brute(rows, words, percent)


@pytest.mark.parametrize("most", [0, 12, 30])
def test_every_boundary_gives_the_same(spark, monkeypatch, most):
    """All lists, all subsets of sets that have few, and both."""
    monkeypatch.setattr(m, "boundary", lambda sizes, percent: most)
    rows = fixture(5, 45)
    assert got(spark, rows, 2, 90) == brute(rows, 2, 90)


def test_parts_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(m, "LIST_PART", 3)
    monkeypatch.setattr(m, "boundary", lambda sizes, percent: 5)
    rows = fixture(6, 60)
    assert got(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_empty_table(spark):
    assert m.joined(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r)[3:] for r in m.joined(spark.createDataFrame([(4, None, "", "", "")], SCHEMA)).collect()] == [(0, 4)]


def test_subsets_are_shared_exactly_by_sets_that_link():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n, d = int(rng.integers(5, 26)), int(rng.integers(0, 3))
        a = np.sort(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([np.delete(a, rng.choice(n, d, replace=False)), rng.integers(0, 1 << 62, int(rng.integers(0, 3))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        linked = 100 * both >= 90 * (len(a) + len(b) - both)
        (ka, sa), (kb, sb) = (m.subset_keys(x[None, :], 30, 90) for x in (a, b))
        ka, kb = dict(zip(ka[0].tolist(), sa[0].tolist())), dict(zip(kb[0].tolist(), sb[0].tolist()))
        # A key of one size pair has two sides, or the side of equal sizes.
        assert any({ka[k], kb[k]} in ({0, 1}, {2}) for k in ka.keys() & kb.keys()) == linked


def test_prefixes_and_bitmaps_never_miss_a_link():
    rng = np.random.default_rng(8)
    for n in (10, 57, 300, 2500):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            gone = int(rng.integers(0, max(2, n // 9)))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 62, gone // 2).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 90 * (len(a) + len(b) - both):
                continue
            order = rng.permutation(np.union1d(a, b))
            prefix = [set([x for x in order.tolist() if x in set(s.tolist())][: m.prefix_length(len(s), 90)]) for s in (a, b)]
            assert prefix[0] & prefix[1]
            bits = sorted((np.frombuffer(m.bitmap(s), np.uint64) for s in (a, b)), key=len)
            folded = np.bitwise_xor.reduce(bits[1].reshape(-1, len(bits[0])), axis=0)
            assert 190 * int(np.bitwise_count(folded ^ bits[0]).sum()) <= 10 * (len(a) + len(b))


def test_the_boundary_follows_the_costs():
    assert m.boundary({}, 90) == 0
    assert m.boundary({5: 1000}, 90) >= 5
    many_small, many_large = m.boundary({12: 100_000, 25: 10}, 90), m.boundary({39: 100_000}, 90)
    assert 12 <= many_small and many_large < 39


def test_very_long_texts(spark):
    """Texts of 60,000 words whose bitmaps have different widths than those of near copies of them."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(50_000)}" for _ in range(60_000)]
    near, far = base[:58_000], base[:50_000]
    rows = [(i, " ".join(t), "", "", "") for i, t in enumerate((base, near, far, base[:8195], base[:8190], base[:4000]))]
    assert got(spark, rows, 3, 90) == brute(rows, 3, 90)
