import random
import zlib

import numpy as np
import pytest

from spanloom.llm import quality_gam, toxicity
from spanloom.llm.training import flat_bytes, labelled_sample, word_hashes

DOC = "doc_id bigint, text string, score string"
LABEL = "doc_id bigint, quality int, toxic int"
RUDE = ["grumf", "blarg", "snorpé"]


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgo", k=rng.randint(2, 7))) for _ in range(400)] + ["the", "and", "of", "der", "und", "ist"] * 20
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(3, 120))
        toxic, good = int(rng.random() < 0.25), int(rng.random() < 0.7)
        if toxic:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(RUDE).upper() + "!"
        text = " ".join(words)
        docs.append((i, text if good else text.upper().replace(" ", " | "), "x"))
        labels.append((i, good, toxic))
    return docs, labels


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("run, column, n, held", [(toxicity.toxicity, 2, 5, 0), (quality_gam.quality, 1, 3, 1)])
def test_held_out_rows_are_told(spark, run, column, n, held):
    docs, labels = corpus()
    extra = [(10_000, None, None), (10_001, "", None), (None, "no id", None), (7, docs[7][1], None), (10_002, "grumf " * 40_000, "y")]
    d, l = spark.createDataFrame(docs + extra, DOC), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (10_000, 1, 0)], LABEL)
    got = run(d, l).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {x[0]: x[column] for x in labels}
    rows = [r for r in got if r.doc_id in truth]
    assert all(r.held_out == (fold(r.doc_id, n) == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    right = [r.predicted == truth[r.doc_id] for r in rows if r.held_out]
    assert len(right) > 100 and np.mean(right) > 0.95
    if column == 2:
        assert next(r for r in got if r.doc_id == 10_002).predicted == 1


@pytest.mark.parametrize("run, target, n, held", [(toxicity.toxicity, "toxic", 5, 0), (quality_gam.quality, "quality", 3, 1)])
def test_held_out_labels_are_not_learnt(spark, run, target, n, held):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, DOC)
    flipped = [(i, 1 - q, 1 - t) if fold(i, n) == held else (i, q, t) for i, q, t in labels]
    a, b = ({(r.doc_id, r.score) for r in run(d, spark.createDataFrame(x, LABEL)).collect()} for x in (labels, flipped))
    assert a == b


def test_without_labels_or_rows(spark):
    d, none = spark.createDataFrame([(1, "a b", "x")], DOC), spark.createDataFrame([], LABEL)
    for run in (toxicity.toxicity, quality_gam.quality):
        assert [r.score for r in run(d, none).collect()] == [0.0]
        assert run(spark.createDataFrame([], DOC), none).count() == 0


def test_sample_is_bounded(spark):
    docs, labels = corpus(200)
    texts, y = labelled_sample(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL), "toxic", 5, 0, per_class=20)
    assert len(texts) == 40 and y.sum() == 20


def test_words_and_threshold():
    h, edges, start, size = word_hashes(*flat_bytes(["Ab, cd!", "", "ab", "é-É"]))
    assert edges.tolist() == [0, 2, 2, 3, 5] and h[0] == h[2] and size.tolist() == [2, 2, 2, 2, 2] and start.tolist() == [0, 4, 7, 9, 12]
    z, y = np.array([0.0, 0.0, 0.0, 2.0, 2.0]), np.array([0, 0, 1, 1, 1])
    assert 0 < toxicity.threshold(z, y) < 2


def test_network_tells_words():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["grumf", "ab", "cd", "ef"], 6)) for _ in range(120)]
    y = np.array([float("grumf" in t) for t in texts])
    model = toxicity.train(texts, y)
    s = toxicity.Scorer(model).score(*flat_bytes(["ab grumf", "ab cd", "", "GRUMF."]))
    assert s[0] > 0.5 > s[1] and s[2] < 0.5 < s[3]


def test_features_match_plain_counting():
    texts = ["The cat. the cat!\nA b\nA b\n", "", "| | X", "one"]
    x = dict(zip(quality_gam.FEATURES, quality_gam.features(*flat_bytes(texts)).T))
    assert x["words"].tolist() == [8, 0, 1, 1] and x["longest_word"].tolist() == [3, 0, 1, 3]
    assert np.allclose(x["duplicate_lines"], [1 / 3, 0, 0, 0]) and np.allclose(x["distinct_words"], [0.5, 0, 1, 1])
    assert np.allclose(x["exclamation"], [1 / 26, 0, 0, 0]) and np.allclose(x["upper"], [3 / 26, 0, 1 / 5, 0])


def test_tables_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert np.mean((quality_gam.train(x[:1500], y[:1500]).score(x[1500:]) >= 0.5) == y[1500:]) > 0.9


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(2)
    n, words = 12, 90
    edges = np.sort(np.concatenate([[0, words], rng.integers(0, words, n - 1)]))
    a, b = rng.integers(0, 5, words), rng.integers(0, 5, words)
    a, b = np.where((a > 0) & (b > 0), a, 0), np.where((a > 0) & (b > 0), b, 0)
    params = [rng.normal(0, 1, (5, toxicity.HALF)) for _ in range(2)]
    params += [rng.normal(0, 1, (toxicity.FILTERS, w * 2 * toxicity.HALF)) for w in toxicity.WIDTHS]
    params += [rng.normal(0, 0.1, toxicity.FILTERS) for _ in toxicity.WIDTHS] + [rng.normal(0, 1, len(toxicity.WIDTHS) * toxicity.FILTERS), rng.normal(0, 1, 1)]
    y, weight = rng.integers(0, 2, n).astype(float), rng.random(n) + 0.5
    of = lambda: toxicity.gradients(params, toxicity.spans_of(a > 0, edges), np.arange(n), a, b, y, weight)
    _, grads = of()
    for x, g in zip(params, grads):
        flat, slope = x.reshape(-1), g.reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            was = flat[i]
            flat[i] = was + 1e-6
            up, _ = of()
            flat[i] = was - 1e-6
            down, _ = of()
            flat[i] = was
            assert abs((up - down) / 2e-6 - slope[i]) < 1e-5


def plain_toxicity(model, text):
    """The network's score word by word."""
    h = word_hashes(*flat_bytes([text]))[0]
    rows = [{int(r): v for r, v in zip(rs, vs)} for rs, vs in zip(model.rows, model.vectors)]
    mask = (1 << toxicity.BITS) - 1
    vectors = []
    for x in h.tolist():
        a, b = rows[0].get(x & mask), rows[1].get(x >> 40 & mask)
        vectors.append(np.concatenate([a, b]).astype(float) if a is not None and b is not None else None)
    z = model.out_bias
    for k, w in enumerate(toxicity.WIDTHS):
        best = np.zeros(toxicity.FILTERS)
        for i in range(len(vectors) - w + 1):
            part = vectors[i : i + w]
            if any(v is not None for v in part):
                flat = np.concatenate([np.zeros(2 * toxicity.HALF) if v is None else v for v in part])
                best = np.maximum(best, model.filters[k] @ flat + model.bias[k])
        z += best @ model.out[k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS]
    words = __import__("re").findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)
    low = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    counts = [sum(w in own for w in low) for own in toxicity.LANGUAGES.values()]
    lang = counts.index(max(counts)) if max(counts) else len(counts)
    return 1 / (1 + np.exp(-(z - model.thresholds[lang])))


def test_toxicity_of_whole_texts_matches_a_plain_scorer(spark):
    docs, labels = corpus(400, 9)
    model = toxicity.train([d[1] for d in docs], np.array([float(x[2]) for x in labels]))
    rows = [*docs[:150], (9001, "", "x"), (9002, None, "x"), (9003, " ".join(d[1] for d in docs), "x"), (9004, "calm words " * 100_000 + "GRUMF! blarg", "x")]
    got = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(rows, DOC), model).collect()}
    for i, text, _ in rows:
        if i != 9004:
            assert abs(got[i] - plain_toxicity(model, text or "")) < 1e-5
    # The very long text is scored whole: its last words decide.
    assert got[9004] > 0.5 > got[9002]


def test_quality_of_whole_texts_matches_plain_look_ups():
    docs, labels = corpus(400, 10)
    texts = [d[1] for d in docs] + ["", "x " * 100_000]
    x = quality_gam.features(*flat_bytes(texts))
    model = quality_gam.train(x[:400], np.array([float(v[1]) for v in labels]))
    got = model.score(x)
    for row, s in zip(x, got):
        place = [sum(c <= v for c in cut) for cut, v in zip(model.cuts, row)]
        coarse = [sum(c <= v for c in cut) for cut, v in zip(model.coarse, row)]
        z = model.base + sum(t[p] for t, p in zip(model.tables, place)) + sum(t[coarse[a], coarse[b]] for (a, b), t in zip(model.pairs, model.pair_tables))
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9
    # Features do not depend on what a text shares a batch with.
    alone = np.concatenate([quality_gam.features(*flat_bytes([t])) for t in texts[-40:]])
    assert np.allclose(alone, x[-40:])


def test_sample_takes_one_row_of_an_id(spark):
    docs = [(1, f"text {i}", "x") for i in range(50)] + [(2, "other", "x")]
    texts, y = labelled_sample(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, 1, 1), (2, 0, 0)], LABEL), "toxic", 5, 9)
    assert len(texts) == 2 and sorted(y.tolist()) == [0, 1]
