"""Passages of over 50 words that repeat, however few bytes they have."""

import random
import re
from collections import Counter

import corpus_pipeline
from spanloom.llm import suffix_dedup as m

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(texts, least):
    """What is left of each text's words when windows of ``least`` words that stand twice go."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    count = Counter(tuple(w[i : i + least]) for w in split for i in range(len(w) - least + 1))
    left = []
    for w in split:
        gone = {k for i in range(len(w) - least + 1) if count[tuple(w[i : i + least])] > 1 for k in range(i, i + least)}
        left.append([x for k, x in enumerate(w) if k not in gone])
    return left


def test_stage_removes_repeats_of_over_50_short_words(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(700)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    passages = [prose(n) for n in range(48, 66)]
    assert all(len(p.encode()) < 400 for p in passages)
    texts = [f"{prose(90)} {p} {prose(90)}" for p in passages for _ in range(2)]
    texts += [f"{prose(30)}\n{passages[-1]}", passages[-2].replace(" ", "\n"), prose(40), "", None, "x " * 60]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in corpus_pipeline.remove_repeated_passages(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    want = brute([t or "" for t in texts], 51)
    assert [got[i].split() for i in range(len(texts))] == want
    # 48 to 50 words stay, 51 and more are gone.
    assert [passages[k] in got[2 * k] for k in range(18)] == [True] * 3 + [False] * 15


def test_long_repeats_of_few_words_go_as_before(spark):
    rng = random.Random(5)
    word = "".join(rng.choices("abcdef", k=450))
    rows = [(i, f"{i} one {word} two {i}", "en", "s", 470) for i in range(2)]
    got = corpus_pipeline.remove_repeated_passages(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.text for r in got) == ["00", "11"]


def test_words_and_divided_groups_match_counting(spark):
    rng = random.Random(6)
    vocab = ["a", "b", "cc", "ddd", "é"]
    passage = rng.choices(vocab, k=14)
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 40))) for _ in range(30)]
    texts += [" ".join(rng.choices(vocab, k=5) + passage[: rng.randint(5, 14)] + rng.choices(vocab, k=5)) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    out = m.deduplicated(spark.createDataFrame(rows, SCHEMA), 4000, as_text=True, min_words=6, block_bytes=400, max_hulls=4)
    got = {r.doc_id: r.kept_text.split() for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 6)
