import random

import pytest

from spanloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = bpe.vocabulary_path()
    return bpe.Encoder(path), tokenizers.Tokenizer.from_file(path)


def agree(both, texts):
    mine, theirs = both
    for text, ids, want in zip(texts, mine.encode(texts), theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == want.ids, text
        assert mine.decode(ids) == theirs.decode(want.ids, skip_special_tokens=False)


def test_random_texts(both):
    rng = random.Random(2)
    letters = ["the", "ing", "er", "ö", "é", " ", " ", "\n", "'s", "'LL", "1", "İ", "Σ", "ß", "한", "½", "!!", "<|endoftext|>", "é", " ", "​", "\x85", "\x1c", "a", "b", "n", "T", "s", "i", "<|", "aaaa"]
    agree(both, ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)])


def test_long_words_and_few_letters(both):
    rng = random.Random(3)
    agree(both, ["".join(rng.choices("aehinrst", k=rng.choice([3, 30, 3000]))) for _ in range(200)] + ["a" * 20000, "!" * 5000, "ab" * 3000])


def test_every_code_point(both):
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    mine, theirs = both
    odd = []
    for i in range(0, len(chars), 20000):
        texts = [f"a{c}B{c} {c}" for c in chars[i : i + 20000]]
        odd += [t for t, ids, want in zip(texts, mine.encode(texts), theirs.encode_batch(texts, add_special_tokens=False), strict=True) if ids != want.ids]
        mine.known = mine.fresh()
    assert not odd, (len(odd), [hex(ord(t[1])) for t in odd[:40]])


def test_compatible_pairs_are_those_that_stay(both):
    mine, rng = both[0], random.Random(4)
    import numpy as np

    a, b = rng.choices(list(mine.inner.items()), k=4000), rng.choices(list(mine.final.items()), k=4000)
    got = mine.compatible(np.array([x[1] for x in a]), np.array([x[1] for x in b]))
    assert got.tolist() == [mine.merge(x[0] + y[0]) == [x[1], y[1]] for x, y in zip(a, b)]


def test_frame(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, None, None), (3, "", "y")]
    got = bpe.encoded(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()
    assert [r.n_tokens for r in got] == [2, 2, 0, 0] and got[0].decoded == "hello</w> world</w>" and got[2].ids == []
    assert bpe.encoded(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
