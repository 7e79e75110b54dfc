import random
import re
from collections import Counter

from spanloom.llm import quality_rules as m

SCHEMA = "doc_id bigint, text string, n_words string"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), base


def fixture():
    rng = random.Random(1)
    vocab = ["the", "of", "und", "la", "Wörter", "a|b", "#x", "é", "\U0001f600", "NBSP in", "1", "sentence.", "Longer"]
    rows = [(i, "".join(rng.choice(vocab) + rng.choice([" ", " ", "\n", "\t", "\x0b ", "  "]) for _ in range(rng.choice([0, 3, 60, 400])))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " \n \n"), (103, "a b c a b c"), (104, "a b c a b"), (105, "x " * 5000), (None, "a a a"), (3, rows[3][1])]
    rows += [(200 + i, " ".join(f"w{j * 7 % 90} the of" for j in range(80)) + f"\nline {i}\nline {i}") for i in range(3)]
    return [(*r, "clash") for r in rows]


def test_counts_match_plain_counting(spark):
    rows = fixture()
    got = m.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    for r, g in zip(rows, got, strict=True):
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute(r[1]), r
        assert not (g.base_failed and g.kept)


def test_sorting_pairs_for_very_long_texts_is_the_same(spark, monkeypatch):
    rows = fixture()
    monkeypatch.setattr(m, "_MASK", 7)
    got = m.measured(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [g.n_repeat_words for g in got] == [brute(r[1])[4] for r in rows]


def test_clashing_hashes_do_not_hide_repeats(spark, monkeypatch):
    """Hashes of a few bits: windows that clash stand between equal ones, and their words decide."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=60)), "x") for i in range(200)] + fixture()
    for bits in (1, 4, 8):
        monkeypatch.setattr(m, "_HIGH", (1 << bits) - 1 << m._IDX)
        got = m.measured(spark.createDataFrame(rows, SCHEMA)).collect()
        assert [g.n_repeat_words for g in got] == [brute(r[1])[4] for r in rows]


def test_very_long_text(spark):
    rng = random.Random(8)
    text = " ".join(rng.choices([f"w{i}" for i in range(4000)], k=300_000)) + "\nend\nend"
    g = m.judged(spark.createDataFrame([(1, text, "x")], SCHEMA)).first()
    assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute(text)


def test_verdict_and_kept_documents(spark):
    prose = "The house of the old man and his dog is by the river that runs to the sea for all to see, " * 1
    good = " ".join(f"{prose} word{i} and other{i * 3} things to name{i}." for i in range(6))
    rows = [(1, good, "x"), (2, good.upper(), "x"), (3, "| ".join(good.split()), "x"), (4, "short text", "x"), (5, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = m.kept_documents(df)
    assert kept.columns == df.columns
    assert m.judged(spark.createDataFrame([], SCHEMA)).count() == 0
    verdicts = {r.doc_id: (r.base_failed, r.kept) for r in m.judged(df).collect()}
    assert verdicts[4] == verdicts[5] == (True, False) and not verdicts[2][1] and not verdicts[3][1]
    assert {r.doc_id for r in kept.collect()} == {k for k, v in verdicts.items() if v[1]}
