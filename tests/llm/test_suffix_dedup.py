import random
from collections import Counter

import numpy as np

from spanloom.llm import suffix_dedup as m

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_bytes string"


def brute(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(b for b, g in zip(t, gone) if not g)))
    return out


def test_block_flags_match_counting():
    rng = random.Random(3)
    for _ in range(60):
        length = rng.choice([3, 5, 8, 20])
        strings = [bytes(rng.choices(b"abc", k=rng.randint(0, 60))) for _ in range(rng.randint(0, 9))]
        count = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[count[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]
        assert [f.tolist() for f in m.repeated_starts(strings, length)] == want


def fixture(rng):
    passage = "".join(rng.choices("abcdefgh é", k=70))
    texts = ["".join(rng.choices("abcdefgh é", k=rng.randint(0, 150))) for _ in range(30)]
    texts += [t + passage[: rng.randint(20, 70)] + u for t, u in zip(texts[:15], texts[5:20])]
    texts += [texts[3]] * 5 + [None, "", "x" * 100, "ab" * 60, texts[4][:-1]]
    texts += [f"{i}{passage}{i * 7}" for i in range(25)]
    return [(i % 40 if i % 11 else None, t, None, "s", None, "clash") for i, t in enumerate(texts)]


def check(spark, rows, **bounds):
    df = spark.createDataFrame(rows, SCHEMA)
    got = m.deduplicated(df, 24, **bounds).collect()
    want = brute([(r[1] or "").encode() for r in rows], 24)
    key = lambda d, n, r, s, k: (d is None, d or 0, n, r, s, k)
    have = sorted(key(g.doc_id, g.n_bytes, g.n_removed, len(g.spans), bytes(g.kept_bytes)) for g in got)
    assert have == sorted(key(r[0], len((r[1] or "").encode()), *w) for r, w in zip(rows, want))


def test_whole_plan_matches_brute_force(spark):
    check(spark, fixture(random.Random(5)), block_bytes=200)


def test_large_groups_are_divided(spark):
    check(spark, fixture(random.Random(6)), block_bytes=200, max_hulls=4)


def test_empty_table(spark):
    assert m.deduplicated(spark.createDataFrame([], SCHEMA), 24).count() == 0


def test_production_size_matches_brute_force(spark):
    """400 bytes and the default bounds, and the same with large groups divided: texts from 0 to 60,000 bytes."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghiklmnoprstué", k=rng.randint(1, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passages = [prose(n) for n in (40, 55, 62, 70, 90, 400)]
    assert min(len(p.encode()) for p in passages) < 400
    texts = [f"{prose(rng.randint(0, 80))} {rng.choice(passages)[rng.randint(0, 60):]} {prose(rng.randint(0, 80))}" for _ in range(80)]
    texts += [passages[5] + passages[5], "z" * 399, "z" * 400, "y" * 401, ("ab" * 300), prose(9000) + passages[4] + prose(300), texts[0], texts[0], None, ""]
    texts += [f"{i} {passages[3]} {i}" for i in range(40)]
    rows = [(i, t, None, "s", None, "clash") for i, t in enumerate(texts)]
    want = brute([(t or "").encode() for t in texts], 400)
    assert sum(w[0] > 0 for w in want) > 60 and sum(w[0] == 0 for w in want) > 10
    for bounds in ({}, {"max_hulls": 5, "block_bytes": 5000}):
        got = {r.doc_id: (r.n_removed, len(r.spans), bytes(r.kept_bytes)) for r in m.deduplicated(spark.createDataFrame(rows, SCHEMA), **bounds).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_strings_left_out_hold_no_repeat():
    """What the filter beside the anchors leaves out has no window in common with another of its group."""
    rng = random.Random(9)
    length = 24
    for _ in range(40):
        shared = bytes(rng.choices(b"abcd", k=rng.randint(4, 40)))
        pieces = [bytes(rng.choices(b"abcd", k=rng.randint(0, 40))) + shared + bytes(rng.choices(b"abcd", k=rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        text, start, count, anchor, _, _ = m.runs(data, offsets, length)
        hulls = [pieces[t][s : s + n + length - 1] for t, s, n in zip(text, start, count)]
        order = np.argsort(anchor, kind="stable")
        hulls, anchor = [hulls[i] for i in order], anchor[order]
        group = np.cumsum(np.diff(anchor, prepend=anchor[:1]) != 0)
        keep = m.may_repeat(group, anchor, hulls, length)
        for g in set(group.tolist()):
            own = [h for h, x in zip(hulls, group) if x == g]
            flags = m.repeated_starts(own, length)
            assert all(k or not f.any() for k, f in zip(keep[group == g], flags))
