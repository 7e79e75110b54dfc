import random
import re

from spanloom.llm import mixing as m

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def fixture(seed=1, sizes=(3, 40, 200, 500, 60)):
    rng, rows = random.Random(seed), []
    names = ["b", "a", None, "", "é"]
    for name, n in zip(names, sizes):
        for _ in range(n):
            text = rng.choice(["", " ", "\n"]).join(["", rng.choice([" ", "\n", "  "]).join(rng.choices(["x", "yy", "zé"], k=rng.randint(0, 60)))])
            rows.append((len(rows) if len(rows) % 50 else None, rng.choice([text, text, text, None]), None, name, None, "clash"))
    return rows + rows[-3:]


def brute_targets(rows):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return sizes, target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
        if not open_:
            return sizes, target


def test_mix_meets_its_targets(spark):
    for seed, sizes in ((1, (3, 40, 200, 500, 60)), (2, (1, 300, 2, 2, 1))):
        rows = fixture(seed, sizes)
        df = spark.createDataFrame(rows, SCHEMA)
        got = m.mix(df, shard_docs=50).collect()
        size, target = brute_targets(rows)
        assert len(got) == len(rows)
        by = {}
        for g in got:
            assert 0 <= g.taken <= 3 * g.size
            by.setdefault((g.source_size, round(g.target, 6)), []).append(g.taken)
        want = {(size[s], round(target[s], 6)) for s in size}
        assert set(by) == want
        for (s, t), taken in by.items():
            assert abs(sum(taken) - t) <= 16 * (1 + 500 / 50) + 1
        again = m.mix(df.repartition(7), shard_docs=50).collect()
        key = lambda g: (g.doc_id is None, g.doc_id or 0, g.size, g.target, g.taken)
        assert sorted(map(key, got)) == sorted(map(key, again))


def test_documents_of_the_mix(spark):
    rows = fixture(3)
    df = spark.createDataFrame(rows, SCHEMA)
    out = m.mixed_documents(df, shard_docs=50)
    assert out.columns == df.columns
    got = out.collect()
    assert sum(len(words(r.text)) for r in got) == sum(g.taken for g in m.mix(df, shard_docs=50).collect())
    originals = {}
    for r in rows:
        originals.setdefault(r[0], set()).add(r[1])
    assert all(any(r.text in (t or "") for t in originals[r.doc_id]) and r.n_chars == len(r.text) for r in got)


def test_highest_quotients(spark):
    rng = random.Random(4)
    for _ in range(6):
        parties, seats = [(1, k, rng.choice([0, 1, 5, 53, 1000, 99999])) for k in range(rng.randint(1, 9))], rng.randint(0, 300)
        df = spark.createDataFrame([(*p, seats) for p in parties], "g int, k int, votes bigint, seats bigint")
        got = {r.k: r.q for r in m.highest_quotients(df, ["g"], ["k"], "votes", "seats", "q").collect()}
        want = {k: 0 for _, k, _ in parties}
        for _ in range(seats if any(v for *_, v in parties) else 0):
            _, k, _ = min((-v / (2 * want[k] + 1), k, 0) for _, k, v in parties)
            want[k] += 1
        assert got == want


def test_empty_and_wordless_tables(spark):
    assert m.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = m.mix(spark.createDataFrame([(1, None, None, "a", None, None), (2, "", None, None, None, None)], SCHEMA)).collect()
    assert [(g.size, g.source_size, g.target, g.taken) for g in got] == [(0, 0, 0.0, 0)] * 2


def test_very_long_text(spark):
    rows = [(1, "long " * 400_000, None, "a", None, "x"), (2, "b c d", None, "a", None, "x"), (3, "e " * 100_000, None, "b", None, "x")]
    got = {r.doc_id: r for r in m.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].size, got[3].size) == (400_000, 100_000) and abs(got[3].target - 300_000) < 1e-6 and abs(got[1].target - 200_003) < 1e-6
    for s in "ab":
        own = [got[r[0]] for r in rows if r[3] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * m.BLOCK and all(r.taken <= 3 * r.size for r in own)
    parts = m.mixed_documents(spark.createDataFrame(rows, SCHEMA)).where("doc_id = 3").collect()
    assert sum(len(words(r.text)) for r in parts) == got[3].taken
