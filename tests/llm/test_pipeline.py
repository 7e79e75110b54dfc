"""The pipeline's stages against plain forms of the same rules, on a small corpus."""

import random
import re

import corpus_pipeline
from spanloom.llm import bpe

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def shingles(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} - {()}


def corpus():
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghik", k=rng.randint(3, 7))) for _ in range(900)] + ["the", "of", "and", "to", "in"] * 40
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    passage = prose(120)
    texts = [prose(rng.randint(60, 200)) for _ in range(30)]
    texts += [texts[0], texts[1], texts[2] + " more words"]  # copies
    texts += [f"{prose(60)} {passage} {prose(60)}" for _ in range(4)]
    texts += ["too short", "", None, "SHOUT!! " * 100, "| ".join(vocab[:100])]
    return [(i, t, "en", f"s{i % 3}" if i % 10 else None, len(t or "")) for i, t in enumerate(texts)]


def test_stages_one_by_one(spark, tmp_path):
    rows = corpus()
    docs = {"all": {r[0]: r[1] for r in rows}}
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        docs[name] = {}
        for r in now.collect():
            assert r.n_chars == len(r.text)
            docs[name].setdefault(r.doc_id, []).append(r.text)
    # Rules: short, shouted and piped texts go; prose stays.
    assert set(docs["quality_rules"]) == set(range(37))
    # One of each near group; groups by brute force.
    left = sorted(docs["quality_rules"])
    sets = {i: shingles(docs["quality_rules"][i][0]) for i in left}
    gone = {i for i in left for j in left if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert set(docs["near_duplicates"]) == set(left) - gone and gone
    # Passages: no 400-byte string is left that was there twice.
    before = [t for v in docs["near_duplicates"].values() for t in v]
    seen, twice = set(), set()
    for t in before:
        b = t.encode()
        for i in range(len(b) - 399):
            (twice if b[i : i + 400] in seen else seen).add(b[i : i + 400])
    after = docs["repeated_passages"]
    assert set(after) == set(docs["near_duplicates"]) and twice
    assert not any(s in t.encode() for s in twice for v in after.values() for t in v)
    # The mix takes parts of these texts, and as many words as there are in all.
    total = sum(len(words(t)) for v in after.values() for t in v)
    mixed = docs["source_mixing"]
    assert all(any(t in o for o in after[i]) for i, v in mixed.items() for t in v)
    assert abs(sum(len(words(t)) for v in mixed.values() for t in v) - total) <= 100
    final = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    e = bpe.encoder(bpe.vocabulary_path())
    assert sorted(tuple(r.ids) for r in final) == sorted(tuple(x) for x in e.encode([t for v in mixed.values() for t in v]))
    # run() does the same in one go.
    assert sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, tuple(r.ids)) for r in final)


def test_stages_take_any_rows(spark, tmp_path):
    """Empty tables, nulls in every column, repeated rows and columns with clashing names, stage by stage and in one go."""
    extra = SCHEMA + ", kept string, spans string, root string, size string, node string, pieces string"
    good = " ".join(f"the house{i} of name{i * 7} and word{i}" for i in range(20))
    more = ("k", "s", "r", "z", "n", "p")
    rows = [(1, good, "en", "a", len(good), *more)] * 2 + [(None, good + " end", None, None, None, *more), (3, None, None, None, None, *[None] * 6), (None, "", "x", "y", 0, *more)]
    for name, data in (("none", []), ("some", rows)):
        docs = spark.createDataFrame(data, extra)
        for stage_name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if stage_name != "bpe_tokens":
                assert out.columns == docs.columns
                out.write.parquet(str(tmp_path / f"{name}-{stage_name}"))
                docs = spark.read.parquet(str(tmp_path / f"{name}-{stage_name}"))
                assert docs.count() > 0 or not data
                assert all((r.kept, r.spans, r.root, r.size, r.node, r.pieces) == more for r in docs.collect())
                # Rows that repeat are one document from the second stage on; others that say almost the same are gone.
                assert stage_name == "quality_rules" or not data or {(r.doc_id, r.lang) for r in docs.collect()} == {(1, "en")}
            else:
                assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"] and (out.count() > 0) == bool(data)
        (tmp_path / name).mkdir()
        spark.createDataFrame(data, extra).write.parquet(str(tmp_path / name / "documents.parquet"))
        assert (corpus_pipeline.run(spark, str(tmp_path / name)).count() > 0) == bool(data)


def test_passages_are_gone_after_the_stage(spark):
    """No 51 words in a row are left that stood in two documents of the small table, and other documents are left alone."""
    from collections import Counter

    docs = corpus_pipeline.apply_quality_rules(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "")
    before = {r.doc_id: words(r.text) for r in docs.collect()}
    after = {r.doc_id: words(r.text) for r in corpus_pipeline.remove_repeated_passages(spark, docs, "").collect()}
    windows = lambda w: [tuple(w[i : i + 51]) for i in range(len(w) - 50)]
    twice = {k for k, n in Counter(x for w in before.values() for x in windows(w)).items() if n > 1}
    assert twice and not any(x in twice for w in after.values() for x in windows(w))
    raw = {r.doc_id: r.text.encode() for r in docs.collect()}
    long = Counter(b[i : i + 400] for b in raw.values() for i in range(len(b) - 399))
    for i, w in before.items():
        if not any(x in twice for x in windows(w)) and not any(long[raw[i][k : k + 400]] > 1 for k in range(len(raw[i]) - 399)):
            assert after[i] == w
