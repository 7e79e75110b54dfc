"""The classifier and the cut on pages whose article is known, with and without telling names."""

import html
import random
import re

import numpy as np
import pandas as pd
import pytest

from spanloom.llm import html_extract as m

SF = "/root/testdata/sf0.01"


def made_page(rng, k):
    """(page, blocks of its article): well-formed pages put together from known parts."""
    word = lambda: "".join(rng.choices("abcdefghiklmnorstu&é<", k=rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n)) + rng.choice([".", "!", ""])
    esc = lambda t: html.escape(t).replace("é", rng.choice(["é", "&eacute;", "&#233;"])).replace(" ", rng.choice([" ", "\n  ", "\t"]), 1)
    want, body = [], []

    def block(tag, n):
        t = text(n)
        want.append(t)
        return f"<{tag}>{esc(t)}</{tag}>"

    body.append(block("h1", rng.randint(2, 9)))
    for _ in range(rng.randint(1, 8)):
        kind = rng.random()
        if kind < 0.6:
            body.append(block("p", rng.randint(5, 60)))
        elif kind < 0.7:
            body.append("<ul>" + "".join(block("li", rng.randint(2, 12)) for _ in range(3)) + "</ul>")
        elif kind < 0.8:
            body.append(f'<div class="{rng.choice(["ad", "promo-box", "share social"])}">{esc(text(rng.randint(3, 20)))}</div>')
        elif kind < 0.9:
            body.append(f"<script>var x = '<p>{word()}</p>';</script><!-- {word()} --><aside>{esc(text(20))}</aside>")
        else:
            body.append(block("blockquote", rng.randint(6, 30)))
    nav = "<nav><ul>" + "".join(f'<li><a href="/{k}">{esc(text(2))}</a></li>' for _ in range(4)) + "</ul></nav>"
    tail = f'<div id="comments"><p>{esc(text(25))}</p></div><footer>{esc(text(12))}</footer>'
    return f"<html><head><title>{esc(text(4))}</title></head><body>{nav}<article>{''.join(body)}</article>{tail}</body></html>", want


def test_made_pages_give_their_article():
    rng = random.Random(12)
    for k in range(300):
        page, want = made_page(rng, k)
        assert m.main_blocks(page) == [" ".join(w.split()) for w in want]


@pytest.fixture(scope="module")
def pages():
    return pd.read_parquet(f"{SF}/pages.parquet").html.dropna().tolist()


def stripped(page):
    return re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer|aside|header|main|section)\b", r"<\1div", page))


def test_pages_without_telling_names(pages):
    """Fitted on half of the pages, labelled on the other half with all names taken away: at most 2 in 1,000 blocks wrong."""
    weights = m.fit(pages[::2])
    blocks = wrong = 0
    for page in pages[1::2]:
        truth = (m.taught(m.blocks_of(page)) == 1).tolist()
        plain = m.blocks_of(stripped(page))
        assert len(plain) == len(truth) and not m.named(plain).any()
        keep = m.minimum_cut(m.scores(plain, weights).tolist(), m.edges_of(plain))
        blocks, wrong = blocks + len(truth), wrong + sum(k != t for k, t in zip(keep, truth))
    assert blocks > 1500 and wrong <= 0.002 * blocks


def test_cut_mends_a_doubtful_classifier(pages):
    """With noise on the scores, the cut changes labels and leaves fewer wrong ones than their signs."""
    rng = np.random.default_rng(3)
    weights, changed, by_sign, by_cut = m.fit(pages[::2]), 0, 0, 0
    for page in pages[1::2]:
        truth = m.taught(m.blocks_of(page)) == 1
        plain = m.blocks_of(stripped(page))
        s = m.scores(plain, weights) + rng.normal(0, 3, len(plain))
        keep = np.array(m.minimum_cut(s.tolist(), m.edges_of(plain)))
        changed, by_sign, by_cut = changed + (keep != (s > 0)).sum(), by_sign + ((s > 0) != truth).sum(), by_cut + (keep != truth).sum()
    assert changed > 100 and by_cut < 0.7 * by_sign


def test_fit_without_weak_labels_is_the_prior():
    assert np.array_equal(m.fit([]), m.PRIOR) and np.array_equal(m.fit(["<p>no article here</p>"]), m.PRIOR)


def test_very_long_pages_and_blocks(spark):
    long = "word and more, " * 200_000
    page = f"<nav><a href=x>x</a></nav><article><p>{long}</p>" + "<p>a short one.</p>" * 20_000 + "</article>"
    got = m.extracted(spark.createDataFrame([(1, page), (2, page)], "page_id bigint, html string")).collect()
    assert {r.text for r in got} == {"\n\n".join([long.strip(), *["a short one."] * 20_000])}
