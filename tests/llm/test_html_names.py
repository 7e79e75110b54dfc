"""Names in the wild: what they say is evidence, and never empties an article."""

import pytest

from spanloom.llm import html_extract as m

TWO = ["The first paragraph has a few words, and then some more of them.", "The second one is as long as that, and it ends here as well."]
BODY = "".join(f"<p>{t}</p>" for t in TWO)
MENU = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>'
FOOT = "<footer><p>All rights are with the makers of this page, and nobody else.</p></footer>"


@pytest.mark.parametrize(
    "attrs",
    [
        'class="post overflow-hidden"', 'class="post has-sidebar"', 'class="post comments-open"', 'id="related-work"', 'class="no-ads"', 'class="promo"', 'class="widget post"', 'class="notice legal"',
        'class="hidden-xs"', "class=share", 'title="a hidden gem"', 'data-hidden-id="3"', 'data-state="hidden"', 'hidden="false"', 'aria-hidden="false"', 'style="color: red"', 'class="newsletter"',
    ],
)
def test_an_article_is_not_left_out_by_its_own_attributes(attrs):
    assert m.main_blocks(f"<body>{MENU}<article {attrs}>{BODY}</article>{FOOT}</body>") == TWO
    assert m.main_blocks(f"<body>{MENU}<main {attrs}>{BODY}</main>{FOOT}</body>") == TWO


@pytest.mark.parametrize("attrs", ['class="text legal"', 'class="notice"', 'class="has-ads"', 'id="related-work"', 'title="a hidden gem"', 'data-hidden-id="3"', 'class="follow"', 'class="search-results-for"'])
def test_parts_of_an_article_with_plain_names_stay(attrs):
    assert m.main_blocks(f"<body>{MENU}<article><h1>Head of it</h1><div {attrs}>{BODY}</div></article>{FOOT}</body>") == ["Head of it", *TWO]
    assert m.main_blocks(f"<body>{MENU}<article><p {attrs}>{TWO[0]}</p><p>{TWO[1]}</p></article>{FOOT}</body>") == TWO


@pytest.mark.parametrize("attrs", ['class="ad"', 'class="cookie-notice"', 'id="sidebar"', 'class="comments"', 'class="share social"', 'class="related-posts"', 'class="siteFooter"', "hidden", 'style="display: none"', 'aria-hidden="true"', 'role="navigation"'])
def test_parts_that_are_no_article_go(attrs):
    part = f"<div {attrs}><p>Words of another kind are in this part, and they are many.</p></div>"
    assert m.main_blocks(f"<body>{MENU}<article><h1>Head of it</h1>{BODY}{part}</article>{part}{FOOT}</body>") == ["Head of it", *TWO]


def test_inline_names_do_not_tear_a_sentence():
    page = '<article><p>Please <span class="follow">follow</span> the <a class="menu" href="x">menu</a> to <span class="share">share</span> it, my <b class="comment">dear</b> reader.</p>' + BODY + "</article>"
    assert m.main_blocks(page) == ["Please follow the menu to share it, my dear reader.", *TWO]


def test_an_advert_inside_a_paragraph_goes_and_the_paragraph_stays_one():
    page = f'<article><p>{TWO[0]} <span class="ad">Buy <span>this</span> now</span> {TWO[1]}</p><p>x<span hidden>y</span> <b>z</b> and a few more words, which end here.</p></article>'
    assert m.main_blocks(page) == [" ".join(TWO), "x z and a few more words, which end here."]


def test_comments_as_articles():
    comment = '<article class="comment"><p>I have read this, and I like it very much, thank you for it.</p></article>'
    assert m.main_blocks(f"<body>{MENU}<article>{BODY}</article>{comment * 3}{FOOT}</body>") == TWO
    assert m.main_blocks(f"<body>{MENU}<article>{BODY}</article><section id=comments><article><p>I like it very much, thank you for it.</p></article></section></body>") == TWO


def test_formulas_are_text():
    assert m.main_blocks(f"<article>{BODY}<p>So <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> is the answer.</p></article>")[-1] == "So x = 2 is the answer."
