import itertools
import random

from spanloom.llm import html_extract as m

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="home">
<header><a href="/">Site</a><p>Our slogan is long enough to be a sentence, is it not.</p></header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
<div id="cookie-notice"><p>We use cookies to make this page better for you, dear reader.</p></div>
<article><header><h1>A &amp; B</h1></header><p>First  para <b>bold</b><br>line&nbsp;two.<p>Second &lt;tag&gt; &#233;.
<div class="ad">Buy this now, it is very good indeed.</div><p>Ok.</p><aside>Side note text here that is long enough.</aside><ul><li>item one<li>item two</ul>
<form><label>Name</label><input name=n><button>Go</button></form></article>
<section class="comments"><article class="comment"><p>I like this article very much, thank you for it.</p></article></section>
<footer>&copy; Site</footer></body></html>"""


def test_article_without_the_rest():
    assert m.main_blocks(PAGE) == ["A & B", "First para bold line two.", "Second <tag> é.", "Ok.", "item one", "item two"]


def test_pages_without_article_elements():
    words = "This is a sentence with quite a few words, as articles have them, and it goes on for a while."
    page = f"<body><div class=menu><a href=a>A</a> <a href=b>B</a></div><div><h1>Head line</h1><p>{words}</p><p>{words}</p><p>Short one.</p></div><div><a href=c>More</a></div>"
    assert m.main_blocks(page) == ["Head line", words, words, "Short one."]


def test_broken_pages():
    assert m.main_blocks(None) == m.main_blocks("") == m.main_blocks("<p") == m.main_blocks("<!-- x") == m.main_blocks("<script>x") == []
    assert m.main_blocks("<nav><li><a href='/'>x</a><article><p>Text of the article here.") == ["Text of the article here."]
    assert m.main_blocks("<article><p>Cut off &am") == ["Cut off &am"]
    assert m.main_blocks('<article><p title="a > b">x y</p><p title="open>z w</p></article>') == ["x y", "z w"]
    assert len(m.main_blocks("<article>" + "<p>some words here</p>" * 5000)) == 5000
    assert m.main_blocks("<div>" * 3000 + "<article><p>deep text</p>") == ["deep text"]


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 8)
        scores = [rng.randint(-6, 6) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 4)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(keep):
            return sum(s for s, k in zip(scores, keep) if s > 0 and not k) - sum(s for s, k in zip(scores, keep) if s < 0 and k) + sum(w for a, b, w in edges if keep[a] != keep[b])

        assert cost(m.minimum_cut(scores, edges)) == min(cost(k) for k in itertools.product([False, True], repeat=n))


def test_frame(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "y")]
    got = m.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert [r.n_chars for r in got] == [len("\n\n".join(m.main_blocks(PAGE)))] * 2 + [0, 0] and got[2].text == "" and got[0].blocks[0] == "A & B"
    assert m.extracted(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
