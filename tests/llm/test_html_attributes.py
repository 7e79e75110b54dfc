"""Quoted attribute values of any length belong to their tag."""

from spanloom.llm import html_extract as m


def test_long_quoted_values_are_not_text():
    for quote in "\"'":
        for n in (3_900, 4_100, 200_000):
            value = ("<p>Not text of the page, but markup in a value.</p>" * (n // 50 + 1))[:n]
            page = f"<article><p data-x={quote}{value}{quote}>Text of the article.</p><div srcdoc={quote}{value}{quote}></div></article>"
            assert m.main_blocks(page) == ["Text of the article."]


def test_quotes_that_never_close_end_with_their_tag():
    after = "".join(f"<p>Words of paragraph {i}.</p>" for i in range(300))
    assert m.main_blocks(f'<article><p title="open>x y</p>{after}</article>') == ["x y", *(f"Words of paragraph {i}." for i in range(300))]
