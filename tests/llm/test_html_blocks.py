"""Pages whose text depends on tags that HTML lets authors leave out, and on elements within an article."""

import pytest

from colloquy.llm.html_extract import blocks_of

ARTICLE = "<article><h1>Heading</h1><p>First words.<p>More words.</article>"


def texts(html):
    return [text for _, text, _ in blocks_of(html)]


@pytest.mark.parametrize(
    "start",
    [
        "<html><head><title>T</title><body>",
        "<html><head><meta charset=utf-8><title>T</title><link rel=x><style>p {}</style><script>var p;</script>",
        "<head><noscript><style>p {}</style></noscript><body class=x>",
        "<head><noscript><img src=x></noscript><body>",
        "<head><template><p>Hidden</p></template><title>T</title>",
        "<head><template><p>Hidden</p><body>",
        "<html><head><title>T</title></head><body>",
    ],
)
def test_head_without_end_tag(start):
    assert texts(start + ARTICLE + "</body></html>") == ["Heading", "First words.", "More words."]


def test_text_ends_a_head():
    assert texts("<head><title>T</title>\n Plain <b>text</b>") == ["Plain text"]


def test_head_text_stays_unseen():
    assert texts("<head><title>T</title><script>var p;</script><noscript>n</noscript></head><p>x") == ["x"]


def test_elements_in_an_article_are_read():
    page = "<article><p>Let <math><mi>a</mi><mo>+</mo><mn>1</mn></math> be.</p><noscript><p>Without scripts.</p></noscript><object><p>Fallback.</p></object><button>Press</button></article>"
    assert texts(page) == ["Let a+1 be.", "Without scripts.", "Fallback.", "Press"]
