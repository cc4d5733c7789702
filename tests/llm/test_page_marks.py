"""Class words that wrap the article, name its sections, or mark what is not part of it."""

import time

import pytest

from barcast.llm import html

PROSE = ("A sentence of the article that runs on for a while without any markup. " * 4).strip()
OTHER = ("Some different words of the page which also make up a paragraph of it. " * 4).strip()


def body(inner):
    return f'<html><body><nav><a href="1">a</a></nav>{inner}<footer>the end</footer></body></html>'


@pytest.mark.parametrize("name", ["site has-sidebar", "page-with-comments", "header-fixed form-page", "search", "wrap promo-free"])
@pytest.mark.parametrize("around", ["article", "div", "section"])
def test_wrappers(name, around):
    page = body(f'<div class="{name}"><{around} id="text"><h1>A title</h1><p>{PROSE}</p><p>{OTHER}</p></{around}></div>')
    assert html.extract(page).split("\n") == ["A title", PROSE, OTHER]


@pytest.mark.parametrize("open_tag", ['<div class="search-method"><p>', '<section id="related-work"><p>', '<p class="form">', '<div class="social-history"><p>'])
@pytest.mark.parametrize("around", ["article", "div"])
def test_topics(open_tag, around):
    tag = open_tag[1:].split()[0].rstrip(">")
    page = body(f"<{around}><h1>A title</h1><p>{PROSE}</p>{open_tag}{OTHER}</p></{tag}><p>{PROSE}</p></{around}>")
    assert html.extract(page).split("\n") == ["A title", PROSE, OTHER, PROSE]


SPARSE = '<ul><li><a href="1">One more</a></li><li><a href="2">And another</a></li></ul>'


@pytest.mark.parametrize("name", ["related", "related-posts", "share-bar", "ad", "newsletter-signup", "search-box", "social", "pagination", "cookie-notice"])
@pytest.mark.parametrize("around", ["article", "div"])
def test_sparse_blocks_go(name, around):
    page = body(f'<{around}><h1>A title</h1><p>{PROSE}</p><div class="{name}">{SPARSE}</div><p>{OTHER}</p></{around}>')
    assert html.extract(page).split("\n") == ["A title", PROSE, OTHER]


@pytest.mark.parametrize("name", ["comments", "comment-list", "ad", "sidebar", "cookie-notice", "notice"])
def test_dense_blocks_that_are_never_the_article(name):
    """Comments, adverts and notices go however much running text they hold, also where they hold more than the article."""
    for around in ("article", "div"):
        page = body(f'<div class="site has-sidebar"><{around}><p>{PROSE}</p><p>{PROSE}</p></{around}><div class="{name}">' + f"<p>{OTHER}</p>" * 3 + "</div></div>")
        assert html.extract(page).split("\n") == [PROSE, PROSE]


def test_comments_as_articles():
    page = body(f'<div><article><p>{PROSE}</p></article><article class="comment"><p>{OTHER}</p></article></div>')
    assert html.extract(page) == PROSE


def test_marked_words_in_a_sentence():
    page = body(f'<article><p>{PROSE} <span class="search-term">found</span> in <a class="related-link" href="1">it</a>.</p></article>')
    assert html.extract(page) == PROSE + " found in it."


def test_time_is_linear_in_open_elements():
    for unit in ("<div>", "<div>a b ", "<b>a<p>", '<i class="search-x">a', '<div class="x-form">a '):
        start = time.process_time()
        html.extract(unit * 40_000)
        assert time.process_time() - start < 20
