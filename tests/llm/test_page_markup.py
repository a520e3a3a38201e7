"""Page extraction: words in compound classes, raw and unclosed elements, and pages made to be slow."""

import time

import pytest

from helixframe.llm import pages


def kept(html):
    return [text for zone, text in pages.lines(html) if zone]


@pytest.mark.parametrize(
    "html",
    [
        '<article><p class="notice-period">Lead.</p>Body</article>',
        '<article><div class="banner-text">Lead.</div>Body</article>',
        '<article><div id="share-price-table">Lead.</div>Body</article>',
        '<div class="content social-post">Lead.</div><div>Body</div>',
        "<article><p>Lead.</p><script src=/js/>var x=1</script>Body</article>",
        "<article><p>Lead.</p><video src=a.mp4>Body</article>",
        "<article><p>Lead.</p><iframe src=/x/>Body</article>",
        "<article><p>Lead.</p><svg/>Body</article>",
    ],
)
def test_article_text_stays(html):
    assert kept(html) == ["Lead.", "Body"]


def test_formulas_are_text():
    assert kept("<article>Since <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</article>") == ["Since x=1 holds"]


@pytest.mark.parametrize("name", ["share-buttons", "cookie-notice", "newsletter-signup", "related-posts", "comment-list", "ad-slot", "adSlot2", "site-footer", "sidebar_left", "nav-main", "social-media-links", "popup"])
def test_what_is_about_something_else_goes(name):
    assert kept(f'<article><div class="{name}">Away</div>Body</article>') == ["Body"]


def test_raw_elements_and_comments():
    assert kept("<article>A<style>p{}</style><!-- <p>no</p> --><textarea>no</textarea>B<script>no</article>") == ["AB"]
    assert kept("<p>one < two</p><p>tail <b") == ["one < two", "tail"]
    assert kept("<p>a <!-- never closed <p>b") == ["a"]


@pytest.mark.parametrize("part", ["<!", '<a "', "<a '", "<div>", "</span>", "<video>", "<p", "< ", "<!-- ", "<p>x", "&amp", "<div></span>"])
def test_long_pages_take_linear_time(part):
    page = "<article>" + part * (2_000_000 // len(part))
    began = time.process_time()
    pages.lines(page)
    small = time.process_time() - began
    began = time.process_time()
    pages.lines(page + ">" + page)
    assert time.process_time() - began < max(3.5 * small, 1.0) + 2
