"""Main text of pages against a plain parser, and what names and templates delete."""

import brute
import pytest
from marketlake.llm import html_text

STORY = "<h1>Title</h1><p>the whole &amp; <b>true</b> story</p>"
TEXT = "Title the whole & true story"


def test_given_pages_against_plain(spark, sf):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in html_text.query(spark, sf).collect()}
    assert got == {i: brute.article_text(html) for i, html in source.items()}


@pytest.mark.parametrize(
    "attribute",
    [
        *(f'class="{x}"' for x in (
            "post-comments", "comment-thread", "commentList", "comments comments--open", "disqus_thread", "cookie-banner",
            "cookie-notice", "site-footer", "post__footer", "ad-slot-3", "related-posts", "newsletter-signup-form", "x share-buttons",
        )),
        'id="comments-list"', "id=sidebar-left", 'role="navigation"', "hidden",
    ],
)
def test_names_that_are_no_article_text(attribute):
    other = f"<div {attribute}><article><p>other words, and more of them than the story itself has</p></article></div>"
    for page in (f"<article>{STORY}{other}</article>", f"<article>{STORY}</article>{other}", f"{other}<article>{STORY}</article>"):
        assert html_text.main_text(f"<body>{page}</body>") == TEXT, page


@pytest.mark.parametrize(
    "name", ["post has-comments", "comments-open", "content-sidebar-wrap", "no-sidebar", "search-results", "headline", "address", "shared-flat", "box"]
)
def test_names_that_only_sound_so(name):
    for page in (f'<article><div class="{name}">{STORY}</div></article>', f'<div class="{name}"><article>{STORY}</article></div>'):
        assert html_text.main_text(f"<body>{page}</body>") == TEXT, page


def test_an_article_keeps_its_title_and_is_not_emptied():
    head = '<div class="article-header"><h1>Title</h1></div><p>the whole &amp; <b>true</b> story</p>'
    assert html_text.main_text(f"<article>{head}</article>") == TEXT
    assert html_text.main_text(f'<article><div class="widget">{STORY}</div></article>') == TEXT
    assert html_text.main_text(f'<article><div class="comments">{STORY}</div></article>') == ""
    # what is deleted between two blocks leaves them two
    assert html_text.main_text("<article>a<aside>x</aside>b<script>y</script>c</article>") == "a bc"


def boxed(spark, rows):
    """rows: (page_id, url, own text, box); the text per page."""
    html = [(i, u, f"<article><p>{t}</p><div>{box}</div></article>") for i, u, t, box in rows]
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(html, "page_id long, url string, html string")).collect()}


def test_templates_are_those_of_a_section(spark):
    small = [(i, f"http://h.org/news/{i}", f"story {i}", "our box") for i in range(html_text.LEAST_ARTICLES)]
    others = [(1000 + i, f"http://h.org/shop/{i}", f"item {i}", f"box {i}") for i in range(200)]
    shared = [(2000 + i, f"http://h.org/shop/s{i}", f"thing {i}", "our box") for i in range(html_text.LEAST_ARTICLES - 1)]
    alone = boxed(spark, small)
    assert set(alone.values()) == {f"story {i}" for i in range(html_text.LEAST_ARTICLES)}
    among = boxed(spark, small + others + shared)
    assert {i: among[i] for i in alone} == alone
    # a box on one article fewer than the least, though it is a template elsewhere, and boxes of one page each
    assert among[2000] == "thing 0 our box" and among[1007] == "item 7 box 7"


def test_copies_of_a_page_are_one_article(spark):
    rows = [(i, "http://h.org/a/x", "one story", "its own box") for i in range(30)]
    assert set(boxed(spark, rows).values()) == {"one story its own box"}


def test_very_long_and_deep_pages():
    long = "<article>" + "".join(f"<div><p>{i} word</p></div>" for i in range(20_000)) + "</article>"
    assert html_text.main_text(long) == " ".join(f"{i} word" for i in range(20_000))
    assert len(html_text.subtrees(long)[1]) == 20_000
    assert html_text.main_text("<article>" + "<div>" * 20_000 + "deep") == "deep"
