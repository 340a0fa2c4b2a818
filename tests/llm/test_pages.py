"""Which parts of a page are its text, and how long that takes on deeply nested pages."""

import time

import pytest

from spindrift.llm import pagetext

STORY = "<h1>Title</h1><p>Main text here, and it is long enough.</p>"
PAGES = {
    "comments as articles": (
        f'<article>{STORY}</article><div id="comments" class="comments-area"><ol class="comment-list"><li><article class="comment-body"><p>I disagree, in more words than the page itself has, on and on.</p></article></li></ol></div>',
        "Title\nMain text here, and it is long enough.",
    ),
    "comments in the article": (f'<article>{STORY}<section id="comments"><p>First!</p></section><div class="respond"><p>Reply</p></div></article>', "Title\nMain text here, and it is long enough."),
    "an article that is a comment": (f'<article>{STORY}</article><article id="comment-7" class="comment"><p>Me too.</p></article>', "Title\nMain text here, and it is long enough."),
    "body beside teasers": (f'<div class="story">{STORY}</div><article><h3><a href="x">Other story</a></h3></article><article><a href="y">Another</a></article>', "Title\nMain text here, and it is long enough."),
    "one teaser": (f'<div>{STORY}</div><article><p>Read on: a story.</p></article>', "Title\nMain text here, and it is long enough."),
    "an article of links beside one of text": (f'<article>{STORY}</article><article><a href="x">Other story, with a long title of many words</a></article>', "Title\nMain text here, and it is long enough."),
    "two stories": (f"<article>{STORY}</article><article><p>Second story.</p></article>", "Title\nMain text here, and it is long enough.\nSecond story."),
    "ids that name other things": (
        '<article><h2 id="comments">Comments on the draft</h2><p>One.</p><h2 id="social">Social</h2><section id="navigation"><p>By the stars.</p></section><p class="reply">He replied.</p><ul id="tags"><li>red</li></ul></article>',
        "Comments on the draft\nOne.\nSocial\nBy the stars.\nHe replied.\nred",
    ),
    "adverts in the article": ('<article><p>One.</p><div class="ad">Buy</div><p>Two.</p><div hidden>no</div><div role="alert">no</div></article>', "One.\nTwo."),
    "names outside an article": (f'<div id="cookies">We use</div><div id="header">Site</div><p class="ad">Buy</p>{STORY}', "Title\nMain text here, and it is long enough."),
    "a wrapper with a bad name": (f'<div class="main-header"><div class="sidebar right"><article>{STORY}</article></div></div>', "Title\nMain text here, and it is long enough."),
    "open and unmatched ends": ("<article><p>One <b>two</p></i></x><p>three</b></article></div>", "One two\nthree"),
    "an inline end does not close blocks": ("<article><i><div>One</i> two</div>three</article>", "One two\nthree"),
    "lists close items": ("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table></article>", "a\nb\nc\nd\ne\nf\ng"),
}


@pytest.mark.parametrize("name", PAGES)
def test_text_of(name):
    page, wanted = PAGES[name]
    assert pagetext.extract(f"<html><body>{page}</body></html>", None, frozenset()) == wanted


def test_copies_of_an_article_keep_their_text(spark):
    page = f"<body><div>By someone</div><article>{STORY}</article></body>"
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", page) for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in pagetext.texts(pages).collect()} == {"Title\nMain text here, and it is long enough."}


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x" + "</i>" * 50_000, "<div>" * 50_000 + "</b></section>" * 50_000, "<ul><li>" * 50_000 + "x", '<div class="ad">' * 40_000 + "x", "<b>" * 50_000 + "</i>" * 50_000, "<i>" + "<div>" * 50_000 + "</i>" * 50_000, "<p>" + "<b>" * 50_000 + "<p>" * 50_000, "<ul>" + "<li><div>" * 50_000 + "<li>x"])
def test_deep_pages_take_linear_time(page):
    began = time.process_time()
    pagetext.extract(page, None, frozenset())
    assert time.process_time() - began < 10
