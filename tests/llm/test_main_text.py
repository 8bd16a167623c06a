"""Article text that unanchored patterns used to drop, and links inside of an article."""

import time

import pytest

from trailmark.llm import text_blocks

LONG = ("word " * 40).strip()
LINKS = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(6))

PAGES = [
    ('<article><p>See the <a href="/hidden-gems">hidden gems</a> here.</p></article>', "See the hidden gems here."),
    ('<article><p title="the hidden valley">Valley.</p><p data-hidden="false">Open.</p></article>', "Valley. Open."),
    ("<article><p>See <a href=/hidden-gems>gems</a>.</p><p hidden>No.</p><p HIDDEN=''>No.</p></article>", "See gems."),
    ('<article><p data-style="display:none" data-class="nav">Shown.</p><p style="display : none">No.</p></article>', "Shown."),
    *(
        (f'<article><p>First.</p><div class="{name}"><p>{LONG}</p></div></article>', f"First. {LONG}")
        for name in ("table-responsive", "protocol", "stock-data", "research", "shareholders", "unrelated", "barcode", "navy", "illegal")
    ),
    *(
        (f'<article><p>First.</p><div class="{name}"><p>{LONG}</p></div></article>', "First.")
        for name in ("site-nav", "shareBar", "box comments", "comment_list", "sign-up", "related-posts", "searchBox", "cookie-notice")
    ),
    (f'<body class="has-sidebar"><p>{LONG}</p><p>{LONG}</p></body>', f"{LONG} {LONG}"),
    (f'<body class="sidebar"><div class="with-sidebar no-toc"><p>{LONG}</p></div></body>', LONG),
    (f'<div class="domain-list"><p>Names.</p></div><p>{LONG}</p><p>{LONG}</p>', f"{LONG} {LONG}"),
    (f'<article class="unrelated-matters"><p>{LONG}</p></article>', LONG),
    (f"<article><p>{LONG}</p><ul>{LINKS}</ul><p>{LONG}</p></article>", f"{LONG} {LONG}"),
    # names that may be a topic: words and links decide inside of an article
    (f"<article><p>A.</p><section id='discussion'><p>{LONG}</p></section></article>", f"A. {LONG}"),
    (f"<article><p>A.</p><h2 id='tools'>Our tools</h2><h2 id='related-work'>Related work</h2><p>{LONG}</p></article>", f"A. Our tools Related work {LONG}"),
    (f"<article><p>A.</p><pre class='response'>ok 1</pre><div class='legal text'>{LONG}</div></article>", f"A. ok 1 {LONG}"),
    (f"<article><p>{LONG}</p><section id='related'><h2>Related</h2><ul>{LINKS}</ul></section></article>", LONG),
    (f"<article><p>{LONG}</p><section id='comments'><p>{LONG}</p></section><div class='comment-text'>{LONG}</div></article>", LONG),
    (f"<article><p>A.</p></article><section id='discussion'><p>{LONG}</p></section>", "A."),
    # the only article of a page is its own; teasers of others are not
    (f"<nav>x</nav><article class='teaser'><p>{LONG}</p></article>", LONG),
    (f"<article class='teaser'><p>{LONG}</p></article>" * 2, ""),
    (f"<article><p>A.</p></article><article class='teaser'><p>{LONG}</p></article>", "A."),
    (f"<article class='comment'><p>{LONG}</p></article>", ""),
    # without an article: title and list go with the paragraph
    (f"<div><a href=/>Home</a></div><h1>The title</h1><p>{LONG}</p><ul><li>one two<li>three<li>four five<li>six</ul>",
     f"The title {LONG} one two three four five six"),
    (f"<h1>Title</h1><h2>Sub title</h2><p>{LONG}</p><ul>{LINKS}</ul>", f"Title Sub title {LONG}"),
    (f"<article><p>{LONG}</p><p><a href=/x>One link</a></p><p>{LONG}</p></article>", f"{LONG} One link {LONG}"),
]


@pytest.mark.parametrize("page,expected", PAGES)
def test_main_text(page, expected):
    assert text_blocks.main_text(page, text_blocks.grow(text_blocks.LABELLED))[0] == expected


@pytest.mark.parametrize("page", [
    "<div>a" * 100_000, "<div>" * 100_000 + "</x>" * 100_000, "<p><b>a" * 100_000, "<b>" * 100_000 + "<p>a</p>" * 100_000,
    "<li><p>" * 50_000 + "<b>" * 50_000 + "<p></p><li></li>" * 50_000, "<a><p>" * 100_000 + "</a>" * 100_000,
])
def test_deep_pages_take_linear_time(page):
    """At a tenth of this depth a walk of all open elements for each tag takes 10 seconds or more."""
    start = time.process_time()
    text_blocks.main_text(page, text_blocks.grow(text_blocks.LABELLED))
    assert time.process_time() - start < 30
