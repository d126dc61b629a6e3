"""Main text of pages whose text is known."""

import html
import re

import numpy as np
import pytest

from silolens.llm.line_blocks import between_surge_and_dive, extract, main_text

FIRST = "The first paragraph is long enough for the sums of a window of lines to surge well past the threshold &amp; on."
BODY = f"<h1>Title</h1>\n<p>{FIRST}<p>Short.</p><p>More  <b>bold</b>\n<a href='x'>link</a> text of the article that goes on for a while.<br>After a break"
TEXT = "Title " + FIRST.replace("&amp;", "&") + " Short. More bold link text of the article that goes on for a while. After a break"
MENU = "<ul><li><a href=a>Home page of the site</a><li><a href=b>All of the other pages that there are</a></ul>"


@pytest.mark.parametrize("before, after", [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<div role='main'>", "</div>"), ("<div class='post-content'>", "</div>"), ("<div>", "</div>"), ("", ""),
    ("<article><header>", "</header></article>"), ("<div class='main has-sidebar no-comments'>", "</div>"),
])
@pytest.mark.parametrize("around", [
    "<nav>%s</nav>", "<header>Site name and a slogan long enough to look like a text of its own, really it is</header>", "<aside>%s and a text beside it that is rather long, so that it would surge alone</aside>",
    "<div id='cookie-notice'>We use cookies to give you the best experience on this site of ours, and so on and on.</div>", "<form>Your name and address please, so that we can write to you about all our offers <input></form>",
    "<script>if (a < b) { document.write('<p>no</p>') }</script>", "<style>p > a { color: red }</style>", "<!-- <p>an old paragraph that is long enough to be a text of its own, if it were shown</p> -->", "%s",
    "<div class='ad banner'>Buy this now, it is the best thing that you can buy for money, and it is cheap too</div>",
    "<ol class='commentList'><li>I like this, it is the best thing that I have read all day, thank you for it all.</ol>",
    "<div class='page-header'>Site name and a slogan that is long enough to look like a text of its own, really it is</div>",
    "<section class=comments><p>I like this, it is the best thing that I have read all day, thank you for it all.</p></section>", "<div style='display:none'>Hidden words that nobody sees, however many of them there may be in the page</div>",
    "<footer>&copy; all rights reserved, and other things that nobody reads at the end of a page</footer>", "<template><p>a template of a paragraph that is not shown anywhere on the page as it is</p></template>",
])
def test_article_without_what_stands_around(before, after, around):
    around = around.replace("%s", MENU)
    assert main_text(f"<html><head><title>T</title></head><body>{around}{before}{BODY}{after}{around}</body></html>") == TEXT


def test_reader_comments_inside_an_article():
    page = f"<article>{BODY}<div id='comments'><h2>Comments</h2><p>{FIRST}</p></div></article>"
    assert main_text(page) == TEXT


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain words that are no page at all, but long enough to be a text of their own", "plain words that are no page at all, but long enough to be a text of their own"),
    ("<article>One.</article>", "One."), ("<article><p>a &lt;b&gt; &#233;&nbsp;c &unknown; 1 < 2</article>", "a <b> é c &unknown; 1 < 2"),
    ("<article><p>cut off in the midd", "cut off in the midd"), ("<article></article>", ""), ("<p title='a > b'>x</p>", ""), ("<article><p title='a > b'>x</p><script>var a", "x"),
    ("<div class=ad>never closed<article><p>text</p></article>", "text"),
])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_surge_and_dive():
    keep = between_surge_and_dive(np.array([5, 0, 0, 0, 60, 2, 50, 0, 0, 0, 7]), 90)
    assert keep.tolist() == [False] * 4 + [True] * 3 + [False] * 4
    assert between_surge_and_dive(np.zeros(0, np.int64), 1).tolist() == []


@pytest.mark.parametrize("line", ["a line of verse of 28 letters", "短い行の文", "2 eggs"])
def test_short_lines_are_a_text(line):
    page = f"<body>{MENU}<div>" + f"<p>{line}</p>" * 1000 + "</div></body>"
    assert main_text(page) == " ".join([line] * 1000)
    assert main_text(f"<p>{line}</p>") == line


def test_text_resumes_after_boilerplate():
    links = "<p><a href=x>another page of this site</a></p>" * 3
    tail = "<p>A short end that stands behind three lines of links.</p><p>Finis.</p>"
    page = f"<div><p>{FIRST}</p><p>{FIRST}</p>{links}{tail}</div>"
    assert main_text(page) == " ".join([FIRST.replace("&amp;", "&")] * 2 + ["A short end that stands behind three lines of links. Finis."])
    assert main_text(f"<div><p>Site</p>{links}<p>{FIRST}</p><p>{FIRST}</p></div>") == " ".join([FIRST.replace("&amp;", "&")] * 2)


def test_sums_decide_beside_an_article():
    links = "<p><a href=x>another page of this site</a></p>" * 3
    teasers = "<article><h3>A card</h3><p>Its teaser.</p></article>" * 2
    body = f"<div><p>{FIRST}</p><p>Short.</p></div>"
    text = FIRST.replace("&amp;", "&") + " Short."
    cards = " ".join(["A card Its teaser."] * 2)
    assert main_text(f"<body>{body}{links}{teasers}</body>") == f"{text} {cards}"
    assert main_text(f"<body>{teasers}{links}{body}</body>") == f"{cards} {text}"
    assert main_text(f"<body><p>Site</p>{links}<article>{BODY}</article>{links}<p>Since 1999</p></body>") == TEXT


@pytest.mark.parametrize("part", [
    "<section id='discussion'>%s</section>", "<section id='related-work'>%s</section>", "<h2 id='legal-status'>Legal status</h2>%s", "<div class='notice'>%s</div>", "<h2 id=comments-on-method>Legal status</h2>%s",
    "<h2>References</h2><ul><li><a href=a>The first work that is cited here</a><li><a href=b>The second work that is cited</a></ul>%s",
])
def test_words_of_a_topic_inside_an_article(part):
    inner = part.replace("%s", f"<p>{FIRST}</p>")
    plain = " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())
    assert main_text(f"<article>{BODY}{inner}</article>") == f"{TEXT} {plain}"


@pytest.mark.parametrize("part", [
    "<div class='related'><ul><li><a href=a>Another page of the site</a><li><a href=b>And one more of them</a></ul></div>", "<div class='comment-list'><p>I like this.</p></div>",
    "<aside>Beside it.</aside>", "<div class='ad'>Buy this now.</div>", "<div role=search>Find more.</div>",
])
def test_clear_evidence_inside_an_article(part):
    assert main_text(f"<article>{BODY}{part}</article>") == TEXT


def test_tables(spark):
    page = f"<article>{BODY}</article>"
    rows = [(1, "u", page, 9), (1, "u", page, 9), (None, None, None, 9), (2, None, "", 9), (3, "v", "<article><p>" + "long words " * 50000, 9)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(extract(frame).collect(), key=lambda r: (r.page_id or 0, r.n_chars))
    assert [(r.page_id, r.n_chars) for r in got] == [(None, 0), (1, len(TEXT)), (1, len(TEXT)), (2, 0), (3, 549999)]
    assert extract(frame.where("false")).count() == 0
