import html
import re
import time

import numpy as np

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from medloom.llm import html_text

BODY = "<p>First paragraph with quite a few words in it, so that it counts.</p><p>Second &amp; third&nbsp;words<br>after a break.</p><ul><li>one</li><li>two</li></ul>"
TEXT = "First paragraph with quite a few words in it, so that it counts.\nSecond & third words\nafter a break.\none\ntwo"


@pytest.mark.parametrize("page", [
    f"<html><body><nav><a href='/'>Home</a></nav><article>{BODY}</article><footer>&copy; x</footer></body></html>",
    f"<html><body><div class='menu main'><a>Home</a><a>News</a></div><div id='content'>{BODY}</div><div class='cookie-notice'>We use cookies, more than you think, on all pages.</div></body></html>",
    f"<body><header><h1>Site</h1></header><main>{BODY}<section class='comments'><p>First! A comment that is rather long, longer than others.</p></section></main><aside>About the author of this site.</aside></body>",
    f"<div><form><label>Name</label><input></form><article>{BODY}<script>var a='<p>no</p>';</script><style>p{{}}</style></article></div>",
    f"<body><article>{BODY}",
    f"<body><article><div class=ad>Buy this now, it is cheap and good and much more.</div>{BODY}</article><div role='complementary'>Related stories of the day</div></body>",
])
def test_regions(page):
    assert html_text.extract(page) == TEXT


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<nav>only menus</nav>", "<script>x</script>", "<!-- c -->"])
def test_nothing(page):
    assert html_text.extract(page) == ""


def test_plain_and_broken_markup():
    assert html_text.extract("just text &lt;b&gt;") == "just text <b>"
    assert html_text.extract("<p>a<p>b</b></i><p>c &am") == "a\nb\nc &am"
    assert html_text.extract("<ul><li>a<li>b</ul>") == "a\nb"


def test_no_class_hides_the_article():
    assert html_text.extract(f"<body class='has-sidebar'><div class='content with-sidebar no-ads'>{BODY}</div></body>") == TEXT


def test_smoothing_and_threshold():
    assert np.allclose(html_text.smooth(np.ones(7)), 1)
    assert html_text.smooth(np.array([0, 0, 9.0, 0, 0])).argmax() == 2
    assert 2 < html_text.threshold(np.array([1.0, 1, 1, 9, 9])) < 9


def test_query(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = {r.page_id: r for r in html_text.extract_pages(pages).collect()}
    for p in pages.collect():
        body = p.html.split("<article>")[1].split("</article>")[0]
        text = html.unescape(re.sub(r"<[^>]*>?", "", re.sub(r"</?(?:p|h1|br)>", "\n", body)))
        want = "\n".join(" ".join(x.split()) for x in text.split("\n") if x.strip())
        assert rows[p.page_id].text == want and rows[p.page_id].n_chars == len(want)


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "y"), (None, "u", "<p>t", "z"), (2, "u", "<p>" + "w " * 300_000, "q")], "page_id long, url string, html string, text string")
    got = html_text.extract_pages(pages).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 599_999] and html_text.extract_pages(pages.limit(0)).count() == 0


LONG = " ".join(f"word{i} of the long body" for i in range(60))


@pytest.mark.parametrize("page, want", [
    (f"<div id=content><h1>Title</h1><p>Intro</p><div class=text><p>{LONG}</p></div></div>", f"Title\nIntro\n{LONG}"),
    (f"<p>Before it.</p><pre>{LONG}</pre><p>After it.</p>", f"Before it.\n{LONG}\nAfter it."),
    (f"<div><a href=x>Home</a> <a href=y>News</a></div><div><h2>Title</h2><blockquote>{LONG}</blockquote><p>End.</p></div>", f"Title\n{LONG}\nEnd."),
])
def test_text_beside_the_longest_block_stays(page, want):
    assert html_text.extract(page) == want


@pytest.mark.parametrize("page, want", [
    (f"<article><p>{LONG}</p></article><article><p>A short second part.</p></article>", f"{LONG}\nA short second part."),
    (f"<article><p>A short article.</p></article><div><p>{LONG}</p></div>", f"A short article.\n{LONG}"),
    (f"<main><h1>Title</h1><p>{LONG}</p><article><p>{LONG[:700]}</p></article></main>", f"Title\n{LONG}\n{LONG[:700].strip()}"),
    (f"<main><article><p>{LONG}</p></article><article class=comment><p>I do not agree.</p></article><article><a href=x>Another story to read</a></article></main>", LONG),
])
def test_articles_and_main_stay_whole(page, want):
    assert html_text.extract(page) == want


@pytest.mark.parametrize("start, end", [
    ("<section id='related-work'>", "</section>"), ("<h2 id='search-methods'>", "</h2>"), ("<h2 id='notice-periods'>", "</h2>"), ("<section id='social-impact'>", "</section>"),
    ("<section id='literature-search'>", "</section>"), ("<div class='entry-header'>", "</div>"),
])
def test_topics_are_no_parts(start, end):
    assert html_text.extract(f"<article><p>{LONG}</p>{start}Some words{end}<p>End of it.</p></article>") == f"{LONG}\nSome words\nEnd of it."


@pytest.mark.parametrize("name", ["content-with-sidebar", "page-with-sidebar", "page has-no-sidebar", "main-banner", "page_without_ads"])
def test_no_name_empties_the_page(name):
    assert html_text.extract(f"<div class='{name}'><p>{LONG}</p><div class='left-sidebar'>Aside words.</div></div>") == LONG


@pytest.mark.parametrize("name", ["cookie-notice", "ad", "ad-slot", "related-posts", "comments", "comment-list", "share-buttons", "left-sidebar", "widget-area", "social-links", "search-form", "sidebar"])
def test_parts_still_go(name):
    assert html_text.extract(f"<div><p>{LONG}</p><div class='{name}'>Words of a part.</div></div>") == LONG


def test_comments_longer_than_the_page_go():
    assert html_text.extract(f"<div><p>The page itself is short.</p><div id=comments><p>{LONG}</p></div></div>") == "The page itself is short."


@pytest.mark.parametrize("odd", ["<![foo[ b ]]>", "<![if gte mso 9]>", "<![CDATA[x]]>", "<![endif]-->", "<!>", "<!-", "<!DOCTYPE [<!ELEMENT a>]>", "<!foo <b>", "<?php x ?>", "</>", "<![", "&#xffffffffff;", "<a b='", "\0"])
def test_odd_declarations(odd):
    assert LONG in html_text.extract(f"<body><p>{LONG}</p>{odd}")
    assert isinstance(html_text.extract(odd + f"<p>{LONG}</p>"), str)


@given(st.lists(st.sampled_from(["<!", "<![", "]]>", "<div>", "</div>", "<p>", "<", ">", "-->", "<!--", "&", "#x;", "a b", "</article>", "<article>", "<script>", "'", '"', "=", "<a href=x>", "</a>", "<td>", "<li>"]), max_size=30))
@settings(max_examples=400, deadline=None)
def test_no_markup_fails(parts):
    text = html_text.extract("".join(parts))
    assert text == "\n".join(" ".join(x.split()) for x in text.split("\n")) and len(text) <= len("".join(parts))


PLAIN = f"""<body><div><div><a href=1>Home</a> <a href=2>News</a> <a href=3>Shop</a></div><div>Today is a day.</div></div>
<div><div><h2>The title</h2><p>{LONG}</p><p>Short one.</p><ul><li>one point</li><li>another</li></ul><p>{LONG[::-1]}</p><p>The end.</p></div></div>
<div><div>All rights held by us.</div><div><a href=4>Imprint</a></div></div></body>"""


def test_ratios_choose_the_region(monkeypatch):
    want = f"The title\n{LONG}\nShort one.\none point\nanother\n{LONG[::-1].strip()}\nThe end."
    assert html_text.extract(PLAIN) == want
    monkeypatch.setattr(html_text, "smooth", np.ones_like)
    assert "All rights" in html_text.extract(PLAIN)


@pytest.mark.parametrize("name", ["related-work", "search-methods"])
def test_articles_in_telling_names(name):
    assert html_text.extract(f"<body><div class='{name}'><h1>Title</h1><p>{LONG}</p></div></body>") == f"Title\n{LONG}"
    assert html_text.extract(f"<article><p>{LONG}</p><section class='{name}'><p>More words.</p></section></article>") == f"{LONG}\nMore words."


def test_many_open_elements_take_linear_time():
    assert html_text.extract("<b>" * 60_000 + "<div>" * 2_000 + "</i>" * 60_000 + "text") == "text"


@pytest.mark.parametrize("page, want", [
    (f"<table><tr><td><a href=1>Home</a><br><a href=2>News</a></td><td><p>{LONG}</p><p>More.</p></td><td>About this site.</td></tr></table>", f"{LONG}\nMore."),
    (f"<div><div><h1>Title</h1></div><div><p>{LONG}</p></div><div>Rights held.</div></div>", f"Title\n{LONG}"),
    (f"<main><div><h1>Title</h1><span>By me</span></div><p>{LONG}</p><div>Rights held.</div></main>", f"Title\n{LONG}"),
    (f"<body><div><p>{LONG}</p></div><div>Rights held.</div></body>", LONG),
    (f"<div>{LONG}<br><br>Second part.<br>Third.</div><div><a href=x>Next</a></div>", f"{LONG}\nSecond part.\nThird."),
    (f"<div><p>{LONG}</p><table><tr><th>a</th><td>1</td></tr></table><p>End.</p></div>", f"{LONG}\na\n1\nEnd."),
    (f"<div><p>{LONG}</p><p>See <a href=x>this report</a></p><p>{LONG}</p></div>", f"{LONG}\nSee this report\n{LONG}"),
])
def test_layouts(page, want):
    assert html_text.extract(page) == want


@pytest.mark.parametrize("unit", ["<a ", "<a b='", "</a ", "<!-- ", "<!", "<?", "<a b=\"x>", "<![CDATA[", "&", "<p", "<"])
def test_unfinished_markup_takes_linear_time(unit):
    began = time.perf_counter()
    for n in (20_000, 200_000 // len(unit)):
        html_text.extract("<html><body><article><p>Some words of the article stand here.</p></article>" + unit * n)
    assert time.perf_counter() - began < 4


def test_text_around_unfinished_markup():
    long = "The words of this paragraph are many and they go on for quite a while, as those of articles do."
    assert html_text.extract(f"<article><p>{long}</p><!-- never <p>ended") == long
    assert html_text.extract(f"<article><p>{long}</p><a href='x' class=") == long
    assert html_text.extract(f"<article><p>{long}</p><p>a < b and c</p></article>") == f"{long}\na < b and c"
    assert html_text.extract(f"<article><p>{long} Tom &amp; Jo &am") .startswith(long)
    assert html_text.extract(f"<article><p>{long}</p><p>Let <math><mi>x</mi></math> be a number in the sense of the text above.</p></article>") == f"{long}\nLet x be a number in the sense of the text above."
    assert long in html_text.extract(f'<article><p><a href="open>link</a> {long}</p></article>')
