"""Operator 2 on pages made by hand."""
from routelens.llm.op2_html import extract, main_blocks, smoothed, threshold

import numpy as np

LONG = "This paragraph has enough words in it to be the main text of a page, by far."
PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var a = "</p><p>no";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies on this page, and tell you so in a long line of text.</div>
<div id="sidebar"><p>{LONG} sidebar</p></div><article><header><h1>Title  of
it</h1><p>by line</p></header><p>{LONG}<p>Short.<p>A&nbsp;b &lt;c&gt; &#233;<br>d</p><aside>aside</aside><div class="advert">Buy</div><p style="display: none">unseen</p><p hidden>unseen</p><form><input value="x">Send</form>
<ul><li>one<li>two</ul><blockquote>{LONG}</blockquote><!-- c --><section class="comments"><article class="comment"><p>{LONG} reader</p></article></section></article>
<footer>&copy; {LONG}</footer></body></html>"""


def test_article():
    assert main_blocks(PAGE) == ["Title of it", LONG, "Short.", "A b <c> é d", "one", "two", LONG]


def test_no_article_element():
    page = f"<body><div class=menu><a>x</a><a>y</a></div><div><p>{LONG}</p><p>{LONG}</p><p>ok</p><p>{LONG}</p></div><div><a>l1</a> <a>l2</a></div></body>"
    assert main_blocks(page) == [LONG, LONG, "ok", LONG]


def test_odd_markup():
    assert main_blocks("") == main_blocks("<p></p>") == []
    for page in ("<![if x]><p>a b</p>", "<p>a b", "<b><i>a b</b></i>", "</div></p>a b", "<script>x", "<!--", "<![CDATA[x", "a & b &am &amp c", "<" * 50, "&" * 50, "<p " * 50):
        main_blocks(page)


def test_smoothing_and_threshold():
    assert np.allclose(smoothed(np.full(9, 3.0)), 3.0)
    assert 1 < threshold(np.array([1.0, 1.0, 9.0, 10.0])) <= 9


def test_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<article><p>x y</p></article>"), (4, "u", "<article><p>" + "w " * 200000 + "</p></article>")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, text string, k0 string")
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in extract(pages).collect()}
    assert extract(pages).count() == 6 and extract(pages).columns == ["page_id", "url", "text", "n_chars"]
    assert got[(2, None)] == got[(3, "u")] == ("", 0) and got[(None, "u")] == ("x y", 3)
    assert got[(4, "u")][1] == 399999 and got[(1, "u")][0] == "\n\n".join(main_blocks(PAGE))
    assert extract(pages.limit(0)).count() == 0


def test_story_beside_an_article():
    """An article element is the region only if all content lies there."""
    card = "<article><p>A teaser of another page.</p></article>"
    for story in (f"<div><p>{LONG}</p><p>{LONG}</p></div>", f"<main><p>{LONG}</p><p>{LONG}</p></main>", f"<p>{LONG}</p><p>{LONG}</p>"):
        for page in (f"<body>{story}{card}</body>", f"<body>{card}{story}</body>"):
            assert main_blocks(page).count(LONG) == 2
    lead = f"{LONG} lead"
    assert main_blocks(f"<body><main><p>{lead}</p><article><p>{LONG}</p></article></main></body>") == [lead, LONG]


def test_no_content_is_cut_by_its_share():
    many, few = [f"{LONG} {i}" for i in range(17)], [f"{LONG} last {i}" for i in range(3)]
    block = lambda tag, texts: f"<{tag}>" + "".join(f"<p>{t}</p>" for t in texts) + f"</{tag}>"
    for tag in ("div", "section", "article"):
        assert main_blocks(f"<body><nav><a>x</a></nav>{block(tag, many)}{block(tag, few)}</body>") == many + few
    assert main_blocks(block("div", many) + "".join(f"<p>{t}</p>" for t in few)) == many + few
    assert main_blocks(f"<p>{LONG}</p>") == [LONG]


def test_class_of_a_wrapper():
    """Names of a container that holds the text don't make it boilerplate; those of its parts do."""
    story = [f"{LONG} {i}" for i in range(4)]
    body = "".join(f"<p>{t}</p>" for t in story)
    parts = f'<div class="left-menu"><a>x</a> <a>y</a></div><div class="comments"><p>{LONG} reader</p></div>'
    for names in ('class="page has-sidebar"', 'class="post no-comments"', 'class="layout-with-menu"', 'id="search-result"', 'class="widget"', 'id="searchResult-7"',
                  'class="has-header"', 'class="page-header"'):
        assert main_blocks(f"<body><div {names}>{body}{parts}</div><p>(c) 1</p></body>")[:4] == story, names
        assert main_blocks(f"<body><div {names}>{body}{parts}</div></body>") == story, names
    parts = "".join(f'<section class="search-result n{i}">{body}</section>' for i in range(3))
    assert main_blocks(f"<body>{parts}<p>(c) 1</p></body>")[:12] == story * 3
    assert main_blocks(f'<body><div class="widget">{body}</div><div class="share">{body}</div></body>') == story * 2


REMARK = "This remark goes on about many other things, at a length that no paragraph of the story reaches, since its writer has much time, and more to say. " * 2
STORY = [f"The story's paragraph number {i} tells what happened on that day in some detail." for i in range(3)]


def _page(after="", before="", start="", end=""):
    return f"<html><body>{start}{before}{''.join(f'<p>{p}</p>' for p in STORY)}{after}{end}</body></html>"


def _remarks(n=8):
    return "".join(f"<div><p>{REMARK}{i}</p></div>" for i in range(n))


def test_discussions_longer_than_the_article_are_left_out():
    for name in ('section class="post-comments"', 'div class="comment-list"', 'div class="cookie-banner"', 'div id="commentArea"', 'div class="comments"'):
        tag = name.split()[0]
        assert main_blocks(_page(after=f"<{name}>{_remarks()}</{tag}>")) == STORY, name
    assert main_blocks(_page(after=f'<div class="comment-list">{_remarks()}</div>', start="<article>", end="</article>")) == STORY


def test_wrappers_with_such_names_still_hold_the_text():
    for name in ('class="page has-sidebar"', 'class="post no-comments"', 'class="layout-with-menu"', 'id="search-result"', 'class="comments"', 'id="widget-area"'):
        assert main_blocks(_page(start=f"<div {name}>", end="</div>")) == STORY, name


def test_a_form_round_the_page_and_a_form_in_it():
    assert main_blocks(_page(start='<form method="post"><input type="hidden" name="v">', end="<button>Go</button></form>")) == STORY
    assert main_blocks(_page(after="<form><p>Subscribe to our weekly letter and get all the news that you may want to read.</p><input><button>Go</button></form>")) == STORY


def test_a_title_is_no_text_also_without_a_head():
    assert main_blocks("<title>Site - The story's title that is quite long for a title</title>" + "".join(f"<p>{p}</p>" for p in STORY)) == STORY
