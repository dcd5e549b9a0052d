"""Main text of pages: whole template pages, odd markup, and pages without an article."""

from __future__ import annotations

import html
import re

from accessgraph.llm import html_text as ht

PROSE = "This is the story of a town and the people who have been in it for all of their lives, and it is one that they like to tell. "


def test_whole_table_against_the_template(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in ht.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in re.split(r"</?(?:p|h1)>", body)]
        wanted = "\n".join(x for x in lines if x)
        assert got[r.page_id] == (wanted, len(wanted))


def test_parts_around_the_article_go():
    page = f"""<!doctype html><html><head><title>T</title><style>p</style></head><body class="has-sidebar">
      <div id="cookieNotice">We use cookies on this site for all of the things that you do.</div>
      <header><h1>Site</h1><nav><a href=/>Home</a></nav></header><main><article class="comments-open">
      <header><h1 class="header">My <i>title</i></h1></header><div class="entry-header">By A</div><p>{PROSE}<p>As.<ul><li>One<li>Two &amp; three</ul>
      <table><tr><td>a<td>b</table><div class="ad-slot">Buy the best of all</div><aside>Related</aside>
      <blockquote>Quote&nbsp;here &#x1F642;</blockquote><script>if(a<b){{x="</p>"}}</script><form><label>Mail</label><input></form>
      <p hidden>no</p><p style="display: none">no</p>
      <article class="comment odd"><p>{PROSE}</p></article><section id="reader-comments"><p>{PROSE}</p></section></article></main>
      <div id="site-header"><p>{PROSE}</p></div><div class="alert">{PROSE}</div>
      <article class="comment"><p>{PROSE}</p></article><div role="complementary"><p>{PROSE}</p></div><div class="footer">foot</div></body></html>"""
    assert ht.main_text(page).split("\n") == ["My title", "By A", PROSE.strip(), "As.", "One", "Two & three", "a", "b", "Quote here \U0001f642"]


def test_pages_without_article_use_the_block_rules():
    links = "".join(f'<li><a href="/{i}">Link number {i} to some other page of this site and more</a>' for i in range(5))
    page = f"<div>{links}</div><div><h2>Heading</h2><p>{PROSE * 2}</p><p>Short.</p><p>{PROSE * 2}</p></div><ul>{links}</ul>"
    assert ht.main_text(page).split("\n") == ["Heading", (PROSE * 2).strip(), "Short.", (PROSE * 2).strip()]
    assert ht.main_text("<p>Hello <b>world</b>.</p>") == "Hello world ." or ht.main_text("<p>Hello <b>world</b>.</p>") == "Hello world."


def test_odd_markup_and_rows(spark):
    odd = [
        None, "", "plain text", "<", "<p title=it's>Hello</p>", '<a href="x>y', "<!-- open", "<script>never closed", "<div>" * 20_000 + "deep",
        "</p></div>x", "<p>a</p>" * 20_000, "&bogus; &#0; &amp", "\x00<p>nul</p>", "<ARTICLE><P>Caps</ARTICLE>",
    ]
    frame = spark.createDataFrame([(i, None, h, "t", 1) for i, h in enumerate(odd)], "page_id long, url string, html string, text string, n_chars int")
    rows = {r.page_id: r for r in ht.extract(frame.unionByName(frame)).collect()}
    assert ht.extract(frame.unionByName(frame)).count() == 2 * len(odd)
    assert rows[0].text == rows[1].text == "" and rows[2].text == "plain text" and rows[4].text == "Hello"
    assert rows[8].text == "deep" and rows[10].text.count("\n") == 19_999 and rows[13].text == "Caps"
    assert all(r.n_chars == len(r.text) for r in rows.values())
    assert ht.extract(frame.limit(0)).count() == 0


def test_undecided_blocks_follow_the_nearest_decided_one():
    blocks = [ht.Block(text=t) for t in (PROSE * 2, "near the good one", "link " * 20, "near the link one", "x")]
    blocks[2].link_chars = 100
    ht.decide(blocks)
    assert [b.kind for b in blocks] == [ht.GOOD, ht.BAD, ht.BAD, ht.BAD, ht.BAD]
    blocks = [ht.Block(text=PROSE * 2), ht.Block(text="a"), ht.Block(text="b"), ht.Block(text="c", link_chars=1)]
    ht.decide(blocks)
    assert [b.kind for b in blocks] == [ht.GOOD, ht.GOOD, ht.BAD, ht.BAD]


def test_wrappers_named_after_other_parts_keep_the_article():
    article = f"<article><h1>Title</h1><p>{PROSE * 2}</p></article>"
    wanted = f"Title\n{(PROSE * 2).strip()}"
    for start, end in (
        ('<div class="content-sidebar-wrap">', "</div>"), ('<div class="layout has-sidebar">', "</div>"),
        ('<div class="elementor-widget-container">', "</div>"), ('<div class="post social-post">', "</div>"),
        ('<form id="aspnetForm" action="/">', "</form>"), ('<div id="modal-page"><main>', "</main></div>"),
        ('<main><div class="related-layout">', "</div></main>"), ('<div class="widget"><div class="social">', "</div></div>"),
    ):
        page = f'<body>{start}{article}<div class="sidebar"><p>{PROSE}</p></div>{end}<div class="footer"><p>{PROSE}</p></div></body>'
        assert ht.main_text(page) == wanted, start
        plain = page.replace("<article>", "<div>").replace("</article>", "</div>")
        assert ht.main_text(plain).endswith((PROSE * 2).strip()), start
    widgets = "".join(f'<div class="elementor-widget"><div class="elementor-widget-container"><p>{PROSE * 2}</p></div></div>' for _ in range(5))
    assert ht.main_text(f"<body>{widgets}</body>").count(PROSE.strip()) == 10


def test_long_parts_around_an_article_still_go():
    article = f"<article><p>{PROSE}</p></article>"
    for part in (
        f'<div id="comments"><p>{PROSE * 9}</p></div>', f'<div class="sidebar"><p>{PROSE * 9}</p></div>',
        f'<section class="related"><article><p>Teaser.</p></article></section>', f'<form><p>{PROSE * 9}</p></form>',
        f'<div style="display:none"><article><p>{PROSE * 9}</p></article></div>', f'<footer><article><p>{PROSE * 9}</p></article></footer>',
    ):
        assert ht.main_text(article + part) == PROSE.strip(), part
    assert ht.main_text(f'<div class="cookie-notice"><p>{PROSE * 9}</p></div>') == ""


DANISH = "Byen ligger ved fjorden, hvor folk gennem mange generationer har levet af fangst, fiskeri og handel langs hele kysten. "
POLISH = "Miasto leży nad zatoką, gdzie ludzie od wielu pokoleń żyją z rybołówstwa, handlu oraz drobnego rzemiosła na wybrzeżu. "
CHINESE = "这座城市位于海湾旁边，许多世代以来，人们依靠捕鱼、贸易和手工业在海岸上生活，并且把故事讲给孩子们听。"


def test_pages_in_other_languages_keep_their_text():
    menu = "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(9))
    for text in (DANISH * 2, POLISH * 2, CHINESE * 2):
        page = f"<body><ul>{menu}</ul><div><h1>Titel</h1><p>{text}</p><p>{text}</p></div><p>© 2020 <a href=/>x</a></p></body>"
        assert ht.main_text(page) == "\n".join(["Titel", text.strip(), text.strip()])
    # A strange block on a page of a known language goes as before.
    junk = "lorem qwzx " * 30
    assert "qwzx" not in ht.main_text(f"<div><p>{PROSE * 3}</p></div><div><p>{junk}</p></div><div><p>{PROSE * 3}</p></div>")


def test_parts_of_an_article_with_telling_names_stay():
    for start, end in (
        ('<section id="discussion">', "</section>"), ('<section id="related-work">', "</section>"), ('<p class="teaser">', "</p>"),
        ('<blockquote class="comment">', "</blockquote>"), ('<div class="login-free">', "</div>"), ('<h1 class="banner-title">', "</h1>"),
        ('<div class="teaser">', "</div>"), ('<section class="announcement">', "</section>"), ('<h2 id="comments">', "</h2>"),
    ):
        page = f"<article><p>{PROSE}</p>{start}{PROSE}{end}<p>{PROSE}</p></article>"
        assert ht.main_text(page) == "\n".join([PROSE.strip()] * 3), start


def test_the_same_names_go_where_links_or_fields_agree():
    links = "".join(f'<li><a href="/{i}">Another story that you may like to read</a></li>' for i in range(3))
    for part in (
        f'<section class="related"><h3>Related</h3><ul>{links}</ul></section>', f'<div class="related-posts"><ul>{links}</ul></div>',
        f'<div class="login"><p>{PROSE}</p><input name="user"></div>', f'<div class="comment"><p>{PROSE}</p></div>',
        f'<div class="reader-comments"><p>{PROSE}</p></div>', f'<div class="ad-slot"><p>{PROSE}</p></div>', f'<form><p>{PROSE}</p><input></form>',
        f'<div class="share-bar"><p>{PROSE}</p></div>', f'<p class="cookie-notice">{PROSE}</p>', f'<h2 hidden>{PROSE}</h2>',
    ):
        page = f"<article><p>{PROSE}</p>{part}<p>{PROSE}</p></article>"
        assert ht.main_text(page) == "\n".join([PROSE.strip()] * 2), part


def test_link_paragraphs_stay_between_good_neighbours():
    linked = '<p><a href="/a">The first of the sources that we have used for this story</a> and <a href="/b">another one of them</a></p>'
    page = f"<article><h1>Title</h1><ul><li><a href='#a'>One part of the page</a></li></ul><p>{PROSE}</p>{linked}<p>{PROSE}</p>{linked}</article>"
    lines = ht.main_text(page).split("\n")
    assert lines == ["Title", PROSE.strip(), "The first of the sources that we have used for this story and another one of them", PROSE.strip()]
