"""Main text of hand-made and of broken pages, and against a plain reading of the tables' pages."""
import html
import re

import pytest

from rallygrid.llm import main_text
from rallygrid.llm.common import load

LONG = "A paragraph that is long enough for three lines in a row to make a block of the size that text has."

PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; x</title><style>p {{}}</style></head><body class="has-sidebar"><div id="cookie-banner"><p>We use cookies. {LONG}</p></div>
<header><div class="logo">Site</div><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav></header>
<div class="layout"><div class="content"><h1>My title</h1><p>First&nbsp;paragraph with <a href="x">a link</a>. {LONG}</p><p>Short.</p><blockquote>Quote &lt;me&gt;</blockquote>
<div class="ad-slot">Buy now!</div><form><label>Mail</label><input><p>Sign up now</p></form><p>{LONG} <b>Bo</b>ld<br>end</p><script>var t = "</p>" + 1 < 2;</script>
<div class="share-buttons"><a href=1>Tweet</a></div></div><div class="sidebar"><h3>Related</h3><p>{LONG}</p></div>
<div id="comments"><h2>2 comments</h2><article class="comment"><p>I think so too. {LONG}</p></article></div></div>
<footer><p>Copyright. {LONG}</p></footer></body></html>"""
TEXT = f"My title\nFirst paragraph with a link. {LONG}\nShort.\nQuote <me>\n{LONG} Bold end"


@pytest.mark.parametrize("page, text", [
    (PAGE, TEXT), (PAGE.replace('<div class="content">', "<article>").replace('<div class="share-buttons"><a href=1>Tweet</a></div></div>', "</article>"), TEXT),
    (None, ""), ("", ""), ("<p>", ""), ("only text", "only text"), ("<p>a<br>b</p><script>var x='</p>'", "a b"), ("<p>cut <b", "cut"),
    ("<nav><a>x</a><article><p>in</p></article>", "in"), ("<article><p class='ad'>no<p>yes<aside>no</aside><ul><li>one<li>two <a>l</a></ul></article><p>after", "yes\none\ntwo l"),
    ("<article><header><h1>H</h1><p>By me</p></header><p>x<footer>f</footer><section id=comments><article>c</article></section></article>", "H\nx"),
    ("<article>" + "".join(f"<p>{i}</p><aside>x</aside><aside>y</aside><aside>z</aside>" for i in range(5)) + "</article>", "0\n1\n2\n3\n4"),
    ("<article><table><tr><td>a<td>b<tr><td>&copy &am</table></article>", "a\nb\n© &am"),
    ("<div hidden>" + LONG + "</div><div>" + LONG + "</div>", LONG), (f"<ul>{'<li><a href=1>A link to another page of ours</a>' * 9}</ul><p>{LONG}</p>", LONG)])
def test_pages(page, text):
    assert main_text.main_text(page) == text


def test_short_lines_apart_from_the_text_go_where_no_article_is_marked():
    page = f"<div>tiny</div>{'<div><a>a link</a></div>' * 4}<p>{LONG}</p><p>{LONG}</p>"
    assert main_text.main_text(page) == f"{LONG}\n{LONG}"


def test_time_grows_with_length_only():
    """Marks that are never closed, and end tags that close nothing."""
    for page in ("<p><b><i class='x'>w " * 50000, "<div>" * 50000 + "</p>" * 50000, "<a href=\"" * 50000, "</i>" * 50000 + "<b>" * 50000, "<!--" * 50000):
        main_text.main_text(page)


def test_tables_pages(spark):
    rows = load(spark, "/root/testdata/sf0.001", "pages")
    got = {r.page_id: r for r in main_text.extract(rows).collect()}
    assert len(got) == rows.count()
    for r in rows.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1).replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(p for p in parts if p)
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, want, len(want))


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, "x", 1), (1, "u", "<p>a", "x", 1), (1, "u", "<p>a", "x", 1), (2, None, f"<article>{'<p>w' * 10 ** 5}</article>", None, None)],
                                 "page_id long, url string, html string, text string, n_chars long")
    got = sorted(((r.page_id or 0, r.url, r.n_chars) for r in main_text.extract(rows).collect()), key=repr)
    assert got == [(0, None, 0), (1, "u", 1), (1, "u", 1), (2, None, 2 * 10 ** 5 - 1)]
    assert main_text.extract(rows.limit(0)).count() == 0
