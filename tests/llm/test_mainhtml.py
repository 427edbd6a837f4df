import html as references
import re

import pytest

from pairloom.llm import mainhtml
from pairloom.llm.queries import QUERIES

PROSE = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor, incididunt ut labore."
SF = "/root/testdata/sf0.001"


def article_of(page):
    """The blocks between the article's tags, for pages whose articles hold only headings, paragraphs, bold text and breaks."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    texts = [" ".join(references.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n".join(t for t in texts if t)


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<div></div><p>", ""), (PROSE, PROSE),
    (f"<p>{PROSE}<p>Short<p>{PROSE}", f"{PROSE}\nShort\n{PROSE}"),
    ("<article><p>&lt;b&gt; &amp;amp; &nbsp;&eacute;&#8364;&#x41; a<br>b</p></article>", "<b> &amp; é€A a b"),
    (f"<ARTICLE><P CLASS=x>{PROSE}</P></ARTICLE><FOOTER>f</FOOTER>", PROSE),
    ("<article><p>one <!-- <p>no</p> --> two</p><p>a < b</p></article>", "one two\na < b"),
    (f"<article><p>a <a href=\"x>link</a> more</p><p>{PROSE}</p><p>half a senten", f"a link more\n{PROSE}\nhalf a senten"),
    (f"<article><p>{PROSE}</p></article><script>if (a<b) write(\"<p>zz</p>\")", PROSE),
    ("<article><p>x <script>var a='<p>'</script>y <button>Share</button>z</p></article>", "x y z"),
])
def test_markup(page, text):
    assert mainhtml.main_text(page or "") == text


@pytest.mark.parametrize("page, text", [
    (f"<body><div class=top><a href=/>Home</a></div><div id=c><h2>Title</h2><p>{PROSE}</p><p>Short.</p><ul><li>one<li>two</ul></div>"
     "<div class=col><ul><li><a href=1>Link a</a><li><a href=2>Link b</a></ul></div><div>Copyright 2020</div>", f"Title\n{PROSE}\nShort.\none\ntwo"),
    (f"<header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>{PROSE}</p><aside>side</aside><form><label>Mail</label></form>"
     f"<section id=comments><h3>Comments</h3><p>{PROSE * 5}</p></section></article></main><div class=cookie-notice>{PROSE * 8}</div>", f"T\n{PROSE}"),
    (f"<div class='wrap no-sidebar'><div class=post-content><p>{PROSE}</p><p>Hi</p></div></div><div class=sidebar><p>{PROSE * 3}</p></div>", f"{PROSE}\nHi"),
    (f"<form id=all><div><p>{PROSE}</p><p>ok</p></div></form>", f"{PROSE}\nok"),
    (f"<main><article><h2>One</h2><p>{PROSE}</p></article><article><h2>Two</h2><p>b</p></article></main><nav>n</nav>", f"One\n{PROSE}\nTwo\nb"),
    (f"<main><h1>Title</h1><article><p>{PROSE}</p></article></main>", f"Title\n{PROSE}"),
    (f"<table><tr><td><a href=1>m1</a><br><a href=2>m2</a><td><p>{PROSE}</p><p>second</p></table>", f"{PROSE}\nsecond"),
])
def test_articles_are_told_from_the_rest(page, text):
    assert mainhtml.main_text(page) == text


@pytest.mark.parametrize("page", [
    "<div>" * 20_000 + "x" + "</span>" * 20_000 + "</section>" * 20_000, '<a href="x>y</a>' * 20_000, "<" * 100_000, "<title>" * 20_000,
    "<p>" + "<b>x" * 50_000, "<ul>" + "<li>x" * 20_000, "<!--" * 20_000])
def test_broken_pages_take_time_in_proportion(page):
    import time
    began = time.process_time()
    mainhtml.main_text(page)
    assert time.process_time() - began < 10


def test_tables(spark, table):
    pages = table([(1, f"<article><p>{PROSE}</p></article>", "x", 5), (1, f"<article><p>{PROSE}</p></article>", "x", 5), (None, None, None, None)],
                  "page_id long, html string, Text string, other int")
    got = mainhtml.extract(pages)
    assert got.columns == ["page_id", "other", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 5, PROSE, len(PROSE))] * 2 + [(None, None, "", 0)]
    assert mainhtml.extract(pages.limit(0)).count() == 0


def test_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op11_tag_path_text"](spark, SF).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        text = article_of(pages[r["page_id"]]["html"])
        assert r["text"] == text and r["n_chars"] == len(text) and r["url"] == pages[r["page_id"]]["url"]
