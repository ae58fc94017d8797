"""HTML extraction on small pages, and importance against a plain count."""

import collections
import math

from vistagrid.llm import styletree
from vistagrid.llm.styletree import extract

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="menu-open"><nav><ul><li>Home</li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- ad --><header>Site</header><article><header><h1>Title &amp; more</h1></header><p>First   <b>bold</b>
text<br>next<p>Second <a href="x">link</a> &copy; &#233;.</p><div class="ad">Buy</div><ul><li>one<li>two</ul><form>Sign up <input></form>
<section id="comments"><p>nice post</p></section></article><aside>Related</aside><footer>Foot</footer></body></html>"""


def test_extract():
    assert extract(PAGE) == "Title & more\nFirst bold text next\nSecond link © é.\none\ntwo"


def test_odd_pages():
    assert extract("") == "" and extract("<") == "<" and extract("plain  text") == "plain text"
    assert extract("<article><p>cut <b>off &amp") == "cut off &"
    assert extract("<article><p>a</p><p title='x>y'>b</article>tail") == "a\nb"
    assert extract("<div>" * 5000 + "deep") == "deep"
    assert extract("<script>never closed <p>x") == "" and extract("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"


def test_low_importance_branches_go(spark):
    body = "<html><body><div class='x1'>Same on every page</div><div class='x2'><p>Text {0} of page {0}</p></div><div class='x3'>More {0}</div></body></html>"
    rows = [(k, f"http://a.example/{k}", body.format(k), "clash", 1) for k in range(12)] + [(50, "http://b.example/", body.format(1), "c", 1), (51, None, None, "c", 1), (52, "x", "", "c", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, other long")
    got = {r.page_id: r.text for r in styletree.main_text(pages).collect()}
    assert all(got[k] == f"Text {k} of page {k}\nMore {k}" for k in range(12))
    assert got[50] == "Same on every page\nText 1 of page 1\nMore 1" and got[51] == "" and got[52] == ""
    assert styletree.main_text(pages.limit(0)).count() == 0


def test_join_instead_of_broadcast(spark, monkeypatch):
    body = "<html><body><div class='x1'>Same</div><div class='x2'>Text {0}</div></body></html>"
    pages = spark.createDataFrame([(k, f"http://a.example/{k}", body.format(k)) for k in range(12)], "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in styletree.main_text(pages).collect()}
    monkeypatch.setattr(styletree, "BROADCAST_NODES", 0)
    assert {r.page_id: r.text for r in styletree.main_text(pages).collect()} == whole


def test_importance(spark):
    texts = ["a", "a", "b", "c", "a"]
    pages = spark.createDataFrame([(f"http://h/{k}", f"<div class='n'>{t}</div>") for k, t in enumerate(texts)], "url string, html string")
    row = styletree.importance(pages).first()
    want = -sum(n / 5 * math.log(n / 5) for n in collections.Counter(texts).values()) / math.log(5)
    assert row.pages == 5 and abs(row.importance - want) < 1e-9
