import html
import math
import re

import pytest

from shelfline.llm import site_style

CASES = [
    (None, ""),
    ("", ""),
    ("plain <b>te</b>xt &amp; more", "plain text & more"),
    ("<p>a<script>if(a<b){'</p>'}</script>b</p><!-- c -->", "ab"),
    ("<div class=sidebar>x</div><p>A\n  B<p>c<ul><li>1<li>2</ul><div id='cookie-notice'>n</div>", "A B\nc\n1\n2"),
    ("<main><h1>T</h1><section class=comments><p>no</p></section><p>x<br>y</p><form>f</form></main><footer>z", "T\nx y"),
    ("<header><h1>Site</h1></header><article><header><h1>T</h1></header>x<aside>q</aside></article>after", "T\nx"),
    ("<article><p>a</p></article></div><p>not</p><article>b</article>", "a\nb"),
    ("<nav><p>m</nav><article>a<table><tr><td>1<td>2<tr><td>3</table></article>", "a\n1\n2\n3"),
    ("<article>" + "<div>" * 300 + "deep" + "<p>x" * 50, "deep" + "\nx" * 50),
]


@pytest.mark.parametrize("page,text", CASES)
def test_main_text(page, text):
    assert site_style.main_text(page) == text


def test_given_pages(llm):
    pages = llm.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for row in site_style.extract_main_text(pages, pages.columns).collect():
        article = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        parts = [re.sub(r"<[^>]*>", "", x) for x in re.split(r"</?(?:p|h1)>", article)]
        blocks = [re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts]
        assert row["text"] == "\n".join(b for b in blocks if b)


def test_branches_that_repeat_over_a_host_are_cut(llm):
    def page(i, extra=""):
        return f"<body><div class=top>Welcome to us</div><div class=body><p>story {i}</p>{extra}</div>"

    rows = [(f"http://a.example/{i}", page(i)) for i in range(20)]
    rows += [("http://few.example/", page(i)) for i in range(5)]
    rows += [("not a url", "<p>x</p>"), ("http://[bad", "<p>y</p>"), (None, None), ("http://a.example/9", page(9))]
    pages = llm.createDataFrame(rows, "url string, html string").selectExpr("*", "'t' AS text", "'h' AS host", "1 AS node")
    found = site_style.extract_main_text(pages, ["url", "host", "text"]).collect()
    assert len(found) == len(rows)
    for row in found:
        if row["url"] and "a.example" in row["url"]:
            assert re.fullmatch(r"story \d+", row["text"])
        elif row["url"] and "few.example" in row["url"]:
            assert row["text"].startswith("Welcome to us\nstory")
    assert sorted(r["text"] for r in found if not (r["url"] or "").endswith(tuple("0123456789/"))) == ["", "x", "y"]
    assert site_style.extract_main_text(pages.limit(0), ["url"]).count() == 0


def test_importance_is_the_entropy_over_different_pages(llm):
    rows = [("http://h/", f"<div class=c>{t}</div>") for t in ["a", "b", "b ", "b  ", "b   "]]
    pages = llm.createDataFrame(rows + rows[:2], "url string, html string")
    (row,) = site_style.node_importance(pages).collect()
    shares = [1 / 5, 4 / 5]
    assert row["pages"] == 5
    assert row["importance"] == pytest.approx(-sum(p * math.log(p, 5) for p in shares))
