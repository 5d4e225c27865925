"""Template deduction on pages without telling names, broken pages, and how much the template does."""

import time

import pytest

from loomgraph.llm import html_extract as H
from loomgraph.llm.shared import ship


def _pages(spark, rows):
    ship(spark)
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def _site(k: int) -> str:
    side = "".join(f"<p>teaser {k} {j}</p>" for j in range(2))
    story = "".join(f"<p>Paragraph {j} of story {k} goes on for a good many words about things</p>" for j in range(3 + k % 4))
    more = "<div class=x9><p>only some pages have this line</p></div>" if k % 3 else ""
    return f"<html><body><div class=q1><p>Plain Site</p><p>All rights of Plain Site</p></div><div class=q2>{side}</div><div class=q3><h1>Story {k}</h1>{story}{more}</div><div class=q4><p>Write to us</p></div></body></html>"


def _story(k: int) -> str:
    return "\n\n".join([f"Story {k}", *(f"Paragraph {j} of story {k} goes on for a good many words about things" for j in range(3 + k % 4))])


def test_no_article_and_no_telling_names(spark):
    rows = [(k, "http://plain.example/p", _site(k)) for k in range(24)]
    got = {r["key"]: r["text"] for r in H.extract_pages(_pages(spark, rows)).collect()}
    assert got == {k: _story(k) for k in range(24)}
    # By its own tree such a page can't be told apart from what stands around it.
    assert all(H.main_text(page) != got[k] for k, _, page in rows)


@pytest.mark.parametrize("limit", [0, 200_000])
def test_hosts_keep_to_their_own_templates(spark, monkeypatch, limit):
    monkeypatch.setattr(H, "BROADCAST_ROWS", limit)
    rows = [(k, "http://plain.example/p", _site(k)) for k in range(24)]
    rows += [(100 + k, "http://other.example/", f"<div><div class=a><p>own {k} words that are here once and are long enough to be an article</p></div><div class=b><p>Same line on all</p></div></div>") for k in range(10)]
    rows += [(200 + k, f"http://few{k}.example/", f"<p>single page {k}<nav>menu</nav>") for k in range(5)]
    rows += [(300, "http://plain.example/p", "<p>a page of another make</p>"), (301, "http://plain.example/p", None)]
    got = {r["key"]: r["text"] for r in H.extract_pages(_pages(spark, rows)).collect()}
    assert {k: got[k] for k in range(24)} == {k: _story(k) for k in range(24)}
    assert got[103] == "own 3 words that are here once and are long enough to be an article"
    assert got[204] == "single page 4" and got[300] == "a page of another make" and got[301] == ""


def test_copies_of_one_article_on_a_host_keep_it(spark):
    rows = [(k, "http://mirror.example/", "<body><nav>m</nav><article><h1>T</h1><p>one text on all pages</p></article></body>") for k in range(12)]
    assert {r["text"] for r in H.extract_pages(_pages(spark, rows)).collect()} == {"T\n\none text on all pages"}


def test_given_pages_have_templates(spark):
    rows = H._page_rows(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), "page_id", "url", "html")
    ship(spark)
    template = H.templates(rows, H.written(H.classes_of(rows), "classes")).cache()
    big = rows.groupBy("host").count().where(f"count >= {H.MIN_PAGES}").count()
    assert template.where("kept").select("host").distinct().count() == big > 0


def test_classes_out_of_order_or_across_each_other_are_not_valid():
    a, b, c, d = 1, 2, 3, 4
    fit = lambda tokens, classes: dict((x[0], x[1:]) for x in H.fit_page(H.Page(tokens, []), classes, {k: list(classes.values()).count(k) for k in classes.values()}))
    nested = fit([a, c, d, b], {a: 1, b: 1, c: 2, d: 2})
    assert all(nested[k][0] for k in (1, 2)) and nested[2][1] != nested[1][1]
    assert fit([a, c, b, d], {a: 1, b: 1, c: 2, d: 2})[2] == (0, 0)  # across
    assert fit([a, b, b, a], {a: 1, b: 1})[1] == (0, 0)  # two tuples in two orders
    assert fit([a, b], {a: 1, b: 1})[1][0] != fit([b, a], {a: 1, b: 1})[1][0]  # pages that differ in order


def test_scanner():
    assert H.main_text('<article><p title="abc>hello</p>') == "hello"
    assert H.main_text("<div>" * 510 + "<nav>menu</nav><p>text") == "text"
    assert H.main_text("a < b &amp; c <3<!-- x --><![CDATA[y]]><p>z<script>if (a</p>) </SCRIPT >w") == "a < b & c <3\n\nz w"
    assert H.main_text('<p data-x="a>b">one</p><P>two</P><p>three<li>four<li>five') == "one\n\ntwo\n\nthree\n\nfour\n\nfive"
    assert H.main_text("<p>cut off in <b") == "cut off in"
    for page in ("<script " * 131_072, "<script>" * 131_072, '<p title="' * 100_000, "</div>" * 170_000, "<div>" * 60_000 + "</p>" * 60_000, "<!--" * 250_000, "<" * 300_000, "<p a=\"'>" * 100_000):
        began = time.time()
        H.main_text(page)
        assert time.time() - began < 5
