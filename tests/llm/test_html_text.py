"""Main text of pages: planted articles in many layouts, and densities against their definition."""

from __future__ import annotations

import html as library
import math
import random
import re

import pytest

from lanewise.llm import html_text, queries
from lanewise.llm.html_text import Page, densities, main_text

LONG = "A paragraph of the story with words enough to be taken for prose, and then some more of them &amp; an end."
PLAIN = library.unescape(LONG)
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
FOOT = "<footer>&copy; somebody &middot; all rights reserved, long words of the imprint that nobody reads and nobody needs</footer>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("   ", ""),
        ("no markup &lt;here&gt;\n at  all", "no markup <here> at all"),
        (f"<html><body>{NAV}{FOOT}</body></html>", ""),
        (f"<body>{NAV}<div class='ad'>Buy things now, they are very cheap today and tomorrow</div><article><h1>T</h1><p>x</article>{FOOT}", "T\n\nx"),
        (f"<article><h1>T</h1><p><b>{LONG}<br><p>{LONG}</p>", f"T\n\n{PLAIN}\n\n{PLAIN}"),
        (f"<header><h1>Site</h1></header><main><header><h1>T</h1></header><p>{LONG}</p><form>Name <input><p>{LONG}</form></main>", f"T\n\n{PLAIN}"),
        (f"<article><p>{LONG}</p><section id=comments><h2>3 comments</h2><article class='comment'><p>{LONG * 4}</p></article></section></article>", PLAIN),
        (f"<article><p>{LONG}</p><div class='related-posts'><a href=x>{LONG}</a></div><aside>{LONG}</aside></article>", PLAIN),
        (f"<body class='single comments-open has-sidebar'><div id='wrap' class='with-sidebar'><div class=story><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div id='sidebar'><p>{LONG * 3}</p></div></div>", f"T\n\n{PLAIN}\n\n{PLAIN}"),
        (f"<div id=x1>{'<a href=q>Menu entry</a> ' * 9}</div><h1>Title</h1><div id=x2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div id=x3><a href=1>terms</a> <a href=2>about us</a></div>", f"Title\n\n{PLAIN}\n\n{PLAIN}\n\n{PLAIN}"),
        (f"<div class=c><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p></div></div>", "\n\n".join([PLAIN] * 3)),
        ("<article><ul><li>one<li>two <i>three</i></ul><table><tr><td>a<td>b<tr><th>c</table><pre>d\n  e</pre><dl><dt>f<dd>g</dl></article>", "one\n\ntwo three\n\na\n\nb\n\nc\n\nd e\n\nf\n\ng"),
        ("<article>a<!-- <p>no</p> --><script>if (a < b) '</p>'</script>b <style>p{}</style><b>c</b>d&nbsp;&eacute;&#233;&#x1F600;&bogus;&amp</article>", "ab cd éé😀&bogus;&"),
        ("<article><p>a <b>b<p>c</b> d</p>e</article>", "a b\n\nc d\n\ne"),
        ("<article><p title='x>y' data-a=\"<p>\">a</p><p class=b\">c</p><P>D", "a\n\nc\n\nD"),
        ("<article><p>one</p><p>two <a hre", "one\n\ntwo"),
        ("<article><p>1 < 2 and 3 <4 </p><![CDATA[<raw>]]></article>", "1 < 2 and 3 <4\n\n<raw>"),
        ("<p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p>yes</p>", "yes"),
        (f"<form id=aspnet><p>{LONG}</p><input><select><option>a<option>b</select></form>", PLAIN),
        ("<div class=sidebar><p>all there is</p></div>", "all there is"),
        ("<script>never closed <p>x</p>", ""),
        ("x<article>yz\x00</article>", "yz\x00"),
    ],
)
def test_layouts(html, want):
    assert main_text(html) == want


def test_hostile_pages_end():
    assert main_text("<div>" * 30_000 + "deep" + "</div>" * 30_000) == "deep"
    assert main_text("<p" * 50_000) == "" and main_text("</p>" * 50_000 + "x") == "x"
    assert main_text("<a b='" * 20_000) == ""
    assert main_text("<ul>" + "<li>" * 3000 + "<b><p>" * 3000 + "x") == "x"
    long = " ".join(f"word{k}" for k in range(200_000))
    assert main_text(f"<article><p>{long}</p></article>") == long


def test_densities_are_those_of_the_definition():
    rnd = random.Random(5)
    for _ in range(60):
        page = Page("".join(rnd.choice(["<div>", "</div>", "<p>", "<a href=x>", "</a>", "<b>", "</b>", "some text ", "x", "<ul><li>", "</ul>"]) for _ in range(60)))
        size = len(page.tags)
        own = [sum(len("".join(t.split())) for n, _, t in page.texts if n == k) for k in range(size)]
        live = [True]
        for k in range(1, size):
            live.append(live[page.parents[k]] and rnd.random() < 0.9)
        own = [c if alive else 0 for c, alive in zip(own, live, strict=True)]

        def up(k, page=page):
            return [k, *up(page.parents[k])] if k else [0]

        def of(k, size=size, page=page, own=own, live=live):
            below = [j for j in range(size) if live[j] and k in up(j)]
            linked = [j for j in below if any(page.tags[i] == "a" for i in up(j))]
            return sum(own[j] for j in below), max(1, len(below) - 1), sum(own[j] for j in linked), sum(page.tags[j] == "a" for j in below if j != k)

        whole_c, _, whole_lc, _ = of(0)
        want = []
        for k in range(size):
            c, t, lc, lt = of(k)
            if not live[k] or not c:
                want.append(0.0)
                continue
            base = math.log(math.log(c / max(1, c - lc) * lc + whole_lc / max(1, whole_c) * c + math.e))
            want.append(c / t * math.log(c / max(1, lc) * t / max(1, lt)) / max(1, base))
        got, sums, _ = densities(page.tags, page.parents, own, live)
        assert got == pytest.approx(want)
        assert sums == pytest.approx([sum(want[j] for j in range(1, size) if page.parents[j] == k) for k in range(size)])


def test_given_pages(spark):
    """The given pages have one article each, of a heading and paragraphs."""
    directory = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{directory}/pages.parquet").collect()}
    got = queries.op12_html_text(spark, directory).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*)</article>", pages[r["page_id"]]["html"], re.DOTALL)[1]
        blocks = [" ".join(library.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(filter(None, blocks)) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_rows(spark):
    made = spark.createDataFrame([(1, None, "t", 5), (None, "<p>a</p>", None, None), (1, "<p>a</p>", "t", 6), (1, "<p>a</p>", "t", 6)], "page_id long, html string, text string, n_chars int")
    got = sorted(((r["given"]["page_id"], r["given"]["n_chars"], r["text"], r["n_chars"]) for r in html_text.main_texts(made).collect()), key=str)
    assert got == sorted([(1, 5, "", 0), (None, None, "a", 1), (1, 6, "a", 1), (1, 6, "a", 1)], key=str)
    assert html_text.main_texts(made.limit(0)).count() == 0
    assert [r["text"] for r in html_text.main_texts(made.select("html").filter("html is not null").limit(1)).collect()] == ["a"]
