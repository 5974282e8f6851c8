"""Pages as trees, exact marginals, and main texts of pages that were not learned from."""

import itertools

import numpy as np
import pytest

from tests.compare import differences, duckdb_over
from wirelark.llm import html_examples, html_text
from wirelark.llm.html_text import forest, main_texts, marginals, marked, visible
from wirelark.llm.html_tree import parse


def outline(page):
    """Tags and texts, nested."""
    tree = parse(page)

    def of(i):
        if tree.tag[i] == "#text":
            return tree.text[i]
        return (tree.tag[i], *(of(j) for j in range(len(tree.tag)) if tree.parent[j] == i))

    return of(0)[1:]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ()),
        ("a < b & c &lt;p&gt; &eacute;&#x41;&amp", ("a <", " b & c <p> éA&",)),
        ("<p>a<p>b<div>c</div></p>d", (("p", "a"), ("p", "b"), ("div", "c"), "d")),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", (("ul", ("li", "a"), ("li", "b", ("ul", ("li", "c"))), ("li", "d")),)),
        ("<table><tr><td>a<td>b<tr><td>c</table>", (("table", ("tr", ("td", "a"), ("td", "b")), ("tr", ("td", "c"))),)),
        ("<p><b>a<br><p>b</b>c", (("p", ("b", "a")), ("p", "b", "c"))),
        ("<b><div>a</b>b</div>c", (("b", ("div", "a", "b"), "c"),)),
        ('<script>var a="</p>";</script><style>p{}</STYLE >x<!-- <p> --><!-->y<!doctype html>z', (("script",), ("style",), "x", "y", "z")),
        ('<a title="x>y" href=z>t</a></i></p>u', (("a", "t"), "u")),
        ("a<script>b", ("a", ("script",))),
        ("a<!-- b", ("a",)),
        ("a<div class='b", ("a",)),
        ("a</div", ("a",)),
        ("a<", ("a<",)),
    ],
)
def test_trees(page, want):
    assert outline(page) == want


def test_marginals_are_exact():
    """Against summing over all labellings."""
    rng = np.random.default_rng(4)
    trees = forest([parse("<div>a<p>b<i>c</i></p><ul><li>d</ul></div>"), parse("x<p>y"), parse("")])
    potential, pairs = rng.normal(size=len(trees.parent)), rng.normal(size=(html_text.N_KINDS, 2, 2))
    got, edges = marginals(trees, potential, pairs)
    weights, counted, summed = 0.0, np.zeros(len(potential)), np.zeros_like(edges)
    inner = np.flatnonzero(trees.parent >= 0)
    for labels in itertools.product((0, 1), repeat=len(potential)):
        y = np.array(labels)
        met = (trees.kind[inner], y[trees.parent[inner]], y[inner])
        weight = np.exp((potential * y).sum() + pairs[met].sum())
        weights += weight
        counted += weight * y
        np.add.at(summed, met, weight)
    assert np.allclose(got, counted / weights) and np.allclose(edges, summed / weights)


@pytest.fixture(scope="module")
def written():
    return html_text.fitted(None)


def labelled_text(page):
    tree = parse(page)
    main, seen = marked(tree), visible(tree)
    pieces = [(" " if tree.apart[i] else "") + (tree.text[i] if main[i] and seen[i] else " ") for i, t in enumerate(tree.tag) if t == "#text"]
    return " ".join("".join(pieces).split())


def test_pages_of_another_seed(written):
    pages = html_examples.labelled_pages(300, seed=77)
    found = main_texts(pages, written)
    right = [labelled_text(p) == t for p, t in zip(pages, found, strict=True)]
    assert np.mean(right) >= 0.95


PAGE = """<!DOCTYPE html><html><head><title>Title words</title></head><body>
<header class="site-header"><a href="/">Home of it</a><p>Our daily words for everyone.</p></header>
<nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>
<div class="cookie-banner notice"><p>We use cookies to make this page better. By reading on you agree.</p><button>Agree</button></div>
<main><article><h1>Of   bridges &amp; rivers</h1><p>The old bridge was built in the year of the flood, and it still <b>stands</b>.</p>
<div class="ad-slot advert">Buy a bridge today, only here and only now!</div>
<p>Many boats pass below it&hellip; Some of them never return,
though nobody could say why that is so.<br>Others do.</p><ul><li>First the red one.</li><li>Then the blue one.</li></ul></article>
<section id="comments" class="comments"><h2>Comments</h2><div class="comment"><p>I have seen this bridge myself, and it is a very fine one, I must say. We were there twice.</p></div></section></main>
<aside class="sidebar"><h3>More</h3><p>Another text about other things that have nothing to do with it.</p></aside>
<form action="/s"><label>Search</label><input name=q><select><option>x</select></form>
<footer>&copy; 2020 The makers. All rights reserved.</footer><script>track("</p>")</script></body></html>"""
TEXT = (
    "Of bridges & rivers The old bridge was built in the year of the flood, and it still stands. Many boats pass below it… Some of them never return, "
    "though nobody could say why that is so. Others do. First the red one. Then the blue one."
)


def test_a_page_of_its_own_kind(written):
    assert main_texts([PAGE, "", "   ", PAGE], written) == [TEXT, "", "", TEXT]


def test_edge_pages(spark, written):
    deep = "<div>" * 20_000 + "<p>deep</p>" + "</div>" * 20_000
    long = "<body><nav><a href=x>menu</a></nav><article><h1>Long</h1>" + "<p>Some words in a long row, again and again.</p>" * 20_000 + "</article><footer>end</footer>"
    many = "<b>" * 5000 + "<div>x</b>" * 5000 + "<!--" + "<p " * 5000
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, None, ""), (3, "v", " \n "), (4, "w", "<"), (5, "d", deep), (6, "l", long), (7, "m", many), (8, "n", "<nav><a href=x>only a menu</a></nav>")]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "page_id long, url string, html string, text string, n_chars string, node string")
    found = html_text.extracted(df, written).collect()
    assert [(r["page_id"], r["url"]) for r in found] == [r[:2] for r in rows]
    by_id = {r["page_id"]: r["text"] for r in found}
    assert by_id[1] == TEXT and by_id[2] == by_id[None] == by_id[3] == by_id[8] == ""
    assert by_id[6] == "Long" + " Some words in a long row, again and again." * 20_000
    assert html_text.page_texts(df.where("false")).count() == 0
    assert html_text.page_texts(df).columns == ["page_id", "url", "text", "n_chars"]


def test_query_on_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert differences(html_text.page_texts(pages), duckdb_over(sf_dir), html_text.ORACLE) is None
