"""Operator 13: blocks of odd HTML, the chain beside brute force, and pages that no layout made."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import html_text
from cellweave.llm.html_blocks import blocks
from cellweave.llm.html_layouts import by_article, labelled

SF, HELD = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def chain(spark):
    return html_text.train(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize(("page", "texts"), [
    (None, []), ("", []), ("  \n\t ", []), ("plain  text\n here", ["plain text here"]), ("a < b and c > d", ["a < b and c > d"]),
    ("<p>one<p>two<div>three</div>four", ["one", "two", "three", "four"]), ("<p>a<br>b<br/>c</p>", ["a b c"]), ("<p><b>bold<br><p>next</b> on</p>", ["bold", "next on"]),
    ("<p>x&amp;y &lt;z&gt; &#233;&#x41; &nbsp; &copy;2024 &unknown; &am</p>", ["x&y <z> éA ©2024 &unknown; &am"]),
    ("<script>var t='</p><p>no';</script><p>yes<style>p{}</style></p><!-- <p>no</p> --><p>too", ["yes", "too"]), ("<p>in<!-- c -->side</p><!-- open", ["inside"]),
    ("<title>T &amp; t</title><body>b<noscript><p>no</p></noscript><template><p>no</p></template>", ["b"]), ("<script>never ends <p>no</p>", []),
    ('<p title="a > b" data-x=\'</p>\'>text</p>', ["text"]), ('<p class="open>rest</p><p>more</p>', ["rest", "more"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><th>g</table>", ["a", "b", "c", "d", "e", "f", "g"]),
    ("<DIV>up<P>per</DIV></span></p>tail", ["up", "per", "tail"]), ("<a href=/x>li</a><i>nk</i>ed", ["linked"]), ("<p> wide  space </p>", ["wide space"]),
])
def test_blocks(page, texts):
    assert [b.text for b in blocks(page)[0]] == texts


def test_elements_and_links():
    held, title = blocks('<title>A  b</title><div class="post-body siteHeader" id=x1><p>see <a href=/>the link</a></p></div>')
    assert title == "A b" and held[0].path[0].words == ("post", "body", "site", "header", "x") and held[0].linked == 7


def test_very_long_and_deep_pages(chain):
    assert blocks("<div>" * 3000 + "deep" + "</div>" * 3000)[0][0].text == "deep"
    text = "word " * 200_000
    assert html_text.main_text(f"<article><p>{text}</p></article>", chain) == text.strip()
    assert len(blocks("<p>x" * 20_000)[0]) == 20_000 and blocks('<p a="' * 2_000)[0] is not None


def random_chain(seed):
    g = np.random.default_rng(seed)
    return html_text.Chain({}, g.normal(size=(2, 2)), float(g.normal())), g


def path_score(c, scores, y):
    out = c.start * y[0] + sum(s for s, b in zip(scores, y) if b)
    return out + sum(c.moves[a, b] for a, b in zip(y, y[1:]))


@pytest.mark.parametrize("seed", range(12))
def test_viterbi_finds_the_best_of_all_labelings(seed):
    c, g = random_chain(seed)
    scores = g.normal(size=1 + seed % 8).tolist()
    best = max(itertools.product((0, 1), repeat=len(scores)), key=lambda y: path_score(c, scores, y))
    assert c.decode(scores) == [bool(b) for b in best] and c.decode([]) == []
    assert html_text.Chain({}, np.zeros((2, 2)), 0.0).decode([0.0, 0.0]) == [False, False]  # ties


def test_likelihood_and_gradient_by_sums_over_all_labelings():
    c, g = random_chain(3)
    sizes = np.array([1, 4, 3])
    emit, gold = g.normal(size=(3, 4)), g.integers(0, 2, (3, 4)).astype(float)

    def slow(emit, moves, start):
        out, it = 0.0, html_text.Chain({}, moves, start)
        for k, n in enumerate(sizes):
            every = [path_score(it, emit[k, :n], y) for y in itertools.product((0, 1), repeat=int(n))]
            out += path_score(it, emit[k, :n], [int(x) for x in gold[k, :n]]) - math.log(sum(map(math.exp, every)))
        return out

    value, by_cell, by_move, by_start = html_text.likelihood(emit, gold, sizes, c.moves, c.start)
    assert value == pytest.approx(slow(emit, c.moves, c.start))
    h = 1e-6
    for i, j in ((0, 0), (1, 3), (2, 1), (2, 3)):
        more = emit.copy()
        more[i, j] += h
        assert by_cell[i, j] == pytest.approx((slow(more, c.moves, c.start) - value) / h, abs=1e-4)
    for i, j in itertools.product((0, 1), repeat=2):
        more = c.moves.copy()
        more[i, j] += h
        assert by_move[i, j] == pytest.approx((slow(emit, more, c.start) - value) / h, abs=1e-4)
    assert by_start == pytest.approx((slow(emit, c.moves, c.start + h) - value) / h, abs=1e-4)


def test_held_out_pages_and_layouts(spark, chain):
    held = [r.html for r in spark.read.parquet(f"{HELD}/pages.parquet").where("page_id >= 200").select("html").collect()]
    wrong = total = 0
    for page, title in labelled(held, 3, seed=77):
        if page:
            got = chain.decode(chain.scores(html_text.features([b for b, _ in page], title)))
            wrong += sum(a != b for a, (_, b) in zip(got, page))
            total += len(page)
    assert total > 1000 and wrong < 0.01 * total


PAGES = [
    ("""<html><head><title>Bridge opens - City News</title></head><body><div id="cookie-consent" class="banner-fixed"><p>We and our partners store cookies on your device.</p><button>Accept</button></div>
<header class="site-header"><a href="/">City News</a><form action="/search"><input name="q"><button>Go</button></form></header><nav class="primary"><ul><li><a href="/a">World</a></li><li><a href="/b">Money</a></li></ul></nav>
<main><article class="story"><h1>Bridge opens</h1><p>The new bridge across the river opened on Monday, the city said.</p><div class="ad-container"><span>Advertisement</span></div><h2>Traffic</h2>
<p>Some 4,000 cars &amp; trucks crossed it on the first day.</p><ul><li>Two lanes each way.</li><li>A path for bicycles.</li></ul><blockquote>It took five years, said the mayor.</blockquote></article>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Storm closes the harbour again</a></li></ul></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I crossed it this morning and it is very good, thank you all.</p></div><form><textarea></textarea><button>Post</button></form></section></main>
<footer><p>&copy; 2024 City News. All rights reserved.</p></footer><script>track("<p>x</p>")</script></body></html>""",
     "Bridge opens\nThe new bridge across the river opened on Monday, the city said.\nTraffic\nSome 4,000 cars & trucks crossed it on the first day.\nTwo lanes each way.\nA path for bicycles.\nIt took five years, said the mayor."),
    ("""<body><div class="topbar">Welcome to my blog</div><div class="menu"><a href="/">Home</a> | <a href="/about">About</a></div><div class="content"><h1>On bread</h1><p>I bake bread every week, and I have learned a few things.</p>
<p>Use good flour.</p><p>Wait for the dough.</p></div><div class="sidebar"><h4>Archive</h4><a href="/2020">2020</a><p>I am a baker who lives in a small town by the sea.</p></div>
<div class="comment-list"><div class="comment-body"><p>Thank you, my bread has never been this good.</p></div></div><div class="newsletter-signup"><p>Get new recipes by mail every Friday.</p></div><div class="footer">Powered by a blog engine</div></body>""",
     "On bread\nI bake bread every week, and I have learned a few things.\nUse good flour.\nWait for the dough."),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_pages_of_other_makes(chain, k):
    assert html_text.main_text(PAGES[k][0], chain) == PAGES[k][1]


def test_query_keeps_every_page_and_its_article(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = html_text.op13(spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r.text == "\n".join(b.text for b, y in by_article(pages[r.page_id].html) if y)
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def test_odd_rows_and_clashing_names(spark, chain):
    rows = [(1, None), (2, ""), (None, "<article><p>One whole sentence, as ever.</p></article>"), (3, "<article><p>Same text.</p></article>"), (3, "<article><p>Same text.</p></article>"), (4, "<nav><a href=/>Home</a></nav>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({"row": F.lit("kept"), "text": F.lit("old"), "N_Chars": F.lit(-1), "h": F.lit(2)})
    got = html_text.extract(df, chain)
    assert sorted(got.columns) == sorted(["page_id", "html", "row", "h", "text", "n_chars"])
    got = sorted(((r.page_id or 0, r.text, r.n_chars, r.row) for r in got.collect()))
    assert got == [(0, "One whole sentence, as ever.", 28, "kept"), (1, "", 0, "kept"), (2, "", 0, "kept"), (3, "Same text.", 10, "kept"), (3, "Same text.", 10, "kept"), (4, "", 0, "kept")]
    none = html_text.train(df.limit(0))
    assert html_text.extract(df.limit(0), none).count() == 0 and html_text.main_text(PAGES[0][0], none).startswith("Bridge opens\nThe new bridge")
