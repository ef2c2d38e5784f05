"""Main text of pages written by hand, in other layouts than the training pages; odd and long pages."""

import time

from weirlight.llm import html_extract

PAGES = {
    "news": (
        """<!doctype html><html><head><title>Harbour bridge reopens - Daily Gazette</title><link rel=stylesheet href=/a.css><script>window.dataLayer=[];function gtag(){dataLayer.push("<p>no</p>")}</script></head><body class="article-page">
<div id="cookie-banner" class="cookie-consent"><p>We use cookies to improve your experience. <a href="/privacy">Read our policy</a>.</p><button>Accept all</button></div>
<header class="masthead"><a href="/"><img src=l.png alt="Daily Gazette"></a><nav class="main-navigation"><ul><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/culture">Culture</a></li></ul></nav></header>
<div class="wrapper"><div class="story-body"><h1>Harbour bridge reopens after two years of repairs</h1>
<p>The harbour bridge opened to traffic again on Monday, after engineers had replaced more than four hundred bolts and both main bearings.</p>
<p>"We are glad that commuters can use it again," said the city's chief engineer. Buses will follow in <em>early</em> June, and cyclists a week&nbsp;later.</p>
<div class="ad-slot advertisement">Advertisement: save 20 % on car insurance today!</div>
<h2>What was repaired</h2><ul><li>All bolts of the western span, which had rusted through.</li><li>The drainage along the foot path.</li></ul>
<p>Costs rose to 38 million &ndash; twice the first estimate.</p></div>
<div class="share-buttons"><a href="#">Share</a> <a href="#">Tweet</a> <a href="#">Mail</a></div>
<aside class="related"><h3>Related stories</h3><ul><li><a href="/1">Tunnel closed for the weekend</a></li><li><a href="/2">Ferry fares to rise</a></li></ul></aside>
<section id="comments" class="comments"><h3>3 comments</h3><div class="comment"><b>anna</b><p>Finally! I have waited for this for such a long time, really.</p></div><div class="comment"><b>bob</b><p>And who pays for it? We do, as always.</p></div></section></div>
<footer class="site-footer"><p>&copy; 2024 Daily Gazette. All rights reserved. <a href="/imprint">Imprint</a></p></footer></body></html>""",
        ["Harbour bridge reopens after two years of repairs", "The harbour bridge opened to traffic again on Monday, after engineers had replaced more than four hundred bolts and both main bearings.", '"We are glad that commuters can use it again," said the city\'s chief engineer. Buses will follow in early June, and cyclists a week later.', "What was repaired", "All bolts of the western span, which had rusted through.", "The drainage along the foot path.", "Costs rose to 38 million – twice the first estimate."],
    ),
    "blog": (
        """<html><body><div id="page"><div id="header"><h1><a href="/">Notes from the garden</a></h1><p class="tagline">A small blog about vegetables</p></div>
<div id="menu"><a href="/">Home</a> | <a href="/about">About</a> | <a href="/archive">Archive</a></div>
<div id="content"><div class="post hentry"><h2 class="entry-title">Growing leeks in heavy soil</h2><div class="entry-content"><p>Leeks don't mind clay as long as it drains. I dig a trench in autumn, fill it with leaves and leave it alone until spring.</p><p>In April the seedlings go out, one hand apart. Water them in, and don't press the soil down; the rain will do that.</p><p>Harvest starts in October.</p></div></div></div>
<div id="sidebar" class="widget-area"><div class="widget"><h3>Recent posts</h3><ul><li><a href=/a>Compost in winter</a><li><a href=/b>Which beans to choose</a></ul></div><div class="widget"><h3>Search</h3><form><input type=text name=s><input type=submit></form></div></div>
<div id="footer">Powered by Press. Theme by someone.</div></div></body></html>""",
        ["Growing leeks in heavy soil", "Leeks don't mind clay as long as it drains. I dig a trench in autumn, fill it with leaves and leave it alone until spring.", "In April the seedlings go out, one hand apart. Water them in, and don't press the soil down; the rain will do that.", "Harvest starts in October."],
    ),
    "manual": (
        """<!DOCTYPE html><html><head><title>Timers</title></head><body><nav class="navbar"><a href="/">Docs</a><a href="/api">API</a><a href="/faq">FAQ</a></nav><aside class="toc sidebar"><ul><li><a href="#a">Start</a></li><li><a href="#b">Stop</a></li><li><a href="#c">Errors</a></li></ul></aside>
<main role="main"><h1>Timers</h1><p>A timer calls a function once after a delay. The delay is given in milliseconds and must not be negative.</p><h2 id="a">Starting a timer</h2><p>Call <code>start(f, n)</code>, where <var>n</var> is the delay &amp; <var>f</var> the function to be called.</p><table><tr><td>delay below zero</td><td>raises an error</td></tr></table><p>The relation <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds.</p></main>
<footer><a href="/edit">Edit this page</a> <a href="/licence">Licence</a></footer></body></html>""",
        ["Timers", "A timer calls a function once after a delay. The delay is given in milliseconds and must not be negative.", "Starting a timer", "Call start(f, n), where n is the delay & f the function to be called.", "delay below zero", "raises an error", "The relation E=m holds."],
    ),
}


def test_pages_by_hand():
    model = html_extract.trained()
    hits = found = given = 0
    for name, (page, blocks) in PAGES.items():
        text = html_extract.extracted([page], model)[0]
        own = text.split("\n\n") if text else []
        print(name, "missing", [b for b in blocks if b not in own], "too many", [b for b in own if b not in blocks])
        hits, found, given = hits + len([b for b in own if b in blocks]), found + len(own), given + len(blocks)
        assert [b for b in own if b in blocks] == [b for b in blocks if b in own]  # in page order
    assert hits / found >= 0.9 and hits / given >= 0.9


def test_parsing_is_linear():
    n = 1 << 19
    for unit in ("<a ", '<a "', "<a b='\">", '<a b=">"', "<!", "<!--", "<button>", "<script>", "<", "&#1", "<p", "<div", "= "):
        for page in (unit * (n // len(unit)), "<" + unit * (n // len(unit)) + ">", "<article><p>word</p>" + unit * (n // len(unit))):
            t = time.time()
            html_extract.Page(page)
            assert time.time() - t < 6, unit
    for page in ("<" + "a" * n, "<div>" * (n // 10) + "</p>" * (n // 8), "<li><div>" + "<blockquote>" * (n // 24) + "<tr></tr>" * (n // 18)):
        t = time.time()
        html_extract.Page(page)
        assert time.time() - t < 6


def test_tags_of_malformed_pages():
    text = lambda h: " ".join(t for t in html_extract.Page(h).text if t)
    assert text("a < b and <p>c<") == "a < b and c<"
    assert text('<p title="x > y">in</p>') == "in"
    assert text('<p title="x > in</p>') == "in"
    assert text("<p title=it's>in</p>") == "in"
    assert text("<p class=x <b>in</b>") == "in"
    assert text("x <b") == "x <b"
    assert text("<p>a<!-- <p>no --> b<script>if (a</b>) '</p>'</script> c") == "a b c"


def test_odd_pages(spark):
    body = "<article><h1>A title of some words</h1>" + "<p>A long page has many sentences, and each of them counts.</p>" * 20_000 + "</article>"
    rows = [(1, "u", body, "clash", 5), (2, None, None, None, 1), (None, "v", "", "x", 2), (3, "w", "<p" * 50_000, "x", 2), (3, "w", "<p" * 50_000, "x", 2)]
    own = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract(own)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = got.collect()
    assert len(out) == 5 and all(r["n_chars"] == len(r["text"]) for r in out)
    one = next(r for r in out if r["page_id"] == 1)
    assert one["text"].count("each of them counts.") == 20_000
    assert html_extract.extract(own.limit(0)).count() == 0
