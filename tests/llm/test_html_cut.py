"""The main text of pages against the pages' own markup, and the cut against all labellings."""

import random
import re
from html import unescape
from itertools import product

import duckdb
import pytest

from lamella.llm import html_cut, queries
from lamella.llm.html_cut import labelled, min_cut

PROSE = "This is a sentence of the article that goes on for quite some words, as prose does. And another one follows it here."


def text(html):
    return " ".join(b[0] for b in labelled(html) if b[4])


def marked(html):
    """What stands in <article>, by patterns."""
    inner = re.search(r"<article>(.*?)(</article>|$)", html or "<article>", re.DOTALL)[1]
    return " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_whole_table(spark, scale):
    where = f"/root/testdata/{scale}"
    want = {(i, u): marked(h) for i, u, h in duckdb.sql(f"select page_id, url, html from '{where}/pages.parquet'").fetchall()}
    got = queries.op13_html_text(spark, where).collect()
    assert {(r.page_id, r.url): r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def cut_cost(surplus, links, kept):
    return sum(max(0, s) if not k else max(0, -s) for s, k in zip(surplus, kept, strict=True)) + sum(w for a, b, w in links if kept[a] != kept[b])


def test_min_cut_is_least():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(0, 9)
        surplus = [rng.randint(-9, 9) for _ in range(n)]
        links = [(i - 1, i, rng.randint(0, 6)) for i in range(1, n)] + [(a, b, rng.randint(1, 4)) for a in range(n) for b in range(a + 2, n) if rng.random() < 0.3]
        every = {k: cut_cost(surplus, links, k) for k in product((False, True), repeat=n)}
        best = min(every.values())
        kept = min_cut(surplus, links)
        assert every[tuple(kept)] == best
        assert sum(kept) == max(sum(k) for k, c in every.items() if c == best)


def test_min_cut_of_a_long_page():
    n = 60_000
    surplus = [(-40 if i % 1000 == 999 else 20 if i % 3 or i % 1000 in (0, 998) else -1) for i in range(n)]
    kept = min_cut(surplus, [(i - 1, i, 3) for i in range(1, n)])
    assert all(k == (i % 1000 != 999) for i, k in enumerate(kept))


@pytest.mark.parametrize("noise", [
    "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News of the day, in full.</a></ul></nav>", f"<header><p>{PROSE}</p></header>", f"<footer>&copy; 2020 {PROSE}</footer>", f"<aside>{PROSE}</aside>", f'<div class="sidebar">{PROSE}</div>',
    f'<div id="cookie-notice" role="alert"><p>{PROSE}</p></div>', f'<div class="ad">{PROSE}</div>', f"<form><label>{PROSE}</label><input value='x'><select><option>one<option>two</select><button>Go</button></form>", "<script>var t='</p><p>no</p>'; if (a<b) x();</script>",
    "<style>p{margin:0}</style>", f'<section id="comments"><h2>Comments</h2><article class="comment"><p>{PROSE}</p></article></section>', f"<noscript>{PROSE}</noscript>", f"<p hidden>{PROSE}</p>", f'<div style="display: none">{PROSE}</div>', f"<!-- {PROSE} -->",
    f'<DIV CLASS=Advertisement><P>{PROSE}</DIV>', "<svg><text>chart</text></svg>", f"<textarea>{PROSE}</textarea>", f"<template>{PROSE}</template>", f'<ul class="related"><li><a href="/x">{PROSE}</a></ul>',
])
def test_noise_goes_and_the_article_stays(noise):
    own = f"<h1>A title</h1><p>{PROSE} <b>bold</b>er &amp; <i>more</i>.<p>Short one.<ul><li>An item<li>Another item</ul><blockquote>Quoted words</blockquote>"
    want = f"A title {PROSE} bolder & more. Short one. An item Another item Quoted words"
    for page in (f"<body>{noise}<article>{own}</article>{noise}</body>", f"<body><article>{own.replace('<p>Short', noise + '<p>Short')}</article></body>", f"<html><body>{noise}<main><div>{own}</div></main>", f"<title>t</title>{noise}<div class=post-content>{own}</div>"):
        assert text(page) == want, page
    assert text(f"<body><div><h1>A title</h1><p>{PROSE}</p><p>{PROSE}</p></div>{noise}</body>") == f"A title {PROSE} {PROSE}"


def test_smoothness_carries_short_blocks():
    """Between paragraphs a short line stays, though by itself it would go; far from them it goes."""
    assert text(f"<div><p>{PROSE}</p><p>Oh</p><p>{PROSE}</p></div>") == f"{PROSE} Oh {PROSE}"
    assert text("<div><div><div><p>Oh</p></div></div></div>") == ""


def test_markup_cases():
    assert labelled(None) == labelled("") == labelled("<p></p><br><div> \n </div>") == []
    a = lambda x: f"<article><p>{PROSE}</p>{x}</article>"
    assert text(a("<p>x &lt; y &#8212; &#x41;&eacute;&nbsp;z &unknown; &am</p>")) == f"{PROSE} x < y — Aé z &unknown; &am"
    assert text(a("one<br>two\n\tthree <span>f</span>our")) == f"{PROSE} one two three four"
    assert text(a("<p>1 < 2 and 3 > 2 <3</p>")) == f"{PROSE} 1 < 2 and 3 > 2 <3"
    assert text(a('<p title="a > b">in</p><p title=\'x\' >out</p>')) == f"{PROSE} in out"
    assert text(f"<article><p>{PROSE}</p><p>cut of") == f"{PROSE} cut of"
    assert text(f"<article><p>{PROSE}</p><p>cut <a hre") == f"{PROSE} cut"
    assert text(f"<article><p>{PROSE}</p><!-- open comment <p>gone") == PROSE
    assert text(f"<article><p>{PROSE}</p><script>gone") == PROSE
    assert text(f"<nav><ul><li><a href=/>x</a><article><p>{PROSE}</p></article>") == PROSE
    assert text(a("<table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl></b></i></td>")) == f"{PROSE} a b c d e"
    assert len(labelled("<div>" * 30_000 + PROSE + "</div>" * 30_000)) == 1
    assert labelled("<a " * 50_000) == []
    assert text(f"<article><p>{PROSE}</p>" + f"<p>{PROSE}</p>" * 5_000 + "</article>") == " ".join([PROSE] * 5_001)


def test_cases(spark):
    page = f"<article><p>{PROSE}</p></article>"
    rows = [(1, "u", page, 5, "t"), (1, "u", page, 5, "t"), (None, None, None, 5, "t"), (2, None, "", 5, "t"), (None, "v", page, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, blocks int, __html string")
    got = html_cut.label_blocks(pages).select("page_id", "url", "__html", html_cut.main_text("blocks").alias("text")).collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(*v)) for v in [(1, "u", "t", PROSE)] * 2 + [(None, None, "t", ""), (2, None, "t", ""), (None, "v", None, PROSE)]) or [tuple(r) for r in got] == [(1, "u", "t", PROSE)] * 2 + [(None, None, "t", ""), (2, None, "t", ""), (None, "v", None, PROSE)]
    assert html_cut.label_blocks(pages.limit(0)).count() == 0
