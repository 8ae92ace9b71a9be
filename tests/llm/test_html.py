"""HTML extraction: the parser, the trees, the decoding, whole pages."""

import itertools
import random
import re
import time
from html import unescape

import numpy as np
import pytest

from labelloom.llm import html_extract as hx


@pytest.mark.parametrize("html,want", [
    ("", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("<p>a <b>b</b>\n c<br>d</p>", ["a b c d"]), ("a &lt;b&gt; &amp;eacute; &eacute;&#233;", ["a <b> &eacute; éé"]),
    ("<script>var t='<p>x</p>';</script>y", ["y"]), ("<style>p{}</style><!-- <p>no</p> -->z", ["z"]), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<div>a<div>b</div>c</div>", ["a", "b", "c"]), ("</p></div>x", ["x"]), ("<head><title>t</title></head><body>b", ["b"]), ("<p>a<", ["a<"]), ("<p>a<p class=", ["a"]), ("<p title='a>b'>c", ["c"]), ("<script>never ends", []),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("1 < 2 and 3 > 2", ["1 < 2 and 3 > 2"]),
])
def test_parser(html, want):
    assert [text for _, text, _ in hx.Page(html).blocks] == want


@pytest.mark.parametrize("html,want", [
    ("<p data-x=it's>Hello</p>", ["Hello"]), ('<p class="x>Hello</p>', ["Hello"]), ("<p class='x>Hello</p><p>b", ["Hello", "b"]), ('<p class="x>Hello</p><p class="y">World</p>', ["World"]),
    ('<p title="a>b" x=\'c>d\'>e', ["e"]), ('<p "a>b">c', ['b">c']), ("<p don't>x</p><p>isn't y", ["x", "isn't y"]), ('<p a = "1>2">x', ["x"]), ('<p a="b', []), ('<p a=">b</p><i>c', ["b", "c"]), ("<a href=x>l</a \">m", ["lm"]),
    ("Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> is", ["Energy E=m is"]), ("<p>a <math>x</p><p>b</p>", ["a x", "b"]),
])
def test_quotes_and_formulas(html, want):
    assert [text for _, text, _ in hx.Page(html).blocks] == want


def test_names_behind_odd_quotes_are_read():
    assert hx.Page("<p data-x=it's class=\"ad box\">a").tokens[1] == {"ad", "box"}
    assert hx.Page("<p class=o'hara>a").tokens[1] == {"o", "hara"}


@pytest.mark.parametrize("part", ["<a x=\"", "<a x='y", "<p a=b'\"", "<", "<a =\"'", "<!-", "<math>", "\"'=<b"])
def test_odd_markup_takes_linear_time(part):
    began = time.time()
    hx.Page(part * 60_000 + ">")
    hx.Page(part * 60_000)
    assert time.time() - began < 20


@pytest.mark.parametrize("html,want", [
    ("<datalist><option value=a><option value=b></datalist><article><p>a</article>", ["a"]), ("<div><button>menu</div><p>a", ["a"]), ("<button>menu<article>a</article><button>x</button><p>b", ["a", "b"]),
    ("<svg><title>logo</svg><p>a", ["a"]), ("<svg><path d=1><p>a", ["a"]), ("<span><video>old</span> a", ["a"]), ("<select><option>x<option>y</select><p>a", ["a"]), ("<svg><svg>x</svg>y</svg>a", ["a"]),
    ("<button><div>x</div></button>a", ["a"]), ("<noscript><p>x</p></noscript>a", ["a"]), ("<div><object>x</div><p>a</p></object>b", ["a", "b"]), ("<textarea><p>x", []), ("<canvas>x</canvas>a<audio src=1>b", ["a"]),
])
def test_what_is_not_shown_ends_with_its_parent_or_the_next_block(html, want):
    assert [text for _, text, _ in hx.Page(html).blocks] == want


def test_decoding_is_the_best_consistent_choice():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(2, 8)
        page = hx.Page("")
        page.tags, page.up, page.tokens = ["#root"] + ["div"] * (n - 1), [-1] + [rng.randrange(k) for k in range(1, n)], [frozenset()] * n
        page.blocks = [(k, "x" * rng.randint(1, 90), 0) for k in range(1, n) if rng.random() < 0.7]
        odds = np.array([rng.uniform(-3, 3) for _ in range(n)])
        own = np.zeros(n)
        for k, text, _ in page.blocks:
            own[k] += len(text)
        s = odds * np.where(own > 0, 1 + np.log1p(own / 40), 0.5)
        s[0] = 0

        def worth(choice, s=s, page=page, n=n):
            return sum(s[k] if choice[k] else -s[k] for k in range(1, n))

        sound = [c for c in itertools.product((True, False), repeat=n) if c[0] and all(c[page.up[k]] or not c[k] for k in range(1, n))]
        assert worth(hx.decode(page, odds)) == pytest.approx(max(map(worth, sound)))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    assert ((hx.Trees().learn(x, y).odds(x) > 0) == y).mean() > 0.95


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!---->", "<!-- a --!>", "<!-- a -->", "<!-- > -- >-->", "<!---!>-->", "</ div>", "</>", "</3>", "<!x>", "<?php ?>", "<!-- <p>no</p> --!>"])
def test_comments_end_where_browsers_end_them(comment):
    page = hx.Page(f"<div><p>one</p>{comment}<p>two</p>{comment}three</div>")
    assert [t for _, t, _ in page.blocks] == ["one", "two", "three"]
    assert [t for _, t, _ in hx.Page(f"a{comment}b").blocks] == ["ab"]


@pytest.mark.parametrize("parts", [("<div>", ""), ("<ul><li>", ""), ("<table><tr><td>", ""), ("<p>", "</div>"), ("<div>", "</section>"), ("<div>", "</div>"), ("<section><p>x", "</b>"), ("<dl><dd>", "<hr>"), ("<select>", "</nav>"), ("<div><template>", "</template>"), ("<template><b>", "</i>"), ("<div><noscript>", "</p>"), ("<blockquote><svg><g>", "</g>")])
def test_depth_costs_nothing(parts):
    import time

    opens, closes = parts
    html = opens * 100_000 + "deep" + closes * 100_000
    began = time.process_time()
    page = hx.Page(html)
    assert time.process_time() - began < 5 and len(page.tags) <= 300_001


def plain_article(html):
    inside = re.search(r"<article>(.*?)(</article>|$)", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1|h2|li|ul|div)\b[^>]*>", inside)
    parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in parts]
    return "\n\n".join(p for p in parts if p)


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = hx.extracted(pages).collect()
    right = sum(r["text"] == plain_article(html[r["page_id"]]) for r in rows)
    assert len(rows) == len(html) and right >= 0.97 * len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_layouts_not_learnt_from():
    import json

    import pandas as pd

    model = hx.Trees(*json.loads(hx._learn(600)(pd.DataFrame({"page_id": [], "html": []}))["model"][0]))
    rng, found, said, right = random.Random(77), 0, 0, 0
    prose = [f"Sentence {k} about the matter, which is long enough to be one, and ends here. It has another." for k in range(60)]
    for _ in range(150):
        html, blocks = hx.rendered(rng, prose, hx.MENU)
        page = hx.Page(html)
        got = set(hx.main_text(page, model.odds(hx.describe(page))).split("\n\n")) - {""}
        want = {b for b, is_good in blocks if is_good}
        found, said, right = found + len(got), said + len(want), right + len(got & want)
    assert right / found > 0.9 and right / said > 0.9


def test_odd_pages(spark):
    rows = [(1, "u", None, "x", 5), (None, None, "", "x", 5), (2, "u", "<p>" * 3000 + "deep", "x", 5), (2, "u", "<div>" * 3000 + "deep", "x", 5), (3, "u", "word " * 100_000, "x", 5), (3, "u", "a", "x", 5), (3, "u", "a", "x", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = hx.extracted(pages).collect()
    assert len(got) == len(rows) and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (1, None)] == ["", ""]
    assert hx.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
