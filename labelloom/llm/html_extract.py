"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A tolerant parser makes a tree of block elements; inline markup only lends its text. Each node is described by its
tag, the tokens of its class, id and role and those above it, its own text, the density of text, links and nodes of
its subtree, its depth, place and siblings. Boosted trees give the odds that a node belongs to the article. Decoding
is exact on the tree: a rejected node takes its whole subtree with it, an accepted text needs every ancestor open, and
of all such choices the one with the best sum of log odds wins, so no ancestor contradicts a descendant.

The trees are learnt from pages of known structure: the texts of at most `most` pages (a documented bound) laid out
anew in many ways, with menus, notices, adverts, forms, comments and so on around an article. No page is labelled, so
these layouts, with the names in GOOD and BAD that sites commonly give their parts, are the only supervision.

Nulls and blanks: a null or empty html has an empty text; a null page_id or url stays null. Unclosed tags and quotes,
stray ends, comments, scripts and bare text are handled as browsers do; nothing is cut but what isn't shown (scripts,
forms' choices, drawings, media), and of that, if its end tag is missing, only what comes before its parent's end or
the next block. Very long pages are read whole, in linear time. A node whose odds tie stays with its parent. Repeated
rows each come back. An empty table gives an empty result. Further columns stay out of the result, so their names
can't clash.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator
from html import escape, unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import hash_sample, in_small_batches

# Elements of HTML by kind.
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset table thead tbody tfoot tr td th blockquote pre figure figcaption address details summary hgroup search dialog menu center".split())
VOID = frozenset("br hr img input meta link area base col embed param source track wbr".split())
RAW = frozenset("script style textarea title".split())
HIDDEN = frozenset("noscript template iframe svg select option button object canvas audio video".split())
NESTED = frozenset("template svg object canvas".split())
ENDS_P = BLOCKS - {"html", "body"} | {"hr"}
INSIDE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "thead", "tbody", "tfoot"}, "td": {"tr"}, "th": {"tr"}}
GROUPS = [frozenset(x.split()) for x in ("p blockquote pre", "h1 h2 h3 h4 h5 h6 hgroup", "li ul ol menu dl dt dd", "div section center", "article main", "nav header footer aside form fieldset address dialog search", "table thead tbody tfoot tr td th", "figure figcaption details summary")]
GOOD = frozenset("article content post entry main story body text prose markdown page blog read".split())
BAD = frozenset("ad ads advert advertisement banner promo sponsor sponsored nav navigation navbar menu breadcrumb breadcrumbs header masthead footer foot sidebar side aside related widget share social comment comments reply replies respond discussion disqus cookie cookies consent notice alert popup modal newsletter subscribe signup login form search pagination pager tags tag copyright legal toolbar skip rail recommended".split())

#: Comments also end with --!>, and <!--> and <!---> are whole ones; </ without a name is one up to the next ">".
#: Quotes delimit a value only behind "="; a tag whose quote is never closed ends at the next ">".
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|</(?:[^a-zA-Z>][^>]*+)?>|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>|([^>]*+)>)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*))", re.I)
UNENDED = re.compile(r"<[a-zA-Z/!?].*", re.S)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


def marks(html: str) -> list[tuple]:
    """Tags and comments of html: (start, end, closing, tag, attributes, matched); the content of RAW belongs to its tag.

    matched: for a start of HIDDEN that has an end tag, the number of tags up to and with it; else 0.
    """
    out: list[list] = []
    starts: dict[str, list[int]] = {}
    at, last = 0, html.rfind(">")
    while at <= last and (m := TOKEN.search(html, at)):
        at, tag, attributes = m.end(), (m[2] or "").lower(), m[3] or m[4] or ""
        out.append([m.start(), at, bool(m[1]), tag, attributes, 0])
        if tag in RAW:
            if tag == "title" and starts.get("svg"):
                out[-1][3] = ""
            elif not m[1] and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                at = out[-1][1] = end.end() if end else len(html)
        elif tag in HIDDEN and m[1]:
            if starts.get(tag):
                out[starts[tag].pop()][5] = len(out)
        elif tag in HIDDEN and not attributes.endswith("/"):
            if tag not in NESTED:
                starts[tag] = []
            starts.setdefault(tag, []).append(len(out) - 1)
    return [tuple(x) for x in out]


class Names(list):
    """A stack of names that knows where each name is, so a step costs no more however deep it is."""

    def __init__(self) -> None:
        super().__init__()
        self.places: dict[str, list[int]] = {}

    def add(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self))
        self.append(name)

    def first(self, name: str) -> int:
        """The place of the lowest one of that name; -1: none."""
        return self.places[name][0] if self.places.get(name) else -1

    def last(self, name: str) -> int:
        return self.places[name][-1] if self.places.get(name) else -1

    def cut(self, k: int) -> None:
        """Without the place k and those above it."""
        while len(self) > k:
            self.places[self.pop()].pop()


class Page:
    """Block elements of html in page order, and its blocks of text as (node, text, characters of links)."""

    def __init__(self, html: str) -> None:
        self.tags, self.up, self.tokens, self.blocks = ["#root"], [-1], [frozenset()], []
        self.html, self._open, self._links = html, [0], 0
        self._names = Names()  # of what is open
        self._names.add("#root")
        self._text: list[str] = []
        self._linked = 0
        tags, at, k = marks(html), 0, 0
        while k < len(tags):
            start, end, closing, tag, attributes, matched = tags[k]
            self._say(html[at:start])
            at, k = end, k + 1
            if tag in RAW:
                self._text.append(" ")
            elif tag in HIDDEN and not closing and not attributes.endswith("/"):
                k = self._hidden(tags, k, tag, matched)
                at = tags[k - 1][1] if k == matched else tags[k][0] if k < len(tags) else len(html)
                self._text.append(" ")
            elif tag and closing:
                self._end(tag)
            elif tag:
                self._start(tag, attributes)
        self._say(UNENDED.sub("", html[at:]))
        self._flush()

    def _hidden(self, tags: list[tuple], k: int, own: str, matched: int) -> int:
        """The first of tags behind an element whose text is left out, tags[k:] being what follows its start.

        It ends with its end tag or its parent's; without an end tag also before the next block, the next of its kind
        and, if it is an option, the next group.
        """
        inside = Names()
        while k < len(tags):
            _, _, closing, tag, attributes, _ = tags[k]
            if k + 1 == matched:
                return matched
            if not tag or tag in RAW or tag in VOID or attributes.endswith("/"):
                pass
            elif closing and inside.last(tag) >= 0:
                inside.cut(inside.last(tag))
            elif closing:
                if self._names.last(tag) >= 0 or not matched:
                    return k
            else:
                if not matched and (tag in BLOCKS or tag == own or (own == "option" and tag == "optgroup")):
                    return k
                inside.add(tag)
            k += 1
        return k

    def _say(self, raw: str) -> None:
        if raw:
            self._text.append(raw)
            if self._links:
                self._linked += len(raw.strip())

    def _flush(self) -> None:
        text = SPACE.sub(" ", unescape("".join(self._text))).strip()
        if text and self.tags[self._open[-1]] != "head":
            self.blocks.append((self._open[-1], text, min(self._linked, len(text))))
        self._text, self._linked = [], 0

    def _close(self, k: int) -> None:
        self._flush()
        del self._open[k:]
        self._names.cut(k)

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "head" or tag in BLOCKS or tag == "hr":
            self._flush()
            names = self._names
            if tag in ENDS_P and names.first("p") >= 0:
                self._close(names.first("p"))
            if tag in INSIDE and (k := names.last(tag)) >= 0 and all(names.last(x) < k for x in INSIDE[tag]):
                self._close(k)
            if tag == "body" and names.first("head") >= 0:
                self._close(names.first("head"))
            if tag != "hr":
                found = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)).lower() if "=" in attributes else ""
                self.tags.append(tag)
                self.up.append(self._open[-1])
                self.tokens.append(frozenset(WORD.findall(found)))
                self._open.append(len(self.tags) - 1)
                names.add(tag)
        elif tag in ("br", "img", "input"):
            self._text.append(" ")
        elif tag == "a":
            self._links = 1

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._links = 0
        elif tag == "br":
            self._text.append(" ")
        elif tag in BLOCKS or tag == "head":
            if (k := self._names.last(tag)) > 0:
                self._close(k)
            else:
                self._flush()


WIDTH = len(GROUPS) + 20


def describe(page: Page) -> np.ndarray:
    """Features of each node of page."""
    n = len(page.tags)
    own, links, marks, words = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    first = np.full(n, np.inf)
    seen = 0
    for k, text, linked in page.blocks:
        own[k] += len(text)
        links[k] += linked
        marks[k] += text.count(".") + text.count(",")
        words[k] += text.count(" ") + 1
        first[k] = min(first[k], seen)
        seen += len(text)
    below, below_links, below_marks, nodes = own.copy(), links.copy(), marks.copy(), np.ones(n)
    children, start = np.zeros(n), first.copy()
    for k in range(n - 1, 0, -1):
        u = page.up[k]
        below[u] += below[k]
        below_links[u] += below_links[k]
        below_marks[u] += below_marks[k]
        nodes[u] += nodes[k]
        children[u] += 1
        start[u] = min(start[u], start[k])
    out = np.zeros((n, WIDTH), np.float32)
    same: dict[tuple[int, str], int] = {}
    for k in range(1, n):
        same[page.up[k], page.tags[k]] = same.get((page.up[k], page.tags[k]), 0) + 1
    depth, good_up, bad_up, bar_up, art_up = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    g = len(GROUPS)
    for k in range(1, n):
        u, tag, tokens = page.up[k], page.tags[k], page.tokens[k]
        good, bad = len(tokens & GOOD), len(tokens & BAD)
        depth[k] = depth[u] + 1
        good_up[k], bad_up[k] = good_up[u] + good, bad_up[u] + bad
        bar_up[k], art_up[k] = bar_up[u] + (tag in GROUPS[5]), art_up[u] + (tag in GROUPS[4])
        for i, group in enumerate(GROUPS):
            if tag in group:
                out[k, i] = 1
        out[k, g : g + 8] = good, bad, good_up[u], bad_up[u], bar_up[u], art_up[u], depth[k], same[u, tag]
    total = max(1.0, below[0])
    up = np.maximum(np.array(page.up), 0)
    out[:, g + 8] = np.log1p(own)
    out[:, g + 9] = links / np.maximum(1, own)
    out[:, g + 10] = marks / np.maximum(1, words)
    out[:, g + 11] = np.log1p(below)
    out[:, g + 12] = below_links / np.maximum(1, below)
    out[:, g + 13] = np.log1p(below / nodes)
    out[:, g + 14] = np.log1p(children)
    out[:, g + 15] = below / np.maximum(1, below[up])
    out[:, g + 16] = np.where(np.isfinite(start), start, total) / total
    out[:, g + 17] = below / total
    out[:, g + 18] = below_links[up] / np.maximum(1, below[up])
    out[:, g + 19] = below_marks / np.maximum(1, nodes)
    return out


class Trees:
    """Gradient-boosted trees for log loss: equal-count bins, depth DEPTH, Newton leaves."""

    DEPTH = 4

    def __init__(self, cuts: list[list[float]] | None = None, trees: list | None = None) -> None:
        self.cuts, self.trees = cuts or [], trees or []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)]).astype(np.int64)

    def learn(self, x: np.ndarray, y: np.ndarray, count: int = 50, rate: float = 0.25) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])).astype(float).tolist() for c in x.T]
        b, f = self.bins(x), np.zeros(len(y))
        for _ in range(count):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, cut, value = [0] * (2 ** (self.DEPTH + 1)), [99] * (2 ** (self.DEPTH + 1)), [0.0] * (2 ** (self.DEPTH + 1))
            at = np.ones(len(y), np.int64)
            for node in range(1, 2 ** (self.DEPTH + 1)):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = float(rate * gs / (hs + 1))
                if node < 2**self.DEPTH and len(rows) > 20:
                    best = (1e-3, 0, 99)
                    for k in range(x.shape[1]):
                        gl = np.cumsum(np.bincount(b[rows, k], g[rows], 33))[:-1]
                        hl = np.cumsum(np.bincount(b[rows, k], h[rows], 33))[:-1]
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        i = int(np.argmax(gain))
                        if gain[i] > best[0]:
                            best = (float(gain[i]), k, i)
                    if best[2] < 99:
                        feature[node], cut[node] = best[1], best[2]
                        at[rows] = 2 * node + (b[rows, best[1]] > best[2])
            self.trees.append((feature, cut, value))
            f += self._one(self.trees[-1], b)
        return self

    def _one(self, tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, cut, value = map(np.asarray, tree)
        at, rows = np.ones(len(b), np.int64), np.arange(len(b))
        for _ in range(self.DEPTH):
            at = np.where(cut[at] < 99, 2 * at + (b[rows, feature[at]] > cut[at]), at)
        return value[at]

    def odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return sum((self._one(t, b) for t in self.trees), np.zeros(len(x)))


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """For each node whether it is open: the tree-consistent choice with the largest sum of log odds."""
    n = len(page.tags)
    own = np.zeros(n)
    for k, text, _ in page.blocks:
        own[k] += len(text)
    s = np.clip(odds, -4, 4) * np.where(own > 0, 1 + np.log1p(own / 40), 0.5)
    for k in range(n):
        if page.tags[k] in ("html", "body", "#root"):
            s[k] = s[k] if own[k] else 0.0
    whole, best = s.copy(), s.copy()
    reject = [False] * n
    for k in range(n - 1, 0, -1):
        reject[k] = -whole[k] > best[k]
        whole[page.up[k]] += whole[k]
        best[page.up[k]] += max(best[k], -whole[k])
    is_open = [True] * n
    for k in range(1, n):
        is_open[k] = is_open[page.up[k]] and not reject[k]
    return is_open


def main_text(page: Page, odds: np.ndarray) -> str:
    is_open = decode(page, odds)
    good = lambda k: is_open[k] and (odds[k] > 0 or page.tags[k] not in ("html", "body", "#root", "div", "section"))
    return "\n\n".join(text for k, text, _ in page.blocks if good(k))


MENU = ["Home", "About", "Contact", "News", "Archive", "Help", "Privacy policy", "Terms", "Sign in", "More"]
PROSE = ["The first account was short, and it left out most of what happened later that year.", "Several people wrote to ask for details, which we give below, in the order of the events."]


def rendered(rng: random.Random, prose: list[str], short: list[str]) -> tuple[str, list[tuple[str, bool]]]:
    """A page in a layout drawn at random, and its blocks of text with whether each belongs to the article.

    Every block begins with a number of its own, by which the parser's blocks are told apart.
    """
    blocks: list[tuple[str, bool]] = []

    def say(text: str, good: bool) -> str:
        text = f"{len(blocks)} {text}"
        blocks.append((SPACE.sub(" ", text).strip(), good))
        return escape(text, quote=False)

    pick = lambda *x: rng.choice(x)
    name = lambda *x: pick(f' class="{pick(*x)}"', f' id="{pick(*x)}"', f' class="{pick("c1", "box", "wrap", "col")} {pick(*x)}"')
    para = lambda good: f"<p>{say(' '.join(rng.sample(prose, min(len(prose), rng.choice((1, 1, 1, 2))))), good)}{pick('</p>', '</p>', '')}"
    menu = lambda: "<ul>" + "".join(f'<li><a href="/x">{say(rng.choice(short), False)}</a></li>' for _ in range(rng.randint(2, 9))) + "</ul>"
    few = lambda: say(" ".join(rng.choice(prose).split()[: rng.randint(3, 18)]), False)

    def bar(tag: str, *names: str, inside) -> str:
        if rng.random() < 0.55:
            return f"<{tag}{name(*names) if rng.random() < 0.4 else ''}>{inside()}</{tag}>"
        return f"<div{name(*names)}>{inside()}</div>"

    nav = lambda: bar("nav", "nav", "menu", "navbar", "site-nav", inside=menu)
    head = lambda: bar("header", "header", "masthead", "site-header", inside=lambda: pick(f"<h2>{few()}</h2>", f"<p>{few()}</p>", few()) + pick("", menu()))
    ad = lambda: f"<{(t := pick('div', 'div', 'aside', 'section'))}{name('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner')}>{pick(few, lambda: para(False))()}</{t}>"
    notice = lambda: f"<div{name('cookie', 'cookie-notice', 'notice', 'consent', 'alert', 'popup')}>{pick(few, lambda: f'<p>{few()}</p>')()}</div>"
    side = lambda: bar("aside", "sidebar", "related", "widget", "side", "recommended", inside=lambda: pick(menu, lambda: f"<h3>{few()}</h3>" + menu(), lambda: para(False) + para(False))())
    form = lambda: f"<form{pick('', name('newsletter', 'subscribe', 'search', 'login'))}><p>{few()}</p><label>{few()}</label><input></form>"
    comments = lambda: f"<{(t := pick('section', 'div', 'div', 'ol'))}{name('comments', 'comment-list', 'replies', 'discussion', 'respond')}>" + "".join(pick(f'<div class="comment">{para(False)}</div>', para(False), f"<li>{para(False)}</li>") for _ in range(rng.randint(1, 6))) + f"</{t}>"
    foot = lambda: bar("footer", "footer", "site-footer", "copyright", "legal", inside=lambda: pick(few, lambda: f"<p>{few()}</p>", lambda: para(False), menu)())

    def article() -> str:
        parts = [f"<h1>{say(rng.choice(short + prose), True)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            kind = rng.random()
            if kind < 0.72:
                parts.append(para(True))
            elif kind < 0.8:
                parts.append(f"<h2>{say(rng.choice(short), True)}</h2>{para(True)}")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{say(rng.choice(prose + short), True)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{pick(para(True), say(rng.choice(prose), True))}</blockquote>")
            elif kind < 0.93:
                parts.append(f"<table><tr><td>{say(rng.choice(short), True)}</td><td>{say(rng.choice(short), True)}</td></tr></table>")
            elif kind < 0.97:
                parts.append(pick(ad, form, side)())
            else:
                parts.append(f"<div>{say(rng.choice(prose), True)}</div>")
        inside = "".join(parts)
        how = rng.random()
        if how < 0.45:
            return f"<article{pick('', name('post', 'entry', 'story'))}>{inside}{comments() if rng.random() < 0.15 else ''}</article>"
        if how < 0.6:
            return f"<main{pick('', name('content', 'main'))}>{inside}</main>"
        if how < 0.9:
            return f"<{(t := pick('div', 'section'))}{name('content', 'post', 'entry-content', 'article-body', 'main', 'text', 'story')}>{inside}</{t}>"
        return f"<div{pick('', ' class=\"c2\"')}>{inside}</div>"

    some = lambda chance, f: f() if rng.random() < chance else ""
    body = some(0.3, notice) + some(0.4, head) + some(0.75, nav) + some(0.5, ad) + some(0.2, form) + some(0.2, side)
    body += pick(lambda: article(), lambda: f'<div class="wrap">{article()}{some(0.3, side)}</div>')() if rng.random() < 0.97 else ""
    body += some(0.3, comments) + some(0.25, ad) + some(0.3, side) + some(0.2, form) + some(0.2, notice) + some(0.8, foot)
    return f"<html><head><title>x</title></head><body>{body}</body></html>", blocks


def _learn(layouts: int, texts: int = 2_000, menus: int = 500, longest: int = 1_500):
    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        prose, short = list(PROSE), list(MENU)
        for html in pdf.sort_values("page_id")["html"]:
            for k, text, linked in (page := Page(html)).blocks:
                if page.tags[k] in ("p", "td", "div") and len(text) > 80:
                    prose.append(text[:longest])
                elif len(text) <= 80 and linked:
                    short.append(text)
        rng, xs, ys = random.Random(13), [], []
        prose, short = rng.sample(prose, min(len(prose), texts)), rng.sample(short, min(len(short), menus))
        for _ in range(layouts):
            html, said = rendered(rng, prose, short)
            known = dict(said)
            page = Page(html)
            x = describe(page)
            good, all_ = np.zeros(len(page.tags)), np.zeros(len(page.tags))
            for k, text, _ in page.blocks:
                good[k] += known.get(text, False)
                all_[k] += 1
            own = all_ > 0
            for k in range(len(page.tags) - 1, 0, -1):
                good[page.up[k]] += good[k]
                all_[page.up[k]] += all_[k]
            clear = (all_ > 0) & ((good == 0) | (good == all_))
            clear[0] = False
            rows = np.flatnonzero(clear & (own | (rng.random() < 0.7)))
            xs.append(x[rows])
            ys.append((good > 0)[rows])
        model = Trees().learn(np.concatenate(xs), np.concatenate(ys).astype(float))
        return pd.DataFrame({"model": [json.dumps([model.cuts, model.trees])]})

    return learn


def train(pages: DataFrame, most: int = 200, layouts: int = 900, page_chars: int = 200_000, texts: int = 2_000, menus: int = 500, text_chars: int = 1_500) -> Trees:
    """Trees learnt from `layouts` layouts of the texts of at most `most` pages, chosen by hash of page_id and html.

    The sample's bounds: pages of fewer than page_chars characters, texts and menus of them at most, and of each text
    the first text_chars characters. They bound what one task learns from, not what is extracted.
    """
    learn = _learn(layouts, texts, menus, text_chars)
    rows = pages.select(F.coalesce("page_id", F.lit(0)).alias("page_id"), F.coalesce("html", F.lit("")).alias("html"))
    rows = hash_sample(rows.where(F.length("html") < page_chars), most, 23, "page_id", "html")
    got = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "model string").first()
    cuts, trees = json.loads(got[0]) if got else json.loads(learn(pd.DataFrame({"page_id": [], "html": []}))["model"][0])
    return Trees(cuts, trees)


def extracted(pages: DataFrame, model: Trees | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    model = model or train(pages)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for at in range(0, batch.num_rows, 64):
                parsed = [Page(h.as_py() or "") for h in batch.column(2)[at : at + 64]]
                odds = model.odds(np.concatenate([describe(p) for p in parsed]))
                ends = np.cumsum([len(p.tags) for p in parsed])
                texts += [main_text(p, o) for p, o in zip(parsed, np.split(odds, ends[:-1]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    done = in_small_batches(pages.select("page_id", "url", "html")).mapInArrow(extract, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
