"""Labelled pages for the extraction chain.

Pages are made from layouts by a seeded generator: every piece of text is written together with its label, so the
labels are exact. Layouts differ in whether the article is marked by a tag, by a class or not at all, in what stands
around and inside it, in their length, and in how well the markup is closed. Some pages are nothing but an article.
"""

from __future__ import annotations

import random
from functools import lru_cache

_SYLLABLES = "ta re mi lo en sur vel ka dor ist un pha gre sol ne qui ba tor am le".split()


class _Page:
    def __init__(self, r: random.Random):
        self.r, self.html, self.wanted, self.seen = r, [], set(), set()

    def words(self, lo: int, hi: int, stop: str = "") -> str:
        """New text; no two blocks of a page have the same, so that a label belongs to one text."""
        while True:
            ws = ["".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(self.r.randint(lo, hi))]
            for i in range(len(ws) - 1):
                if self.r.random() < 0.12:
                    ws[i] += self.r.choice([",", ",", ".", ";"])
            t = " ".join(ws).capitalize() + stop
            if t not in self.seen:
                self.seen.add(t)
                return t

    def good(self, open_tag: str, text: str, close: str = "") -> None:
        self.wanted.add(text)
        self.html.append(f"{open_tag}{text}{close}")

    def add(self, s: str) -> None:
        self.html.append(s)


def _paragraphs(p: _Page, n: int, closed: bool) -> None:
    r = p.r
    for _ in range(n):
        lo, hi = r.choice([(1, 3), (3, 9), (8, 30), (25, 80)])
        kind = r.random()
        text = p.words(lo, hi, r.choice([".", ".", ".", "", "!"]))
        if kind < 0.72:
            p.good("<p>", text, "</p>" if closed else "")
        elif kind < 0.8:
            p.good("<p><b>", text, "<br>" if not closed else "</b></p>")
        elif kind < 0.86:
            p.good(f"<h{r.randint(2, 3)}>", text, "</h2>")
        elif kind < 0.92:
            p.good("<ul><li>", text, "</li></ul>")
        elif kind < 0.96:
            p.good("<blockquote>", text, "</blockquote>")
        else:
            p.good("<pre>", text, "</pre>")


def _links(p: _Page, n: int) -> str:
    return "".join(f'<li><a href="/x">{p.words(1, 4)}</a></li>' for _ in range(n))


def _before(p: _Page) -> None:
    r = p.r
    if r.random() < 0.8:
        p.add(r.choice(["<nav>", '<div class="nav">', '<div id="menu">', '<ul class="navbar">', '<div role="navigation">']) + f"<ul>{_links(p, r.randint(2, 8))}</ul>" + "</nav></div>")
    if r.random() < 0.4:
        p.add(f"<header>{'<p>' * r.randint(0, 1)}{p.words(1, 8)}</header>")
    if r.random() < 0.5:
        _advert(p)
    if r.random() < 0.25:
        p.add(f"<header><h1>{p.words(1, 5)}</h1>{r.choice(['', f'<p>{p.words(2, 10)}</p>'])}</header>")
    if r.random() < 0.4:
        _notice(p)
    if r.random() < 0.25:
        _form(p)
    if r.random() < 0.2:
        p.add(f'<div class="breadcrumb"><a href="/">{p.words(1, 2)}</a> <a href="/y">{p.words(1, 3)}</a></div>')


def _advert(p: _Page) -> None:
    tag = p.r.choice(["div", "div", "section", "aside", "p"])
    name = p.r.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "ad banner"])
    p.add(f'<!-- x --><{tag} class="{name}">{p.words(2, 20, p.r.choice([".", "", "!"]))}</{tag}>')


def _notice(p: _Page) -> None:
    p.add(f'<div class="{p.r.choice(["cookie-notice", "notice", "alert", "newsletter", "consent", "popup", "subscribe-box"])}"><p>{p.words(4, 25, ".")}</p><button>{p.words(1, 2)}</button></div>')


def _form(p: _Page) -> None:
    p.add(f'<form action="/s"><label>{p.words(1, 3)}</label><input name="q"><p>{p.words(2, 14, ".")}</p><select><option>{p.words(1, 2)}</option></select><button>{p.words(1, 2)}</button></form>')


def _comments(p: _Page) -> None:
    r = p.r
    p.add(r.choice(['<section class="comments">', '<div id="comments">', '<ol class="comment-list">', '<div class="replies">']))
    for _ in range(r.randint(1, 4)):
        p.add(f'<div class="{r.choice(["comment", "comment-body", "reply"])}"><p>{p.words(3, 40, r.choice([".", "!", ""]))}</p></div>')
    p.add("</section></div></ol>")


def _side(p: _Page) -> None:
    r = p.r
    p.add(r.choice(["<aside>", '<div class="sidebar">', '<aside class="related">', '<div id="sidebar" role="complementary">', '<section class="widget">']))
    for _ in range(r.randint(1, 3)):
        p.add(f"<h3>{p.words(1, 4)}</h3>" + r.choice([f"<ul>{_links(p, 3)}</ul>", f"<p>{p.words(5, 30, '.')}</p>"]))
    p.add("</aside></div></section>")


def _after(p: _Page) -> None:
    r = p.r
    if r.random() < 0.4:
        _comments(p)
    if r.random() < 0.35:
        _side(p)
    if r.random() < 0.3:
        _advert(p)
    if r.random() < 0.2:
        _form(p)
    if r.random() < 0.9:
        sign = r.choice(["&copy; ", "&copy; ", "", "Copyright "])
        p.add(r.choice(["<footer>", "<footer>", '<div class="footer">', '<div id="footer"><p>']) + sign + p.words(1, 20, r.choice([".", ""])) + "</footer></div>")


def _inside(p: _Page) -> None:
    """What is no text of the article though it stands in it."""
    r = p.r
    kind = r.randrange(5)
    if kind == 0:
        p.add(f"<form><p>{p.words(3, 25, r.choice(['.', '']))}</p><input></form>")
    elif kind == 1:
        p.add(f"<aside><p>{p.words(3, 30, r.choice(['.', '']))}</p></aside>")
    elif kind == 2:
        p.add(r.choice(["<footer>", "<footer><p>"]) + p.words(3, 25, r.choice([".", ""])) + "</footer>")
    elif kind == 3:
        p.add("<nav>" + r.choice([f"<ul>{_links(p, r.randint(1, 4))}</ul>", f'<a href="/x">{p.words(1, 7)}</a>']) + "</nav>")
    else:
        _comments(p)


def _bare(p: _Page) -> None:
    """A page that is nothing but an article, with or without elements around its blocks."""
    r = p.r
    n = r.choice([0, 1, 1, 2])
    p.add("<div>" * n)
    if r.random() < 0.4:
        p.good("<h1>", p.words(1, 8), "</h1>")
    _paragraphs(p, r.randint(1, 5), True)
    p.add("</div>" * n + "</body></html>")


def _page(r: random.Random) -> tuple[str, set[str]]:
    p = _Page(r)
    if r.random() < 0.12:
        p.add(r.choice(["<html><body>", "<body>", ""]))
        _bare(p)
        return "".join(p.html), p.wanted
    closed = r.random() < 0.6
    p.add(f'<!DOCTYPE html><html lang="en"><head><title>{p.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>')
    alone = r.random() < 0.15  # nothing around the article
    if not alone:
        _before(p)
        if r.random() < 0.25:
            _side(p)
    opened = r.choice(
        ["<article>"] * 5
        + ["<main>", "<main><article>", '<div class="content">', '<div class="post"><div class="post-content">', '<div id="main-content">', '<div class="article-body">', '<section class="story">', '<article class="post">', "<div>", ""]
    )
    p.add(opened)
    if r.random() < 0.8:
        headed = "article" in opened and r.random() < 0.25
        p.good("<header><h1>" if headed else "<h1>", p.words(1, 10, r.choice(["", "", "."])), "</h1></header>" if headed else "</h1>")
    if r.random() < 0.2:
        p.add(f'<div class="{r.choice(["share", "social", "meta", "byline"])}"><a href="/z">{p.words(1, 3)}</a></div>')
    n = r.choice([1, 2, 4, 8, 14])
    _paragraphs(p, n, closed)
    if r.random() < 0.3:
        r.choice([_advert, _notice, _form, _side, _comments])(p)
        _paragraphs(p, r.randint(1, 4), closed)
    if r.random() < 0.35 and ("article" in opened or "main" in opened):
        _inside(p)
        if r.random() < 0.5:
            _paragraphs(p, r.randint(1, 2), True)
    if r.random() < 0.2:
        _comments(p)
    p.add({"<article>": "</article>", "<main>": "</main>", "<main><article>": "</article></main>"}.get(opened, "</article>" if "article " in opened else "</section>" if "section" in opened else "</div>" * opened.count("<div")))
    if not alone:
        _after(p)
    if r.random() < 0.9:
        p.add("</body></html>")
    return "".join(p.html), p.wanted


@lru_cache(maxsize=1)
def labelled_pages(n: int = 600, seed: int = 20) -> list[tuple[str, set[str]]]:
    """(html, texts of the article's blocks)."""
    r = random.Random(seed)
    return [_page(r) for _ in range(n)]
