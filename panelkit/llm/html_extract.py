"""Main-text extraction by a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks: runs of text between block-level tags. Each block has features of its ancestors (tags,
and the words of their class, id and role), of its own tag and of its text. A chain labels every block as article or
not; its weights come from labelled pages (``html_train``) by maximum likelihood, and a page is decoded by Viterbi.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An attribute: its name, and after = a value in quotes or up to white space. Quotes that do not follow = are no quotes.
_NAME_VALUE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>|\Z)))?+"""
#: Comments and the like, or a tag (2: name, 3: attributes). No part is read twice, so the time is linear.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|</>|<(?:[!?]|/[^a-zA-Z>])[^>]*+(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME_VALUE})*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]++))?+""")
_SPACE = re.compile(r"\s+")
#: Tags whose content is not text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "xmp", "noembed", "noframes"}
#: Those of them whose content has no markup.
PLAIN = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_PLAIN_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in PLAIN}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: An opening tag of the left closes an open one of the right.
_P_ENDERS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: What the words of class, id and role say, by kind.
KINDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs toolbar skip topbar masthead",
    "edge": "header footer foot head banner copyright colophon legal bottom top",
    "side": "sidebar side aside related widget rail secondary complementary recommended popular trending more latest archive tags tagcloud",
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner-ad adsense commercial",
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr subscribe newsletter signup paywall toast dialog message warning",
    "form": "form search login register contact input captcha",
    "comment": "comment comments commentlist reply replies disqus discussion respond feedback reactions",
    "share": "share sharing social follow author byline meta info date",
    "body": "article content post entry story body main text page-content articlebody main-content post-body prose",
}
#: Tags that say the same.
_TAG_KIND = {"nav": "menu", "menu": "menu", "aside": "side", "footer": "edge", "form": "form", "dialog": "notice"}
_KIND_OF: dict[str, set[str]] = {}
for _k, _ws in KINDS.items():
    for _w in _ws.split():
        _KIND_OF.setdefault(_w, set()).add(_k)
_TAGS = ("article", "main", "section", "div", "body", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "td", "th", "p", "pre", "blockquote", "h1", "h2", "h3", "dl", "dd", "dt", "figure", "figcaption", "button", "select", "fieldset", "dialog", "menu", "details")
FEATURES = (
    ["bias", "hidden"]
    + [f"in {t}" for t in _TAGS]
    + [f"own {t}" for t in _TAGS]
    + [f"{k} above" for k in KINDS]
    + [f"{k} above, in article" for k in ("menu", "side", "advert", "notice", "form", "comment", "share", "edge")]
    + ["header above, in article", "outside the article", "no article"]
    + ["1-2 words", "3-9 words", "10-24 words", "25+ words", "links mostly", "some links", "ends a sentence", "commas", "copyright sign", "first tenth", "last tenth"]
)
_AT = {f: i for i, f in enumerate(FEATURES)}


@lru_cache(maxsize=4096)
def _element(tag: str, attributes: str) -> tuple[str, tuple[int, ...], frozenset]:
    """(tag, feature numbers of the element as an ancestor, kinds)."""
    kinds: set[str] = {_TAG_KIND[tag]} if tag in _TAG_KIND else set()
    hidden = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        value = value.strip("\"'").lower()
        if name in ("hidden", "aria-hidden"):
            hidden = hidden or value in ("", "true", "hidden")
            continue
        for w in value.split():
            kinds |= _KIND_OF.get(w, set())
            for part in re.split(r"[-_]+", w):
                kinds |= _KIND_OF.get(part, set())
    f = [_AT[f"in {tag}"]] if f"in {tag}" in _AT else []
    f += [_AT[f"{k} above"] for k in sorted(kinds)]
    return tag, tuple(f + [_AT["hidden"]] * hidden), frozenset(kinds)


def _raw_end(html: str, at: int, tag: str) -> int:
    """Where the content of a RAW element that starts at this place, and its closing tag, end; not closed: the page's end.

    In elements of plain text nothing but the closing tag is markup. The others are read by tags, so that a closing
    tag in a comment or an attribute does not end them; they may hold elements of their own kind.
    """
    if tag in PLAIN:
        m = _PLAIN_END[tag].search(html, at)
        return m.end() if m else len(html)
    depth = 1
    while m := _TOKEN.search(html, at):
        at = m.end()
        inner = (m.group(2) or "").lower()
        whole = (m.group(3) or "").rstrip().endswith("/")
        if inner == tag and not whole:
            depth += -1 if m.group(1) else 1
            if not depth:
                return at
        elif inner in PLAIN and not m.group(1) and not whole:
            at = _raw_end(html, at, inner)
    return len(html)


class _Open:
    """The open elements. Each is put in and taken out once, and what holds for all of them is kept as counts."""

    def __init__(self):
        self.stack: list[list] = []  # [tag, features, kinds, still open]
        self.blocks: list[list] = []  # those that are not inline
        self.of: dict[str, list[list]] = {}
        self.features: Counter = Counter()
        self.kinds: Counter = Counter()

    def push(self, tag: str, features: tuple[int, ...], kinds: frozenset) -> None:
        e = [tag, features, kinds, True]
        self.stack.append(e)
        self.of.setdefault(tag, []).append(e)
        if tag not in INLINE:
            self.blocks.append(e)
        for x in features:
            self.features[x] += 1
        for x in kinds:
            self.kinds[x] += 1

    def _off(self, e: list) -> None:
        e[3] = False
        for count, xs in ((self.features, e[1]), (self.kinds, e[2])):
            for x in xs:
                count[x] -= 1
                if not count[x]:
                    del count[x]

    def _down_to(self, e: list) -> None:
        while True:
            top = self.stack.pop()
            if top[3]:
                self.of[top[0]].pop()
                if top[0] not in INLINE:
                    self.blocks.pop()
                self._off(top)
            if top is e:
                return

    def close(self, tag: str) -> None:
        """Ends the innermost element of this tag: a block with all that is open in it, an inline one alone."""
        mine = self.of.get(tag)
        if not mine:
            return
        if tag in INLINE:
            self._off(mine.pop())
            while self.stack and not self.stack[-1][3]:
                self.stack.pop()
        else:
            self._down_to(mine[-1])

    def end_before(self, tag: str) -> None:
        """An opening tag may end the block it stands in; inline elements left open do not keep that block open."""
        ends = {"p"} if tag in _P_ENDERS else _SIBLINGS.get(tag, set())
        if self.blocks and self.blocks[-1][0] in ends:
            self._down_to(self.blocks[-1])


def blocks(html: str) -> tuple[list[str], list[tuple[int, ...]]]:
    """(text of each leaf block, its feature numbers), in page order; blocks of white space only are left out.

    Tags are read as browsers read them. The time is linear in the page's length, however deep its elements stand.
    """
    texts: list[str] = []
    feats: list[tuple[set[int], str, bool, int, int]] = []
    opened = _Open()
    parts: list[str] = []
    linked = 0
    at = 0

    def flush():
        nonlocal linked
        raw = "".join(parts)
        parts.clear()
        if raw and not raw.isspace():
            text = _SPACE.sub(" ", unescape(raw)).strip()
            if text:
                f = set(opened.features)
                if _AT["in article"] in f or _AT["in main"] in f:
                    f |= {_AT[k] for x in opened.kinds if (k := f"{x} above, in article") in _AT}
                    if _AT["in header"] in f:
                        f.add(_AT["header above, in article"])
                feats.append((f, opened.blocks[-1][0] if opened.blocks else "body", "©" in text, linked, len(text)))
                texts.append(text)
        linked = 0

    def text_part(s: str):
        nonlocal linked
        if s:
            parts.append(s)
            if opened.of.get("a"):
                linked += len(s)

    while m := _TOKEN.search(html, at):
        text_part(html[at : m.start()])
        at = m.end()
        close, tag, attributes = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if close:
            opened.close(tag)
        elif tag in RAW:
            if not attributes.rstrip().endswith("/"):
                at = _raw_end(html, at, tag)
        elif tag not in VOID:
            opened.end_before(tag)
            opened.push(*_element(tag, attributes))
    text_part(html[at:])
    flush()

    out = []
    total = len(texts)
    marked = {_AT["in article"], _AT["in main"]}
    none = all(marked.isdisjoint(f) for f, *_ in feats)
    for i, (f, own, sign, links, n) in enumerate(feats):
        f.add(0)
        if none:
            f.add(_AT["no article"])
        elif marked.isdisjoint(f):
            f.add(_AT["outside the article"])
        if f"own {own}" in _AT:
            f.add(_AT[f"own {own}"])
        words = texts[i].count(" ") + 1
        f.add(_AT["1-2 words" if words < 3 else "3-9 words" if words < 10 else "10-24 words" if words < 25 else "25+ words"])
        if links * 2 > n:
            f.add(_AT["links mostly"])
        elif links:
            f.add(_AT["some links"])
        if texts[i][-1] in ".!?\"'”’)":
            f.add(_AT["ends a sentence"])
        if "," in texts[i]:
            f.add(_AT["commas"])
        if sign:
            f.add(_AT["copyright sign"])
        if i * 10 < total:
            f.add(_AT["first tenth"])
        if (total - 1 - i) * 10 < total:
            f.add(_AT["last tenth"])
        out.append(tuple(sorted(f)))
    return texts, out


class Chain:
    """Two labels (0: not article, 1: article); weights of features for label 1, and of each pair of labels in a row."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def unary(self, feats: list[tuple[int, ...]]) -> np.ndarray:
        return np.array([self.weights[list(f)].sum() for f in feats])

    def decode(self, feats: list[tuple[int, ...]]) -> list[int]:
        """Viterbi: the likeliest labels; ties go to 0."""
        if not feats:
            return []
        u = self.unary(feats).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        back, s0, s1 = [], 0.0, u[0]
        for x in u[1:]:
            a, b = s0 + m00, s1 + m10
            c, d = s0 + m01, s1 + m11
            back.append((0 if a >= b else 1, 0 if c >= d else 1))
            s0, s1 = max(a, b), max(c, d) + x
        label = 0 if s0 >= s1 else 1
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[tuple[int, ...]], list[int]]], rounds: int = 150, ridge: float = 0.05) -> Chain:
    """Maximum likelihood with a ridge penalty, by adaptive gradient steps; all pages go forward and backward at once."""
    pages = [p for p in pages if p[0]]
    size, longest, k = len(pages), max(len(f) for f, _ in pages), len(FEATURES)
    x = np.zeros((size, longest, k), np.float64)
    y = np.zeros((size, longest), np.int64)
    n = np.array([len(f) for f, _ in pages])
    for p, (feats, labels) in enumerate(pages):
        for t, f in enumerate(feats):
            x[p, t, list(f)] = 1
        y[p, : len(labels)] = labels
    inside = np.arange(longest)[None, :] < n[:, None]
    w, moves = np.zeros(k), np.zeros((2, 2))
    gw, gm = np.full(k, 1e-8), np.full((2, 2), 1e-8)

    lse = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & inside[:, 1:]).sum()
    target = np.einsum("ptk,pt->k", x, (y == 1) & inside)
    for _ in range(rounds):
        u = np.stack([np.zeros((size, longest)), x @ w], axis=2)
        alpha, beta = np.zeros_like(u), np.zeros_like(u)
        alpha[:, 0] = u[:, 0]
        for t in range(1, longest):
            step = lse(np.swapaxes(alpha[:, t - 1, :, None] + moves[None], 1, 2)) + u[:, t]
            alpha[:, t] = np.where(inside[:, t, None], step, alpha[:, t - 1])
        z = lse(alpha[:, -1])
        for t in range(longest - 2, -1, -1):
            step = lse(moves[None] + (u[:, t + 1] + beta[:, t + 1])[:, None, :])
            beta[:, t] = np.where(inside[:, t + 1, None], step, 0)
        one = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * inside
        both = np.exp(alpha[:, :-1, :, None] + moves[None, None] + (u[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * inside[:, 1:, None, None]
        dw = target - np.einsum("ptk,pt->k", x, one) - ridge * w
        dm = seen - both.sum(axis=(0, 1)) - ridge * moves
        gw += dw**2
        gm += dm**2
        w += 0.5 * dw / np.sqrt(gw)
        moves += 0.5 * dm / np.sqrt(gm)
    return Chain(w, moves)


@lru_cache(maxsize=1)
def model() -> Chain:
    """The chain of the labelled pages of ``html_train``; made once in each process that asks."""
    from .html_train import labelled_pages

    pages = []
    for html, wanted in labelled_pages():
        texts, feats = blocks(html)
        pages.append((feats, [int(t in wanted) for t in texts]))
    return train(pages)


def main_text(html: str, chain: Chain) -> str:
    texts, feats = blocks(html)
    return "\n\n".join(t for t, y in zip(texts, chain.decode(feats), strict=True) if y)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages, from the whole html.

    Null or empty html, and pages without a block that is decoded as article, give an empty text. Rows with equal ids
    are kept. Other columns are ignored, whatever their names.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model())  # a few hundred numbers

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(h, shared.value) if h else "" for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
