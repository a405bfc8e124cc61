import random

import pytest
from panelkit.llm.html_extract import FEATURES, blocks, extract_pages, main_text, model
from panelkit.llm.html_train import _page


def test_held_out_pages():
    r = random.Random(4711)
    wrong = total = 0
    for _ in range(100):
        html, wanted = _page(r)
        texts, feats = blocks(html)
        assert wanted <= set(texts)
        wrong += sum((t in wanted) != bool(y) for t, y in zip(texts, model().decode(feats), strict=True))
        total += len(texts)
    assert wrong < 0.02 * total


def test_viterbi_is_the_best_path():
    chain = model()
    r = random.Random(1)
    for _ in range(20):
        feats = [tuple(r.sample(range(len(FEATURES)), 5)) for _ in range(7)]
        u = chain.unary(feats)

        def value(path, u=u):
            return sum(u[i] for i, y in enumerate(path) if y) + sum(chain.moves[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max(value([n >> i & 1 for i in range(7)]) for n in range(128))
        assert abs(value(chain.decode(feats)) - best) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav><div class="ad">Buy now, cheap things here.</div>
<div class="cookie-notice"><p>We use cookies on this site, please agree.</p></div>
<article><h1>A &amp; B</h1><p>First   para,
with <b>bold</b> and <a href="/l">link</a> text &lt;here&gt; that goes on for some words.<p>Second one<br>goes on with more text, as usual.
<div class="comments"><p>Nice article, thanks a lot for it!</p></div></article>
<aside><h3>Related</h3><p>Something else that you may want to read today.</p></aside>
<form><label>Search</label><input><button>Go</button></form><footer>&copy; 2020 someone</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE, model()) == "A & B\n\nFirst para, with bold and link text <here> that goes on for some words.\n\nSecond one goes on with more text, as usual."


def test_rows_of_every_kind(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (None, "u", "<p"), (1, "u", PAGE), (4, "u", "<article><p>" + "word " * 50000 + "</article>")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 6
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r for r in got}
    assert by[2]["text"] == by[3]["text"] == "" and by[1]["text"].startswith("A & B") and by[4]["n_chars"] == 5 * 50000 - 1
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string, text string")).collect() == []


P1 = "<p>The harbour was closed for three days while the storm went over the coast.</p>"
P2 = "<p>Ships waited outside, and the crews were brought food by boat each morning.</p>"
T1, T2 = P1[3:-4], P2[3:-4]


@pytest.mark.parametrize(
    "extra",
    [
        "<form><p>Leave your address and we will write to you each week.</p><input></form>",
        "<aside>You may also like the tale of the lighthouse keeper.</aside>",
        "<aside><p>You may also like the tale of the lighthouse keeper.</p></aside>",
        "<footer>Copyright 2020, all rights reserved by the paper.</footer>",
        "<footer><p>Copyright 2020, all rights reserved by the paper.</p></footer>",
        "<ol class=commentlist><li>What a fine article this is, thank you all.</li></ol>",
        '<nav><a href="/a">Back to the list</a></nav>',
    ],
)
@pytest.mark.parametrize("paragraphs", [P1, P1 + P2])
def test_what_stands_in_short_articles_without_being_text(extra, paragraphs):
    want = "\n\n".join([T1, T2][: paragraphs.count("<p>")])
    for outer in ("article", "main"):
        assert main_text(f"<body><{outer}>{paragraphs}{extra}</{outer}></body>", model()) == want
        assert main_text(f"<body><{outer}>{paragraphs}{extra}{P2 if P2 not in paragraphs else ''}</{outer}></body>", model()) == f"{T1}\n\n{T2}"


def test_site_headers_and_article_headers():
    assert main_text(f"<body><header><h1>Site</h1></header><main>{P1}{P2}</main></body>", model()) == f"{T1}\n\n{T2}"
    assert main_text(f"<body><header><h1>Site</h1></header><article><header><h1>Storm at sea</h1></header>{P1}{P2}</article></body>", model()) == f"Storm at sea\n\n{T1}\n\n{T2}"


@pytest.mark.parametrize("page", ["<body><div>{}</div></body>", "<body>{}</body>", "{}", "<html><body><div><div>{}</div></div></body></html>", "<body><article>{}</article></body>"])
def test_plain_pages(page):
    assert main_text(page.format(P1), model()) == T1
    assert main_text(page.format(P1 + P2), model()) == f"{T1}\n\n{T2}"


def test_scripts_that_look_like_markup():
    first = '<article><h1>A title</h1><p>First para of the article, with words enough to be read as its text.</p>'
    last = '<p>Second para of the article, which also goes on for some more words.</p></article>'
    want = blocks(first + last)[0]
    assert len(want) == 3
    for raw in (
        "<script>for(i=0;i<n;i++){go()}</script>",
        "<script>var s = '<!--'; if (a<b && c) x()</SCRIPT >",
        "<script>if(a<b){s='it'}</script >",
        "<style>a:before{content:'<b'}</style>",
        "<script>s='</scripts>'</script>",
        "<textarea><!-- <p \"</textarea>",
        "<title>a<b</title>",
        "<noscript><style>x<y</style><p>no</p></noscript>",
        "<svg><!-- </svg> --><text>no</text></svg>",
    ):
        assert blocks(first + raw + last)[0] == want, raw
    assert blocks(first + "<script>a<b")[0] == want[:2]


def test_quotes_belong_to_values_only():
    for page in (
        "<article><p title=it's>Hello world</p><p>don't do this.</p><p>three</p></article>",
        "<article><p title=it's>Hello world</p><p>do this.</p><p>three</p></article>",
        """<article><p title="a > b" data-x='>"'>Hello world</p><p =' '>don't do this.</p><p a=">three</p></article>""",
        "<article><p a = \"x\"b='y'/>Hello world</p><p a=>do this.</p><p\ntitle=\"it's\"\n>three</p></article>",
    ):
        got = blocks(page)[0]
        assert got[0] == "Hello world" and "<" not in "".join(got), page
        assert len(got) == (2 if 'a=">' in page else 3), page
    assert blocks("<p>a<!-->b<!--->c<!-- x --!>d</p></ x>e</>f")[0] == ["abcd", "ef"]


def test_inline_ends_leave_blocks_open():
    assert blocks("<ul><li><b>one<li>two</b> more</ul>tail")[0] == ["one", "two more", "tail"]
    assert blocks("<object><object>no</object>no</object>yes<template/>too")[0] == ["yes", "too"]


def test_long_and_deep_pages_take_linear_time():
    import time

    for unit in ("<div>", "<b>", "<p><b>x", "</i>", "<b><div>", '<a x="', "<a b='", "<!--", "<script>"):
        began = time.time()
        main_text(unit * 100_000, model())
        assert time.time() - began < 8, unit
    began = time.time()
    blocks("<b>" * 50_000 + "<div>" * 50_000 + "</b>" * 50_000 + "x")
    assert time.time() - began < 5


def brute_blocks(html):
    """Texts between block tags by the standard library's parser, for pages whose elements are all closed."""
    from html.parser import HTMLParser

    from panelkit.llm.html_extract import INLINE, RAW

    out, skip = [""], []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in RAW:
                skip.append(tag)
            if tag == "br":
                out[-1] += " "
            elif tag not in INLINE:
                out.append("")

        def handle_endtag(self, tag):
            if tag in RAW:
                skip.pop()
            if tag not in INLINE:
                out.append("")

        def handle_data(self, data):
            if not skip:
                out[-1] += data

    reader = Reader(convert_charrefs=True)
    reader.feed(html)
    reader.close()
    return [t for t in (" ".join(x.split()) for x in out) if t]


def brute_decode(chain, feats):
    """The likeliest labels by trying all; ties to the first in the order of labels from the end."""
    u = chain.unary(feats)
    n = len(feats)

    def value(path):
        return sum(u[i] for i, y in enumerate(path) if y) + sum(chain.moves[a, b] for a, b in zip(path, path[1:], strict=False))

    return list(max(([m >> i & 1 for i in range(n)] for m in range(1 << n)), key=value)) if n else []


HAND = [
    (
        """<html><head><title>Tide tables | Harbour Gazette</title></head><body class="home page">
<div id="masthead" role='navigation'><a href=/>Gazette</a> | <a href=/sport>Sport</a></div>
<main><article data-id="7"><h1>Tide tables explained</h1>
<p class=lead>High water isn't the same every day &ndash; it moves by some fifty minutes.</p>
<aside class="related"><h4>See also</h4><a href="/m">The moon</a></aside>
<p>The moon pulls the sea, and the sun helps<br>twice a month.</p></article></main>
<div class="comments"><p>Great read, thank you!</p></div><footer><p>&copy; Harbour Gazette. All rights reserved.</p></footer></body></html>""",
        "Tide tables explained\n\nHigh water isn't the same every day – it moves by some fifty minutes.\n\nThe moon pulls the sea, and the sun helps twice a month.",
    ),
    (
        """<body><nav><ul><li><a href="#">Start</a></li></ul></nav><div class="cookie-banner">We use cookies, please accept them.</div>
<article><h1>Bread</h1><p>Flour, water, salt&nbsp;and time.</p><pre>mix; wait; bake</pre>
<form action="/q"><label>Mail</label><input name=m><button>Send</button></form>
<p>Bake it until it sounds hollow, and let it cool for an hour.</p></article><script>if (a<b) { s = "</p>" }</script></body>""",
        "Bread\n\nFlour, water, salt and time.\n\nmix; wait; bake\n\nBake it until it sounds hollow, and let it cool for an hour.",
    ),
]


def test_pages_that_the_generator_did_not_make():
    for html, want in HAND:
        assert brute_blocks(html) == blocks(html)[0]
        assert main_text(html, model()) == want


def test_query_as_brute_force(spark):
    r, pages = random.Random(9), [h for h, _ in HAND]
    while len(pages) < 12:
        inner = "".join(f"<{t} class='{r.choice(['ad', 'post', 'menu', 'x'])}'>{r.choice(['a &lt; b', 'one, two <b>three</b>.', 'w ' * 30, '<!-- c -->x'])}</{t}>" for t in r.choices(["p", "div", "li", "h2", "script", "nav", "svg", "footer"], k=8))
        pages.append(f"<body>{r.choice(['<article>', '<div>'])}{inner}</body>")
    got = {x["page_id"]: x["text"] for x in extract_pages(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "'u' as url", "html")).collect()}
    for i, html in enumerate(pages):
        texts, feats = blocks(html)
        assert texts == brute_blocks(html)
        assert got[i] == "\n\n".join(t for t, y in zip(texts, brute_decode(model(), feats), strict=True) if y)
