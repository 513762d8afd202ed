"""Main text by density: an independent scorer, pages without telling names, and broken markup."""

import html
import math
import os
import random
import re
import time

import pytest

from surveymend.llm import htmltext

SF = "/root/testdata/sf0.01"
A = "Long enough words to be the content of the page, of which there are several, and some more."
B = "And more of them, which say something else at some length, so that the part is dense."
C = "A third paragraph closes the text, with as many words as the others have, or nearly."
BODY = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
TEXT = f"{A} {B} {C}"


# ---- a scorer of its own, over nested tuples (tag, children)


def grow(rng, depth):
    kids = []
    for _ in range(rng.randint(1, 4)):
        k = rng.random()
        if k < 0.35 or depth > 4:
            kids.append(("p", [" ".join(["word"] * rng.randint(1, 30))] + ([("a", ["link " * rng.randint(1, 9)])] if rng.random() < 0.4 else []) + ([("b", ["bold"])] if rng.random() < 0.3 else [])))
        elif k < 0.5:
            kids.append(("ul", [("li", [("a", ["go " * rng.randint(1, 4)])]) for _ in range(rng.randint(1, 6))]))
        elif k < 0.6:
            kids.append(("br", []))
            kids.append("loose text " * rng.randint(1, 8))
        else:
            kids.append(("div", grow(rng, depth + 1)))
    return kids


def written(x):
    return x if isinstance(x, str) else "<br>" if x[0] == "br" else f"<{x[0]}>{''.join(map(written, x[1]))}</{x[0]}>"


def numbers(x):
    """characters, tags below, link characters, links of a node or text."""
    if isinstance(x, str):
        return len(x.strip()), 0, 0, 0
    below = [numbers(y) for y in x[1]]
    c, lc, lt = (sum(b[i] for b in below) for i in (0, 2, 3))
    t = sum(b[1] + (not isinstance(y, str)) for b, y in zip(below, x[1], strict=True))
    return (c, t, c, lt + 1) if x[0] == "a" else (c, t, lc, lt)


def density(n, body):
    c, t, lc, lt = n
    if c == 0:
        return 0.0
    top = max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1) + 1
    bottom = c / max(c - lc, 1) * lc + body[2] / max(body[0], 1) * c + math.e
    return c / max(t, 1) * math.log(top, bottom)


def total(x, body):
    out, run = 0.0, (0, 0, 0, 0)
    for y in x[1]:
        inline = isinstance(y, str) or y[0] in ("a", "b")
        n = numbers(y)
        if inline:
            run = tuple(a + b for a, b in zip(run, (n[0], n[1] + (not isinstance(y, str)), n[2], n[3]), strict=True))
        else:
            out, run = out + density(run, body), (0, 0, 0, 0)
            if y[0] != "br":
                out += density(n, body)
    return out + density(run, body)


def blocks(x):
    yield x
    for y in x[1]:
        if not isinstance(y, str) and y[0] not in ("a", "b", "br"):
            yield from blocks(y)


def test_density_equals_an_independent_scorer():
    rng = random.Random(9)
    for _ in range(200):
        page = ("html", grow(rng, 0))
        root, _ = htmltext.tree("".join(map(written, page[1])))
        nodes = htmltext._preorder(root)
        htmltext.measure(nodes)
        mine, theirs = [n for n in nodes if n.tag not in ("a", "b", "br")], list(blocks(page))
        body = numbers(page)
        assert [n.tag for n in mine] == [x[0] for x in theirs]
        for n, x in zip(mine, theirs, strict=True):
            assert n.density == pytest.approx(density(numbers(x), body)) and n.total == pytest.approx(total(x, body))
        _, best, threshold = htmltext.content(root, "")
        sums = [total(x, body) for x in theirs]
        assert best.total == pytest.approx(max(sums))
        assert threshold == pytest.approx(min(n.density for n in htmltext._path(best)))


# ---- pages without telling names


def article_of(page):
    article = page[page.index("<article>") + 9 : page.index("</article>")]
    return " ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", article)).split())


def nameless(page, elements="article|main"):
    page = re.sub(rf"<(/?)(?:{elements})\b", r"<\1div", page)
    return re.sub(r"\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


ALL = "article|main|header|nav|footer|aside|form"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_articles_are_found_without_names(spark):
    for page in [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]:
        want = article_of(page)
        assert htmltext.text_of(page) == want
        assert htmltext.text_of(nameless(page)) == want
        assert htmltext.text_of(nameless(page, ALL)) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("constant", [0.0, 1.0])
def test_no_article_is_found_without_density(spark, monkeypatch, constant):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").limit(100).collect()]
    monkeypatch.setattr(htmltext, "composite", lambda *a: constant)
    assert not any(htmltext.text_of(nameless(p, ALL)) == article_of(p) for p in pages)


D = "Inner words that are long enough to be a paragraph of the article, and are all a part of it."
MENU = f"<nav><ul>{''.join(f'<li><a href=/{k}>Section {k}</a></li>' for k in range(8))}</ul></nav>"
REFERENCES = "".join(f"<li><a href=/r{k}>A reference with a long title number {k}</a></li>" for k in range(5))


@pytest.mark.parametrize(
    "part",
    [
        f"<section class='social-history'><p>{D}</p></section>", f"<div class='ad-hoc-networks'><p>{D}</p></div>", f"<div class='ad-hoc-networks'>{D}</div>", f"<div class=menu><p>{D}</p></div>", f"<p class='share-price'>{D}</p>",
        f"<div><div id='comment-on-law'><p>{D}</p></div></div>", f"<aside><p>{D}</p></aside>", f"<p><label>{D}</label></p>", f"<fieldset><p>{D}</p></fieldset>", f"<ul>{REFERENCES}</ul>", "<p>Short.</p>", "<table><tr><td>1</td><td>2</td></tr></table>",
    ],
)
@pytest.mark.parametrize("outside", [("", ""), (MENU, "<footer>(c) us</footer>"), (f"<div class=sidebar><p>{B}</p></div>", f"<div class=comments><p>{B}</p><p>{C}</p></div>")])
def test_parts_of_an_article_stay_whatever_their_names(part, outside):
    page = f"<body>{outside[0]}<article><h1>Head</h1><p>{A}</p>{part}<p>{B}</p><p>{C}</p></article>{outside[1]}</body>"
    inner = " ".join(re.sub("<[^>]+>", " ", part).split())
    assert htmltext.text_of(page) == f"Head {A} {inner} {B} {C}"


NOISE = [
    f"<aside class='sidebar'><p>{B}</p></aside>", "<div class='ad'><p>Buy this now, because it is cheap and good for everybody here.</p></div>", "<form><label>Name</label><input><button>Send</button></form>", "<form action=/s><p>Please sign up for our letter and get all the news every day.</p></form>",
    f"<div class='newsletter-signup'><p>{C}</p></div>", f"<section id='comments'><h2>Comments</h2><article class='comment'><p>{B}</p></article></section>", "<div class='related-links'><ul><li><a href=a>Other article one</a></li><li><a href=b>Other article two</a></li></ul></div>",
    "<footer>Written by me, in 2020, all rights kept</footer>", "<div class='cookie-banner'>We use cookies on this site to make it better for you.</div>", "<noscript>Enable scripts please to see this page.</noscript>", "<script>var x=1;</script><style>p{}</style>", "<nav><a href=1>1</a> <a href=2>2</a> <a href=3>Next page</a></nav>",
    "<div class=notice>This site will be down on Sunday for works.</div>", "<div role=alert>Your browser is old, please upgrade it soon.</div>", "<!-- c -->", "<div class='share-buttons'><a href=x>Share here</a><a href=f>Share there</a></div>", "<div class='breadcrumbs'><a href=/>Home</a> &gt; <a href=/n>News</a></div>",
]


@pytest.mark.parametrize("outer", ["article", "main", "div"])
@pytest.mark.parametrize("noise", NOISE)
def test_what_isnt_content_goes_wherever_it_is(noise, outer):
    article = f"<h1>Head line</h1><p>{A}</p><p>Short.</p><p>{B}</p>%s<ul><li>One item</li><li>Two items</li></ul><p>{C}</p>"
    want = f"Head line {A} Short. {B} One item Two items {C}"
    for before, inside, after in ((noise, "", ""), ("", noise, ""), ("", "", noise)):
        page = f"<title>Head line - Site</title><body><header><a href=/>Site</a><p>Our motto is good</p></header>{MENU}{before}<{outer}>{article % inside}</{outer}>{after}<aside><h3>More</h3><p>{A}</p></aside><footer><p>Copyright by the site, and all of its parts, 2021.</p></footer>"
        assert htmltext.text_of(page) == want


def test_articles_beside_each_other_and_short_ends_stay():
    two = f"<p>{D}</p><p>{D}</p>"
    assert htmltext.text_of(f"<body>{MENU}<article>{BODY}</article><article>{two}</article></body>") == f"{TEXT} {D} {D}"
    assert htmltext.text_of(f"<body>{MENU}<article>{two}</article><article>{BODY}</article></body>") == f"{D} {D} {TEXT}"
    assert htmltext.text_of(f"<body>{MENU}<div>{BODY}</div><div><p>That was all of it, more or less.</p></div></body>") == f"{TEXT} That was all of it, more or less."


LINKS = "".join(f"<li><a href=/{k}>Section {k}</a></li>" for k in range(8))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class='content no-sidebar'><article>{BODY}</article></div>", TEXT),
        (f"<div class='has-sidebar'><div>{BODY}</div></div>", TEXT),
        (f"<div class='comment-box ad'><div>{BODY}</div></div><div>x</div>", TEXT),
        (f"<div id=page><header><h1>Site</h1><p>Its motto, a long one</p></header><main>{BODY}</main></div>", TEXT),
        (f"<article><header><h1>Head</h1></header>{BODY}</article>", "Head " + TEXT),
        (f"<body><div><ul>{LINKS}</ul></div><div>{BODY}</div><div>Ours since 1999.</div></body>", TEXT),
        (f"<body><div><ul>{LINKS}</ul></div><div>{BODY}</div><div><p>That was all of it.</p></div></body>", TEXT + " That was all of it."),
        (f"<body><div><p>Buy this, it is cheap and good for you, they say.</p></div><div>{BODY}</div></body>", TEXT),
        (f"<body><div><h1>Head</h1></div><div>{BODY}</div></body>", "Head " + TEXT),
        (f"<title>Head - Site</title><div><h2>Site</h2></div><div><h1>Head</h1><p>{A}</p></div><div>{BODY}</div>", f"Head {A} {TEXT}"),
        (f"<div><div>{BODY}</div><div class=ad><p>{A}</p></div><div>{BODY}</div></div>", f"{TEXT} {TEXT}"),
        (f"<div>{BODY}<div class='cookie-notice'>{A}</div><div class='share-bar'><p>{B}</p></div></div>", TEXT),
        (f"<div>{BODY}</div><div class=comments>{'<p>I disagree with all of this, at length, and say why.</p>' * 4}</div>", TEXT),
        (f"<article>{BODY}<section class='comments'>{BODY}</section></article>", TEXT),
        (f"<div role=navigation><p>{A}</p><p>{B}</p></div><div>{BODY}</div>", TEXT),
        ("<div>First line of it<br>second line<br>third line</div><ul>" + LINKS + "</ul>", "First line of it second line third line"),
    ],
)
def test_content_of_pages(page, want):
    assert htmltext.text_of(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><div class=\"open>{BODY}</div></article>", TEXT),
        (f"<article><p title=\"open>{A}</p><p class=\"x\">{B}</p></article>", f"{A} {B}"),
        (f"<article><p title='a > b < c'>{A}</p></article>", A),
        (f"<article><p>{A}</p><p class='x'id='y'>{B}</p></article>", f"{A} {B}"),
        (f"<article><p>{A}</p><a href=/x/>{B}</a></article>", f"{A} {B}"),
        (f"<article><p>{A}</p><img src='x'", A),
        (f"<article><p>{A}</b></i></p><p>{B}</div></article>", f"{A} {B}"),
        ("<p>1 < 2 & 3 > 2 &lt;b&gt;</p>", "1 < 2 & 3 > 2 <b>"),
    ],
)
def test_broken_markup(page, want):
    assert htmltext.text_of(page) == want


@pytest.mark.parametrize("page", ["<i>" * 30_000 + "</b>" * 30_000, "<div>" * 30_000 + "</p>" * 30_000, "<b><div>" + "<i>" * 30_000 + "</b>" * 30_000, "<div>" * 20_000 + "<li></li>" * 20_000, "<a " * 30_000, "<a x=" + "'y" * 30_000, "<" * 60_000])
def test_time_grows_with_length(page):
    t = time.perf_counter()
    htmltext.text_of(page + "<p>end</p>")
    assert time.perf_counter() - t < 3


def test_empty_and_repeated_pages(spark):
    df = spark.createDataFrame([(1, "u", BODY, 5), (1, "u", BODY, 5), (2, None, None, 0)], "page_id long, url string, html string, n_chars long")
    assert sorted(r["n_chars"] for r in htmltext.extract(df).collect()) == [0, len(TEXT), len(TEXT)]
    assert htmltext.extract(df.limit(0)).collect() == []
