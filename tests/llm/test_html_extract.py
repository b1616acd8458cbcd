"""Main text: block trees, alignment, and whole hosts."""

import html
import os
import random
import re
import time

import pytest

from claimgauge.llm import html_extract as he


def text_of(source):
    return he.extract(source, None, frozenset())


@pytest.mark.parametrize(
    "source, expected",
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>a<b>b</b>c<br>d</p><p>e\n\t f", "abc d e f"),
        ("<nav>menu</nav><article><h1>T</h1><p>one<p>two</article><footer>f</footer>", "T one two"),
        ("<article>in<footer>sign</footer><aside>side</aside>text</article> out", "in text"),
        ("<body class='has-sidebar'><main><form>f</form><div class='cookie-notice'>c</div><p>m</p></main>", "m"),
        ("<article><p>a</p><div id='comments'><article><p>reader</p></article></div></article>", "a"),
        ("<div id=comments><article>reader</article></div><article>a</article>", "a"),
        ("<div class=sidebar-left><div><article><p>kept</p></article></div></div>", "kept"),
        ("<article><script>var x='</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>", "yes"),
        ("<article><p>a <span class='ad'>buy</span> b</p></article>", "a b"),
        ("<article><ul><li>x<li>y<ul><li>z</ul></ul><table><tr><td>1<td>2<tr><td>3</table>", "x y z 1 2 3"),
        ("<ARTICLE><P TITLE='a > b'>q &lt; r &#233; &copy; &am &nosuch;</P></ARTICLE>", "q < r é © &am &nosuch;"),
        ("<article>a < b and <3 c</article>", "a < b and <3 c"),
        ("<article><p>cut off <b>here", "cut off here"),
        ("<article><p>open comment <!-- never closed <p>x", "open comment"),
        ("<p>before</p></div></p></b><p>after</p>", "before after"),
        ("<![CDATA[x]]><?php y ?><!DOCTYPE html><p>z", "z"),
    ],
)
def test_text_of_one_page(source, expected):
    assert text_of(source) == expected


def test_deep_and_long_pages():
    assert text_of("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after") == "deep after"
    assert text_of("<article>" + "<p>w " * 20000) == " ".join(["w"] * 20000)
    assert text_of("<a " + 'x="' * 3000) == "<a " + " ".join(['x="' * 3000])


def plain_matching(a, b):
    """The size of the best matching by trying everything."""
    if a.label != b.label:
        return 0

    def lists(x, y):
        if not x or not y:
            return 0
        return max(lists(x[1:], y), lists(x, y[1:]), plain_matching(x[0], y[0]) + lists(x[1:], y[1:]) if x[0].label == y[0].label else 0)

    return 1 + lists(a.kids, b.kids)


def test_alignment_pairs_as_many_nodes_as_possible():
    rng = random.Random(13)

    def page(depth=0):
        kids = "".join(page(depth + 1) for _ in range(rng.randrange(0, 4))) if depth < 3 else ""
        return f"<{rng.choice(['div', 'section'])}>t{rng.randrange(3)}{kids}</div></section>"

    for _ in range(30):
        a, b = he.parse(page() + page()), he.parse(page() + page())
        pairs = he.align(a, b)
        order = {id(n): i for i, n in enumerate(he.text_nodes(a))}, {id(n): i for i, n in enumerate(he.text_nodes(b))}
        places = [(order[0][id(x)], order[1][id(y)]) for x, y in pairs]
        assert places == sorted(places) and len({p for p, _ in places}) == len({q for _, q in places}) == len(places)
    one = he.parse("<ul><li>1<li>2<li>3</ul><p>x")
    assert len(he.align(one, he.parse("<ul><li>1<li>3</ul><p>y"))) == 3
    assert plain_matching(one, one) == 1 + 1 + 3 * 2 + 2


def blog(i, rng, title="Site"):
    body = "".join(f"<div><span>{rng.random()} words of page {i}</span></div>" for _ in range(3))
    return (
        f"<html><body><div class='top'><div>{title} of things</div></div><div class='left'><div>About us</div><div>Write to us</div></div>"
        f"<div class='mid'><div>Title {i}</div>{body}<div>Subscribe today</div></div><div>All rights reserved {title}</div></body></html>"
    )


def test_constant_parts_of_a_host_go_and_varying_parts_stay(spark):
    rng = random.Random(14)
    rows = [(i, f"http://A.net/{i}", blog(i, rng)) for i in range(12)]
    rows += [(100 + i, f"https://b.net/{i}", blog(7, random.Random(1), "Other")) for i in range(12)]  # copies of one page
    rows += [(200, "http://single.net/", blog(3, rng)), (201, None, "<p>no address"), (None, "http://a.net/x", blog(50, rng)), (202, "http://a.net/y", None), (0, "http://a.net/0", rows[0][2])]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int").repartition(3)
    got = he.extract_pages(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_url = {r.url: r.text for r in got}
    for i in range(12):
        text = by_url[f"http://A.net/{i}"] if i else by_url["http://a.net/0"]
        assert text.startswith(f"Title {i} ") and text.count("words of page") == 3
        assert not any(w in text for w in ("About", "Subscribe", "rights", "things"))
    assert by_url["http://a.net/x"].startswith("Title 50") and by_url["http://a.net/y"] == ""
    assert "words of page 7" in by_url["https://b.net/3"]
    assert "About us" in by_url["http://single.net/"] and by_url[None] == "no address"


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    rng = random.Random(15)
    pages = spark.createDataFrame([(i, "http://a.net/", blog(i, rng)) for i in range(9)], "page_id long, url string, html string")
    before = sorted(he.extract_pages(pages).collect())
    monkeypatch.setattr(he, "BROADCAST_BYTES", -1)
    assert sorted(he.extract_pages(pages).collect()) == before


def test_empty_table(spark):
    assert he.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables not present")
def test_articles_of_the_driver_pages(spark):
    def article(source):
        inner = source[source.index("<article>") + 9 : source.index("</article>")]
        return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>|</?p>|</?h1>", " ", inner))).split())

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r.page_id: r.text for r in he.op1_html_extract(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: article(h) for i, h in pages.items()}


@pytest.mark.parametrize(
    "source",
    [
        "<div class='layout no-ads'><article><p>one</p></article></div>",
        "<article class='post has-comments'><p>one</p></article>",
        "<article class='has-sidebar'><p>one</p></article>",
        "<article class='search-results'><p>one</p></article>",
        "<div class='comments-layout'><article><p>one</p></article></div>",
        "<div class='has-sidebar'><p>one</p></div>",
        "<div id='header-free'><p>one</p></div>",
        "<nav>menu</nav><form id='all'><div class='sidebar'>x</div><main><p>one</p><button>Send</button></main></form>",
        "<div>" * 160 + "<nav>menu</nav><article><p>one</p></article>",
    ],
)
def test_wrappers_keep_their_article(source):
    assert text_of(source) == "one"


def test_named_elements_that_hold_the_prose_are_wrappers():
    prose = "".join(f"<p>{'many words of an article ' * 4}{i}</p>" for i in range(4))
    assert text_of(f"<div class='widget'>{prose}<div class='share'>Share</div></div><div>c</div>").startswith("many words")
    assert text_of("<p>short one</p><div class='menu'>" + "<div>a menu entry</div>" * 30 + "</div>") == "short one"
    assert text_of(f"<div>an article of a few words</div><div class='comments'>{prose}</div>") == "an article of a few words"


def test_equal_siblings_are_paired_after_any_number_of_others():
    def page(n, mark):
        return he.parse("<div>" + "".join(f"<p>{mark} {i}</p>" for i in range(n)) + "<p>Subscribe today</p></div>")

    for n in (3, 5, 8):
        for m in (3, 5, 8):
            pairs = he.align(page(n, "a"), page(m, "b"))
            assert len(pairs) == min(n, m) + 1 and [x.text for x, y in pairs if x.text == y.text] == ["Subscribe today"]


def plain_score(a, b):
    """Nodes and equal siblings of the best matching of two lists of leaves, by trying everything."""
    if not a or not b:
        return 0
    pair = he._NODE * he._matched(a[0], b[0]) + (a[0].digest == b[0].digest) if a[0].label == b[0].label else -1
    return max(plain_score(a[1:], b), plain_score(a, b[1:]), pair + plain_score(a[1:], b[1:]) if pair >= 0 else 0)


@pytest.mark.parametrize("cells", [1 << 20, 4])
def test_pairing_is_the_best_one(monkeypatch, cells):
    monkeypatch.setattr(he, "TABLE_CELLS", cells)
    rng = random.Random(16)
    for _ in range(60):
        a, b = (he.parse("".join(f"<{rng.choice(['p', 'h2'])}>{rng.randrange(3)}</p></h2>" for _ in range(rng.randrange(7)))) for _ in range(2))
        pairs = he._paired_kids(a, b)
        got = sum(he._NODE * he._matched(x, y) + (x.digest == y.digest) for x, y in pairs)
        assert got == plain_score(a.kids, b.kids) and a.nodes == 1 + 2 * len(a.kids)


def test_matched_nodes_are_as_many_as_by_trying_everything():
    rng = random.Random(17)

    def page(depth=0):
        kids = "".join(page(depth + 1) for _ in range(rng.randrange(0, 3))) if depth < 3 else ""
        return f"<{rng.choice(['div', 'section'])}>t{kids}</div></section>"

    for _ in range(40):
        a, b = he.parse(page() + page()), he.parse(page())
        assert he._matched(a, b) == plain_matching(a, b)


def test_a_page_of_20000_siblings_is_aligned_in_time():
    a = he.parse("<article>" + "".join(f"<p>a {i}" for i in range(20_000)) + "<p>end")
    b = he.parse("<article>" + "".join(f"<p>b {i}" for i in range(15_000)) + "<p>mid<h2>h</h2><p>end")
    start = time.monotonic()
    pairs = he.align(a, b)
    assert len(pairs) == 15_002 and pairs[-1][0].text == "end" and time.monotonic() - start < 60


def test_deep_trees_are_aligned():
    a, b = he.parse("<div>" * 4000 + "x<p>y"), he.parse("<div>" * 4000 + "z<h2>y</h2><p>y")
    assert [(x.text, y.text) for x, y in he.align(a, b)] == [("x", "z"), ("y", "y")]


def test_frames_longer_than_the_articles_go(spark):
    frame = "".join(f"<div><div>{'constant words of the frame ' * 4}{i}</div></div>" for i in range(3))
    rows = [(i, "http://f.net/", f"<body><div class=a>{frame}</div><div class=b>{'<p>' + str(i) * 90 + '</p>'}</div></body>") for i in range(9)]
    # Copies of the seed do not vote.
    rows += [(100 + i, "http://f.net/", rows[0][2]) for i in range(30)]
    got = {r.page_id: r.text for r in he.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: str(i % 100 if i < 100 else 0) * 90 for i, _, _ in rows}


def test_layouts_of_a_host_have_templates_of_their_own(spark):
    def page(i):
        side, words = ("left", "About these pages") if i % 2 else ("right", "Letters to us")
        body = "".join(f"<p>page {i} says {j}</p>" for j in range(2 + i % 5))
        return f"<body><div class='{side}'><div>{words}</div></div><div class='mid-{side}'>{body}<p>Subscribe today</p></div></body>"

    rows = [(i, "http://l.net/", page(i)) for i in range(20)]
    got = {r.page_id: r.text for r in he.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(f"page {i} says {j}" for j in range(2 + i % 5)) for i in range(20)}
