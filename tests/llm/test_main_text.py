"""Main text of pages: layouts, edges, and a plain reading of the line distribution."""

import random

import pytest

from seclake.llm.main_text import SURGE, WINDOW, Line, extract_main_text, main_text, stretches

LONG = "Plain words of a paragraph that goes on for a while. " * 4
PAR = " ".join(LONG.split())


def page(body):
    return f"<!DOCTYPE html><html><head><title>A title</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


LAYOUTS = {
    "article": f"<nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{LONG}</p><p>Of.</p></article><footer>&copy; x</footer>",
    "main": f"<header>Site</header><main><h1>Head</h1><p>{LONG}<p>Of.</main><aside>Side {LONG}</aside>",
    "classes": f"<div id=top-nav><a href=/>Home</a></div><div class='cookie-notice'>{LONG}</div><div class=text><h1>Head</h1><p>{LONG}</p><p>Of.</p></div>"
               f"<div class='sidebarLeft'>{LONG}</div><section id='comments'><p>{LONG}</p></section><div class=footer>x</div>",
    "form around all": f"<form action=x><div class=nav>Menu</div><article><h1>Head</h1><p>{LONG}</p><p>Of.</p></article></form>",
    "advert inside": f"<article><h1>Head</h1><p>{LONG}</p><div class='ad'>Buy {LONG}</div><form>Mail: <input></form><p>Of.</p></article>",
    "comments by heading": f"<div><h1>Head</h1><p>{LONG}</p><p>Of.</p><div><h3>3 comments</h3><p>{LONG}</p></div></div>",
    "nested article": f"<article><h1>Head</h1><p>{LONG}</p><p>Of.</p><article><p>{LONG}</p></article></article>",
    "links only around": f"<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div><h1>Head</h1><p>{LONG}</p><p>Of.</p></div><ul><li><a href=1>Three</a></ul>",
    "unhinted ends": f"<div><a href=1>Home</a></div><div><h1>Head</h1><p>{LONG}</p><p>Of.</p></div><div>All rights</div>",
    "table": f"<table><tr><td><a href=/>Home</a><br><a href=/b>B</a></td><td><h1>Head</h1><p>{LONG}<p>Of.</td></tr></table>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert main_text(page(LAYOUTS[name])) == f"Head\n\n{PAR}\n\nOf."


def test_references_white_space_and_blocks():
    body = "<article><p>a &lt;b&gt;&nbsp; c &amp;amp; &#8364;&#x41;&am<br>d\n\t e</p><ul><li>one<li>two</ul><blockquote>q</blockquote></article>"
    assert main_text(page(body)) == "a <b> c &amp; €A&am d e\n\none\n\ntwo\n\nq"


def test_broken_markup():
    assert main_text("<article><p>one<p class=\"x>two</p><b>three") == "one\n\ntwo\n\nthree"
    assert main_text("<!-- a <p>b</p>") == "" and main_text("a < b and c") == "a < b and c"
    assert main_text("<p>text<!-- open") == "text" and main_text("<script>x") == ""
    assert main_text("<p>x</p><textarea><p>y</textarea>z") == "x\n\nz"
    assert main_text("<nav>menu only</nav>") == "" and main_text("<ul><li><a href=x>y</a></ul>") == ""


def test_work_grows_with_the_page():
    import time

    def cost(make, n):
        start = time.perf_counter()
        main_text(make(n))
        return time.perf_counter() - start

    for make in (lambda n: "<div>" * n + "</p>" * n, lambda n: "<nav>" + "<article>" * n, lambda n: "<div>" * n + "</section>" * n, lambda n: "<a ='" * n,
                 lambda n: "<form>" * n + "<main>" * n, lambda n: "<span class=ad>" * n + "</b></div>" * n):
        assert cost(make, 40_000) < 20 * max(cost(make, 4_000), 0.01)


def test_stretches_equal_a_plain_reading():
    """Windows summed one by one over all lines, blank ones included."""
    rng = random.Random(3)
    for _ in range(200):
        lines = [Line("x", rng.choice([0, 0, 1, 5, 90]), rng.choice([0, 0, 1, 2, 3]), 0, "", 0, False) for _ in range(rng.randint(1, 15))]
        weights, owner = [], []
        for i, line in enumerate(lines):
            weights += [0] * line.blanks + [line.weight]
            owner += [None] * line.blanks + [i]
        padded = weights + [0] * WINDOW
        sums = [sum(padded[i : i + WINDOW]) for i in range(len(weights))]
        expected, at = [], 0
        while at < len(weights):
            if not weights[at]:
                at += 1
                continue
            end = at
            while end + 1 < len(sums) and sums[end + 1]:
                end += 1
            inside = [i for i in range(at, end + 1) if weights[i]]
            expected.append((owner[inside[0]], owner[inside[-1]] + 1, sum(weights[i] for i in inside), max(sums[at : end + 1])))
            at = end + 1
        assert [f[:3] for f in stretches(lines)] == [e[:3] for e in expected]
        assert all(f[3] == e[3] for f, e in zip(stretches(lines), expected))
    assert SURGE > 0


def test_operator_edges(spark):
    rows = [(1, "u", page(LAYOUTS["article"]), "k"), (1, "u", page(LAYOUTS["article"]), "k"), (2, None, None, None), (None, "u", "", "k"),
            (3, "u", page(f"<article><p>{'word ' * 400_000}</p></article>"), "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract_main_text(pages).collect()
    assert [c for c in out[0].asDict()] == ["page_id", "url", "text", "n_chars"]
    texts = sorted((r["page_id"] or 0, len(r["text"]), r["n_chars"]) for r in out)
    size = len(f"Head\n\n{PAR}\n\nOf.")
    assert texts == [(0, 0, 0), (1, size, size), (1, size, size), (2, 0, 0), (3, 1_999_999, 1_999_999)]
    assert extract_main_text(pages.limit(0)).count() == 0
