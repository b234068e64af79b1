import random

import pytest

from marginwise.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no";</script></head><body class="page">
<header><a href=/>Home</a> <h2>Site name</h2></header><nav><ul><li><a href=a>One</a></li><li>Two</li></ul></nav>
<div id="cookie-notice"><p>We use cookies to make this site better. Please accept all of these now.</p></div>
<!-- <p>hidden</p> --><div class="wrap"><div class="post-content"><h1>Title&nbsp;here &amp; there</h1>
<p>First   part with a <a href=x>link</a> in it,<br>and more words so that it reads like prose.<p>Short.</p>
<div class="ad">Buy this now!</div><ul><li>point one is here.</li></ul></div>
<aside><p>Popular things that others read, a long sentence too, isn't it.</p></aside></div>
<form><label>Mail</label><input></form><section id="comments"><p>Great article, thanks for it!</p></section><footer>&copy; us</footer></body></html>"""


def test_article():
    want = ["Title here & there", "First part with a link in it, and more words so that it reads like prose.", "Short.", "point one is here."]
    assert html.main_text(PAGE, {}).split("\n\n") == want


@pytest.mark.parametrize("page", [None, "", "   ", "<p>", "<div><nav>menu</nav></div>", "<!-- open", "<script>x"])
def test_pages_without_content(page):
    assert html.main_text(page, {}) == ""


@pytest.mark.parametrize("page", ["<<<>>><a", "<p " + "x" * 50_000, "<div>" * 3000 + "deep", "</p></div>text", "<a <b <c"])
def test_broken_pages_are_read(page):
    assert isinstance(html.main_text(page, {}), str)


def test_titles_in_headers_of_the_article():
    inside = "<header><a href=/>Site</a></header><article><header class=entry-header><h1>The title</h1></header><p>Text of it.</p></article>"
    assert html.main_text(inside, {}) == "The title\n\nText of it."
    named = "<div id=header>Site</div><div class='post-header'><h1>The title</h1></div><div class=postContent><p>Text of it.</p></div>"
    assert html.main_text(named, {}) == "The title\n\nText of it."


def brute_cut(unary, edges):
    best, found = None, None
    for mask in range(1 << len(unary)):
        label = [bool(mask >> i & 1) for i in range(len(unary))]
        cost = sum(max(0, -u) if keep else max(0, u) for u, keep in zip(unary, label))
        cost += sum(w for i, j, w in edges if label[i] != label[j])
        if best is None or cost < best - 1e-9:
            best, found = cost, label
    return best, found


def cut_cost(unary, edges, label):
    cost = sum(max(0, -u) if keep else max(0, u) for u, keep in zip(unary, label))
    return cost + sum(w for i, j, w in edges if label[i] != label[j])


def test_minimum_cut_against_brute_force():
    draw = random.Random(4)
    for _ in range(200):
        n = draw.randint(1, 9)
        unary = [draw.uniform(-3, 3) for _ in range(n)]
        edges = [(i, i + 1, draw.uniform(0, 3)) for i in range(n - 1)] + [(0, n - 1, draw.uniform(0, 2))] * (n > 2)
        best, _ = brute_cut(unary, edges)
        assert cut_cost(unary, edges, html.minimum_cut(unary, edges)) == pytest.approx(best)


def test_smoothing_rescues_a_doubtful_block():
    assert html.minimum_cut([3.0, -0.5, 3.0], [(0, 1, 1.0), (1, 2, 1.0)]) == [True, True, True]
    assert html.minimum_cut([-3.0, 0.5, -3.0], [(0, 1, 1.0), (1, 2, 1.0)]) == [False, False, False]


def test_frame(spark):
    rows = [(1, PAGE, "x", 5), (2, None, None, 6), (1, PAGE, "x", 7), (3, "<p>" + "long words here " * 20_000, "y", 8)]
    pages = spark.createDataFrame(rows, "page_id int, html string, text string, n_chars int")
    found = html.extract(pages)
    assert found.columns == ["page_id", "html", "text", "n_chars"]
    got = found.collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] == 2] == [""]
    assert html.extract(pages.limit(0)).count() == 0
