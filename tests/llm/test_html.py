"""Main text of pages: clusters choose, depth costs nothing extra, tables without rows."""

import time
import tracemalloc

import numpy as np
import pytest

from sparksift.llm import html_text

LONG = "<p>" + "several words of a sentence " * 12 + "</p>"


def page(n=4):
    return "<body><div><a href=a>Home page</a></div><div><a href=b>All the news</a></div><div>Sign in now</div><h1>Title</h1>" + LONG * n + "<div>Seen</div><div>12 times</div><div>Call us</div></body>"


def test_threshold_chooses_the_lines():
    text = html_text.main_text(page())
    assert text.startswith("Title\nseveral words") and "Home page" not in text and "Sign in" not in text and "Call us" not in text
    assert html_text.main_text(page(), 0).startswith("Home page\nAll the news\nSign in now\nTitle") and html_text.main_text(page(), 0).endswith("Call us")
    assert html_text.main_text(page(), 50) == ""


def test_clusters_choose_the_container():
    boxes = "<div><ul>" + "".join(f"<li><a href=x{i}>Link number {i}</a></li>" for i in range(40)) + "</ul></div>"
    html = f"<body>{boxes}<div><h2>Head</h2>{LONG * 3}<p>Short.</p></div>{boxes}</body>"
    text = html_text.main_text(html, 0.5)
    assert text.startswith("Head\n") and text.endswith("Short.") and "Link" not in text
    assert "Link number 3" in html_text.main_text(html, 0)


def test_clusters_are_smoothed_ratios():
    lines = [html_text.Line("x" * n, 0, 1, "p", 0) for n in (1, 1, 1, 300, 280, 1, 290, 1, 1, 1)]
    w = np.exp(-np.array([-2, -1, 0, 1, 2]) ** 2 / 2)
    x = np.array([1, 1, 1, 1, 1, 300, 280, 1, 290, 1, 1, 1, 1, 1], float)
    want = np.array([(x[i : i + 5] * w).sum() / w.sum() for i in range(10)])
    got = html_text.clusters(lines, 1.0)
    assert got.tolist() == (want >= want.std()).tolist()
    assert got[5] and not got[0] and not got[9]  # a short line between long ones is in their cluster


def test_menus_inside_an_article_go():
    html = f"<article><h1>T</h1><p><a href=x>One link stays.</a></p>{LONG * 3}{LONG}<p>a</p><p>b</p><p>c</p><ul><li><a href=1>Mail</a></li><li><a href=2>Post</a></li><li><a href=3>Chat</a></li></ul></article>"
    text = html_text.main_text(html)
    assert "One link stays." in text and "Mail" not in text and text.endswith("\na\nb\nc")


@pytest.mark.parametrize("tail", ["", "</i>", "</div>"])
def test_depth_is_linear(tail):
    def cost(n):
        tracemalloc.start()
        html_text.main_text("<i><div>" + "<div>" * n + "<b>" * n + (tail * n or "") + "some words")
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak

    assert cost(100_000 if not tail else 20_000) < 100e6
    began = time.time()
    html_text.main_text("<i><div>" + "<b>" * 50_000 + tail * 50_000 + "words")
    assert time.time() - began < 20


def test_long_pages_and_odd_rows(spark):
    body = "<article>" + "<p>word word word</p>" * 50_000 + "</article>"
    rows = [(1, "u", body, "t"), (2, None, None, "t"), (3, "v", "", "t"), (3, "v", "", "t"), (None, "w", "</p></p><b>x", "t")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    got = html_text.extract(pages, keep=["page_id", "url"]).collect()
    assert sorted((len(r.text), r.page_id or 0) for r in got) == [(0, 2), (0, 3), (0, 3), (1, 0), (50_000 * 15 - 1, 1)]
    assert html_text.extract(pages.limit(0), keep=["page_id"]).count() == 0
