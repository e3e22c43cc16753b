import time

import pytest

from marlstone.sources import outline
from marlstone.sources import readers as S


@pytest.mark.parametrize("html,expected", [
    ("<a href='/s'>single</a><a href=/bare>bare</a><A HREF=\"/u\">Upper</A>", [("/s", "single"), ("/bare", "bare"), ("/u", "Upper")]),
    ("<a class=x href='/n'>with <b>bold</b><br>word</a>", [("/n", "with bold word")]),
    ("<a href='/1'>one<a href='/2'>two</a></a>", [("/1", "one"), ("/2", "two")]),
    ("<!-- <a href='/c'>no</a> --><script>var a = \"<a href='/j'>no</a>\";</script><style>a{}</style><a href='/y'>yes</a>", [("/y", "yes")]),
    ("<a>no address</a><a href=''>empty</a><a href='/x?a=1&amp;b=2'>a &lt; b</a>", [("", "empty"), ("/x?a=1&b=2", "a < b")]),
    ("<a href='/open'>cut off", [("/open", "cut off")]), ("<![CDATA[ x ]]><![if y]><a href='/z'>z</a>", [("/z", "z")]), ("text < 3 & more", []), ("", []), (None, []),
])
def test_links(html, expected):
    assert [(x["url"], x["title"]) for x in outline.links(html)] == expected


def titles(html, most=15):
    return [(x["title"], x["url"], x["unit"], x["date"]) for x in outline.announcements(html, S.NAVIGATION, most)]


def test_only_the_content_area_counts():
    menu, own, other = "<a href='/m'>a menu entry of a page</a>", "<a href='/o'>an announcement itself</a>", "<a href='/p'>one of the list of pages</a>"
    assert [t[1] for t in titles(menu + own)] == ["/m", "/o"]
    assert [t[1] for t in titles(f"{menu}<div class='wide mpgdetail'><div><p>{own}</div></div>{menu}")] == ["/o"]
    assert [t[1] for t in titles(f"<div id=pageptlist>{other}</div><div class=mpgdetail>{own}</div>")] == ["/o"]
    assert [t[1] for t in titles(f"{menu}<div id=pageptlist>{other}</div>")] == ["/p"]
    assert titles(f"{menu}<div class=mpgdetail></div>") == []
    assert [t[1] for t in titles(f"<div class=mpgdetail>{own}")] == ["/o"]  # never closed


def test_tables_within_tables_and_open_cells():
    inner = "<table><tr><td>x<td><a href='/in'>an inner link</a></table>"
    html = f"<table class='a table'><thead><tr><th>Date<th>Title</thead><tr><td>2026-03-01<td><a href='/a'>最新<b>公告</b></a>{inner}<td>Office <i>A</i></td></tr><tr><td>{inner}</td><td>no link</td></tr><tr><td>one</table><a href='/z'>a long enough link</a><table class=table><tr><td><a href='/2'>second table</a><td>x</table>"
    assert titles(html) == [("最新公告", "/a", "Office A", "2026-03-01"), ("an inner link", "/in", "", "")]
    assert titles(html, most=1) == []  # the head is a row
    assert titles("<table class=table></table><a href='/z'>a long enough link</a>") == []


def test_time_grows_in_a_straight_line():
    for html in ("<b>" * 200_000 + "</i>" * 200_000, "<a href=x>" * 200_000, "<table><tr><td>" * 50_000, "<td>" * 200_000 + "</td>" * 200_000, "<div class=mpgdetail>" * 100_000 + "</div>" * 100_000):
        began = time.time()
        outline.announcements(html, S.NAVIGATION, 15)
        assert time.time() - began < 10


def test_pages_of_a_table(spark):
    pages = spark.createDataFrame([(1, "<a href='/a'>short</a><a href='javascript:x'>a script of the page</a><a href='/b'>a long enough title</a><a href='/c'>a long enough title</a>", "extra"), (2, None, ""), (3, "", None)], "page_id long, html string, title string")
    assert [tuple(r) for r in S.announcements(pages, "http://site").collect()] == [(1, 0, "a long enough title", "http://site/b", "", "")]
    assert [r.url for r in S.page_links(pages, least=6).collect()] == ["javascript:x", "/b", "/c"]
    assert S.page_links(pages.limit(0)).count() == 0 and S.announcements(pages.limit(0), "").count() == 0
