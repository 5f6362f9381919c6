import time

import pytest

from noticeloom.llm.urlfilter import filter_urls, page_aliases, resolved

PAGE = "http://h.org/a/b/c.html?x=1"


@pytest.mark.parametrize(
    ("ref", "want"),
    [
        ("d.html", "http://h.org/a/b/d.html"),
        ("../d", "http://h.org/a/d"),
        ("../../../d/./e/..", "http://h.org/d/"),
        ("?p=2", "http://h.org/a/b/c.html?p=2"),
        ("#top", "http://h.org/a/b/c.html?x=1#top"),
        ("/d/../e?q=/../", "http://h.org/e?q=/../"),
        ("//o.net/x", "http://o.net/x"),
        ("https://o.net", "https://o.net"),
    ],
)
def test_references(ref, want):
    assert resolved(PAGE, ref) == want
    assert page_aliases(PAGE, f'<link href="{ref}" rel="canonical">') == [want]


def test_forms_of_links():
    assert resolved("http://h.org", "d") == "http://h.org/d"
    assert page_aliases(PAGE, "<LINK REL=canonical HREF=d.html>") == ["http://h.org/a/b/d.html"]
    assert page_aliases(PAGE, "<link rel='alternate canonical' title=it's href='/s?a=1&amp;b=2&copy=3&#38;d&lt'>") == ["http://h.org/s?a=1&b=2&copy=3&d<"]
    assert page_aliases(PAGE, '<link rel=canonical href="/1"><meta content="0;URL=\'/2\'" http-equiv=Refresh><link href=/3 rel=canonical>') == ["http://h.org/1", "http://h.org/2", "http://h.org/3"]
    assert page_aliases(PAGE, '<meta http-equiv="refresh" content="5; ../z"><meta http-equiv=refresh content=9>') == ["http://h.org/a/z"]
    assert page_aliases(PAGE, '<!-- <link rel=canonical href=/n> --><script>"<link rel=canonical href=/n>"</script><link rel=icon href=/canonical>') == []
    assert page_aliases(PAGE, '<base href="/root/"><link title="a > b" rel=canonical href="q">') == ["http://h.org/root/q"]
    assert page_aliases(PAGE, "<link " + "=a" * 200_000) == []


def test_relative_aliases_carry_blocks(spark):
    link = "<link rel=canonical href={}>"
    rows = [
        (1, "http://x.org/d/a", link.format("b")), (2, "http://x.org/d/b", link.format("../e/?p=1&amp;q=2")), (3, "http://x.org/e/?p=1&q=2", link.format("http://x.org/one") + link.format("http://s.net/fr/")),
        (4, "http://x.org/other", link.format("b")), (5, None, link.format("b")), (6, "plain", link.format("b")),
    ]
    got = {r.page_id: (r.verdict, r.via) for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("block", "alias") for i in (1, 2, 3)} | {i: ("allow", "default") for i in (4, 5, 6)}


def test_unclosed_tags_are_passed_once():
    began = time.perf_counter()
    assert page_aliases("https://a.org/", "<link " * 100_000) == []
    assert page_aliases("https://a.org/", '<link rel=canonical href="/x">' + "<meta " * 100_000) == ["https://a.org/x"]
    assert time.perf_counter() - began < 3
