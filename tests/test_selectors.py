"""Configured selectors on small pages."""

import time

import pytest

from hearthline.sources import selectors

PAGE = """<div class="list big"><div class='card first'><a href="/a/1?x=1">one</a><a data-u="/u" href="/a/2">two</a></div>
<p class="card" data-u="/self">no link<br></p><section><div class=card><span><a href='../b'>b</a></span></div></section></div>
<div id="foot"><a href="https://o.p/q#z" rel="nofollow me">foot</a><a>none</a></div>"""


def links(*config):
    return selectors.selected_links(PAGE, *config)


def test_items_and_links():
    assert links(".card", "a", "href") == ["/a/1?x=1", "/a/2", "../b"]
    assert links(".card", "a", "data-u") == ["/a/1?x=1", "/u", "/self", "../b"]
    assert links(".absent", "a", "href") == ["/a/1?x=1", "/a/2", "../b", "https://o.p/q#z"] and links("", "a", "href") == []
    assert links("#foot", "a[rel~=me]") == ["https://o.p/q#z"] and links("#foot", "a[rel=me]") == []
    assert links("div.card > a") == ["/a/1?x=1", "/a/2"] and links("div.card a, #foot a") == ["/a/1?x=1", "/a/2", "../b", "https://o.p/q#z"]
    assert links("div > div", "a[href^='/a']") == ["/a/1?x=1", "/a/2"] and links(".list", "a[href$=\"1\"]") == ["/a/1?x=1"] and links(".list", "section a[href*=b]") == ["../b"]
    assert links(".big.list", "*[data-u]") == ["/a/2"] and selectors.selected_links("", ".x") == []


def test_bad_selectors_are_refused():
    for bad in ("a:hover", "a,,b", "> a", "a >", "a["):
        with pytest.raises(ValueError):
            selectors.compiled(bad)


def test_deep_and_broken_markup_takes_time_in_proportion():
    deep = "<div class=x><i>" * 40000 + "<a href=z>" + "</b>" * 40000
    began = time.time()
    assert selectors.selected_links(deep, ".x", "div a") == ["z"] and time.time() - began < 20


def test_pages_meet_the_configuration_of_their_domain(spark):
    pages = spark.createDataFrame([(1, "https://www.a.b/c/d", PAGE), (2, "https://other.x/", PAGE), (3, "https://q.r/", None)], "page_id long, url string, html string")
    configs = spark.createDataFrame([("a.b", ".card", None, ""), ("q.r", None, None, None)], "domain string, item_selector string, link_selector string, link_attr string")
    got = {r.page_id: r.links for r in selectors.configured_links(pages, configs).collect()}
    assert got == {1: ["https://www.a.b/a/1", "https://www.a.b/a/2", "https://www.a.b/b"], 3: []}
