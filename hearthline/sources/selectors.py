"""Configured selectors: links of a page by the item and link selectors of its source.

A selector is a list, by commas, of steps by blanks (inside) or > (directly inside); a step is a tag, classes, an id and attribute
tests. Steps are matched from the root down while tags are read: an element inherits from its parent which beginnings of a
selector are fulfilled above it, so matching costs the elements times the steps, however deep they nest.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions import extract as X
from hearthline.functions import normalize as N

_PART = re.compile(r"""\s*(?P<comma>,)\s*|\s*(?P<child>>)\s*|(?P<blank>\s+)|(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TESTS = {
    "=": lambda own, v: own == v, "~=": lambda own, v: v != "" and v in own.split(), "^=": lambda own, v: v != "" and own.startswith(v), "$=": lambda own, v: v != "" and own.endswith(v),
    "*=": lambda own, v: v != "" and v in own, "|=": lambda own, v: own == v or own.startswith(v + "-"),
}


def compiled(selector: str) -> list[list[tuple[bool, list]]]:
    """Alternatives of steps (directly inside the step before, tests of one element)."""
    out, steps, tests, direct, at = [], [], [], False, 0
    text = selector.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"selector {selector!r} cannot be read at {text[at:]!r}")
        at = m.end()
        if m["comma"] or m["child"] or m["blank"]:
            if not tests:
                raise ValueError(f"selector {selector!r} has an empty step")
            steps, tests, direct = [*steps, (direct, tests)], [], bool(m["child"])
            if m["comma"]:
                out, steps = [*out, steps], []
        elif m["tag"]:
            tests.append(("tag", m["tag"].lower(), None, None))
        elif m["cls"] or m["id"]:
            tests.append(("attr", "class" if m["cls"] else "id", _TESTS["~="] if m["cls"] else _TESTS["="], m["cls"] or m["id"]))
        else:
            value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), None)
            tests.append(("attr", m["attr"].lower(), _TESTS[m["op"]] if m["op"] else None, value))
    if text and not tests:
        raise ValueError(f"selector {selector!r} ends in an empty step")
    return [*out, [*steps, (direct, tests)]] if text else []


def _holds(tests: list, tag: str, attrs: dict[str, str]) -> bool:
    for kind, name, test, value in tests:
        if kind == "tag":
            if name not in ("*", tag):
                return False
        elif name not in attrs or (test and not test(attrs[name], value)):
            return False
    return True


class _Reader(HTMLParser):
    """Elements as (attributes, parent, which selectors they match); parents come before what is inside."""

    def __init__(self, selectors: list[list]) -> None:
        super().__init__(convert_charrefs=True)
        self.selectors, self.elements, self.open, self.names = selectors, [], [-1], Counter()
        none = [[(frozenset(), frozenset()) for _ in alternatives] for alternatives in selectors]
        self.states = {-1: none}  # of open elements: beginnings fulfilled by the element, and by it or anything above

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found: dict[str, str] = {}
        for k, v in attrs:
            found[k] = v or ""
        parent = self.open[-1]
        above, own, matched = self.states[parent], [], []
        for k, alternatives in enumerate(self.selectors):
            rows, full = [], False
            for n, steps in enumerate(alternatives):
                parent_here, anywhere = above[k][n]
                here = {i + 1 for i, (direct, tests) in enumerate(steps) if (i == 0 or i in (parent_here if direct else anywhere)) and _holds(tests, tag, found)}
                full |= len(steps) in here
                rows.append((frozenset(here), anywhere | here))
            own.append(rows)
            matched.append(full)
        self.elements.append((found, parent, matched))
        if tag not in _VOID:
            number = len(self.elements) - 1
            self.open.append(number)
            self.states[number] = own
            self.names[tag] += 1
            self._tags = getattr(self, "_tags", [None])
            self._tags.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close()

    def handle_endtag(self, tag: str) -> None:
        while self.names[tag] > 0:
            if self._close() == tag:
                return

    def _close(self) -> str:
        tag = self._tags.pop()
        self.names[tag] -= 1
        del self.states[self.open.pop()]
        return tag


def selected_links(html: str, item: str, link: str = "a", attr: str = "href") -> list[str]:
    """Targets of the links inside the items of a page, as written.

    An item without a link inside is a link itself. Where no item is found the links of the page are items; without an item
    selector they are too, but then only links inside links count.
    """
    reader = _Reader([compiled(item), compiled(link)])
    reader.feed(html or "")
    reader.close()
    elements = reader.elements
    items = [i for i, (_, _, m) in enumerate(elements) if m[0]]
    candidates = set(items or [i for i, (_, _, m) in enumerate(elements) if m[1]])
    # The candidates around each element: whether there is one is known from its parent.
    around, filled, targets = [False] * len(elements), set(), []
    nearest = [-1] * len(elements)
    for i, (_, parent, matched) in enumerate(elements):
        if parent >= 0:
            nearest[i] = parent if parent in candidates else nearest[parent]
            around[i] = nearest[i] >= 0
        if around[i] and matched[1]:
            targets.append(i)
            up = nearest[i]
            while up >= 0 and up not in filled:
                filled.add(up)
                up = nearest[up]
    if item.strip():
        targets += [i for i in candidates if i not in filled]
    return [t for i in sorted(targets) if (t := (elements[i][0].get(attr) or elements[i][0].get("href") or ""))]


def configured_links(pages: DataFrame, configs: DataFrame) -> DataFrame:
    """page_id, links: sorted distinct canonical links of each page by its source's selectors.

    pages: page_id, url, html; configs: domain, item_selector, link_selector, link_attr. Pages without a configuration are left out.
    """
    @F.pandas_udf("array<string>")
    def found(html: pd.Series, item: pd.Series, link: pd.Series, attr: pd.Series) -> pd.Series:
        return pd.Series([selected_links(*row) for row in zip(html, item, link, attr)])

    default = lambda c, value: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(value))
    set_ = configs.select("domain", F.coalesce("item_selector", F.lit("")).alias("item"), default("link_selector", "a").alias("link"), default("link_attr", "href").alias("attr"))
    rows = pages.withColumn("domain", N.domain(F.col("url"))).join(set_, "domain")
    hrefs = rows.select("page_id", "url", found(F.coalesce("html", F.lit("")), "item", "link", "attr").alias("hrefs"))
    return hrefs.select("page_id", F.array_sort(F.array_distinct(F.transform("hrefs", lambda h: _canonical(X.resolve_link(F.col("url"), h))))).alias("links"))


def _canonical(link: Column) -> Column:
    return F.regexp_extract(link, r"^[^?#]*", 0)
