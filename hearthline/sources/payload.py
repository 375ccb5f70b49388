"""What only a walk through nested payloads and markup finds: records, contacts with their place, phone, address and picture.

The walks are small Python helpers over one row each, run as Arrow-batched functions; everything around them stays in
Column expressions. Null, empty and broken input gives empty results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline.functions import extract as X

#: Levels below the top and entries of a list that a walk looks at.
DEPTH, ENTRIES = 4, 50
# Keys that are looked at first, key groups of a listing record, markup that carries contacts.
PHONE_KEYS = ("phone", "phones", "telephone", "mobile", "contactPhone", "contact_phone", "sellerPhone", "calltracking", "calltrackingNumber", "formattedPhone", "tel")
IMAGE_KEYS = ("image", "image_url", "imageUrl", "photo", "photo_url", "photoUrl", "preview", "thumbnail", "cover", "gallery", "images", "photos")
ADDRESS_PARTS = ("addressRegion", "addressLocality", "streetAddress", "addressLine")
ADDRESS_HINTS = ("address", "location", "geo", "place", "region", "locality", "street")
RECORD_KEYS = (("title", "name", "heading"), ("price", "cost", "price_value", "amount"), ("address", "location", "addressraw", "streetaddress"), ("area", "area_sqm", "square", "sqm", "floorarea"), ("url", "link", "href", "detail_url"))
PHONE_ATTRIBUTES = ("data-phone", "data-tel", "data-contact-phone", "data-qa-phone", "data-phone-number")
SELLER_SIGNS = ("seller", "owner", "agent", "contact", "phone", "realtor", "broker")
# The patterns of extract.py; Python's \s holds all that counts as white space there.
_PHONE, _EMAIL, _IMAGE = (re.compile(p.replace(X.SPACE, r"\s")) for p in (X.PHONE, X.EMAIL, X.IMAGE_FILE))
_PATTERNS = {"phone": _PHONE, "email": _EMAIL}
_SCRIPT = re.compile(r"""<script\b[^>]*\btype\s*=\s*["']application/(?:ld\+)?json["'][^>]*>(.*?)</script>""", re.IGNORECASE | re.DOTALL)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTACT = "array<struct<type:string,value:string,location:string,context:string>>"


def _load(text) -> object:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def _squeeze(text) -> str:
    return " ".join(str(text or "").split())


def _leaves(node, first: tuple[str, ...], depth: int = 0) -> Iterator[str]:
    """Strings below node in search order: preferred keys of a level come before the others."""
    if node is None or depth > DEPTH:
        return
    if isinstance(node, str):
        yield node
    elif isinstance(node, dict):
        for key in (*(k for k in first if k in node), *(k for k in node if k not in first)):
            yield from _leaves(node[key], first, depth + 1)
    elif isinstance(node, list):
        for item in node[:ENTRIES]:
            yield from _leaves(item, first, depth + 1)


def _phone(node) -> str | None:
    return next((_squeeze(m.group(0)) for m in map(_PHONE.search, _leaves(node, PHONE_KEYS)) if m), None)


def _image(node, base: str) -> str | None:
    return next((urljoin(base, x) for x in _leaves(node, IMAGE_KEYS) if _IMAGE.search(x)), None)


def _is_address(text: str) -> bool:
    t = _squeeze(text).lower()
    return len(t) >= 6 and not t.startswith("http") and (any(map(str.isdigit, t)) or any(w in t for w in X.ADDRESS_WORDS))


#: Where an address may be, in the order of the search: a dictionary gives what lies below it, or a text that is the answer, as a tuple.
ADDRESS_STEPS = (
    lambda d: [d["address"]] if d.get("address") else [],
    lambda d: [(", ".join(dict.fromkeys(p)),)] if (p := [t for k in ADDRESS_PARTS if isinstance(d.get(k), str) and (t := _squeeze(d[k]))]) else [],
    lambda d: [v for k, v in d.items() if k[:1] != "@" and any(w in k.lower() for w in ADDRESS_HINTS)],
)


def _address(node) -> str | None:
    agenda: list[tuple[int, object]] = [(0, node)]
    while agenda:
        depth, x = agenda.pop()
        if isinstance(x, tuple):
            return x[0]
        if isinstance(x, str) and depth <= DEPTH and _is_address(x):
            return _squeeze(x)
        below = [] if depth > DEPTH else [v for step in ADDRESS_STEPS for v in step(x)] if isinstance(x, dict) else x[:ENTRIES] if isinstance(x, list) else []
        agenda += [(depth + 1, v) for v in reversed(below)]
    return None


def is_listing_record(keys: Column) -> Column:
    """Whether an array of keys names at least two of the five groups of a listing record."""
    low = F.transform(keys, lambda k: F.lower(k))
    hits = [F.arrays_overlap(low, F.array(*map(F.lit, group))).cast("int") for group in RECORD_KEYS]
    return F.coalesce(sum(hits[1:], hits[0]) >= 2, F.lit(False))


def _records(node) -> Iterator[dict]:
    if isinstance(node, dict):
        keys = {k.lower() for k in node}
        if sum(not keys.isdisjoint(group) for group in RECORD_KEYS) >= 2:
            yield node
        else:
            for value in node.values():
                yield from _records(value)
    elif isinstance(node, list):
        for item in node:
            yield from _records(item)


def _page_records(page) -> list[str]:
    found: dict = {}
    for script in _SCRIPT.findall(page or ""):
        for record in _records(_load(script)):
            name = next((str(record[k]) for k in ("id", "external_id", "url", "link") if record.get(k)), None)
            found.setdefault(name if name else object(), record)
    return [json.dumps(r, ensure_ascii=False) for r in found.values()]


def _fields(payload: pd.Series, base: pd.Series) -> pd.DataFrame:
    nodes = [_load(p) for p in payload]
    return pd.DataFrame({"phone": [_phone(n) for n in nodes], "address": [_address(n) for n in nodes], "image": [_image(n, b or "") for n, b in zip(nodes, base)]}, dtype=object)


def _said(text: str, location: str, context: str, kinds=(("phone", _PHONE), ("email", _EMAIL))) -> Iterator[dict]:
    for kind, pattern in kinds:
        for value in pattern.findall(text):
            yield {"type": kind, "value": value, "location": location, "context": _squeeze(context)}


def strings(node) -> Iterator[tuple[tuple, str]]:
    """(path, text) of every string of a payload, in its order; a path holds keys and list places. Any depth."""
    agenda: list[tuple[tuple, object]] = [((), node)]
    while agenda:
        path, x = agenda.pop()
        if isinstance(x, str):
            yield path, x
        entries = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()
        agenda += [((*path, k), v) for k, v in reversed(list(entries))]


#: What a string is searched for: words of its own key, the kind of contact, and the context that is noted (None: the key). The last two hold for any string.
READINGS = ((("mail",), "email", None), (("phone", "tel", "contact"), "phone", None), (("",), "phone", "payload_text"), (("",), "email", "payload_text"))


def _payload_contacts(node) -> Iterator[dict]:
    for path, text in strings(node):
        key = path[-1].lower() if path and isinstance(path[-1], str) else ""
        for words, kind, context in READINGS:
            if any(w in key for w in words):
                yield from _said(text, "json_payload", context or key, ((kind, _PATTERNS[kind]),))


class _Markup(HTMLParser):
    """Contacts of a page by how they are marked: telephone links, mail links, attributes, then blocks about the seller."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.found: list[list[tuple[int, list[dict]]]] = [[], [], [], []]
        self.seen = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.seen += 1
        self.open.append({"tag": tag, "at": {k: v or "" for k, v in attrs}, "text": [], "order": self.seen})
        if tag in _VOID:
            self._close()

    def handle_endtag(self, tag: str) -> None:
        if any(e["tag"] == tag for e in self.open):
            while self._close() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["tag"] not in ("script", "style"):
            for e in self.open:
                e["text"].append(data)

    def close(self) -> None:
        super().close()
        while self.open:
            self._close()

    def _place(self, e: dict) -> str:
        for parent in reversed(self.open):
            if parent["tag"] in ("footer", "header"):
                return parent["tag"]
        meta = f"{e['at'].get('class', '')} {e['at'].get('id', '')}".lower()
        for place, words in (("footer", ("footer", "подвал")), ("header", ("header", "шапк")), ("seller_block", SELLER_SIGNS)):
            if any(w in meta for w in words):
                return place
        return "listing_body"

    def _close(self) -> str:
        e = self.open.pop()
        at, text, href = e["at"], _squeeze(" ".join(e["text"])), e["at"].get("href", "")
        place = self._place(e)
        about = text or (_squeeze(" ".join(self.open[-1]["text"])) if self.open else "")

        def add(kind: int, rows: list[dict]) -> None:
            self.found[kind].append((e["order"], rows))

        if e["tag"] == "a" and href.startswith("tel:"):
            number = re.search(r"tel:\s*([+\d][\d\s\-()]{9,})", href, re.IGNORECASE)
            add(0, [{"type": "phone", "value": number.group(1) if number else "", "location": place, "context": about}])
        if e["tag"] == "a" and href.startswith("mailto:"):
            add(1, [{"type": "email", "value": href[7:].split("?", 1)[0], "location": place, "context": about}])
        for k, name in enumerate(PHONE_ATTRIBUTES):
            if name in at:
                number = _PHONE.search(at[name])
                self.found[2].append((k * 10**9 + e["order"], [{"type": "phone", "value": number.group(0) if number else at[name], "location": place, "context": text}]))
        if any(w in at.get("class", "") for w in SELLER_SIGNS) or any(w in at.get("id", "") for w in ("seller", "owner", "agent", "contact")):
            add(3, list(_said(text, place, text)))
        return e["tag"]


def _page_contacts(page) -> list[dict]:
    m = _Markup()
    m.feed(page or "")
    m.close()
    return [c for kind in m.found for _, rows in sorted(kind, key=lambda x: x[0]) for c in rows if c["value"]]


def _each(one, kind: str, column) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(one)

    return F.pandas_udf(run, kind)(column)


def embedded_records(html) -> Column:
    """JSON texts of the listing records in a page's JSON scripts, each id or address once."""
    return _each(_page_records, "array<string>", html)


def payload_fields(payload, base) -> Column:
    """First phone, address and picture of a nested JSON payload; pictures are resolved against base."""
    return F.pandas_udf(_fields, "phone string, address string, image string")(payload, base)


def payload_contacts(payload) -> Column:
    """Contacts that a nested JSON payload names, those under a telling key before those in other strings of it."""
    return _each(lambda p: list({(c["type"], c["value"]): c for c in reversed(list(_payload_contacts(_load(p))))}.values())[::-1], CONTACT, payload)


def markup_contacts(html) -> Column:
    """Contacts that a page marks as such, with the place of their element: footer, header, seller_block or listing_body."""
    return _each(_page_contacts, CONTACT, html)
