"""Extraction from raw text and HTML, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline import keywords

from .normalize import _text, squeeze

# What counts as white space, a phone, an e-mail, an address on the web, and the words before an address or in a street.
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
PHONE = rf"(?:\+7|8)[{SPACE}\-()]*\d{{3}}[{SPACE}\-()]*\d{{3}}[{SPACE}\-]*\d{{2}}[{SPACE}\-]*\d{{2}}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = rf"https?://[^{SPACE}<>\")\]]+"
PRICE = rf"(?iu)(\d[\d{SPACE}]{{2,}})[{SPACE}]*(?:руб|₽)"
AREA = rf"(?iu)(\d+(?:[.,]\d+)?)[{SPACE}]*(?:м2|м²|кв\.?[{SPACE}]*м|sqm|sq\.?[{SPACE}]*m)"
ADDRESS = rf"(?iu)(?:адрес|location)[{SPACE}]*[:\-][{SPACE}]*([^\n\r|;]{{8,150}})"
STREET = r"(?iuU)\b(?:ул\.?|улица|пр-?кт|проспект|пер\.?|переулок|шоссе|бульвар|наб\.?|набережная|проезд|пл\.?|площадь|мкр\.?|микрорайон)\s*[^,;\n]{3,80}"
ADDRESS_WORDS = ("ул", "улиц", "просп", "пр-кт", "шоссе", "район", "street", "st.", "ave")
IMAGE_FILE = r"(?i)\.(?:jpg|jpeg|png|webp)(?:\?|$)"


def any_keyword(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words), F.lit(False))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(pattern), group)


def price(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(_text(text), PRICE, 1), r"\D+", "").try_cast("double")


def area(text: Column) -> Column:
    return F.replace(F.regexp_extract(_text(text), AREA, 1), F.lit(","), F.lit(".")).try_cast("double")


def labelled_address(text: Column) -> Column:
    return F.nullif(squeeze(F.regexp_extract(_text(text), ADDRESS, 1)), F.lit(""))


def district(text: Column, known: Iterable[str]) -> Column:
    lowered = F.lower(_text(text))
    listed = F.coalesce(*(F.when(F.contains(lowered, F.lit(d.lower())), F.lit(d)) for d in known), F.lit(None).cast("string"))
    return F.coalesce(listed, F.nullif(F.regexp_extract(_text(text), r"([А-ЯЁа-яё-]{4,})\s+район", 1), F.lit("")))


def street(text: Column, addr: Column) -> Column:
    """The street named in the address, or in the text where there is no address; else the whole address."""
    given = F.nullif(addr, F.lit(""))
    found = F.regexp_extract(F.coalesce(given, _text(text)), STREET, 0)
    return F.when(found != "", squeeze(found)).otherwise(squeeze(given))


def address_candidate(text: Column, tokens: Iterable[str] = ADDRESS_WORDS) -> Column:
    t = squeeze(text)
    return (F.length(t) >= 6) & ~F.lower(t).startswith("http") & (t.rlike(r"\d") | any_keyword(F.lower(t), tokens))


def listing_type(url: Column, text: Column, rent_urls: Iterable[str] = keywords.RENT_URLS, sale_urls: Iterable[str] = keywords.SALE_URLS, rent: Iterable[str] = keywords.LISTING_RENT, sale: Iterable[str] = keywords.LISTING_SALE) -> Column:
    u, t = F.lower(_text(url)), F.lower(_text(text))
    return F.when(any_keyword(u, rent_urls), "rent").when(any_keyword(u, sale_urls), "sale").when(any_keyword(t, rent), "rent").when(any_keyword(t, sale), "sale")


def intent(text: Column, investor: Iterable[str] = keywords.INVESTOR, tenant: Iterable[str] = keywords.TENANT, seller: Iterable[str] = keywords.SELLER) -> Column:
    t = F.lower(_text(text))
    return F.when(any_keyword(t, investor), "investor").when(any_keyword(t, tenant), "tenant").when(any_keyword(t, seller), "seller").otherwise("unknown")


def organisations(text: Column, forms: Iterable[str] = tuple(f.upper() for f in keywords.LEGAL_FORMS)) -> Column:
    pattern = rf"(?iu)(?U)\b({'|'.join(forms)})\s+\"?([A-Za-zА-Яа-я0-9 .\-]{{2,}})\"?"
    both = F.arrays_zip(all_matches(text, pattern, 1).alias("f"), all_matches(text, pattern, 2).alias("n"))
    return F.transform(both, lambda x: F.concat(F.upper(x["f"]), F.lit(" "), squeeze(x["n"])))


def page_title(html: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_extract(_text(html), r"(?s)<title>(.*?)</title>", 1), r"<[^>]+>", " "))


def page_heading(html: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_extract(_text(html), r"(?s)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", " "))


def page_text(html: Column) -> Column:
    bare = F.regexp_replace(_text(html), r"(?s)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    return squeeze(F.regexp_replace(bare, r"(?s)<[^>]+>", " "))


def image_url(html: Column, url: Column | None = None) -> Column:
    """The page's own preview picture, else its first picture that is not inlined; resolved where the page's address is given."""
    metas = F.filter(all_matches(html, r"(?is)<meta\b[^>]*>"), lambda m: m.rlike(r"""(?i)(?:property|name)\s*=\s*["'](?:og|twitter):image["']"""))
    shown = F.trim(F.regexp_extract(F.get(metas, 0), r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1))
    pictures = F.filter(F.transform(all_matches(html, r"""(?is)<img\b[^>]*?\bsrc\s*=\s*["']([^"']*)["']""", 1), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("data:"))
    found = F.coalesce(F.nullif(shown, F.lit("")), F.get(pictures, 0))
    return found if url is None else F.when(found.isNotNull(), resolve_link(url, found))


def anchors(html: Column, cap: int = 400) -> Column:
    """Structs (href, text) of the first cap anchors with an address, without those that lead nowhere else."""
    pattern = F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>""")
    both = F.slice(F.arrays_zip(F.regexp_extract_all(_text(html), pattern, 1).alias("h"), F.regexp_extract_all(_text(html), pattern, 2).alias("t")), 1, cap)
    made = F.transform(both, lambda x: F.struct(F.trim(x["h"]).alias("href"), squeeze(F.regexp_replace(x["t"], r"(?s)<[^>]*>", " ")).alias("text")))
    return F.filter(made, lambda x: ~x["href"].rlike(r"^(?:#|mailto:|tel:|$)"))


def links(html: Column, cap: int = 400) -> Column:
    return F.transform(anchors(html, cap), lambda x: x["href"])


def fold_dots(path: Column) -> Column:
    """An absolute path without . and .. segments."""
    parts = F.split(path, "/")
    folded = F.aggregate(
        F.slice(parts, 2, 100_000), F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)),
    )
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    joined = F.concat(F.lit("/"), F.array_join(folded, "/"))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(joined, F.when(joined == "/", "").otherwise(tail))).otherwise(path)


def resolve_link(url: Column, href: Column) -> Column:
    """href as seen from the page at url: against its scheme, host, path or directory, with dots folded."""
    base = _text(url)
    scheme, root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    own, rest = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href == "", base)
        .when(href.startswith("#"), F.concat(root, path, query, href)).when(href.startswith("?"), F.concat(root, path, href))
        .when(href.startswith("/"), F.concat(root, fold_dots(own), rest)).otherwise(F.concat(root, fold_dots(F.concat(folder, own)), rest))
    )


def hint_count(text: Column, hints: Iterable[str]) -> Column:
    t = F.lower(_text(text))
    return reduce(lambda a, b: a + b, (F.contains(t, F.lit(h)).cast("int") for h in hints), F.lit(0))


def sitemap_urls(xml: Column, hints: Iterable[str], cap: int = 80) -> Column:
    found = F.transform(all_matches(xml, r"(?i)<loc>([^<]+)</loc>", 1), lambda u: F.trim(squeeze(u)))
    return F.slice(F.filter(found, lambda u: hint_count(u, hints) > 0), 1, cap)


def keywords_of(text: Column, least: int = 5) -> Column:
    """Lower-case words of at least that many signs, in order, without the punctuation around them."""
    words = F.transform(F.split(_text(text), rf"[{SPACE}]+"), lambda w: F.lower(F.regexp_replace(w, r"""^[.,:;!?()\[\]{}"']+|[.,:;!?()\[\]{}"']+$""", "")))
    return F.filter(words, lambda w: F.length(w) >= least)


def summary(text: Column, cap: int = 260) -> Column:
    t = squeeze(text)
    return F.when(F.length(t) > cap, F.concat(F.left(t, F.lit(cap - 3)), F.lit("..."))).otherwise(t)
