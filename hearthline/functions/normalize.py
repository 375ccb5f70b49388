"""Normalisation of scalars, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline import keywords

SPACES = r"(?U)\s+"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column, lower: bool = False) -> Column:
    out = F.trim(F.regexp_replace(_text(c), SPACES, " "))
    return F.lower(out) if lower else out


def phone_loose(c: Column) -> Column:
    # Named once: each further use of a column would be generated, and run, again.
    return F.regexp_replace(F.regexp_replace(_text(c), r"\D+", ""), r"^8(?=\d{10}$)", "7")


def phone_strict(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(phone_loose(c), r"^7\d{10}$", 0), "^7", "+7")


def phone_keep(c: Column) -> Column:
    strict = phone_strict(c)
    return F.when(strict != "", strict).otherwise(F.trim(_text(c)))


def email(c: Column) -> Column:
    return F.lower(F.trim(_text(c)))


def address(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(_text(c))), SPACES, " ")


def organisation(c: Column, legal_forms: Iterable[str] = keywords.NAME_FORMS) -> Column:
    """A name for comparison: lower case, without quotes, brackets and legal forms, letters and digits only."""
    t = F.regexp_replace(F.lower(_text(c)), "[\"'«»()]+", " ")
    t = F.regexp_replace(t, rf"(?U)\b(?:{'|'.join(legal_forms)})\b", " ")
    return squeeze(F.regexp_replace(t, r"[^a-zа-я0-9\s]+", " "))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(_text(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]+)", 1)), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    return F.regexp_extract(_text(url), r"^[A-Za-z]+://[^/?#]+[^?#]*", 0)


def clean_url(url: Column, redirect_param: str = "uddg") -> Column:
    bare = F.regexp_replace(F.trim(_text(url)), r"[).,\]]+$", "")
    full = F.regexp_replace(bare, r"^(?![A-Za-z]+://)(//)?(?=.)", "https://")
    return F.coalesce(F.try_url_decode(F.nullif(F.regexp_extract(full, rf"[?&]{redirect_param}=([^&#]+)", 1), F.lit(""))), full)


def unwrap_redirect(url: Column, host: str = "duckduckgo.com", path: str = "/l/", param: str = "uddg") -> Column:
    """The target of a search engine's redirect; other addresses as they are."""
    target = F.try_url_decode(F.nullif(F.regexp_extract(url, rf"[?&]{param}=([^&#]+)", 1), F.lit("")))
    redirects = F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1).endswith(host) & F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1).startswith(path)
    return F.coalesce(F.when(redirects, target), url)


def external_id(url: Column, seed: Column) -> Column:
    path = F.regexp_extract(_text(url), r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    found = F.regexp_extract(path, r"\d{5,}", 0)
    return F.when(found != "", found).otherwise(F.left(F.sha1(_text(seed)), F.lit(20)))


def published_at(c: Column) -> Column:
    """Epoch seconds or one of three formats; anything else, a trailing Z included, is null."""
    epoch = F.when(c.rlike(r"^\d{9,11}(\.\d+)?$"), F.timestamp_seconds(c.try_cast("double")))
    return F.coalesce(epoch, *(F.try_to_timestamp(F.when(c.rlike(p), c), F.lit(f)) for p, f in ((r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$", "yyyy-MM-dd'T'HH:mm:ss"), (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", "yyyy-MM-dd HH:mm:ss"), (r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd"))))


def safe_float(c: Column) -> Column:
    return F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(".")).try_cast("double")


def clamp_int(c: Column, default: int, low: int, high: int) -> Column:
    return F.least(F.greatest(F.coalesce(c.cast("string").try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def channel_handle(c: Column) -> Column:
    """What stands before the first slash, without leading @, in lower case. Addresses of channels are not taken apart."""
    return F.lower(F.element_at(F.split(F.regexp_replace(F.trim(_text(c)), "^@+", ""), "/"), 1))


def channel_list(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(_text(c), r"[,\n]"), channel_handle), lambda x: x != ""))


def query_list(c: Column, default: list[str], cap: int = 20) -> Column:
    items = F.filter(F.transform(F.split(_text(c), r"[,\n]"), lambda x: F.trim(x)), lambda x: x != "")
    lowered = F.transform(items, lambda x: F.lower(x))
    first = F.filter(F.transform(items, lambda x, i: F.when(F.array_position(lowered, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())
    return F.when(F.size(first) > 0, F.slice(first, 1, cap)).otherwise(F.array(*(F.lit(x) for x in default)))


def repair_mojibake(c: Column) -> Column:
    # Signs above U+00FF cannot have come from misread bytes: such texts stay as they are.
    fixed = F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")
    return F.when(c.rlike("[ÐÑ]") & ~c.rlike("[^\\x00-\\xFF]"), fixed).otherwise(c)


def strip_markdown(c: Column) -> Column:
    t = F.regexp_replace(_text(c), r"\[([^\]]+)\]\([^)]+\)", "$1")
    return squeeze(F.regexp_replace(t, r"[*_`#>]+", " "))


def markdown_title(c: Column) -> Column:
    """What follows a `Title:` at the start of a line, else the first line that is not blank and names no source or content; null without one."""
    said = squeeze(F.regexp_extract(_text(c), r"(?imU)^\s*Title:\s*(.+?)\s*$", 1))
    lines = F.transform(F.split(_text(c), r"[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), lambda x: squeeze(x))
    first = F.get(F.filter(lines, lambda x: (x != "") & ~F.lower(x).startswith("url source:") & ~F.lower(x).startswith("markdown content:")), 0)
    return F.coalesce(F.nullif(said, F.lit("")), first)


def remap_status(c: Column, mapping: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.coalesce(known[c], c)
