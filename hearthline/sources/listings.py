"""Sources and sinks of listings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline import keywords
from hearthline.functions import extract as X
from hearthline.functions import normalize as N

from hearthline.operators import contacts
from hearthline.operators.shared import cut, escaped, remove

from . import payload

_CANDIDATE = "struct<seq:int,type:string,normalized:string,value:string,location:string,contact_class:string,confidence:double,reasons:array<string>>"
#: The canonical listing: its columns and types.
CANONICAL = {
    "id": "long", "agency_id": "int", "parser_source_id": "long", "source_channel": "string", "source_external_id": "string", "raw_url": "string", "telegram_post_url": "string", "title": "string", "description": "string",
    "listing_type": "string", "image_url": "string", "normalized_address": "string", "address_district": "string", "address_street": "string", "city": "string", "region_code": "string", "latitude": "double", "longitude": "double",
    "area_sqm": "double", "price_rub": "decimal(14,2)", "contact_name": "string", "contact_phone": "string", "contact_email": "string", "contact_candidates": f"array<{_CANDIDATE}>", "selected_contact": _CANDIDATE,
    "rejected_contacts": f"array<{_CANDIDATE}>", "contact_rejection_reasons": "array<string>", "contact_confidence": "double", "intent": "string", "payload": "map<string,string>",
}
# Names under which a field may arrive.
ALIASES = {"title": ("title", "name"), "raw_url": ("url", "link"), "description": ("description", "text"), "area_sqm": ("area", "area_sqm"), "price_rub": ("price", "price_rub"), "contact_phone": ("phone", "contact_phone"), "contact_email": ("email", "contact_email"), "source_external_id": ("id", "external_id"), "address": ("address",)}


def validate(rows: DataFrame, bounds: dict[str, tuple[float, float]] | None = None, least_title: int = 3) -> DataFrame:
    """rows with reasons (array) and valid."""
    bad = [F.when(F.length(F.trim(F.coalesce("title", F.lit("")))) < least_title, "title")] + [F.when((F.col(c) < low) | (F.col(c) > high), c) for c, (low, high) in (bounds or {}).items()]
    out = rows.withColumn("reasons", F.filter(F.array(*bad), lambda x: x.isNotNull()))
    return out.withColumn("valid", F.size("reasons") == 0)


def canonical(rows: DataFrame, region: str = "RU-UDM") -> DataFrame:
    """Rows in the canonical columns, with the defaults of an ingest."""
    have = set(rows.columns)
    cols = {n: (F.col(n) if n in have else F.lit(None)).cast(t) for n, t in CANONICAL.items()}
    cols["title"] = F.left(N.squeeze(cols["title"]), F.lit(255))
    cols["description"] = F.left(cols["description"], F.lit(4000))
    cols["region_code"], cols["intent"] = F.coalesce(cols["region_code"], F.lit(region)), F.coalesce(cols["intent"], F.lit("unknown"))
    return rows.select(*(c.alias(n) for n, c in cols.items()))


def json_records(raw: DataFrame, column: str = "value", items_key: str | None = None) -> DataFrame:
    """One row for each record of JSON texts: an array, or an object that holds one under items_key."""
    text = F.get_json_object(column, f"$.{items_key}") if items_key else F.col(column)
    items = F.from_json(text, "array<map<string,string>>")
    rows = raw.select(F.explode(items).alias("r"))
    def field(n: str) -> Column:
        return F.coalesce(*(F.col("r")[a] for a in ALIASES[n]))
    body = F.concat_ws(" ", field("title"), field("description"))
    return rows.select(
        field("source_external_id").alias("source_external_id"), field("title").alias("title"), field("raw_url").alias("raw_url"), field("description").alias("description"), field("address").alias("address"),
        F.coalesce(N.safe_float(field("price_rub")), X.price(body)).alias("price_rub"), F.coalesce(N.safe_float(field("area_sqm")), X.area(body)).alias("area_sqm"), field("contact_phone").alias("contact_phone"), field("contact_email").alias("contact_email"),
    )


def rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files; the picture comes from the enclosure, the media tags or the description."""
    media = "array<struct<_url:string>>"
    schema = f"title string, link string, description string, enclosure struct<_url:string>, `media:content` {media}, `media:thumbnail` {media}"
    rows = spark.read.format("xml").option("rowTag", "item").option("attributePrefix", "_").schema(schema).load(path)
    body = F.coalesce("description", F.lit(""))
    picture = F.coalesce(F.nullif(F.col("enclosure._url"), F.lit("")), F.get("media:content", 0)["_url"], F.get("media:thumbnail", 0)["_url"], X.image_url(body, F.col("link")))
    text = F.nullif(X.page_text(body), F.lit(""))
    return rows.select(N.squeeze(F.col("title")).alias("title"), F.col("link").alias("raw_url"), F.coalesce(text, N.squeeze(body)).alias("description"), picture.alias("image_url")).where("title <> ''")


def embedded_records(pages: DataFrame) -> DataFrame:
    """Listing records in the JSON scripts of pages(page_id, url, html), in canonical names; a record without a title is none."""
    rows = pages.select("page_id", "url", F.explode(payload.embedded_records("html")).alias("record"))
    found = payload.payload_fields("record", "url")
    said = lambda *names: F.coalesce(*(F.nullif(N.squeeze(F.get_json_object("record", f"$.{n}")), F.lit("")) for n in names))
    text = F.concat_ws(" ", "title", "description")
    rows = rows.select(
        "page_id", said("title", "name", "heading").alias("title"), F.coalesce(said("url", "link", "href"), F.col("url")).alias("raw_url"), F.coalesce(said("description", "text", "summary"), F.lit("")).alias("description"), said("address", "location").alias("address"),
        N.safe_float(said("price", "cost", "amount")).alias("price"), N.safe_float(said("area", "area_sqm", "sqm")).alias("area"), said("id", "external_id").alias("own_id"), said("phone", "contact_phone").alias("phone"), said("email", "contact_email").alias("contact_email"), found.alias("found"),
    ).where("title IS NOT NULL")
    return rows.select(
        "page_id", F.coalesce("own_id", N.external_id(F.col("raw_url"), F.col("title"))).alias("source_external_id"), "raw_url", F.left("title", F.lit(255)).alias("title"), F.left("description", F.lit(4000)).alias("description"), F.coalesce("address", X.labelled_address(text)).alias("normalized_address"),
        F.coalesce("price", X.price(text)).alias("price_rub"), F.coalesce("area", X.area(text)).alias("area_sqm"), F.coalesce("phone", F.col("found.phone")).alias("contact_phone"), "contact_email", F.col("found.image").alias("image_url"),
    )


API_ITEM = "struct<id:string,title:string,address:string,price:string,status:string,url:string,category:struct<id:string,name:string>,item_detail:string>"


def api_rows(raw: DataFrame, source: str, source_url: Column, column: str = "value", items_key: str = "resources") -> DataFrame:
    """Listings in landed pages of a paged API: JSON objects with the items under items_key. source: what to call an item without a title."""
    items = F.from_json(F.get_json_object(column, f"$.{items_key}"), f"array<{API_ITEM}>")
    r = lambda name: N.squeeze(F.col(f"r.{name}"))
    rows = raw.withColumn("__url", source_url).select("__url", F.explode(items).alias("r"))
    own = r("id")
    title = F.when(r("title") != "", r("title")).when(own != "", F.concat(F.lit(f"{source} item "), own)).otherwise(f"{source} item")
    address = F.nullif(r("address"), F.lit(""))
    rows = rows.select(
        own.alias("own_id"), title.alias("title"), address.alias("normalized_address"), F.coalesce(F.nullif(r("url"), F.lit("")), F.col("__url")).alias("raw_url"), r("status").alias("status"), F.col("r.category").alias("category"), N.safe_float(F.col("r.price")).alias("price_rub"), F.col("r.item_detail").alias("detail"),
        N.squeeze(F.concat_ws(" ", title, address, F.col("r.category.name"), F.col("r.status"))).alias("text"),
    )
    found = payload.payload_fields("detail", "raw_url")
    return rows.select(
        F.coalesce(F.nullif("own_id", F.lit("")), N.external_id(F.col("raw_url"), F.col("title"))).alias("source_external_id"), "raw_url", F.left("title", F.lit(255)).alias("title"), F.left(F.coalesce(F.nullif("text", F.lit("")), F.col("title")), F.lit(4000)).alias("description"), "normalized_address",
        X.street(F.col("text"), F.col("normalized_address")).alias("address_street"), "price_rub", "status", F.col("category.name").alias("category"), found["phone"].alias("contact_phone"), found["image"].alias("image_url"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """A listing record of each page: heading or title, text, contacts, place, price, area and picture found in it."""
    meta = F.filter(X.all_matches(F.col("html"), r"(?is)<meta\b[^>]*>"), lambda m: m.rlike(r"""(?i)(?:name|property)\s*=\s*["'](?:og:)?description["']"""))
    about = N.squeeze(F.regexp_extract(F.get(meta, 0), r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1))
    rows = pages.select("page_id", "url", "html", X.page_text(F.col("html")).alias("text"), F.coalesce(F.nullif(X.page_heading(F.col("html")), F.lit("")), X.page_title(F.col("html"))).alias("title"), F.nullif(about, F.lit("")).alias("about"))
    text = F.col("text")
    return rows.select(
        "page_id", N.canonical_url(F.col("url")).alias("raw_url"), N.external_id(F.col("url"), F.col("url")).alias("source_external_id"), F.left("title", F.lit(255)).alias("title"), F.left(F.coalesce("about", "text"), F.lit(4000)).alias("description"), X.labelled_address(text).alias("normalized_address"),
        X.street(text, X.labelled_address(text)).alias("address_street"), X.price(text).alias("price_rub"), X.area(text).alias("area_sqm"), F.get(X.all_matches(text, X.PHONE), 0).alias("contact_phone"), F.get(X.all_matches(text, X.EMAIL), 0).alias("contact_email"), X.image_url(F.col("html"), F.col("url")).alias("image_url"),
    )


def page_items(pages: DataFrame, city: str | None = None, region_code: str | None = None, region_words: Iterable[str] = keywords.MESSAGE_REGION, districts: Iterable[str] = ()) -> DataFrame:
    """A canonical listing of each page of a source that lies in its city or region, with its contacts found, classified and chosen.

    Candidates come from the page's JSON records, from its markup, from its heading and description, and from the start of its text, in this
    order of trust; the chosen one gives the listing its phone or e-mail. Place and price come from the records, else from the text.
    """
    rows = page_records(pages).withColumnRenamed("normalized_address", "said_address").join(pages.select("page_id", "html", "url"), "page_id")
    records = F.concat(F.lit("["), F.array_join(payload.embedded_records("html"), ","), F.lit("]"))
    rows = rows.select("*", X.page_text(F.col("html")).alias("body"), records.alias("records")).withColumn("found", payload.payload_fields("records", "url"))
    about = F.when(F.col("description") == F.left("body", F.lit(4000)), "").otherwise(F.col("description"))
    rows = rows.withColumns({"hint": N.squeeze(F.concat_ws(" ", "title", about)), "text": N.squeeze(F.concat_ws(" ", "title", about, F.left("body", F.lit(8000)))), "normalized_address": F.coalesce(F.col("found.address"), "said_address")})
    inside = in_region(F.col("text"), F.col("normalized_address"), F.lit(city).cast("string"), F.lit(region_code).cast("string"), region_words)
    rows = cut(rows.where(inside), "page-items")
    origins = [("listing_body", F.coalesce(F.nullif("hint", F.lit("")), F.col("text"))), ("page_text", F.left("body", F.lit(4000)))]
    found = contacts.candidates(rows, "page_id", origins, [payload.payload_contacts("records"), payload.markup_contacts("html")])
    rated = contacts.classified(found.join(rows.select("page_id", N.domain(F.col("url")).alias("home")), "page_id"), F.col("home"))
    chosen = contacts.bundles(rated.drop("home"), "page_id")
    own = F.col("selected")
    return rows.join(chosen, "page_id", "left").select(
        "page_id", "raw_url", "source_external_id", "title", F.left("text", F.lit(4000)).alias("description"), X.listing_type(F.col("url"), F.col("hint")).alias("listing_type"), X.intent(F.col("text")).alias("intent"),
        F.coalesce("image_url", F.col("found.image")).alias("image_url"), "normalized_address", X.district(F.col("text"), list(districts)).alias("address_district"), X.street(F.col("text"), F.col("normalized_address")).alias("address_street"),
        F.lit(city).cast("string").alias("city"), F.lit(region_code).cast("string").alias("region_code"), X.area(F.col("text")).alias("area_sqm"), X.price(F.col("text")).alias("price_rub"),
        own["label"].alias("contact_name"), F.when(own["type"] == "phone", own["normalized"]).alias("contact_phone"), F.when(own["type"] == "email", own["normalized"]).alias("contact_email"),
        F.col("candidates").alias("contact_candidates"), F.col("selected").alias("selected_contact"), F.col("rejected").alias("rejected_contacts"), F.col("rejection_reasons").alias("contact_rejection_reasons"), "contact_confidence",
    )


def messages(rows: DataFrame, text: str, order: list[Column], cap: int | None = None, **packs) -> DataFrame:
    """Messages that are not blank and pass message_relevant(), the first cap of them in that order."""
    kept = rows.where((F.trim(F.coalesce(text, F.lit(""))) != "") & message_relevant(F.col(text), **packs))
    return kept if cap is None else kept.orderBy(*order).limit(cap)


def updated_since(rows: DataFrame, at: Column | None, column: str = "updated_at") -> DataFrame:
    """Rows updated at that moment or later; all without one. The condition reaches the scan."""
    return rows if at is None else rows.where(F.col(column) >= at)


def message_relevant(text: Column, exclude=(), topic=(), action=(), region=()) -> Column:
    """No excluded word, and a word of each pack that is given."""
    t, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(True)
    if exclude:
        out = out & ~X.any_keyword(t, exclude)
    for pack in (topic, action, region):
        if pack:
            out = out & X.any_keyword(t, pack)
    return out


#: The settings of a source's messages and what they are where a source says nothing.
MESSAGE_FILTERS = {
    "commercial_only": True, "region_only": True, "require_transaction": True, "require_estate": True, "commercial": keywords.MESSAGE_COMMERCIAL, "estate": keywords.MESSAGE_ESTATE, "transaction": keywords.MESSAGE_TRANSACTION,
    "exclude": keywords.MESSAGE_EXCLUDE, "region": keywords.MESSAGE_REGION,
}


def _filters(given: dict | None) -> dict:
    """Settings with defaults; packs are trimmed and lower-cased, and an empty pack counts as not given."""
    out = dict(MESSAGE_FILTERS)
    for k, v in (given or {}).items():
        if isinstance(MESSAGE_FILTERS[k], bool):
            out[k] = bool(v)
        elif words := tuple(w for x in v or () if (w := str(x).strip().lower())):
            out[k] = words
    return out


def message_passes(text: Column, filters: dict | None = None, region_context: Column | None = None) -> Column:
    """No excluded word; with commercial_only a commercial word and, if required, one of estate and of transactions; with region_only a word of the region.

    The region may be named in region_context instead, such as the text with the channel's name.
    """
    f, t = _filters(filters), F.lower(F.coalesce(text, F.lit("")))
    where = t if region_context is None else F.lower(F.coalesce(F.nullif(region_context, F.lit("")), t))
    out = ~X.any_keyword(t, f["exclude"])
    if f["commercial_only"]:
        for pack, needed in (("commercial", True), ("estate", f["require_estate"]), ("transaction", f["require_transaction"])):
            out = out & X.any_keyword(t, f[pack]) if needed else out
    return out & X.any_keyword(where, f["region"]) if f["region_only"] else out


def channel_passes(username: Column, title: Column, query: Column, filters: dict | None = None) -> Column:
    """Whether a channel's name and title speak of the trade, whatever commercial_only says, and with the query that found it of the region."""
    named = N.squeeze(F.concat_ws(" ", username, title))
    return message_passes(named, (filters or {}) | {"commercial_only": True, "require_transaction": False}, N.squeeze(F.concat_ws(" ", named, query)))


def in_region(text: Column, address: Column, city: Column, region_code: Column, words: Iterable[str], special: str = "RU-UDM") -> Column:
    """Whether a listing lies in its source's city or region. An address that names neither decides against the special region."""
    place, said = F.lower(F.coalesce(address, F.lit(""))), F.lower(N.squeeze(text))
    town, words = F.lower(F.coalesce(city, F.lit(""))), tuple(w.lower() for w in words)
    in_town = lambda t: (town != "") & F.contains(t, town)
    is_special = F.coalesce(region_code == special, F.lit(False))
    anywhere = (town == "") & (F.coalesce(region_code, F.lit("")) == "")
    return F.when(anywhere, True).when((place != "") & in_town(place), True).when((place != "") & is_special, X.any_keyword(place, words)).when(in_town(said), True).when(is_special, X.any_keyword(said, words)).otherwise(True)


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with parser_source_id filled from their channel's source and payload completed by source_id, source_name and source_url.

    sources(source_channel, source_id, source_name, source_url); keys that the payload has stay.
    """
    known = sources.select("source_channel", F.col("source_id").alias("__id"), F.col("source_name").alias("__name"), F.col("source_url").alias("__url"))
    rows = rows.join(known, "source_channel", "left")
    own = F.coalesce("payload", F.create_map().cast("map<string,string>")) if "payload" in rows.columns else F.create_map().cast("map<string,string>")
    given = F.map_filter(F.create_map(F.lit("source_id"), F.col("__id").cast("string"), F.lit("source_name"), F.col("__name"), F.lit("source_url"), F.col("__url")), lambda k, v: v.isNotNull() & ~F.map_contains_key(own, k))
    first = F.coalesce("parser_source_id", "__id") if "parser_source_id" in rows.columns else F.col("__id")
    return rows.withColumns({"payload": F.map_concat(own, given), "parser_source_id": first}).drop("__id", "__name", "__url")


def refresh(rows: DataFrame, path: str, partition: str = "agency_id", tenants: Iterable | None = None) -> None:
    """Replaces the rows of the run's tenants and leaves those of others. tenants: those of the run; without them, those that rows hold.

    A tenant of the run without rows ends with none. Its folder is emptied after the others are written.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    if tenants is not None:
        named = {None if t is None else str(t) for t in tenants}
        have = {None if r[0] is None else str(r[0]) for r in rows.select(partition).distinct().where(F.col(partition).cast("string").isin(*(named - {None})) | F.col(partition).isNull()).collect()}
        for tenant in named - have:
            remove(rows.sparkSession, f"{path}/{partition}={'__HIVE_DEFAULT_PARTITION__' if tenant is None else escaped(tenant)}")


def append_new(rows: DataFrame, stored: DataFrame, path: str, key: list[str]) -> None:
    """Appends the rows whose key the stored table lacks."""
    rows.join(stored.select(*key), key, "left_anti").write.mode("append").parquet(path)
