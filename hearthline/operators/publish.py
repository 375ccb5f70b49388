"""Quality gate, stages, properties, leads and call tasks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline import keywords
from hearthline.functions import normalize as N
from hearthline.functions.normalize import _text

from .market import deal_type, property_type

# Stages in order, contacts that never count, labels of lead sources.
STAGES = ("raw", "parsed", "normalized", "object_resolved", "contacts_resolved", "scored", "published", "rejected")
INVALID_CONTACTS = ("platform_contact", "support_contact")
SOURCE_LABELS = {"telegram": "Telegram", "avito": "Avito", "yandex": "Яндекс Недвижимость", "bankrupt": "Банкротство"}
NO_LABEL, NO_ADDRESS, NO_CITY, REGION = "Не выбрано", "Без адреса", "Не указан", "RU-UDM"
CONVERTED = ("converted_to_lead", "converted_to_deal")


def gate(title: Column, address: Column, city: Column, contact_class: Column) -> Column:
    """Reasons against publishing; empty means it passes."""
    reasons = F.array(
        F.when(F.length(F.trim(_text(title))) < 3, "missing_title"), F.when((_text(address) == "") & (_text(city) == ""), "missing_location"), F.when(_text(contact_class).isin(*INVALID_CONTACTS), "invalid_contact"),
    )
    return F.filter(reasons, lambda x: x.isNotNull())


def advance(current: Column, target: Column) -> Column:
    """The later of two stages; a missing stage takes any, an unknown target changes nothing."""
    rank = F.create_map(*(F.lit(x) for k, s in enumerate(STAGES) for x in (s, k)))
    return F.when(rank[target].isNull(), current).when(current.isNull(), target).when(rank[target] > F.coalesce(rank[current], F.lit(0)), target).otherwise(current)


def published(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """rows with reasons, reached, stage, status, published_at, first_published and first_rejected.

    rows: title, address, city, contact_class (or reasons, what gate() gave for them), stage, status, and where they have them score and published_at. reached is the last
    stage before the verdict: a row with a score gets as far as scored, another to contacts_resolved, a failing one to normalized, and no
    stage is ever given up. The first time of publishing is kept; a row counts as first published, or rejected, if it was not before.
    """
    have = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    at = F.lit(None).cast("timestamp") if at is None else at
    if "reasons" not in rows.columns:
        rows = rows.withColumn("reasons", gate(F.col("title"), F.col("address"), F.col("city"), F.col("contact_class")))
    bad = F.size("reasons") > 0
    reached = F.lit("normalized")
    good = F.when(have("score", "double").isNotNull(), "scored").otherwise("contacts_resolved")
    reached = advance(F.col("stage"), F.when(bad, reached).otherwise(good))
    was = lambda stage: F.coalesce(F.col("stage") == stage, F.lit(False))
    news = {"reached": reached, "first_published": ~bad & ~was("published"), "first_rejected": bad & ~was("rejected"), "published_at": F.when(bad, have("published_at", "timestamp")).otherwise(F.coalesce(have("published_at", "timestamp"), at))}
    rows = rows.withColumns(news)
    return rows.withColumn("stage", F.when(bad, "rejected").otherwise("published")).withColumn("status", F.when(bad & ~F.coalesce(F.col("status").isin(*CONVERTED), F.lit(False)), "rejected").otherwise(F.col("status")))


def publish_counters(rows: DataFrame, properties: DataFrame) -> DataFrame:
    """One row for each tenant of a run: objects_resolved, published, rejected. rows: published(); properties: new_properties() of the run."""
    of = rows.groupBy("agency_id").agg(F.count_if("first_published").alias("published"), F.count_if("first_rejected").alias("rejected"))
    made = properties.groupBy("agency_id").agg(F.count(F.lit(1)).alias("objects_resolved"))
    return of.join(made, "agency_id", "left").withColumn("objects_resolved", F.coalesce("objects_resolved", F.lit(0)))


def publish_owners(identities: DataFrame, at: Column) -> DataFrame:
    """identities with lifecycle_status and published_at: owners are published, the first time is kept, others keep their state."""
    owner = F.col("contact_class") == "owner_candidate"
    return identities.withColumn("published_at", F.when(owner, F.coalesce("published_at", at)).otherwise(F.col("published_at"))).withColumn(
        "lifecycle_status", F.when(owner, "published_to_owners").otherwise(F.coalesce(F.nullif("lifecycle_status", F.lit("")), F.lit("owner_scored")))
    )


# The types that a property can have.
PROPERTY_TYPES = ("office", "retail", "warehouse", "industrial", "land", "mixed_use", "other")
PROPERTY_KEY = ["agency_id", "source_channel", "source_external_id"]


def property_id(*key: Column) -> Column:
    return F.xxhash64(*(F.coalesce(k.cast("string"), F.lit("\x00")) for k in key))


def new_properties(listings: DataFrame, existing: DataFrame | None = None, rules=keywords.PROPERTY_RULES) -> DataFrame:
    """One property for each (tenant, channel, external id) that has none yet, from its earliest listing.

    Listings of a channel without an external id share the key whose id is null. Listings that fail the gate or that have a property_id should
    not be given. The property has the listing's id, texts, place, measures, and its deal and property type.
    """
    c = F.col
    have = lambda name, kind: c(name) if name in listings.columns else F.lit(None).cast(kind)
    filled = lambda name, default: F.coalesce(F.nullif(name, F.lit("")), F.lit(default))
    kind = property_type(have("property_hint", "string"), c("title"), have("description", "string"), rules)
    columns = {
        "title": c("title"), "description": have("description", "string"), "address": filled("address", NO_ADDRESS), "city": filled("city", NO_CITY), "region_code": filled("region_code", REGION),
        "latitude": have("latitude", "double"), "longitude": have("longitude", "double"), "area_sqm": have("area_sqm", "double"), "price_rub": have("price_rub", "double"),
        "deal_type": deal_type(have("listing_type", "string"), c("title"), have("description", "string")), "property_type": F.when(kind.isin(*PROPERTY_TYPES), kind).otherwise("other"),
    }
    # Only the smallest id of a key moves through the aggregate; texts are fetched for those that are new.
    first = listings.groupBy(*PROPERTY_KEY).agg(F.min("id").alias("id"))
    if existing is not None:
        known = existing.select(*(c(k).alias(f"__{k}") for k in PROPERTY_KEY)).distinct()
        first = first.join(known, reduce(and_, (c(k).eqNullSafe(c(f"__{k}")) for k in PROPERTY_KEY)), "left_anti")
    return first.join(listings.select("id", *(v.alias(k) for k, v in columns.items())), "id").withColumn("property_id", property_id(*(c(k) for k in PROPERTY_KEY)))


def with_property(listings: DataFrame, properties: DataFrame) -> DataFrame:
    """listings with the property_id that they have or that their key has."""
    key = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in PROPERTY_KEY))
    ids = properties.select(*(F.col(k).alias(f"__{k}") for k in PROPERTY_KEY), F.col("property_id").alias("__id"))
    own = F.col("property_id") if "property_id" in listings.columns else F.lit(None).cast("long")
    return listings.join(ids, key, "left").withColumn("property_id", F.coalesce(own, "__id")).drop("__id", *(f"__{k}" for k in PROPERTY_KEY))


def auto_leads(scored: DataFrame, leads: DataFrame | None = None, least: float = 70.0, below_market: bool = True) -> DataFrame:
    """Published listings with a usable contact that score enough and are no lead yet.

    scored: id, status, stage, score, owner_score, below_market, contact_phone, contact_email, contact_class; leads: id of the listings that are leads.
    """
    c = F.col
    usable = ~_text(c("contact_class")).isin(*INVALID_CONTACTS) & ((_text(c("contact_phone")) != "") | (_text(c("contact_email")) != ""))
    enough = (F.coalesce("score", F.lit(0.0)) >= least) | (F.coalesce("owner_score", F.lit(0.0)) >= least)
    enough = enough | F.coalesce("below_market", F.lit(False)) if below_market else enough
    good = scored.where((c("stage") == "published") & ~c("status").isin("duplicate", "possible_duplicate", "rejected") & usable & enough)
    return good if leads is None else good.join(leads.select("id"), "id", "left_anti")


def to_leads(listings: DataFrame, auto_created: bool = False, state: str = "active", title: Column | None = None) -> DataFrame:
    """A lead for each listing, with the defaults and labels of a conversion, and the listing's status after it."""
    labels = F.create_map(*(F.lit(x) for kv in SOURCE_LABELS.items() for x in kv))
    return listings.select(
        F.col("id").cast("string").alias("source_record_id"), "agency_id", F.coalesce(title if title is not None else F.lit(None).cast("string"), F.col("title")).alias("title"), "contact_phone", "contact_email",
        F.lit("new_lead").alias("status"), F.coalesce(labels[F.col("source_channel")], F.lit(NO_LABEL)).alias("lead_source"), F.lit(state).alias("lead_state"), F.lit(auto_created).alias("auto_created"),
        F.lit("converted_to_lead").alias("listing_status"),
    )


def to_deals(listings: DataFrame, value: Column | None = None, title: Column | None = None) -> DataFrame:
    """A deal for each listing, through a promoted lead. value: what was agreed; 0 and null give the listing's price."""
    given = F.lit(None).cast("double") if value is None else value.cast("double")
    worth = F.coalesce(F.when(given != 0, given), F.col("price_rub").cast("double"))
    name = F.coalesce(title if title is not None else F.lit(None).cast("string"), F.col("title"))
    return listings.select(F.col("id").cast("string").alias("source_record_id"), "agency_id", name.alias("title"), F.lit("promoted_to_deal").alias("lead_state"), F.lit("new").alias("status"), worth.alias("value_rub"), F.lit("converted_to_deal").alias("listing_status"))


CALL_NOTE = "Автозадача: прозвонить лид из парсера."


def call_tasks(leads: DataFrame, calls: DataFrame, at: Column | None = None) -> DataFrame:
    """An outgoing call for each automatic lead with a phone that has no call yet.

    leads: lead_id, agency_id, contact_phone, source_record_id, auto_created, lead_state; calls: lead_id. A lead is called once, whoever
    else has its number.
    """
    ready = leads.where(F.col("auto_created") & (F.col("lead_state") == "auto_created") & (F.coalesce("contact_phone", F.lit("")) != ""))
    called = calls.where(F.col("lead_id").isNotNull()).select("lead_id").distinct()
    fixed = {"provider": "parser_pipeline", "direction": "outbound", "status": "ringing", "notes": CALL_NOTE}
    return ready.join(called, "lead_id", "left_anti").select(
        "agency_id", "lead_id", "source_record_id", F.col("contact_phone").alias("to_number"), F.lit(None).cast("string").alias("from_number"), (F.lit(None).cast("timestamp") if at is None else at).alias("started_at"), *(F.lit(v).alias(k) for k, v in fixed.items())
    )


def tasks_by_source(tasks: DataFrame, listings: DataFrame) -> DataFrame:
    """(source, tasks): the calls of each source whose listing is known. listings: id, agency_id, source. Ids of listings may be negative."""
    record = F.when(F.trim("source_record_id").rlike(r"^-?[0-9]+$"), F.trim("source_record_id").try_cast("long"))
    rows = tasks.withColumn("id", record).join(listings.select("id", "agency_id", "source"), ["id", "agency_id"])
    return rows.where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("tasks"))


def promoted(identities: DataFrame, tasks: DataFrame, listings: DataFrame, at: Column) -> DataFrame:
    """identities after a run of calls: those of a called listing's phone or e-mail are promoted, and the first time of that is kept.

    identities: agency_id, contact_key, lifecycle_status, promoted_at; listings: id, agency_id, contact_phone, contact_email. Both keys of a
    listing count, so one listing may promote two identities.
    """
    phone, mail = N.phone_strict(F.col("contact_phone")), N.email(F.col("contact_email"))
    keys = F.array(F.when(phone != "", F.concat(F.lit("phone:"), phone)), F.when(mail != "", F.concat(F.lit("email:"), mail)))
    called = tasks.select("agency_id", F.trim("source_record_id").try_cast("long").alias("id"))
    # Distinct keys, so an identity with very many called listings meets one row.
    hit = listings.join(called, ["agency_id", "id"], "left_semi").select("agency_id", F.explode(keys).alias("contact_key")).where("contact_key IS NOT NULL").distinct().withColumn("__hit", F.lit(True))
    rows = identities.join(hit, ["agency_id", "contact_key"], "left")
    now = F.coalesce("__hit", F.lit(False))
    return rows.withColumns({"promoted_at": F.when(now, F.coalesce("promoted_at", at)).otherwise(F.col("promoted_at")), "lifecycle_status": F.when(now, "promoted_to_call_center").otherwise(F.col("lifecycle_status"))}).drop("__hit")


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in that order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
