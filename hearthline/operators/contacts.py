"""Contact candidates of a text: found, classified, rated, and the best one chosen, as Column expressions and windows.

Null and empty texts have no candidates. Values that normalise to nothing and repeats of a normalised value are left out.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline import keywords
from hearthline.functions import extract as X
from hearthline.functions import normalize as N

#: Places whose contacts belong to the listing's own block.
OWN_BLOCK = ("seller_block", "listing_meta", "detail_block")
EDGE = ("header", "footer")
#: Arrays of contacts that come with their place.
MARKED = "array<struct<type:string,value:string,location:string,context:string>>"
# What a chosen contact is called.
LABELS = {"owner_candidate": "Собственник", "agent_candidate": "Агент", "organization_contact": "Организация", "unknown_contact": "Контакт"}


def candidates(rows: DataFrame, id_col: str, origins: list[tuple[str, Column]], marked: list[Column] = ()) -> DataFrame:
    """id_col, seq, type, value, normalized, location, context; the first origin that names a value wins.

    marked: arrays of (type, value, location, context), as seeds, payloads and markup give them; they come first. origins:
    (location, text), the most trusted first. Phones come before e-mails within a text.
    """
    def given(place: int, found: Column) -> Column:
        clean = lambda v: F.when(v["type"] == "phone", N.phone_keep(v["value"])).otherwise(N.email(v["value"]))
        return F.transform(found, lambda v, i: F.struct(F.lit(place).alias("origin"), i.alias("at"), v["type"].alias("type"), F.trim(v["value"]).alias("value"), clean(v).alias("normalized"), v["location"].alias("location"), F.left(N.squeeze(v["context"]), F.lit(240)).alias("context")))


    def mentions(place: int, location: str, text: Column, kind: str, pattern: str, clean) -> Column:
        context = F.left(N.squeeze(text), F.lit(240))
        one = lambda v, i: F.struct(F.lit(place).alias("origin"), i.alias("at"), F.lit(kind).alias("type"), F.trim(v).alias("value"), clean(v).alias("normalized"), F.lit(location).alias("location"), context.alias("context"))
        return F.transform(X.all_matches(text, pattern), one)

    kinds = (("phone", X.PHONE, N.phone_keep), ("email", X.EMAIL, N.email))
    parts = [given(k - len(marked), F.coalesce(c, F.array().cast(MARKED))) for k, c in enumerate(marked)] + [mentions(2 * k + j, location, text, *kind) for k, (location, text) in enumerate(origins) for j, kind in enumerate(kinds)]
    found = rows.select(id_col, F.explode(F.concat(*parts)).alias("c")).select(id_col, "c.*").where("normalized <> ''")
    # The earliest mention of each value: an aggregate, combined before the shuffle.
    first = found.groupBy(id_col, "type", "normalized").agg(F.min_by(F.struct("origin", "at", "value", "location", "context"), F.struct("origin", "at")).alias("m"))
    order = Window.partitionBy(id_col).orderBy("m.origin", "m.at")
    return first.select(id_col, F.row_number().over(order).alias("seq"), "type", "normalized", "m.value", "m.location", "m.context")


def classified(found: DataFrame, source_domain: Column | None = None, owner: Iterable[str] = keywords.CONTACT_OWNER, agent: Iterable[str] = keywords.CONTACT_AGENT, hint: Iterable[str] = keywords.CONTACT_HINT, support: Iterable[str] = keywords.CONTACT_SUPPORT, ads: Iterable[str] = keywords.CONTACT_ADS, prefixes: Iterable[str] = keywords.CONTACT_EMAIL_PREFIXES) -> DataFrame:
    """found with reasons (array), contact_class and confidence."""
    text, location = F.lower(F.coalesce("context", F.lit(""))), F.col("location")
    hinted = X.any_keyword(text, (*owner, *agent, *hint))
    mail = F.col("type") == "email"
    blocked = F.lit(False)
    for p in prefixes:
        blocked = blocked | F.col("normalized").startswith(p)
    home = F.lit(False) if source_domain is None else (source_domain != "") & F.element_at(F.split("normalized", "@"), -1).endswith(source_domain)
    reasons = [
        F.when(mail & blocked, "email_prefix_blocked"), F.when(mail & home & ~hinted, "platform_domain"), F.when(X.any_keyword(text, support), "support_context"),
        F.when(location.isin(*EDGE) & ~hinted, "header_footer"), F.when(X.any_keyword(text, ads), "ad_contact"),
    ]
    rows = found.withColumn("reasons", F.filter(F.array(*reasons), lambda r: r.isNotNull()))
    helpdesk = F.arrays_overlap("reasons", F.array(F.lit("email_prefix_blocked"), F.lit("support_context")))
    kind = F.when(helpdesk, "support_contact").when(F.size("reasons") > 0, "platform_contact").when(X.any_keyword(text, owner), "owner_candidate").when(X.any_keyword(text, agent), "agent_candidate").when(location.isin(*OWN_BLOCK), "organization_contact").otherwise("unknown_contact")
    rows = rows.withColumn("contact_class", kind)
    base = F.element_at(F.create_map(*(F.lit(x) for kv in keywords.CONTACT_CONFIDENCE.items() for x in kv)), F.col("contact_class"))
    rated = base + F.when(mail, 0.0).otherwise(0.05) + F.when(location.isin(*OWN_BLOCK), 0.05).otherwise(0.0) - F.when(location.isin(*EDGE), 0.2).otherwise(0.0)
    return rows.withColumn("confidence", F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), rated)), 3))


def best(rated: DataFrame, id_col: str) -> DataFrame:
    """The chosen contact of each id that has one: highest confidence, phones first, then the earliest."""
    rank = F.struct("confidence", (F.col("type") == "phone").alias("phone"), (-F.col("seq")).alias("early"))
    top = rated.where(F.size("reasons") == 0).groupBy(id_col).agg(F.max_by(F.struct("seq", "type", "normalized", "contact_class", "confidence"), rank).alias("b"))
    return top.select(id_col, "b.*")


def bundles(rated: DataFrame, id_col: str) -> DataFrame:
    """One row for each id: its candidates in order, the rejected ones, the sorted distinct reasons, and the chosen contact."""
    one = F.struct("seq", "type", "normalized", "value", "location", "contact_class", "confidence", "reasons")
    all_ = rated.groupBy(id_col).agg(F.array_sort(F.collect_list(one)).alias("candidates"))
    all_ = all_.withColumn("rejected", F.filter("candidates", lambda c: F.size(c["reasons"]) > 0))
    all_ = all_.withColumn("rejection_reasons", F.array_sort(F.array_distinct(F.flatten(F.transform("rejected", lambda c: c["reasons"])))))
    labels = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    chosen = best(rated, id_col).select(F.col(id_col).alias("__id"), F.struct("type", "normalized", "contact_class", "confidence", labels[F.col("contact_class")].alias("label")).alias("selected"))
    return all_.join(chosen, all_[id_col] == chosen["__id"], "left").drop("__id").withColumn("contact_confidence", F.col("selected.confidence"))
