"""Lead scores, as Column expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import keywords
from hearthline.functions.extract import any_keyword
from hearthline.functions.normalize import _text, squeeze

WEIGHTS = {"freshness": 0.25, "owner": 0.20, "under_market": 0.20, "uniqueness": 0.10, "urgency": 0.10, "completeness": 0.10, "spam": -0.05}


def _clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))


def _steps(c: Column, steps, rest: float) -> Column:
    out = F.lit(rest)
    for top, value in reversed(steps):
        out = F.when(c <= top, float(value)).otherwise(out)
    return out


def age_hours(published: Column, as_of: Column) -> Column:
    return F.greatest(F.coalesce((as_of.cast("double") - published.cast("timestamp").cast("double")) / 3600.0, F.lit(0.0)), F.lit(0.0))


def freshness(hours: Column) -> Column:
    return _steps(hours, ((6, 100), (24, 85), (72, 70), (168, 50), (720, 30)), 10.0)


def owner_probability(text: Column, has_phone: Column, owner=keywords.OWNER, agent=keywords.AGENT) -> Column:
    return _clamp(F.lit(20.0) + F.when(has_phone, 25.0).otherwise(0.0) + F.when(any_keyword(text, owner), 35.0).otherwise(0.0) - F.when(any_keyword(text, agent), 30.0).otherwise(0.0))


def under_market(text: Column, price_m2: Column, deviation: Column, discount=keywords.DISCOUNT) -> Column:
    return _under_market(any_keyword(text, discount), price_m2, deviation)


def _under_market(discounted: Column, price_m2: Column, deviation: Column) -> Column:
    known = F.when(deviation <= -0.2, 90.0).when(deviation <= -0.1, 75.0).when(deviation <= -0.05, 65.0).when(deviation <= 0.05, 50.0).when(deviation >= 0.2, 25.0).otherwise(35.0)
    guess = _clamp(F.when(price_m2.isNotNull(), 45.0).otherwise(20.0) + F.when(discounted, 25.0).otherwise(0.0))
    return F.when(deviation.isNotNull(), known).otherwise(guess)


def uniqueness(status: Column) -> Column:
    return F.when(status == "duplicate", 10.0).when(status == "possible_duplicate", 40.0).otherwise(80.0)


def completeness(*fields: Column) -> Column:
    have = [F.coalesce((f.cast("string") != "") & (F.coalesce(f.cast("string").try_cast("double"), F.lit(1.0)) != 0), F.lit(False)).cast("int") for f in fields]
    return sum(have[1:], have[0]) * (100.0 / len(fields))


def spam_risk(text: Column, has_contact: Column, status: Column) -> Column:
    return _clamp(_spam_said(text, has_contact) + _spam_of(status))


def _spam_said(text: Column, has_contact: Column) -> Column:
    return F.when(F.length(text) < 12, 30.0).otherwise(0.0) + F.when(has_contact, 0.0).otherwise(30.0) + F.when(text.rlike("!{3,}"), 15.0).otherwise(0.0)


def _spam_of(status: Column) -> Column:
    return F.when(status.isin("duplicate", "possible_duplicate"), 25.0).otherwise(0.0)


def said(packs: dict | None = None) -> dict[str, Column]:
    """What lead_scores() asks of a listing's texts and contacts, as narrow columns that stand for them. packs: owner, agent, discount, urgency."""
    p = {"owner": keywords.OWNER, "agent": keywords.AGENT, "discount": keywords.DISCOUNT, "urgency": keywords.URGENCY} | (packs or {})
    text = squeeze(F.concat_ws(" ", _text(F.col("title")), _text(F.col("description"))), lower=True)
    has_phone, has_contact = _text(F.col("contact_phone")) != "", (_text(F.col("contact_phone")) != "") | (_text(F.col("contact_email")) != "")
    contact = F.when(has_phone, F.col("contact_phone")).otherwise(F.col("contact_email"))
    return {
        "owner_said": owner_probability(text, has_phone, p["owner"], p["agent"]), "discount_said": any_keyword(text, p["discount"]), "urgency_said": F.when(any_keyword(text, p["urgency"]), 80.0).otherwise(30.0),
        "complete": completeness(F.col("title"), F.col("price_rub"), F.col("area_sqm"), F.col("address"), contact), "spam_said": _spam_said(text, has_contact),
    }


#: The columns of said().
SAID = ("owner_said", "discount_said", "urgency_said", "complete", "spam_said")


def parts(rows: DataFrame, as_of: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """All that a lead's score takes, in a few numbers, and the status where rows have it. rows: deviations() with the columns of said()."""
    hours = age_hours(F.col("updated_at"), F.lit(as_of).cast("timestamp"))
    return rows.select("id", "agency_id", "deviation", "below_market", hours.alias("hours"), F.col("owner_said").alias("owner"), _under_market(F.col("discount_said"), F.col("price_m2"), F.col("deviation")).alias("under_market"), F.col("urgency_said").alias("urgency"), F.col("complete").alias("completeness"), "spam_said", *(c for c in ("status",) if c in rows.columns), *keep)


def lead_scores(rows: DataFrame, as_of: str, packs: dict | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the seven parts, score, tier and the columns of keep. rows: deviations() with status, or parts() with it; packs: owner, agent, discount, urgency."""
    if "hours" not in rows.columns:
        rows = parts(rows if "spam_said" in rows.columns else rows.withColumns(said(packs)), as_of, keep)
    made = rows.select(
        "id", "agency_id", "status", "deviation", "below_market", "hours", freshness(F.col("hours")).alias("freshness"), "owner", "under_market", uniqueness(F.col("status")).alias("uniqueness"), "urgency", "completeness",
        _clamp(F.col("spam_said") + _spam_of(F.col("status"))).alias("spam"), *keep,
    )
    score = _clamp(sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)))
    return made.withColumn("score", score).withColumn("tier", F.when(F.col("hours") <= 720, "premium").otherwise("archive"))


def bucket(score: Column) -> Column:
    return F.when(score >= 80, "hot").when(score >= 65, "high").when(score >= 45, "medium").otherwise("low")


def with_owner(scored: DataFrame, links: DataFrame, on: list[str] | None = None) -> DataFrame:
    """scored with what the contact's identity says about each listing. links: identity.links(), or identity.handed() met on the contact that scored keeps."""
    names, on = {"owner_intel_score": "owner_probability_score", "owner_intel_confidence": "owner_confidence", "owner_intel_summary": "owner_explanation_summary", "owner_intel_priority_score": "owner_priority_score"}, on or ["id"]
    return scored.join(links.select(*on, *(F.col(a).alias(b) for a, b in names.items())), on, "left")


def owner_label(owner_intel: Column, owner: Column) -> Column:
    """Who seems to offer: by the identity's score, else by the listing's own."""
    score = F.coalesce(owner_intel, owner)
    return F.when(score.isNull(), "unknown").when(score >= 65, "owner").when(score <= 35, "agent").otherwise("maybe")


def top_reasons(scored: DataFrame, owner_intel: Column, n: int = 3) -> Column:
    """The first n reasons to look at a listing. scored: lead_scores()."""
    c = F.col
    cheap = F.coalesce(c("below_market"), F.lit(False))
    own = F.coalesce(owner_intel >= 60, c("owner") >= 60, F.lit(False))
    every = F.array(F.when(cheap | (c("under_market") >= 60), "below market"), F.when(own, "owner"), F.when(c("hours") <= 24, "new"), F.when(c("urgency") >= 60, "urgent"), F.when(c("uniqueness") >= 70, "rare"), F.when(cheap | (c("under_market") >= 65), "price drop"))
    return F.slice(F.filter(every, lambda x: x.isNotNull()), 1, n)
