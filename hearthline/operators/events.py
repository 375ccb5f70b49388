"""Event upserts and changes between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.extract import keywords_of


def upsert(events: DataFrame, key: list[str], fields: list[str], order: list[str], first: dict[str, str] | None = None) -> DataFrame:
    """The latest non-null value of each field for each key; first: output name -> column whose earliest value counts."""
    at = F.struct(*order)
    return events.groupBy(*key).agg(
        *(F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields), *(F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(n) for n, c in (first or {}).items())
    )


def changes(events: DataFrame, key: list[str], fields: list[str], order: list[str], owner: str | None = None) -> DataFrame:
    """key, order, field, before, after, kind of each field that differs from the row before.

    kind: owner_changed for the field named owner, else filled, cleared or changed; null and blank count as empty.
    """
    at = Window.partitionBy(*key).orderBy(*order)
    def one(f: str) -> Column:
        a, b = F.lag(F.col(f).cast("string")).over(at), F.col(f).cast("string")
        return F.struct(F.lit(f).alias("field"), a.alias("before"), b.alias("after"))
    rows = events.withColumn("first", F.row_number().over(at) == 1).select(*key, *order, "first", F.array(*map(one, fields)).alias("c"))
    rows = rows.where("NOT first").select(*key, *order, F.explode("c").alias("c")).select(*key, *order, "c.*").where(~F.col("before").eqNullSafe(F.col("after")))
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    was, now = empty("before"), empty("after")
    return rows.withColumn("kind", F.when(F.col("field") == F.lit(owner), "owner_changed").when(was & ~now, "filled").when(~was & now, "cleared").otherwise("changed"))


def calls_to_leads(calls: DataFrame, leads: DataFrame) -> DataFrame:
    """calls(call_id, lead_id, from_number), leads(lead_id, title, contact_phone): each call's lead, the known one or one built from its number."""
    known = leads.select(F.col("lead_id").alias("known_id"), F.col("title").alias("known_title"), F.col("contact_phone").alias("known_phone"))
    rows = calls.join(known, calls["lead_id"] == known["known_id"], "left")
    is_new = F.col("known_id").isNull()
    return rows.select(
        "call_id", "known_id", F.when(is_new, F.concat(F.lit("Call lead "), F.coalesce("from_number", F.lit("unknown")))).otherwise(F.col("known_title")).alias("title"),
        F.when(is_new, F.col("from_number")).otherwise(F.col("known_phone")).alias("contact_phone"), F.when(is_new, F.concat(F.lit("call:"), F.col("call_id"))).alias("source_record_id"), is_new.alias("is_new"),
    )


def top_keywords(transcripts: DataFrame, key: str, turn: str, text: str, n: int = 10, least: int = 5) -> DataFrame:
    """key, word, n, rank: the most frequent long words of each transcript; of equally frequent ones the earlier first."""
    words = transcripts.select(key, turn, F.posexplode(keywords_of(F.col(text), least)).alias("at", "word"))
    counts = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(turn, "at")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).select(key, "word", "n", F.col("rank").cast("int").alias("rank"))
