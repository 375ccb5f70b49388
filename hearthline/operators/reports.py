"""Lists, boards and figures that are read off the tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that a listing search looks into, where they are there.
SEARCHED = ("title", "description", "listing_type", "address", "district", "street", "city", "contact_name", "contact_phone", "contact_email", "raw_url", "telegram_post_url")


def status_counts(rows: DataFrame, known: list[str], column: str = "status") -> DataFrame:
    """status, n for each known status in their order, 0 where none has it; other statuses are left out."""
    order = rows.sparkSession.createDataFrame([(k, s) for k, s in enumerate(known)], "k int, status string")
    return F.broadcast(order).join(rows.groupBy(F.col(column).alias("status")).agg(F.count(F.lit(1)).alias("n")), "status", "left").select("k", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _counts_text(rows: DataFrame, known: list[str], name: str) -> DataFrame:
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("k", "status", "n"))), lambda x: F.concat_ws("=", x["status"], x["n"].cast("string")))
    return status_counts(rows, known).agg(F.array_join(pairs, ",").alias(name))


def kpis(listings: DataFrame, calls: DataFrame, leads: DataFrame, deals: DataFrame, lead_statuses: list[str], deal_statuses: list[str], open_deals: tuple[str, ...]) -> DataFrame:
    """One row of thirteen figures. Each table is summed up on its own, and one-row results are put side by side.

    listings(status), calls(status, transcript_status), leads(status), deals(status, value_rub).
    """
    said = lambda s: F.count_if(F.col("status") == s)
    parts = [
        listings.agg(F.count(F.lit(1)).alias("parser_total"), said("new").alias("parser_new"), said("possible_duplicate").alias("parser_possible_duplicate"), said("duplicate").alias("parser_duplicate")),
        calls.agg(F.count(F.lit(1)).alias("calls_total"), said("missed").alias("calls_missed"), F.count_if(F.col("transcript_status") == "completed").alias("calls_transcribed")),
        leads.agg(F.count(F.lit(1)).alias("leads_total")), _counts_text(leads, lead_statuses, "leads_by_status"),
        deals.agg(F.count(F.lit(1)).alias("deals_total"), F.coalesce(F.sum(F.when(F.col("status").isin(*open_deals), F.col("value_rub"))), F.lit(0)).cast("double").alias("pipeline_value_rub")), _counts_text(deals, deal_statuses, "deals_by_status"),
    ]
    out = parts[0].withColumn("__one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("__one", F.lit(1)), "__one")
    rate = F.when(F.col("leads_total") > 0, F.bround(F.col("deals_total") / F.col("leads_total") * 100, 2)).otherwise(0.0)
    return out.drop("__one").withColumn("conversion_lead_to_deal_percent", rate)


def search(rows: DataFrame, text: str = "", status: str | None = None, channel: str | None = None, listing_type: str | None = None, region: str | None = None, updated_from: str | None = None, updated_to: str | None = None, duplicates_only: bool = False, published_only: bool = True, columns=SEARCHED) -> DataFrame:
    """Listings that meet every condition given. A day as upper end holds to its last moment; dates that cannot be read are ignored; % and _ in text are wildcards."""
    def moment(value: str) -> Column:
        return F.lit(value).try_cast("timestamp")

    c, conditions = F.col, []
    if status:
        conditions.append(c("status") == status)
    if channel:
        conditions.append(c("source_channel") == channel)
    if listing_type:
        conditions.append(c("listing_type") == listing_type)
    if duplicates_only:
        conditions.append(c("status").isin("duplicate", "possible_duplicate"))
    if published_only:
        conditions.append(c("pipeline_status") == "published")
    if region:
        conditions.append((c("region_code") == region) | c("city").ilike(f"%{region}%"))
    if updated_from:
        conditions.append(F.coalesce(c("updated_at") >= moment(updated_from), moment(updated_from).isNull()))
    if updated_to:
        end = moment(updated_to)
        inside = c("updated_at") < end + F.make_dt_interval(F.lit(1)) if len(updated_to) == 10 else c("updated_at") <= end
        conditions.append(F.coalesce(inside, end.isNull()))
    if text.strip():
        hits = [c(x).ilike(f"%{text.strip()}%") for x in columns if x in rows.columns]
        any_hit = F.lit(False)
        for h in hits:
            any_hit = any_hit | F.coalesce(h, F.lit(False))
        conditions.append(any_hit)
    for x in conditions:
        rows = rows.where(x)
    return rows


def paged(rows: DataFrame, order: list[Column], page: int = 1, size: int = 20) -> tuple[DataFrame, int, int, int]:
    """(rows of the page, total, page, pages); a page past the end is the last one."""
    total = rows.count()
    pages = max(1, math.ceil(total / size))
    page = min(max(page, 1), pages)
    return rows.orderBy(*order).offset((page - 1) * size).limit(size), total, page, pages


def top(rows: DataFrame, order: list[Column], n: int, where: Column | None = None) -> DataFrame:
    """The first n rows in that order, of those that meet the condition (a parent, a tenant)."""
    return (rows if where is None else rows.where(where)).orderBy(*order).limit(n)


def newest(rows: DataFrame, tenant: Column | None = None, key: str = "id") -> DataFrame:
    """A tenant's rows, the newest first."""
    return (rows if tenant is None else rows.where(tenant)).orderBy(F.desc(key))


def active_tenants(sources: DataFrame) -> DataFrame:
    return sources.where("is_active").select("agency_id").distinct()


def contact_objects(rows: DataFrame) -> DataFrame:
    """The objects of each contact: how many listings, and when one was last updated. rows: graph.keyed()."""
    # One aggregate for each column, so that those nobody asks for are not moved.
    earliest = F.struct((-F.col("updated_at").cast("timestamp").cast("double")).alias("t"), "id")
    first = {c: F.min_by(v, earliest).alias(c) for c, v in (("address_key", F.col("address_key")), ("area_sqm", F.col("area_sqm").cast("double")), ("listing_type", F.col("listing_type")))}
    own = rows.where("contact_key IS NOT NULL")
    return own.groupBy("agency_id", "contact_key", "object_key").agg(*first.values(), F.count(F.lit(1)).alias("count"), F.max("updated_at").alias("last_seen"))


def contact_timeline(rows: DataFrame, days: int = 30) -> DataFrame:
    """Listings of each contact by day of their last update, the latest days."""
    per_day = rows.where("contact_key IS NOT NULL AND updated_at IS NOT NULL").groupBy("agency_id", "contact_key", F.date_format("updated_at", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy("agency_id", "contact_key").orderBy(F.desc("date")))
    return per_day.withColumn("k", rank).where(F.col("k") <= days).drop("k")


def source_summary(sources: DataFrame, runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Active, automatically found and failed sources, with the last finished run and the next one due of each job, side by side.

    sources(state, auto_discovered), runs(job_key, started_at, finished_at), jobs(job_key, next_run_at).
    """
    state = sources.agg(F.count_if(F.col("state") == "active").alias("active_sources"), F.count_if(F.col("auto_discovered")).alias("auto_activated_sources"), F.count_if(F.col("state").isin("paused", "error")).alias("failed_sources")).withColumn("__one", F.lit(1))
    last = runs.groupBy("job_key").agg(F.max_by("finished_at", "started_at").alias("last_run_at"))
    return jobs.select("job_key", "next_run_at", F.lit(1).alias("__one")).join(last, "job_key", "left").join(state, "__one").drop("__one")


def board(items: DataFrame, stages: list[str], key: str = "id", column: str = "status") -> DataFrame:
    """status, key: the items of each stage, stages in their order and empty ones with a null item; unknown stages come last."""
    order = items.sparkSession.createDataFrame([(k, s) for k, s in enumerate(stages)], "place int, status string")
    rows = items.select(F.col(column).alias("status"), key)
    known = F.broadcast(order).join(rows, "status", "left") if stages else rows.limit(0).withColumn("place", F.lit(0))
    other = rows.join(F.broadcast(order), "status", "left_anti").withColumn("place", F.lit(len(stages)))
    return known.select("place", "status", key).unionByName(other.select("place", "status", key))
