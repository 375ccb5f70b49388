"""Segments, market medians and deviations from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import keywords
from hearthline.functions.extract import any_keyword
from hearthline.functions.normalize import _text

from .selection import medians, same
from .shared import cut

KEYS = ["agency_id", "region", "district", "property_type", "deal_type", "area_band"]
#: Rungs of the lookup, from specific to general: which keys must match; the others must be null in the benchmark.
LADDER = (("region", "district", "property_type", "deal_type", "area_band"), ("region", "district", "property_type", "deal_type"), ("region", "property_type", "deal_type", "area_band"), ("region", "property_type", "deal_type"), ("property_type", "deal_type"))

#: Benchmarks (about 100 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 200_000


def property_type(hint: Column, title: Column, description: Column, rules=keywords.PROPERTY_RULES) -> Column:
    text = F.lower(F.concat_ws(" ", _text(hint), _text(title), _text(description)))
    out = F.lit("other")
    for name, words in reversed(rules):
        out = F.when(any_keyword(text, words), name).otherwise(out)
    return out


def deal_type(listing_type: Column, title: Column, description: Column, rent=keywords.RENT, sale=keywords.SALE) -> Column:
    given, text = F.lower(_text(listing_type)), F.lower(F.concat_ws(" ", _text(title), _text(description)))
    return F.when(given.isin("rent", "lease", "аренда"), "rent").when(given.isin("sale", "sell", "продажа"), "sale").when(any_keyword(text, rent), "rent").when(any_keyword(text, sale), "sale").otherwise("rent")


def area_band(area: Column, bands=keywords.AREA_BANDS) -> Column:
    out = F.lit(None).cast("string")
    for low, high, label in reversed(bands):
        out = F.when((area > low) & (area <= high), label).otherwise(out)
    return out


def price_per_m2(price: Column, area: Column) -> Column:
    return F.when((area > 0) & price.isNotNull(), price / area)


def segments(listings: DataFrame, rules=keywords.PROPERTY_RULES) -> DataFrame:
    price, area = F.col("price_rub").cast("double"), F.col("area_sqm").cast("double")
    return listings.select(
        "*", F.nullif(F.coalesce("region_code", "city"), F.lit("")).alias("region"), property_type(F.lit(None), F.col("title"), F.col("description"), rules).alias("property_type"),
        deal_type(F.col("listing_type"), F.col("title"), F.col("description")).alias("deal_type"), area_band(area).alias("area_band"), price.alias("price"), price_per_m2(price, area).alias("price_m2"),
    )


def benchmarks(segmented: DataFrame, as_of: str, window_days: int = 180, least: int = 3) -> DataFrame:
    """Medians of each segment with at least that many priced rows since the window's start; rejected rows, where status tells, are left out."""
    rows = segmented.where(F.coalesce(F.col("status") != "rejected", F.lit(True))) if "status" in segmented.columns else segmented
    rows = rows.where((F.col("updated_at") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(window_days))) & F.col("price").isNotNull() & F.col("area_sqm").isNotNull())
    # Written narrow, as sizes and medians both read it; a segment of any size is selected from without gathering it.
    rows = cut(rows.select(*KEYS, "price", "price_m2", "updated_at"), "priced")
    sized = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("listing_count"), F.min("updated_at").alias("first_at"), F.max("updated_at").alias("last_at")).where(F.col("listing_count") >= least)
    middle = medians(rows, KEYS, ["price", "price_m2"])
    return sized.join(middle, same(sized, middle, KEYS)).select(*(sized[k] for k in KEYS), "median_price", "median_price_m2", "listing_count", "first_at", "last_at")


def deviations(segmented: DataFrame, bench: DataFrame) -> DataFrame:
    """segmented with rung, market_m2, deviation and below_market: the first rung with a median.

    A listing's keys of each rung meet a benchmark's keys, nulls included, as one string. Few benchmarks are broadcast and looked
    up rung by rung without moving listings; many are met by one shuffled join for all rungs.
    """
    def key(keep: tuple[str, ...]) -> Column:
        return F.concat_ws("\x1f", F.col("agency_id").cast("string"), *(F.coalesce(F.col(k), F.lit("\x00")) if k in keep else F.lit("\x00") for k in KEYS[1:]))

    # A benchmark stands for three rows at least and the keys are few, yet their number grows with the table: broadcast only below BROADCAST_ROWS.
    have = bench.where("median_price_m2 > 0").select(key(tuple(KEYS[1:])).alias("key"), "median_price_m2")
    small = have.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if small:
        found, rows = [], segmented
        for i, keep in enumerate(LADDER):
            rung = F.broadcast(have.select(F.col("key").alias(f"__k{i}"), F.col("median_price_m2").alias(f"__m{i}")))
            rows = rows.join(rung, key(keep) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
            found.append(F.when(F.col(f"__m{i}").isNotNull(), F.struct(F.lit(i + 1).alias("rung"), F.col(f"__m{i}").alias("market_m2"))))
        rows = rows.withColumn("__b", F.coalesce(*found)).withColumn("rung", F.col("__b.rung")).withColumn("market_m2", F.col("__b.market_m2")).drop("__b", *(f"__m{i}" for i in range(len(LADDER))))
    else:
        ranked = F.array(*(F.struct(F.lit(i + 1).alias("rung"), key(k).alias("key")) for i, k in enumerate(LADDER)))
        asked = segmented.select("id", F.explode(ranked).alias("r")).select("id", "r.rung", "r.key")
        best = asked.join(have, "key").groupBy("id").agg(F.min_by(F.struct("rung", "median_price_m2"), "rung").alias("b")).select("id", "b.rung", F.col("b.median_price_m2").alias("market_m2"))
        rows = segmented.join(best, "id", "left")
    dev = F.when(F.col("market_m2").isNotNull() & F.col("price_m2").isNotNull(), (F.col("price_m2") - F.col("market_m2")) / F.col("market_m2"))
    return rows.withColumn("deviation", dev).withColumn("below_market", F.coalesce(F.col("deviation") <= -0.1, F.lit(False)))
