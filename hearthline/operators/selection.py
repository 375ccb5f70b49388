"""Exact medians of groups of any size: no group's values meet in one task.

Groups of up to HOT_ROWS rows go through the engine's exact median, which holds a group's distinct values. Larger ones are
counted by (group, value), the counts are dealt over ranges of (group, value), and running sums over the ranges of a group
tell which one holds the middle; only there are single values counted up to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, discard

#: Rows of a group up to which one task may hold its values.
HOT_ROWS = 200_000


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, nulls included."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def medians(rows: DataFrame, keys: list[str], values: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """keys and median_<value> of each value column, nulls left out; keys may be null. rows are read several times, so write them before."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.where(F.col("n") > hot_rows).drop("n")  # no more than one row for each hot_rows rows
    plain = lambda part: part.groupBy(*keys).agg(*(F.median(v).alias(f"median_{v}") for v in values))
    if hot.isEmpty():
        return plain(rows)
    hot = cut(hot, "hot-groups")
    large = rows.join(hot, same(rows, hot, keys), "left_semi")
    found = None
    for v in values:
        one = selected(large, keys, v)
        found = one if found is None else found.join(one.toDF(*(f"__{k}" for k in keys), f"median_{v}"), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)), "left").drop(*(f"__{k}" for k in keys))
    # Groups without any value of the first column are missing among the selected.
    every = hot.join(found.toDF(*(f"__{k}" for k in keys), *(f"median_{v}" for v in values)), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)), "left").drop(*(f"__{k}" for k in keys))
    return plain(rows.join(hot, same(rows, hot, keys), "left_anti")).unionByName(every)


def ranges(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, part): how often each value occurs, dealt over ranges of (keys, value); part is the number of the range."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return cut(counts.repartitionByRange(*keys, value).withColumn("part", F.spark_partition_id()), "value-ranges")


def selected(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and median_<value> by selection: the mean of the two middle values."""
    dealt = ranges(rows, keys, value)
    of_key = Window.partitionBy(*keys)
    sizes = dealt.groupBy("part", *keys).agg(F.sum("n").alias("size"))  # one row for each range and group it holds
    sizes = sizes.withColumn("total", F.sum("size").over(of_key)).withColumn("before", F.sum("size").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    sizes = sizes.withColumn("before", F.coalesce("before", F.lit(0))).withColumn("low", F.floor((F.col("total") - 1) / 2)).withColumn("high", F.floor(F.col("total") / 2))
    holds = lambda rank: (F.col("before") <= F.col(rank)) & (F.col(rank) < F.col("before") + F.col("size"))
    middle = sizes.where(holds("low") | holds("high")).select(F.col("part").alias("in"), *(F.col(k).alias(f"__{k}") for k in keys), "before", "low", "high")
    met = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.col("part") == F.col("in"))
    running = F.sum("n").over(Window.partitionBy("part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    near = dealt.join(middle, met).withColumn("from", F.col("before") + F.coalesce(running, F.lit(0)))
    covers = lambda rank: (F.col("from") <= F.col(rank)) & (F.col(rank) < F.col("from") + F.col("n"))
    at = near.groupBy(*keys).agg(F.max(F.when(covers("low"), F.col(value))).alias("__low"), F.max(F.when(covers("high"), F.col(value))).alias("__high"))
    out = cut(at.select(*keys, ((F.col("__low") + F.col("__high")) / 2).alias(f"median_{value}")), "medians")
    discard(dealt)
    return out
