"""The listings view over the star schema: one SQL text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

LISTINGS = open(__file__.rsplit("/", 1)[0] + "/listings_view.sql").read()
# The id of LISTINGS is an order's key times 10^13 and the rest, which leaves 64 bits from order 922 337 on, and then both engines stop. Spark
# reads the same number as two's complement: 10^13 is 5^13 shifted by 13 bits, and a shift drops what is too high. Ids end in 0 or 1, and only
# numbers 5 * 2^64 apart would then be equal, so ids are unique up to order 9 223 371.
ID = re.search(r"\(\(\(l_orderkey .*?\) \* 10(?=\s+AS id)", LISTINGS, re.S).group()
REST = "(l_partkey * 100000000 + l_suppkey * 10000 + l_linenumber * 1000 + CAST(l_quantity AS BIGINT) * 10)"
WRAPPED = f"(shiftleft(l_orderkey * 1220703125 + shiftright({REST}, 13), 13) | ({REST} & 8191))"
TABLES = ("lineitem", "orders", "part", "customer", "nation", "region")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A table of fewer splits than cores, dealt by a hash of key over all of them; larger tables are read in their own splits, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = re.sub(rf"(FROM|JOIN)(\s+)({'|'.join(TABLES)})\b", r"\1\2{\3}", LISTINGS.replace(ID, WRAPPED))
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return spark.sql(sql, **tables | {"lineitem": spread(tables["lineitem"], "l_orderkey")})
