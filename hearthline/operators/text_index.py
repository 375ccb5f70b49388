"""Text search over listings by trigrams: postings narrow the rows, the condition itself decides.

An index has three tables, dealt over folders: grams (by a hash of the gram: the distinct lower-cased texts that hold each trigram, by
their hashes), holders (by the hash of the text: the rows that have it) and rows (by a hash of the id: the texts). So a text that many
rows share has its grams once. A search reads the folders of its rarest grams, then of the texts that hold them all, and then only
the folders of their rows; texts of equal hashes only add rows, which the condition refuses. Terms without three plain signs in a row are
answered by a scan of the rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .incremental import bucket_of, stored
from .reports import SEARCHED
from .shared import cut

BUCKETS = 256
#: Grams of a term that are looked up, the rarest ones.
LOOKED_UP = 4


def grams_of(text: Column) -> Column:
    low = F.lower(text)
    return F.transform(F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(low, i, F.lit(3)))


def build(listings: DataFrame, path: str, columns=SEARCHED, buckets: int = BUCKETS) -> None:
    """Writes the index of these columns of listings (id and those of the columns that are there)."""
    have = [c for c in columns if c in listings.columns]
    rows = listings.select("id", *(F.col(c).cast("string").alias(c) for c in have)).withColumn("bucket", bucket_of(["id"], buckets))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    kept = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    texts = kept.select("id", F.explode(F.array_distinct(F.array(*(F.lower(F.col(c)) for c in have)))).alias("text")).where("text IS NOT NULL").withColumn("key", F.xxhash64("text"))
    # A frequent text or gram fills its folder's files from many tasks: they are dealt by a part of the id or of the text as well.
    holders = texts.select("key", "id").withColumn("bucket", bucket_of(["key"], buckets))
    holders.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/holders")
    grams = texts.select("key", "text").distinct().select("key", F.explode(F.array_distinct(grams_of(F.col("text")))).alias("gram")).withColumn("bucket", bucket_of(["gram"], buckets))
    grams.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(4))).sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")
    sizes = rows.sparkSession.read.schema(grams.schema).parquet(f"{path}/grams").groupBy("gram", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/sizes")


def plain_pieces(text: str) -> list[str]:
    """The parts of a search text between the wildcards % and _ that are long enough to have grams; a backslash ends the use of grams."""
    return [] if "\\" in text else [p for p in text.replace("_", "%").split("%") if len(p) >= 3]


def search(spark: SparkSession, path: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """(id) of the rows one of whose columns is like %text%, in any case of letters: what a scan of all rows finds."""
    text = text.strip()
    rows = spark.read.parquet(f"{path}/rows")
    texts = [c for c in rows.columns if c not in ("id", "bucket")]
    hit = reduce(or_, (F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False)) for c in texts))
    pieces = plain_pieces(text)
    if not pieces:
        return rows.where(hit).select("id")
    asked = spark.createDataFrame([(p,) for p in pieces], "piece string").select(F.explode(F.array_distinct(grams_of(F.col("piece")))).alias("gram")).distinct().withColumn("bucket", bucket_of(["gram"], buckets))
    asked = asked.collect()  # no more than the signs of the text
    sizes = stored(spark, f"{path}/sizes", sorted({r["bucket"] for r in asked}), "gram string, n long, bucket int").where(F.col("gram").isin([r["gram"] for r in asked])).collect()
    if len(sizes) < len(asked):  # a gram that no row has
        return rows.where(F.lit(False)).select("id")
    rarest = sorted(sizes, key=lambda r: (r["n"], r["gram"]))[:LOOKED_UP]
    said = stored(spark, f"{path}/grams", sorted({r["bucket"] for r in rarest}), "key long, gram string, bucket int").where(F.col("gram").isin([r["gram"] for r in rarest]))
    said = cut(said.groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rarest)).select("key", bucket_of(["key"], buckets).alias("bucket")), "text-hits")
    held = stored(spark, f"{path}/holders", sorted(r["bucket"] for r in said.select("bucket").distinct().collect()), "key long, id long, bucket int")
    found = cut(held.join(said.select("key"), "key", "left_semi").select("id", bucket_of(["id"], buckets).alias("bucket")).distinct(), "gram-hits")
    numbers = sorted(r["bucket"] for r in found.select("bucket").distinct().collect())  # no more than there are folders
    return stored(spark, f"{path}/rows", numbers, rows.schema).join(found.select("id"), "id", "left_semi").where(hit).select("id")
