"""Micro-batch jobs: call-event upserts and ingest-time duplicate decisions, each batch merged into a table by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearthline.operators import dedup, events
from hearthline.operators.shared import cut, discard, exists

#: Folders that the keys of all listings seen are dealt over; a batch reads only those of its own keys.
BUCKETS = 1024


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, key: list[str], fields: list[str], order: list[str]) -> StreamingQuery:
    """Appends each batch's rows; read the latest values by key back with current(). A batch that is replayed changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        batch.select(*key, *order, *fields).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, key: list[str], fields: list[str], order: list[str]) -> DataFrame:
    return events.upsert(spark.read.parquet(table), key, fields, order)


def compact(spark: SparkSession, table: str, target: str, key: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """Writes what current() needs of the batches of table as the first batch of target: one row for each key and field that is set.

    The newest value of a field keeps its place in the order, so later batches merge with it as they would with all rows.
    """
    rows = spark.read.parquet(table)
    at = F.struct(*order)
    newest = rows.groupBy(*key).agg(*(F.max(F.when(F.col(f).isNotNull(), F.struct(at.alias("at"), F.col(f).alias("value")))).alias(f) for f in fields), F.max(at).alias("__last"))
    one = lambda f: newest.where(F.col(f).isNotNull()).select(*key, *(F.col(f"{f}.at.{o}").alias(o) for o in order), *(F.col(f"{f}.value").alias(x) if x == f else F.lit(None).cast(rows.schema[x].dataType).alias(x) for x in fields))
    out = newest.where(F.coalesce(*(F.col(f)["at"] for f in fields)).isNull()).select(*key, *(F.col(f"__last.{o}").alias(o) for o in order), *(F.lit(None).cast(rows.schema[x].dataType).alias(x) for x in fields))
    for f in fields:
        out = out.unionByName(one(f))
    out.write.mode("overwrite").parquet(f"{target}/batch=0")
    return spark.read.parquet(target)


def stored_firsts(spark: SparkSession, table: str, agency: str, numbers: list[int], before: int) -> DataFrame:
    """The keys in these folders as they were before a batch. Folders without rows are passed over, and no other folder is listed or read."""
    schema = dedup.FIRSTS.format(agency=agency) + ", bucket int, batch int"
    paths = [p for p in (f"{table}/keys/bucket={n}" for n in numbers) if exists(spark, p)]
    rows = spark.read.schema(schema).option("basePath", f"{table}/keys").parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.where(F.col("batch") < before)


def dedup_stream(stream: DataFrame, table: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Each arriving listing is decided against what came before it; decisions go to table/decisions, keys to table/keys.

    Of all rows seen only the first of each key is kept (dedup.firsts), dealt over folders by a hash of the key, so a
    batch lists and reads the folders of its own keys. Rows are decided as of their arrival: an id that comes later than a larger one does not
    revise it. A batch that is replayed does not see its own keys and overwrites what it wrote.
    """
    agency = stream.schema["agency_id"].dataType.simpleString()

    def decide(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base = cut(dedup.base_rows(batch), "stream-rows")
        numbers = [r["bucket"] for r in dedup.asked_buckets(base, buckets).collect()]  # no more than there are folders
        stored = cut(dedup.asked_of(stored_firsts(spark, table, agency, numbers, number), base).drop("bucket", "batch"), "stream-keys")
        made = cut(dedup.decided(base, stored, ruled=True), "stream-decisions")
        made.drop("by_ext").write.mode("overwrite").parquet(f"{table}/decisions/batch={number}")
        key = ["kind", "agency_id", "source_channel", "key", "area", "price"]
        known = stored.select(*(F.col(k).alias(f"__{k}") for k in key))
        new = dedup.firsts(base, made)
        met = F.lit(True)
        for k in key:
            met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
        new = new.join(known, met, "left_anti").withColumn("bucket", dedup.bucket(*(F.col(k) for k in ("kind", "agency_id", "source_channel", "key", "price")), buckets)).withColumn("batch", F.lit(number))
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{table}/keys")
        for frame in (made, stored, base):
            discard(frame)

    return stream.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
