"""Helpers shared by the training-data operators: shared folders, materialised cuts, small model broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot if it holds more rows than this, and more than this share of all: at most HOT_SHARE keys are hot at any size.
HOT_ROWS, HOT_SHARE = 1000, 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Set here only where the session has none and runs in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="hearthline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Texts go to Python workers at most rows at a time, as some are very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and lost executors cost nothing."""
    path = scratch(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that cut() wrote, once all that was derived from it is written itself."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def hot_least(rows: DataFrame) -> int:
    """Rows that a key of this table may hold without being hot."""
    return max(HOT_ROWS, rows.count() // HOT_SHARE)


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key) of the keys that hold many rows; HOT_SHARE rows at most, so it may be broadcast. rows should be narrow and written."""
    return cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_least(rows)).select(key), "hot")


def join_hot(rows: DataFrame, single: DataFrame, key: list[str], hot: DataFrame | None = None) -> DataFrame:
    """Inner join of rows with single, which has one row for each key. Rows of hot keys meet theirs by broadcast, so none fills a task."""
    hot = hot_keys(rows, *key) if hot is None else hot
    if hot.isEmpty():
        return rows.join(single, key)
    hot = F.broadcast(hot)
    return rows.join(hot, key, "left_anti").join(single, key).unionByName(rows.join(F.broadcast(single.join(hot, key, "left_semi")), key))


def columns_of(docs: DataFrame) -> list[Column]:
    """All columns of docs, whatever signs their names hold."""
    return [docs["`" + c.replace("`", "``") + "`"] for c in docs.columns]


def row_hash(docs: DataFrame) -> Column:
    """A hash over all columns; what holds a map, which has no hash, goes in as JSON."""
    maps = lambda t: isinstance(t, MapType) or any(map(maps, [f.dataType for f in t.fields] if isinstance(t, StructType) else [t.elementType] if isinstance(t, ArrayType) else []))
    return F.xxhash64(*(F.to_json(F.struct(c.alias("c"))) if maps(f.dataType) else c for c, f in zip(columns_of(docs), docs.schema.fields)))


def whole_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null text as empty; every other column is dropped, so clashing names cannot matter."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def packed(docs: DataFrame, keys: str) -> DataFrame:
    """The key columns and z, the compressed text: less to move where texts must meet what was found about them."""
    names = [k.split()[0] for k in keys.split(",")]

    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield b[names].assign(z=[z.compress(t.encode()) for t in b["text"]])

    return docs.mapInPandas(pack, f"{keys}, z binary")
