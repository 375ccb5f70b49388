"""Exact dedup by content sort, in DataFrame functions only.

Sampled splitters range-partition the normalised texts: by their first characters, then by their digest, so that the
splitters that travel stay small. Within a range rows are sorted by the whole text and the id, which places equal texts
next to each other; each row is compared with its neighbour in full, and the first row of a run has the smallest id.
A text that holds more than a 4096th of all rows is cut by a hash of the id besides, so that it fills many ranges; the
runs of such a text, at most SPREAD, are tied together by its digest.

Defined cases: null text counts as empty and all empty texts are one group; a null id never becomes the kept row
unless its whole group has none (then keep_id is null and kept is false); rows that repeat both id and text are all
returned, each with the same decision; very long texts are compared whole; extra columns are ignored whatever their
names; an empty table gives an empty result. drop_exact_copies decides by row, not by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, cut, hot_keys, row_hash, whole_text

#: One ASCII white space run becomes one space.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Parts that a text with very many rows is cut into.
SPREAD = 1024
#: Characters of a text that splitters look at first.
HEAD = 48


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_RUN, " ")


PLACE = ["head", "text_sha256", "part"]


def _keys(norm: Column) -> list[Column]:
    return [F.left(norm, F.lit(HEAD)).alias("head"), F.sha2(norm, 256).alias("text_sha256")]


def _compared(texts: DataFrame, hot: DataFrame, norm: Column, *tie: str) -> DataFrame:
    """texts in content order, with hot, part, run and first: whether a row's text differs from that of the row before it."""
    rows = texts.join(F.broadcast(hot.select("text_sha256", F.lit(True).alias("hot"))), "text_sha256", "left")
    rows = rows.withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).otherwise(0)).repartitionByRange(*PLACE)
    # The windows run inside the ranges, over one sort by place, text and id, without another exchange.
    at = Window.partitionBy(*PLACE).orderBy("norm", F.asc_nulls_last("doc_id"), *tie)
    return rows.withColumn("norm", norm).withColumn("first", F.when(F.col("norm") == F.lag("norm").over(at), 0).otherwise(1)).withColumn("run", F.sum("first").over(at.rowsBetween(Window.unboundedPreceding, 0))).drop("norm")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    # Written: the regular expression runs once, and counting, sampling and sorting read its result.
    texts = cut(whole_text(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm")).select("*", *_keys(F.col("norm"))), "exact-texts")
    hot = hot_keys(texts.select("text_sha256"), "text_sha256")
    run = Window.partitionBy(*PLACE, "run")
    runs = _compared(texts, hot, F.col("norm")).select("doc_id", "text_sha256", "hot", "part", F.min("doc_id").over(run).alias("low"), F.count(F.lit(1)).over(run).alias("n"))
    keep, size = F.col("low"), F.col("n")
    if not hot.isEmpty():
        runs = cut(runs, "exact-runs")
        ends = runs.where("hot").groupBy("text_sha256", "part", "low", "n").agg(F.count(F.lit(1))).groupBy("text_sha256").agg(F.min("low").alias("all_low"), F.sum("n").alias("all_n"))
        runs = runs.join(F.broadcast(ends), "text_sha256", "left")  # a row for each hot text
        keep, size = F.when(F.col("hot"), F.col("all_low")).otherwise(keep), F.coalesce("all_n", size)
    return runs.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: exactly one row of each text.

    It is a row of the smallest id; null ids come last, but stay where a text has no other. Of rows that repeat both id and
    text the one with the smallest hash stays. The rows go through the sort whole, and the first of each run comes out.
    """
    norm = lambda text: normalised(F.coalesce(text, F.lit("")))
    texts = cut(docs.select(docs[id_col].cast("long").alias("doc_id"), F.struct(*columns_of(docs)).alias("whole"), row_hash(docs).alias("order"), *_keys(norm(docs[text_col]))), "exact-texts")
    hot = hot_keys(texts.select("text_sha256"), "text_sha256")
    firsts = _compared(texts, hot, norm(F.col("whole")[text_col]), "order").where("first = 1")
    if not hot.isEmpty():
        rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "order")
        best = texts.join(F.broadcast(hot), "text_sha256", "left_semi").groupBy("text_sha256").agg(F.min(rank).alias("best"))  # a row for each hot text
        firsts = firsts.join(F.broadcast(best), "text_sha256", "left").where("hot IS NULL OR (order = best.order AND doc_id <=> best.doc_id)")
    return firsts.select("whole.*")


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
