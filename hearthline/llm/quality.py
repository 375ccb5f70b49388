"""Quality by compression: a text that the dictionary of good text packs better than the dictionary of bad text is good.

Two zstandard dictionaries are trained on a bounded sample of labelled rows (SAMPLE of each class); the difference of the
two compressed sizes over their sum, taken over all blocks of the whole text, is calibrated by a logistic curve on whole texts
of rows that trained no dictionary. Scoring is a map over the rows, without exchange.

Defined cases: null and empty texts compress as one empty block and get the score of that; without labelled rows of both
classes there is no model, every score is 0.5 and keep_good rejects nothing; repeated rows are scored alike; very long texts are compressed whole, block by block; rows
of labelled rows that repeat an id the smallest text is learnt; rows
with a null id are scored and never held out; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_text
from .labelled import held_out, logistic, sample

#: Labelled rows of each class that a model learns from at most; two thirds train the dictionaries.
SAMPLE = 3000
#: Bytes of a block that is compressed on its own, so that a long text cannot become its own dictionary.
BLOCK = 2000
#: Bytes of each dictionary.
DICTIONARY = 32768
#: Compression level.
LEVEL = 3
#: Blocks of each class that train a dictionary at most, taken by hash from all blocks of the sampled texts.
TRAIN_BLOCKS = 4000


class SizeDifference:
    """Normalised difference of compressed sizes under two dictionaries: above 0, the good one packs better."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.packers = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) for d in (good, bad)]

    def __call__(self, text: str) -> float:
        data = text.encode()
        a, b = (sum(len(p.compress(data[k : k + BLOCK])) for k in range(0, max(len(data), 1), BLOCK)) for p in self.packers)
        return (b - a) / (a + b)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, float, float] | None:
    """(good dictionary, bad dictionary, slope, bias), or None without both classes."""
    # Few rows (SAMPLE of each class), read several times below.
    rows = cut(sample(docs, labels, "quality", SAMPLE, True).select("doc_id", "text", "label"), "quality-sample")
    ids = sorted(rows.select("doc_id", "label").collect(), key=lambda r: r["doc_id"])
    rest = {r["doc_id"] for r in ids[::3]}
    if not all(any(r["label"] == c and r["doc_id"] not in rest for r in ids) for c in (1, 0)):
        return None

    def split(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[~b["doc_id"].isin(rest)]
            for i, c, data in zip(b["doc_id"], b["label"], b["text"].map(str.encode)):
                at = range(0, max(len(data), 1), BLOCK)
                yield pd.DataFrame({"doc_id": i, "label": c, "at": at, "block": [data[k : k + BLOCK] for k in at]})

    blocks = rows.mapInPandas(split, "doc_id long, label int, at long, block binary")
    dictionaries = []
    for c in (1, 0):
        chosen = blocks.where(F.col("label") == c).orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(TRAIN_BLOCKS).collect()
        texts = [bytes(r["block"]) for r in sorted(chosen, key=lambda r: (r["doc_id"], r["at"]))]
        try:
            dictionaries.append(zstandard.train_dictionary(DICTIONARY, texts).as_bytes())
        except zstandard.ZstdError:  # too few samples to train on: their bytes serve as they are
            dictionaries.append(b"".join(texts)[-DICTIONARY:].ljust(8, b" "))

    def measured(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        measure = SizeDifference(*dictionaries)
        for b in batches:
            b = b[b["doc_id"].isin(rest)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": b["text"].map(measure).astype(float), "label": b["label"]})

    tried = sorted(rows.mapInPandas(measured, "doc_id long, x double, label int").collect(), key=lambda r: r["doc_id"])
    slope, bias = logistic([[r["x"]] for r in tried], [r["label"] for r in tried])
    # The sample is balanced by class; the bias goes back to the classes' shares among all labelled rows outside the held-out fold.
    share = labels.where(~held_out(F.col("doc_id"))).agg(F.avg(F.col("quality").cast("double"))).first()[0] or 0.5
    have = np.mean([r["label"] for r in tried]) if tried else 0.5
    odds = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    return dictionaries[0], dictionaries[1], float(slope), float(bias + odds(share) - odds(have))


def scorer(model: tuple[bytes, bytes, float, float] | None):
    """Column function: the score of a text, null taken as empty; 0.5 without a model."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = SizeDifference(*model[:2])
        for texts in batches:
            x = np.array([measure(t) for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(model[2] * x + model[3], -30, 30))))

    return (lambda text: run(F.coalesce(text, F.lit("")))) if model else (lambda text: F.lit(0.5))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = whole_text(docs).select("doc_id", scorer(fit(docs, labels))(F.col("text")).alias("score"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns; each row is judged by its own text."""
    model = fit(docs, labels)
    return docs if model is None else docs.where(scorer(model)(docs["text"]) >= threshold)
