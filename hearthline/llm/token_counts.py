"""Token counts through a digest cache.

Texts are digested; digests that the cache lacks for this tokenizer version are encoded once each and appended; every
document then joins its digest with the stored counts. The cache is a Parquet table (digest, tokenizer, n_tokens) in the
shared folder, so it outlives the job and a lost executor.

Defined cases: null text counts as empty (0 tokens); repeated rows and copies are encoded once and each returned; very
long texts are encoded whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, scratch, small_batches, whole_text
from .merges import Merges

#: Entries that a worker's word cache may hold before it starts anew; it bounds memory, not results.
CACHE_WORDS = 250_000
#: Texts whose new words are learnt together.
STRETCH = 500
#: Outside this range a text is looked up chunk by chunk as it is, without lowering case first.
_PLAIN = re.compile("[^\x00-įı-ɏ]")
#: Signs that are one letter in lower case too, where they are letters. Not so İ: its lower case ends in a mark, which a stop behind it joins.
_SURE = re.compile("[A-Za-zª-įı-ɏͰ-ԯ]")


class WordMerges:
    """Ids of lower-case words of letters, each a single pre-token, by vectorised merge rounds."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        pairs = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs[ids[a], ids[b]] = (rank, ids[a + b])
        self.merges = Merges(pairs, max(ids.values()) + 1)
        # Byte-level alphabet: printable Latin-1 signs stand for themselves, the other bytes for signs from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.inner = np.array([ids[sign[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([ids[sign[b] + end] for b in range(256)], dtype=np.int64)

    def encode(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data, ends = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(sizes) - 1
        sym = self.inner[data]
        sym[ends] = self.last[data[ends]]
        word, sym, _ = self.merges.run(sym, np.repeat(np.arange(len(raw)), sizes))
        flat, cuts = sym.astype("<u4").tobytes(), (np.searchsorted(word, np.arange(len(raw) + 1)) * 4).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


class WordEncoder:
    """Token ids of whole texts from ids of white-space-free chunks, each encoded once by the library.

    The tokenizer drops white space before its pre-tokenizer and none of its pre-tokens or special strings holds any, so a
    text's ids are the ids of its chunks put together. A chunk that ends in a letter and one stop or comma is two
    pre-tokens; its stem is looked up alone.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = WordMerges(path)
        self.ends = {x: self._encode([x])[0] for x in ".,!"}
        self.chunks: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        probes = ["", " ", "A  b\tc", "don't!! x.y,", "İ, Ünïcode. é\u0301!", "<|endoftext|> 12 日本🎉", "ﬁ ǅ. ß!"]
        for probe, chunks in zip(probes, self.encode(probes)):
            if b"".join(chunks) != self._encode([probe])[0]:
                raise ValueError(f"this tokenizer encodes {probe!r} in a way that is not supported")

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch(words, add_special_tokens=False)]

    def _split(self, text: str) -> list[str]:
        if "<|" not in text and not _PLAIN.search(text):
            text = text.lower()
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def encode(self, texts: list[str]) -> Iterator[list[bytes]]:
        """For each text the little-endian 32-bit ids of its chunks. Words new to a stretch of texts are learnt together."""
        for k in range(0, len(texts), STRETCH):
            if len(self.chunks) > CACHE_WORDS:
                self.chunks = {}
            if len(self.stems) > CACHE_WORDS:
                self.stems = {}
            split = list(map(self._split, texts[k : k + STRETCH]))
            known = self.chunks
            if new := {w for w in set().union(*split) if w not in known}:
                self._learn(new)
            for words in split:
                yield list(map(known.__getitem__, words))

    def _learn(self, words: set[str]) -> None:
        stems, ends = self.stems, self.ends
        cut = {w: w[:-1] for w in words if w[-1:] in ends and w[-2:-1].isalpha() and _SURE.match(w, len(w) - 2)}
        new = {s for s in words if s not in cut and s not in stems}
        new.update(s for s in cut.values() if s not in stems)
        plain = [s for s in new if s.isalpha() and s.islower() and not _PLAIN.search(s)]
        stems.update(zip(plain, self.words.encode(plain)))
        rest = list(new.difference(plain))
        stems.update(zip(rest, self._encode(rest)))
        self.chunks.update({w: stems[cut[w]] + ends[w[-1]] if w in cut else stems[w] for w in words})


_encoders: dict[tuple[type, str], object] = {}


def worker_encoder(kind: Callable, path: str):
    """One encoder for each Python worker, kept between tasks."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def library_counts(path: str) -> Callable[[list[str]], list[int]]:
    """For .model files: sentencepiece; for .json: the tokenizers library."""
    if path.endswith(".model"):

        def count(texts: list[str]) -> list[int]:
            return [len(x) for x in worker_encoder(_processor, path).encode(texts, num_threads=1)]

        return count
    return lambda texts: [sum(map(len, x)) // 4 for x in worker_encoder(WordEncoder, path).encode(texts)]


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. cache: folder of the stored counts; without one the call has a cache of its own."""
    spark, version, count = docs.sparkSession, tokenizer_version(tokenizer), library_counts(tokenizer)
    cache = cache or scratch(spark, "token-counts")
    rows = whole_text(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text", F.sha2("text", 256).alias("digest"))
    schema = "digest string, tokenizer string, n_tokens long"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache)
    stored = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    # first() combines on the map side: many copies of one text leave a map task as one row.
    misses = rows.join(stored, "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))

    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"], "tokenizer": version, "n_tokens": np.array(count(b["text"].tolist()), dtype="int64")})

    with small_batches(spark):
        misses.mapInPandas(encode, schema).write.mode("append").parquet(cache)
    counts = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
    digests = cut(rows.select("doc_id", "n_bytes", "digest"), "token-digests")
    return join_hot(digests, counts, ["digest"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
