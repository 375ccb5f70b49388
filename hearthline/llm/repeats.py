"""Removal of every byte that a repeated 200-byte string covers, judged on all documents at once.

Suffixes are sorted by external induction (induced.py), and a common prefix of 200 bytes with a neighbour marks a repeat.
Sorting is dealt over tasks by anchors: the anchor of a string is the smallest hash among its substrings of LEVELS[0]
bytes. Equal strings have equal anchors, so only suffixes of one anchor must meet, and a hash that occurs once in the
corpus can be set aside without a look at its bytes. Neighbouring strings with one anchor form a run; runs that are equal
as a whole (by 128 bits of hash over their bytes) are sorted once. An anchor with more than GROUP distinct runs is dealt
anew by longer anchors, which spreads what only shares a line or a sentence; what still meets at the last level shares
nearly the whole string and is sorted in one shard, whose queues and arrays go to disk.

Defined cases: null and empty texts have no bytes and empty output; texts below 200 bytes are never touched; copies are
removed everywhere, as each occurs elsewhere; rows that repeat a doc_id are each returned and count as two documents;
very long texts are read whole; extra columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import induced
from .common import columns_of, cut, discard, hot_least, join_hot, whole_text

#: Bytes of a string that must not repeat.
LENGTH = 200
#: Bytes of an anchor, by level; a level is used for what the one before left in groups of more than GROUP distinct runs.
LEVELS, GROUP = (40, 120, 180), 512
#: Bytes of a shard, by whole anchors, and strings of a text within it: longer texts are cut, so that a text of one repeated byte is not sorted byte by byte.
SHARD, PIECE = 1 << 20, 1024
#: Bytes of texts that are hashed together, and rows that leave a task together.
CHUNK, ROWS = 1 << 17, 500
#: Odd multipliers of the hash.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: A run by the hash of its bytes, and a row by two numbers (see row_name): they are what most shuffled bytes are made of.
_RUN, _ROW = ["d1", "d2"], ["r1", "r2"]
_RUNS = "anchor long, d1 long, d2 long, r1 long, r2 long, start int, n int, weight int"
_PARTS = "d1 long, d2 long, parts array<struct<a:int,b:int>>"


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring stretches from their hashes."""
    x = a * _MIX[0]
    x += b * _MIX[1]
    x ^= x >> np.uint64(29)
    x *= _MIX[2]
    x ^= x >> np.uint64(32)
    return x


def hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the width bytes from each position, by doubling."""
    h, size, out, done = (data.astype(np.uint64) + np.uint64(1)) * _MIX[3], 1, None, 0
    while True:
        if width & size:
            n = len(data) - done - size + 1
            out = h[:n] if out is None else _join(h[:n], out[size : size + n])
            done += size
        size *= 2
        if size > width:
            return out
        h = _join(h[: -(size // 2)], h[size // 2 :])


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of width values."""
    size, m = 1, h
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, d1, d2, start, n strings, weight) of each run; weight 2 if its anchor occurs twice in the text."""
    data, sizes = b"".join(texts), np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    h = hashes(np.frombuffer(data, dtype=np.uint8), width)
    low = smallest(h, LENGTH - width + 1)
    own = np.repeat(np.arange(len(texts)), sizes)[: len(h)]
    n_at = len(low)
    at = np.flatnonzero(ends[own[:n_at]] - np.arange(n_at) >= LENGTH)
    value, text = low[at], own[at]
    new = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])])
    n, start, anchor, text = np.diff(np.r_[new, len(at)]), at[new], value[new], text[new]
    # The same anchor twice in one text: only then can a string repeat inside a run.
    mixed = h ^ (own.astype(np.uint64) * _MIX[1])
    mixed.sort()
    twice = np.isin(anchor ^ (text.astype(np.uint64) * _MIX[1]), mixed[1:][mixed[1:] == mixed[:-1]])
    digest = xxhash.xxh3_128_digest
    d = np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(start.tolist(), (start + n + (LENGTH - 1)).tolist())]), dtype="<i8").reshape(-1, 2)
    return text, anchor.view(np.int64), d[:, 0], d[:, 1], start - (ends - sizes)[text], n, 1 + twice


def intervals(hit: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) bytes that the strings marked in hit cover."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.r_[0, cuts + 1]].tolist(), (at[np.r_[cuts, len(at) - 1]] + LENGTH).tolist()))


def pack_bytes(docs: DataFrame, keys: str = "r1 long, r2 long") -> DataFrame:
    """The key columns and z, the compressed text: less to move where texts must meet what was found about them."""
    names = [k.split()[0] for k in keys.split(",")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for k in range(0, len(b), ROWS):
                part = b.iloc[k : k + ROWS]
                yield part[names].assign(z=[z.compress(t) for t in part["text"]])

    return docs.mapInPandas(run, f"{keys}, z binary")


def _emit(width: int):
    """Runs of the texts, CHUNK bytes of texts at a time."""

    def frame(names: list[tuple[int, int]], texts: list[bytes]) -> pd.DataFrame:
        text, anchor, d1, d2, start, n, weight = runs(texts, width)
        r1, r2 = np.array(names, dtype=np.int64)[text].T
        return pd.DataFrame({"anchor": anchor, "d1": d1, "d2": d2, "r1": r1, "r2": r2, "start": start, "n": n, "weight": weight})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names, texts, held = [], [], 0
            for r1, r2, t in zip(b["r1"], b["r2"], b["text"]):
                if len(t) < LENGTH:
                    continue
                names.append((r1, r2))
                texts.append(t)
                held += len(t)
                if held >= CHUNK:
                    yield frame(names, texts)
                    names, texts, held = [], [], 0
            if texts:
                yield frame(names, texts)

    return run


def _fetch(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes of the wanted runs."""
    z = zstandard.ZstdDecompressor()
    for b in batches:
        for k in range(0, len(b), ROWS):
            out = []
            for blob, wanted in zip(b["z"].iloc[k : k + ROWS], b["wanted"].iloc[k : k + ROWS]):
                data = z.decompress(blob)
                out += [(r["anchor"], r["d1"], r["d2"], r["kinds"], data[r["start"] : r["start"] + r["n"] + LENGTH - 1]) for r in wanted]
            yield pd.DataFrame(out, columns=["anchor", *_RUN, "kinds", "body"])


def _compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by anchor; whole groups of anchors are sorted together, SHARD bytes or a little more at once."""
    held, size = [], 0
    for b in batches:
        anchor, sizes = b["anchor"].to_numpy(), b["body"].map(len).to_numpy()
        edges = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(b)]
        for x, y in zip(edges, edges[1:]):
            if size >= SHARD and held[-1]["anchor"].iloc[-1] != anchor[x]:
                yield resolve(pd.concat(held))
                held, size = [], 0
            held.append(b.iloc[x:y])
            size += int(sizes[x:y].sum())
    if held:
        yield resolve(pd.concat(held))


def resolve(b: pd.DataFrame) -> pd.DataFrame:
    """For each run the parts covered by strings that occur twice among the runs of its anchor."""
    pieces, owner = [], []
    for k, body in enumerate(b["body"]):
        for at in range(0, len(body) - LENGTH + 1, PIECE):
            pieces.append(body[at : at + PIECE + LENGTH - 1])
            owner.append(k)
    hit = induced.repeated(pieces, b["anchor"].to_numpy()[owner], LENGTH)
    n = b["body"].map(len).to_numpy() - (LENGTH - 1)
    ends = np.cumsum(n)
    some = np.add.reduceat(hit, ends - n, dtype=np.int64) > 0
    parts = [[{"a": x, "b": y} for x, y in intervals(hit[e - m : e])] if s else [] for e, m, s in zip(ends.tolist(), n.tolist(), some.tolist())]
    return b[_RUN].assign(parts=parts)


def find_spans(docs: DataFrame, level: int = 0) -> DataFrame:
    """(r1, r2, spans): for each row of docs(r1, r2, text as bytes) that has any, its byte spans to remove, not yet merged."""
    # Written, as both the count and the join below read it and hashing costs more than the rows do; no longer needed after that.
    every = cut(docs.mapInPandas(_emit(LEVELS[level]), _RUNS), "repeat-every")
    least = hot_least(every)
    again = cut(every.groupBy("anchor").agg(F.sum("weight").alias("times")).where("times > 1"), "repeat-anchors")
    found = cut(join_hot(every, again.select("anchor"), ["anchor"], again.where(F.col("times") > 2 * least).select("anchor")), "repeat-runs")
    discard(every)
    # One place of each run: first() takes all four columns from the same row.
    kinds = cut(found.groupBy("anchor", *_RUN).agg(F.count(F.lit(1)).alias("times"), F.max("weight").alias("weight"), *(F.first(c).alias(c) for c in (*_ROW, "start", "n"))), "repeat-kinds")
    per_anchor = cut(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("weight").alias("heavy")).where("kinds > 1 OR heavy > 1"), "repeat-anchors")
    mixed = join_hot(kinds, per_anchor, ["anchor"], per_anchor.where(F.col("kinds") > least).select("anchor"))
    wanted = mixed.groupBy(*_ROW).agg(F.collect_list(F.struct("anchor", *_RUN, "kinds", "start", "n")).alias("wanted"))
    bodies = cut(pack_bytes(docs).join(wanted, _ROW).select("z", "wanted").mapInPandas(_fetch, "anchor long, d1 long, d2 long, kinds long, body binary"), "repeat-bodies")
    hot = F.col("kinds") > GROUP if level + 1 < len(LEVELS) else F.lit(False)
    partial = bodies.where(~hot).repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_compare, _PARTS).where(F.size("parts") > 0)
    if not bodies.where(hot).isEmpty():
        deeper = find_spans(bodies.where(hot).select(F.col("d1").alias("r1"), F.col("d2").alias("r2"), F.col("body").alias("text")), level + 1)
        partial = partial.unionByName(deeper.select(F.col("r1").alias("d1"), F.col("r2").alias("d2"), F.col("spans").alias("parts")))
    # A run that occurs twice as a whole is covered whole; for the others the order of suffixes decides.
    twice = kinds.where("times > 1")
    whole = twice.select(*_RUN, F.array(F.struct(F.lit(0).alias("a"), (F.col("n") + (LENGTH - 1)).alias("b"))).alias("parts"))
    parts = cut(whole.unionByName(partial.join(kinds.where("times = 1").select(*_RUN), _RUN, "left_semi")), "repeat-parts")
    discard(bodies)
    placed = join_hot(found.select(*_RUN, *_ROW, "start"), parts, _RUN, twice.where(F.col("times") > least).select(*_RUN))
    return (
        placed.select(*_ROW, F.transform("parts", lambda p: F.struct((F.col("start") + p["a"]).alias("a"), (F.col("start") + p["b"]).alias("b"))).alias("parts"))
        .groupBy(*_ROW).agg(F.flatten(F.collect_list("parts")).alias("spans"))
    )


def row_name(doc_id: Column, text: Column) -> list[Column]:
    """Names a row by its id and by a hash of id and text; rows that repeat both have one name and the same spans."""
    return [F.coalesce(doc_id, F.lit(0)), F.xxhash64(doc_id, text)]


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with texts also r1, r2 (see row_name) and kept, the text left.

    In kept, bytes of a character that a span cuts in two are dropped.
    """
    rows = whole_text(docs, id_col, text_col)
    rows = rows.select(*(c.alias(n) for n, c in zip(_ROW, row_name(F.col("doc_id"), F.col("text")))), "doc_id", F.encode("text", "UTF-8").alias("text"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", r1 long, r2 long, kept string" * texts

    def keep(blob: bytes, spans) -> tuple:
        data = zstandard.ZstdDecompressor().decompress(blob)
        gone = merged(spans) if spans is not None else []
        edges = [0, *(x for s in gone for x in s), len(data)]
        kept = b"".join([data[x:y] for x, y in zip(edges[::2], edges[1::2])])
        return (len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), *([kept.decode(errors="ignore")] * texts))

    def apply(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), ROWS):
                part = b.iloc[k : k + ROWS]
                frame = pd.DataFrame([keep(*x) for x in zip(part["z"], part["spans"])], columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] * texts)])
                frame.insert(0, "doc_id", part["doc_id"].array)
                yield frame.assign(r1=part["r1"].array, r2=part["r2"].array) if texts else frame

    spans = find_spans(rows.select(*_ROW, "text"))
    return pack_bytes(rows, "r1 long, r2 long, doc_id long").join(spans, _ROW, "left").select(*_ROW, "doc_id", "z", "spans").mapInPandas(apply, schema)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with repeated passages gone from the texts. Documents stay, also those left empty; length_col, where it is there, is counted anew."""
    # Only changed texts come back; they meet their rows by name.
    left = remove_repeats(docs, id_col, text_col, texts=True).where("n_removed > 0").select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), F.col("kept").alias("__kept")).dropDuplicates(["__r1", "__r2"])
    r1, r2 = row_name(docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit("")))
    kept = F.coalesce(left["__kept"], docs[text_col])
    columns = [kept.alias(c) if c == text_col else F.length(kept).cast(docs.schema[c].dataType).alias(c) if c == length_col else own for c, own in zip(docs.columns, columns_of(docs))]
    return docs.join(left, (r1 == left["__r1"]) & (r2 == left["__r2"]), "left").select(*columns)
