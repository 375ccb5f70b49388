"""Near-duplicate components by similarity sketches, banding and exact verification.

Sketch: 200 bins filled in rounds. In each of the first 200 rounds every shingle falls into one hashed bin with value
(round, hash); later rounds serve one bin each, so that every bin fills; a bin keeps its smallest value. Bands of 5 bins
make the buckets; at 80 % similarity a pair shares none of the 40 buckets with probability 1.3e-7.

Shingles are compared by 64-bit hashes; equal shingle sets, by 128 bits of hash, are one node. Each bucket first links its members to its smallest node, verified on the full sets.
Buckets that still hold several components are then compared across components: small ones pair by pair, larger ones in
blocks of at most about 2 * BLOCK members within a task, so that no link of a bucket is lost and no task grows with the
bucket. What does grow with its square, divided by BLOCK, is the number of sets sent to tasks for members that share a
bucket but no component; at 5 equal bins of 200 such members are few unless very many texts are half alike. Labels travel by smallest neighbour and pointer jumping over written tables.

Defined cases: null and empty texts, or texts of white space, have n_shingles 0 and are linked with nothing; fewer words
than a shingle make one shingle of the whole sequence; rows that share an id count as one document that is linked if any
of its texts is; a row without an id is linked with nothing, gets component_id null and is not kept; very long texts are
read whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, hot_least, join_hot, packed, whole_text

BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
#: Buckets up to this size are compared pair by pair; larger ones in blocks of BLOCK members.
SMALL, BLOCK = 16, 256
#: Words that a worker's cache may hold before it starts anew.
CACHE_WORDS = 250_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEEDS = np.arange(1, 2 * BINS + 1, dtype=np.uint64) * _A
_EMPTY = np.uint64(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, size: int) -> None:
        self.size, self.words = size, {}

    def __call__(self, data: bytes) -> np.ndarray:
        words = data.translate(_LOWER).split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = list(map(self.words.get, words))
        if None in known:
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
            self.words.update({w: xxhash.xxh64_intdigest(w) for w, h in zip(words, known) if h is None})
            known = [self.words.get(w) or xxhash.xxh64_intdigest(w) for w in words]
        h = np.array(known, dtype=np.uint64)
        size = min(self.size, len(h))
        x = mix(h[: len(h) - size + 1] + np.uint64(size))
        for k in range(1, size):
            x = mix(x * _A + h[k : len(h) - size + 1 + k])
        return np.unique(x)


def sketch(x: np.ndarray) -> np.ndarray:
    """The BINS values of a set."""
    out, done = np.full(BINS, _EMPTY), 0
    step = min(BINS, int(1.2 * BINS * np.log(BINS) / len(x)) + 1)
    while done < BINS and (done == 0 or (out == _EMPTY).any()):
        rounds = np.arange(done, min(BINS, done + step), dtype=np.uint64)
        h = mix(x[None, :] ^ _SEEDS[done : done + len(rounds)][:, None])
        value = (h >> np.uint64(16)) | (rounds << np.uint64(48))[:, None]
        np.minimum.at(out, ((h & np.uint64(0xFFFF)) % np.uint64(BINS)).astype(np.int64).ravel(), value.ravel())
        done += len(rounds)
    for b in np.flatnonzero(out == _EMPTY):
        out[b] = (mix(x ^ _SEEDS[BINS + b]) >> np.uint64(16)).min() | np.uint64(int(BINS + b) << 48)
    return out


def bands(x: np.ndarray) -> np.ndarray:
    s = sketch(x).reshape(BANDS, ROWS)
    h = _SEEDS[:BANDS].copy()
    for k in range(ROWS):
        h = mix(h * _A + s[:, k])
    return h.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketches(rows: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut_up = Shingler(size)
        for b in batches:
            for k in range(0, len(b), 1000):
                part = b.iloc[k : k + 1000]
                sets = [cut_up(t.encode()) for t in part["text"]]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].array,
                        "n_shingles": [len(x) for x in sets],
                        "h1": [int((mix(x + _A).sum() + np.uint64(len(x))).view(np.int64)) if len(x) else None for x in sets],
                        "h2": [int(mix(x * _C + _B).sum().view(np.int64)) if len(x) else None for x in sets],
                        "bands": [bands(x) if len(x) else None for x in sets],
                    }
                ).astype({"h1": "Int64", "h2": "Int64"})

    return rows.mapInPandas(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def _sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, items) for the wanted nodes: their shingle sets as bytes."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut_up, z = Shingler(size), zstandard.ZstdDecompressor()
        for b in batches:
            for k in range(0, len(b), 1000):
                part = b.iloc[k : k + 1000]
                yield pd.DataFrame({"node": part["node"].array, "items": [cut_up(z.decompress(x)).tobytes() for x in part["z"]]})

    docs = packed(rows.where("doc_id IS NOT NULL"), "doc_id long")
    return docs.join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "z").mapInPandas(run, "node long, items binary").where(F.length("items") > 0).dropDuplicates(["node", "items"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(b["x"], b["y"])]
            yield b.loc[good, ["a", "b"]]

    x = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    near = F.length("x") * 100 >= F.length("y") * percent
    far = F.length("y") * 100 >= F.length("x") * percent
    return pairs.join(x, "a").join(y, "b").where(near & far).mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): smallest reachable node, by smallest neighbour and pointer jumping; each round is a written table.

    A node with very many links is met by broadcast; nodes that share the label of a very large component are left to the engine's own split of skewed joins.
    """
    both = cut(edges.select("a", F.col("b").alias("node")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("node"))).distinct(), "links")
    hubs = hot_keys(both.select("node"), "node")
    labels = cut(both.groupBy("a").agg(F.least(F.min("node"), F.col("a")).alias("comp")).select(F.col("a").alias("node"), "comp"), "labels")
    while True:
        near = join_hot(both, labels, ["node"], hubs).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        step = cut(step.join(labels.select(F.col("node").alias("mid"), F.col("comp").alias("far")), "mid").select("node", "old", F.least("mid", "far").alias("comp")), "labels")
        labels = step.select("node", "comp")
        if step.where("old <> comp").isEmpty():
            return labels


def _across(found: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links between different components that share a bucket."""
    member = found.join(labels, "node", "left").select("key", "head", "node", F.coalesce("comp", "node").alias("comp"))
    sides = member.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    split = sides.groupBy("key").agg(F.sum("n").alias("m"), F.max("n").alias("most"), F.max_by("comp", "n").alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    member = cut(member.join(split, "key"), "near-open")
    small = member.where(F.col("m") <= SMALL)
    other = small.select("key", F.col("node").alias("b"), F.col("comp").alias("other"))
    pairs = small.where("node <> head").join(other, "key").where("node < b AND comp <> other").select(F.col("node").alias("a"), "b").distinct()
    big = member.where(F.col("m") > SMALL).withColumn("rest", F.col("comp") != F.col("main"))
    n_main, n_rest = F.ceil(F.col("most") / BLOCK), F.ceil((F.col("m") - F.col("most")) / BLOCK)
    big = big.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), n_rest).otherwise(n_main)))
    rest, one = F.sequence(F.lit(0).cast("long"), n_rest - 1), F.col("block")
    # A task is (rest block i, main block j) or (rest blocks i <= j); a member goes to each task of its block.
    main_tasks = F.transform(rest, lambda i: F.struct(i.alias("i"), one.alias("j"), F.lit(False).alias("inner")))
    rest_tasks = F.concat(
        F.transform(F.sequence(F.lit(0).cast("long"), n_main - 1), lambda j: F.struct(one.alias("i"), j.alias("j"), F.lit(False).alias("inner"))),
        F.transform(rest, lambda j: F.struct(F.least(one, j).alias("i"), F.greatest(one, j).alias("j"), F.lit(True).alias("inner"))),
    )
    tasks = big.select("key", "node", "comp", "rest", F.explode(F.when(F.col("rest"), rest_tasks).otherwise(main_tasks)).alias("t")).select("key", "node", "comp", "rest", "t.*")

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        sets_ = [np.frombuffer(x, dtype=np.uint64) for x in b["items"]]
        sizes = np.array([len(x) for x in sets_])
        _, item = np.unique(np.concatenate(sets_), return_inverse=True)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        node, comp, out = b["node"].to_numpy(), b["comp"].to_numpy().copy(), []
        mark = np.zeros(item.max() + 1, dtype=bool)
        for k in np.flatnonzero(b["rest"].to_numpy()):
            own = item[starts[k] : starts[k] + sizes[k]]
            mark[own] = True
            shared = np.add.reduceat(mark[item], starts)
            mark[own] = False
            hit = np.flatnonzero((comp != comp[k]) & (100 * shared >= percent * (sizes + sizes[k] - shared)))
            while len(hit):
                j = hit[0]
                out.append((min(node[k], node[j]), max(node[k], node[j])))
                comp[comp == comp[j]] = comp[k]
                hit = hit[comp[hit] != comp[k]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    blocks = tasks.join(sets, "node").groupBy("key", "i", "j", "inner").applyInPandas(compare, "a long, b long")
    return _verified(pairs, sets, percent).unionByName(blocks).distinct()


def near_components(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    rows = whole_text(docs, id_col, text_col)
    sketches = cut(_sketches(rows, shingle), "sketches")
    # Equal shingle sets are one node, named by their smallest id; first() combines on the map side.
    named = sketches.where("doc_id IS NOT NULL AND h1 IS NOT NULL")
    classes = cut(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")), "classes")
    buckets = classes.select("node", F.explode("bands").alias("key"))
    heads = buckets.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail"), F.count(F.lit(1)).alias("m")).where("m > 1")
    found = cut(buckets.join(heads.where("head < tail").select("key", "head"), "key"), "near-buckets")
    sets = cut(_sets(rows, found.select("node").distinct(), shingle), "near-sets")
    star = found.where("head < node").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    links = cut(_verified(star, sets, percent), "near-links")
    more = cut(_across(found, components(links), sets, percent), "near-links")
    # Copies follow their class and stay out of the links; only ids that stand for several texts tie classes together.
    large = classes.where(F.col("copies") > hot_least(named))
    own = join_hot(named.select("doc_id", "h1", "h2"), classes.select("h1", "h2", "node"), ["h1", "h2"], large.select("h1", "h2"))
    by_id = cut(own.groupBy("doc_id").agg(F.min("node").alias("node"), F.array_sort(F.collect_set("node")).alias("nodes")), "near-members")
    ties = by_id.where("size(nodes) > 1").select(F.col("node").alias("a"), F.explode("nodes").alias("b")).where("a <> b")
    labels = components(links.unionByName(more).unionByName(ties))
    every = classes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    comps = join_hot(by_id.select("doc_id", "node"), every, ["node"], large.select("node").distinct()).select(F.col("doc_id").alias("__id"), "comp")
    member = sketches.select("doc_id", "n_shingles")
    return member.join(comps, member["doc_id"] == comps["__id"], "left").select(
        "doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"), F.coalesce(F.coalesce("comp", "doc_id") == F.col("doc_id"), F.lit(False)).alias("kept")
    )


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each component, that of the smallest id.

    Rows are told apart by id and text together: of two texts under one id each is judged alone, and a null id comes last.
    Texts without words all stay; rows that repeat both id and text stay or go together.
    """
    row = F.xxhash64(docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit("")))
    named = docs.select(row.alias("row"), docs[text_col].alias("text"))
    found = near_components(named, shingle, percent, "row", "text").select(F.col("doc_id").alias("row"), "component_id")
    first = F.struct(F.col("id").isNull(), "id", "row")
    ids = docs.select(row.alias("row"), docs[id_col].cast("long").alias("id"))
    best = ids.join(found, "row").groupBy("component_id").agg(F.min_by("row", first).alias("__stays")).select("__stays")
    return docs.join(best, row == best["__stays"], "left_semi")
