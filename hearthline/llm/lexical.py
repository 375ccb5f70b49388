"""Ranked lexical search of many items at once: what their queries share is summed once.

Items are dealt into blocks of a bounded number of (item, term) pairs; each block is asked of all documents. A block's
shared term sets are mined in one task: terms of an item stand in order of how many items hold them, adjacent pairs that several
items hold become a set of their own, and sets pair up again, until nothing is shared. The result is a sharing DAG: terms, sets of
terms, items. Documents are read once into postings of the block's terms; over a batch of documents each node of
the DAG is one accumulator, the sum of its children's, so a set that many items share is added up once. Tasks keep the
best documents of each item, and only those leave them.

Defined cases: null or empty texts have no terms and are no result; items without terms have no rows; rows that repeat an
item's id are one item with the terms of all; rows that repeat a document's id are documents of their own, so an id can be
listed twice; null ids of documents come last among equal scores, items whose id is null are one item; very long texts are read
whole; extra columns are ignored whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, whole_text

#: (item, term) pairs of a block at most, unless one item has more. What a block broadcasts, terms and DAG, is bounded by it.
BLOCK_PAIRS = 1 << 19
#: Accumulators that a task holds at once: nodes of the DAG times documents of a batch.
CELLS = 1 << 22
#: Parts in which an item's best documents are ranked before they meet.
PARTS = 64
_TERM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of digits, Latin letters (A-Z lower-cased) and all signs beyond ASCII, as UTF-8."""
    return text.encode().translate(_TERM).split()


def item_terms(items: DataFrame, id_col: str = "item_id") -> DataFrame:
    """(item_id, term), each pair once."""

    def split(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, found in zip(b["doc_id"], b["text"].map(lambda t: sorted(set(terms(t))))):
                yield pd.DataFrame({"item_id": pd.array([i] * len(found), dtype="Int64"), "term": pd.Series(found, dtype=object)})

    return whole_text(items, id_col).mapInPandas(split, "item_id long, term binary").distinct()


def blocks_of(pairs: DataFrame) -> tuple[DataFrame, int]:
    """pairs with block, and the number of blocks: as few as keep each within BLOCK_PAIRS, by a hash of the item."""
    total, items = pairs.count(), pairs.select("item_id").distinct().count()
    blocks = max(1, -(-total // BLOCK_PAIRS))
    while True:
        dealt = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
        most = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= BLOCK_PAIRS or blocks >= 4 * items:
            return dealt, blocks
        blocks *= 2


def mine(lists: list[list[int]], nodes: int) -> tuple[list[list[int]], dict[int, tuple[int, int]]]:
    """(items as disjoint nodes, the two children of each new set); nodes is the number of terms.

    Each round counts adjacent pairs over the items, and every item replaces the pairs that others hold too, the more
    widely held of two that overlap. A pair that only one item has left after that stays a pair.
    """
    held = Counter(t for x in lists for t in x)
    lists = [sorted(x, key=lambda t: (-held[t], t)) for x in lists]
    sets: dict[int, tuple[int, int]] = {}
    while True:
        pairs = Counter(p for x in lists for p in zip(x, x[1:]))
        chosen = []
        for x in lists:
            at, k = [], 0
            while k + 1 < len(x):
                n = pairs[x[k], x[k + 1]]
                after = pairs[x[k + 1], x[k + 2]] if k + 2 < len(x) else 0
                if n > 1 and n >= after:
                    at.append(k)
                    k += 1
                k += 1
            chosen.append(at)
        used = Counter((x[k], x[k + 1]) for x, at in zip(lists, chosen) for k in at)
        names = {p: nodes + k for k, p in enumerate(sorted(p for p, n in used.items() if n > 1))}
        if not names:
            return lists, sets
        sets |= {name: p for p, name in names.items()}
        nodes += len(names)
        for row, (x, at) in enumerate(zip(lists, chosen)):
            merged = {k: names[x[k], x[k + 1]] for k in at if (x[k], x[k + 1]) in names}
            lists[row] = [merged.get(k, t) for k, t in enumerate(x) if k - 1 not in merged]


def sharing_dag(pairs: DataFrame) -> DataFrame:
    """(block, level, parent, child, item_id, term): the DAG of each block, its terms (level 0) and its items (item_id set).

    Nodes are numbered in each block, children before parents. Level 0 rows name a term by its node, in child.
    """

    def plan(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(part["term"].to_numpy(dtype=object), return_inverse=True)
        ids, of = pd.factorize(part["item_id"], use_na_sentinel=False)[::-1]
        lists: list[list[int]] = [[] for _ in ids]
        for item, code in zip(of, codes):
            lists[item].append(int(code))
        lists, sets = mine(lists, len(names))
        level = dict.fromkeys(range(len(names)), 0)
        rows = [(0, None, k, False, None, t) for k, t in enumerate(names)]
        for name, children in sets.items():  # in order of making, so children have their level
            level[name] = 1 + max(level[c] for c in children)
            rows += [(level[name], name, c, False, None, None) for c in children]
        last = 1 + max(level.values())
        rows += [(last, len(level) + k, c, True, None if pd.isna(i) else int(i), None) for k, (i, x) in enumerate(zip(ids, lists)) for c in x]
        out = pd.DataFrame(rows, columns=["level", "parent", "child", "is_item", "item_id", "term"])
        return out.assign(block=key[0], parent=out["parent"].astype("Int64"), item_id=out["item_id"].astype("Int64"))

    return pairs.groupBy("block").applyInPandas(plan, "block int, level int, parent long, child long, is_item boolean, item_id long, term binary")


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document: all its terms counted, those of the vocabulary listed with their counts."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = b["text"].map(terms)
            found = [[(vocabulary[t], k) for t, k in Counter(w).items() if t in vocabulary] for w in words]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": words.map(len), "terms": [[t for t, _ in f] for f in found], "tfs": [[k for _, k in f] for f in found]})

    return whole_text(docs).mapInPandas(count, "doc_id long, n long, terms array<int>, tfs array<int>")


class Sharing:
    """A block's DAG as arrays: for each level the parents and, one after another, the children of each."""

    def __init__(self, edges: pd.DataFrame) -> None:
        edges = edges.sort_values(["level", "parent"], kind="stable")
        self.levels = []
        for _, rows in edges.groupby("level"):
            parents, starts = np.unique(rows["parent"].to_numpy(dtype=np.int64), return_index=True)
            self.levels.append((parents, rows["child"].to_numpy(dtype=np.int64), starts))
        top = edges[edges["is_item"]].drop_duplicates("parent")
        self.items, self.ids = top["parent"].to_numpy(dtype=np.int64), top["item_id"].astype("Int64").array
        self.nodes = int(edges["parent"].max()) + 1

    def __call__(self, leaves: np.ndarray) -> np.ndarray:
        """Scores [item, document] from contributions [node, document], of which only terms are filled."""
        for parents, children, starts in self.levels:
            leaves[parents] = np.add.reduceat(leaves[children], starts, axis=0)
        return leaves[self.items]


class Best:
    """The k best (score, document) of each item so far; equal scores by ascending id, null ids last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.score = k, np.zeros((items, k), dtype=np.int64)
        self.order = np.full((items, k), np.inf)
        self.doc: np.ndarray = np.full((items, k), None, dtype=object)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        rows = np.flatnonzero(scores.max(axis=1) >= np.maximum(self.score[:, -1], 1))
        if not len(rows):
            return
        first = np.argsort(-scores[rows], axis=1, kind="stable")[:, : self.k]  # docs come by ascending id
        new = np.take_along_axis(scores[rows], first, axis=1)
        for r, s, d in zip(rows, new, docs[first]):
            merged = sorted([*zip(self.score[r], self.doc[r]), *zip(s, d)], key=lambda x: (-x[0], x[1] is None, x[1] or 0))[: self.k]
            self.score[r], self.doc[r] = [x[0] for x in merged], [x[1] for x in merged]


def _ranked(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    pairs = cut(item_terms(items, id_col), "lexical-items")
    dealt, blocks = blocks_of(pairs)
    dag, found = cut(sharing_dag(dealt), "lexical-dag"), []
    for block in range(blocks):
        edges = dag.where(F.col("block") == block).toPandas()  # bounded by BLOCK_PAIRS
        if len(edges):
            found.append(_search_block(docs, edges, k))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    rows = _ranked(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), k, "item_id", "part").drop("part")
    return _ranked(rows, k, "item_id").select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, edges: pd.DataFrame, k: int) -> DataFrame:
    leaf = edges[edges["level"] == 0]
    vocabulary = dict(zip(map(bytes, leaf["term"]), leaf["child"].tolist()))
    listed = cut(postings(docs, vocabulary), "lexical-postings")
    n_docs, n_terms = listed.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for r in listed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # a row for each term of the block
        weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    plan = Sharing(edges[edges["level"] > 0])

    def score(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, size = Best(len(plan.items), k), max(1, CELLS // plan.nodes)
        for b in batches:
            b = b[b["terms"].map(len) > 0].sort_values("doc_id", na_position="last")
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size]
                lengths = part["terms"].map(len).to_numpy()
                doc, term = np.repeat(np.arange(len(part)), lengths), np.concatenate(part["terms"].to_list())
                tf = np.concatenate(part["tfs"].to_list()).astype(np.int64)
                m = np.array([10 + 90 * int(n) * n_docs // n_terms for n in part["n"]], dtype=np.int64)[doc]
                leaves = np.zeros((plan.nodes, len(part)), dtype=np.int64)
                leaves[term, doc] = weights[term] * ((1000000000 * tf) // (1000 * tf + 8 * m))
                best.add(plan(leaves), np.array([None if pd.isna(i) else int(i) for i in part["doc_id"]], dtype=object))
        item, place = np.nonzero(best.score > 0)
        yield pd.DataFrame({"item_id": plan.ids[item], "doc_id": pd.array(best.doc[item, place], dtype="Int64"), "score": best.score[item, place]})

    rows = cut(listed.mapInPandas(score, "item_id long, doc_id long, score long"), "lexical-best")
    discard(listed)
    return rows


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
),
q AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
),
total AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS terms FROM d WHERE len(terms) > 0),
tf AS MATERIALIZED (
  SELECT doc_id, row, n, term, count(*) AS tf FROM (SELECT doc_id, row, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, row, n, term
),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
parts AS (SELECT doc_id, row, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS part FROM tf JOIN w USING (term), total),
scores AS (SELECT item_id, row, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN parts USING (term) GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
