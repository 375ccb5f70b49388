"""Exact top-k inner-product search by ball trees.

Rows are assigned to cells: the nearest centre, then the nearest centre of what is left of the vector, and so on, with as
many levels as the table's size asks for. Centres are fitted on a bounded sample, every row is indexed, and a cell that
outgrows a shard is split by a hash of the id. Each shard holds a ball tree. A query first searches one shard of its own
cell; the kth score it finds there is the threshold with which it visits only those other shards, and inside them only
those nodes, whose inner-product upper bound q.c + |q| r reaches it. Queries meet the shards' balls block by block within
Spark. Bounds are never below true scores, so the result is exact.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; vectors of
another length than the query's do not match it; repeated rows with one id are one candidate each; a query id on several
rows asks once, with the smallest of its vectors; ties go to the smaller id; a table with fewer candidates than k gives all
of them; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a shard, on average, and of a tree's leaf at most.
SHARD, LEAF = 4096, 48
#: Rows that the centres are fitted on, the most centres of a level, and the most levels (256^3 cells of SHARD rows).
FIT_ROWS, CENTRES, LEVELS = 8192, 256, 3
#: Queries that visit a shard together, and balls that they meet at once.
BLOCK, BALLS = 256, 4096
#: Rows of (cell, parts) up to which they are broadcast.
BROADCAST_ROWS = 100_000


def whole_numbers(embedding: Column) -> Column:
    """floor(1024 * x) of each component; null where the vector takes no part."""
    usable = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(embedding.isNotNull() & (F.size(embedding) > 0) & usable, F.transform(embedding, lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("double")))


def build(ids: np.ndarray, rows: np.ndarray) -> list[tuple]:
    """Nodes (centre, radius, left, right, ids, rows) of a ball tree; leaves hold rows, inner nodes two children."""
    nodes: list[tuple] = []

    def grow(at: np.ndarray) -> int:
        x = rows[at]
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
        k = len(nodes)
        nodes.append(())
        if len(at) <= LEAF or radius == 0:
            nodes[k] = (centre, radius, -1, -1, ids[at], x)
            return k
        far = x[((x - centre) ** 2).sum(1).argmax()]
        other = x[((x - far) ** 2).sum(1).argmax()]
        order = np.argsort(x @ (other - far), kind="stable")
        half = len(at) // 2
        nodes[k] = (centre, radius, grow(at[order[:half]]), grow(at[order[half:]]), None, None)
        return k

    grow(np.arange(len(ids)))
    return nodes


def search(nodes: list[tuple], query_id: int, q: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
    """(score, id) of the best k rows here that score at least floor, without the query's own row."""
    size = float(np.sqrt(q @ q))
    slack = 1e-9 * size
    bound = lambda n: float(q @ nodes[n][0]) + size * nodes[n][1] * (1 + 1e-12) + slack * (1 + abs(nodes[n][0]).max()) + 1e-6
    todo, best = [(-bound(0), 0)], []
    while todo:
        upper, n = heapq.heappop(todo)
        if -upper < (best[0][0] if len(best) == k else floor) or -upper < floor:
            break
        _, _, left, right, ids, rows = nodes[n]
        if left >= 0:
            for child in (left, right):
                heapq.heappush(todo, (-bound(child), child))
            continue
        scores = rows @ q
        least = max(floor, best[0][0] if len(best) == k else -np.inf)
        good = np.flatnonzero((scores >= least) & (ids != query_id))
        if len(good) > k:  # by score, then the smaller id
            good = good[np.lexsort((ids[good], -scores[good]))[:k]]
        for j in good.tolist():
            item = (float(scores[j]), -int(ids[j]))
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
    return [(s, -i) for s, i in best]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)


def fit_centres(x: np.ndarray, cells: int) -> list[np.ndarray]:
    """Centres of each level, fitted on what the levels before leave of the sample."""
    levels = []
    while len(levels) < LEVELS and (cells > 1 or not levels):
        k = min(CENTRES, len(x), cells)
        c = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(5):
            near = nearest(x, c)
            c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
        levels.append(c)
        x, cells = x - c[nearest(x, c)], -(-cells // k)
    return levels


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. is_query: which rows are queries."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col)).alias("v"), is_query.alias("asks")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    head = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").collect()
    if not head:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    total = rows.count()
    centres = {dim: fit_centres(np.array([r["v"] for r in head if len(r["v"]) == dim]), max(1, -(-total // SHARD))) for dim in sorted({len(r["v"]) for r in head})}

    def assign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell = np.zeros(len(b), dtype=np.int64)
            sizes = b["v"].map(len).to_numpy()
            for dim in np.unique(sizes).tolist():
                which = np.flatnonzero(sizes == dim)
                x, name = np.array(b["v"].iloc[which].tolist()), np.full(len(which), dim, dtype=np.int64)
                for c in centres.get(dim, []):
                    near = nearest(x, c)
                    x, name = x - c[near], name * CENTRES + near
                cell[which] = name
            yield b.assign(cell=cell)

    placed = cut(rows.mapInPandas(assign, "vec_id long, v array<double>, asks boolean, cell long"), "topk-rows")
    large = cut(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD).select("cell", F.ceil(F.col("n") / SHARD).alias("parts")), "topk-cells")
    large = F.broadcast(large) if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else large
    placed = placed.join(large, "cell", "left").withColumn("shard", F.xxhash64("cell", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1)))))

    def tree(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        x = np.array(b["v"].tolist(), dtype=float)
        nodes = build(b["vec_id"].to_numpy(), x)
        return pd.DataFrame({"shard": [key[0]], "dim": [x.shape[1]], "centre": [nodes[0][0].tolist()], "radius": [nodes[0][1]], "tree": [pickle.dumps(nodes)]})

    # Vectors of two lengths never share a cell, as its name holds the length; a shard's name is a hash, so the length is part of the key.
    sized = placed.select("shard", F.size("v").alias("dim"), "vec_id", "v")
    trees = cut(sized.groupBy("shard", "dim").applyInPandas(tree, "shard long, dim int, centre array<double>, radius double, tree binary"), "topk-trees")
    queries = cut(placed.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "shard")).alias("q")).select("query_id", "q.v", "q.shard", F.size("q.v").alias("dim")), "topk-queries")
    asked = "shard long, dim int, query_id long, v array<double>, floor double"

    def visit(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for asks, blob in zip(b["asks"], b["tree"]):
                nodes = pickle.loads(blob)
                out = [(a["query_id"], i, int(s)) for a in asks for s, i in search(nodes, a["query_id"], np.array(a["v"], dtype=float), k, a["floor"])]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def blocks(asking: DataFrame) -> DataFrame:
        n_blocks = max(1, -(-total // (100 * BLOCK)))
        grouped = asking.groupBy("shard", "dim", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "v", "floor")).alias("asks"))
        return grouped.join(trees.select("shard", "dim", "tree"), ["shard", "dim"]).select("asks", "tree").mapInPandas(visit, "query_id long, vec_id long, score long")

    first = cut(blocks(queries.select("shard", "dim", "query_id", "v", F.lit(float("-inf")).alias("floor"))), "topk-first")
    floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor"))
    # Balls lie in blocks, one row each, and every block of queries goes to every block of balls of its length.
    n_balls, n_asks = max(1, -(-trees.count() // BALLS)), max(1, -(-queries.count() // BLOCK))
    balls = trees.groupBy("dim", F.pmod(F.xxhash64("shard"), F.lit(n_balls)).cast("long").alias("there")).agg(F.collect_list(F.struct("shard", "centre", "radius")).alias("balls"))
    groups = queries.join(floors, "query_id", "left").groupBy("dim", F.pmod(F.xxhash64("query_id"), F.lit(n_asks)).alias("here")).agg(F.collect_list(F.struct("query_id", "v", "shard", "floor")).alias("asks"))
    meets = groups.withColumn("there", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_balls - 1).cast("long")))).join(balls, ["dim", "there"]).select("dim", "asks", "balls")

    def choose(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, asks, near in zip(b["dim"], b["asks"], b["balls"]):
                shards, c, r = np.array([x["shard"] for x in near]), np.array([x["centre"] for x in near]), np.array([x["radius"] for x in near])
                out = []
                for a in asks:
                    v, floor = np.array(a["v"]), -np.inf if a["floor"] is None else a["floor"]
                    inner = c @ v
                    upper = (inner + np.sqrt(v @ v) * r) * (1 + 1e-12) + np.abs(inner) * 1e-9 + 1e-6
                    out += [(s, dim, a["query_id"], v, floor) for s in shards[(upper >= floor) & (shards != a["shard"])].tolist()]
                yield pd.DataFrame(out, columns=["shard", "dim", "query_id", "v", "floor"])

    found = first.unionByName(blocks(meets.mapInPandas(choose, asked)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT vec_id, min(v) AS v FROM ok WHERE vec_id % 100 = 0 GROUP BY vec_id) q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 10
"""
