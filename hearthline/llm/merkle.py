"""Merkle manifest of a dataset: a tree over the rows of each language, a tree over their roots, and proofs of rows.

Leaves are numbered by one range sort: numbers come from the places of rows inside the sorted ranges and the sizes of the
ranges before them, so a language that holds most rows is dealt like any other. Trees grow in rounds: a round takes aligned blocks of
2^BITS nodes and returns BITS levels over each, so n leaves take log(n)/BITS rounds and no group holds more than a block.

Proofs are octopus multiproofs. Each leaf partition, an aligned block or what is chosen of it, computes the minimal union of
node coordinates that its leaves do not give themselves, in its own tree and in the tree over the roots, and fetches them by
one join; the inner nodes that its leaves share are derived once, and the proof of each leaf is expanded from both locally.
Nodes near a root are asked for by very many partitions and meet them by broadcast (join_hot).

A path is an array of steps from leaf to root: `L` or `R` and the digest of the sibling on that side, or `S` where a node is
alone in its run and is hashed alone.

Defined cases: null fields are `-` in a leaf; null ids come first in their language; rows that repeat an id are ordered by
leaf, and rows equal in all fields have equal leaves and each a path of its own; a null or empty text is a leaf like any
other; a null language is a tree of its own, the first; a language of one row has its leaf as root; with one language the root is
that subroot and no step follows it; extra columns are ignored whatever their names; an empty table has no
rows and no root. A row whose n_chars is null, or whose id is null, cannot be tampered with and verifies.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, join_hot

#: Levels that a round grows; a block holds 2^BITS nodes.
BITS = 8
#: The number of the tree over the roots of the others.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def digest_of(run: str) -> str:
    return sha256(run.encode()).hexdigest()


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows, written in this order, with their number from 0 in it and the number of the range that holds them.

    Equal rows are cut anywhere, so a key that fills many ranges does no harm. The sizes of ranges, one number for each
    shuffle partition, are all that the driver sees.
    """
    at = F.monotonically_increasing_id()
    ranged = rows.withColumn("tie", at).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie").withColumn("at", at)
    written = cut(ranged.withColumn("part", F.shiftright("at", 33).cast("int")), "merkle-order")
    sizes = written.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    starts = np.cumsum([0, *(r["n"] for r in sizes)])[:-1].tolist()
    before = rows.sparkSession.createDataFrame([(r["part"], s) for r, s in zip(sizes, starts)], "part int, before long")
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return written.join(F.broadcast(before), "part").withColumn(name, inside + F.col("before")).drop("at", "before")


def _block_levels(base: int):
    def levels(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        """The levels over one aligned block: BITS of them, or as many as its tree has left."""
        block = block.sort_values("idx")
        nodes, first, width, out = block["digest"].tolist(), int(block["idx"].iloc[0]), int(block["width"].iloc[0]), []
        for level in range(base + 1, base + BITS + 1):
            if width == 1:
                break
            nodes, first, width = [digest_of("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)], first >> 1, (width + 1) >> 1
            out.append(pd.DataFrame({"tree": key[0], "level": level, "idx": np.arange(first, first + len(nodes)), "digest": nodes, "width": width}))
        return pd.concat(out)

    return levels


def grow(rows: DataFrame, widest: int) -> list[DataFrame]:
    """All nodes (tree, level, idx, digest, width) of the trees over rows (tree, idx, digest, width), written, round by round.

    width is the number of nodes of that level; widest is the largest at level 0.
    """
    found, base = [rows.select("tree", F.lit(0).alias("level"), "idx", "digest", "width")], 0
    while widest > 1:
        below = found[-1].where((F.col("level") == base) & (F.col("width") > 1))
        found.append(cut(below.groupBy("tree", F.shiftright("idx", BITS).alias("block")).applyInPandas(_block_levels(base), "tree long, level int, idx long, digest string, width long"), "merkle-nodes"))
        base, widest = base + BITS, -(-widest >> BITS)
    return found


def missing(places: np.ndarray, width: int) -> list[tuple[int, int]]:
    """The minimal union of (level, index) that paths from these places need and that their leaves do not give."""
    known, level, out = np.unique(places), 0, []
    while width > 1:
        siblings = known ^ 1
        out += [(level, int(i)) for i in siblings[(siblings < width) & ~np.isin(siblings, known)]]
        known, width, level = np.unique(known >> 1), (width + 1) >> 1, level + 1
    return out


def expand(places: list[int], digests: list[str], width: int, fetched: dict[tuple[int, int], str]) -> tuple[list[list[str]], str]:
    """The path of each place and the root above them; inner nodes that places share are hashed once."""
    at, paths, level, known = places, [[] for _ in places], 0, dict(zip(places, digests))
    while width > 1:
        sibling = lambda i: known.get(i ^ 1) or fetched[level, i ^ 1]  # noqa: B023, E731
        steps = {i: ("L" if i & 1 else "R") + sibling(i) if i ^ 1 < width else "S" for i in known}
        for path, i in zip(paths, at):
            path.append(steps[i])
        known = {i >> 1: digest_of(own + step[1:] if step[0] != "L" else step[1:] + own) for i, own in known.items() for step in (steps[i],)}
        at, width, level = [i >> 1 for i in at], (width + 1) >> 1, level + 1
    return paths, next(iter(known.values()))


def _coordinates(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """What a leaf partition fetches: nodes of its tree, and of the tree over the roots."""
    row = part.iloc[0]
    want = [(key[0], *c) for c in missing(part["idx"].to_numpy(), int(row["width"]))] + [(TOP, *c) for c in missing(np.array([row["place"]]), int(row["trees"]))]
    return pd.DataFrame({"tree": key[0], "block": key[1], "node": pd.Series([{"tree": t, "level": lv, "idx": i} for t, lv, i in want], dtype=object)})


def _paths(key: tuple, part: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    fetched = {(n["tree"], n["level"], n["idx"]): d for n, d in zip(nodes["node"], nodes["found"])}
    own = {(lv, i): d for (t, lv, i), d in fetched.items() if t != TOP}
    over = {(lv, i): d for (t, lv, i), d in fetched.items() if t == TOP}
    row = part.iloc[0]
    paths, subroot = expand(part["idx"].tolist(), part["digest"].tolist(), int(row["width"]), own)
    (rest,), root = expand([int(row["place"])], [subroot], int(row["trees"]), over)
    return part[["doc_id", "lang", "altered"]].assign(leaf=part["digest"], subroot=subroot, derived_root=root, path=[p + rest for p in paths])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give, by SQL functions alone."""
    other = lambda s: F.substring(s, 2, 64)
    return F.aggregate(path, leaf, lambda own, s: F.sha2(F.when(s.startswith("L"), F.concat(other(s), own)).otherwise(F.concat(own, other(s))), 256))


def prove(docs: DataFrame, chosen: Column | None = None) -> DataFrame:
    """doc_id, lang, leaf, altered, subroot, derived_root, root, path: one row for each row of docs, or for the chosen ones.

    altered is the leaf as the tampered row gives it, null where nothing is tampered with; chosen is a condition on doc_id,
    lang and leaf. root is the manifest's; derived_root is what the path of the untampered leaf leads to.
    """
    session = docs.sparkSession
    source = [docs[f"`{c}`"] for c in FIELDS]
    values = dict(zip(FIELDS, source))
    tampered = (F.crc32(values["doc_id"].cast("string").cast("binary")) % 7 == 0) & values["n_chars"].isNotNull()
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    leaves = docs.select(*(v.alias(c) for c, v in values.items()), tampered.alias("tampered")).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf_of([F.col(c) for c in FIELDS]).alias("digest"), F.when(F.col("tampered"), leaf_of(changed)).alias("altered"))
    leaves = cut(leaves, "merkle-leaves")  # the range sort samples its input first, and texts should be read once

    ordered = numbered(leaves, [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.asc("digest")], "number")
    spans = ordered.groupBy("part", "lang").agg(F.min("number").alias("low"), F.count(F.lit(1)).alias("n"))  # at most one row a range, and one more a language
    trees = numbered(spans.groupBy("lang").agg(F.min("low").alias("tree"), F.sum("n").alias("width")), [F.asc("tree")], "place").drop("part")
    size = trees.agg(F.count(F.lit(1)).alias("trees"), F.max("width").alias("widest")).first()
    names = spans.select("part", "lang").join(trees.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of"))).select(F.col("part").alias("in"), "of", "tree", "width", "place")
    # A language is met by (range, language), so no key holds more rows than a range.
    placed = ordered.join(names, (F.col("part") == F.col("in")) & F.col("lang").eqNullSafe(F.col("of")))
    placed = cut(placed.select("doc_id", "lang", "digest", "altered", "tree", (F.col("number") - F.col("tree")).alias("idx"), "width", "place", F.lit(size["trees"]).cast("long").alias("trees")), "merkle-places")
    discard(leaves)

    own = grow(placed, size["widest"] or 0)
    alone = lambda found: [f.where("width = 1") for f in found]
    subroots = _union(alone(own)).join(trees.select("tree", "place"), "tree")
    over = grow(cut(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("place").alias("idx"), "digest", F.lit(size["trees"]).cast("long").alias("width")), "merkle-subroots"), size["trees"])
    root = _union(alone(over)).select("digest").first()

    block = F.shiftright("idx", BITS).alias("block")
    wanted = placed if chosen is None else placed.withColumnRenamed("digest", "leaf").where(chosen).withColumnRenamed("leaf", "digest")
    asked = cut(wanted.select("tree", block, "idx", "width", "place", "trees").groupBy("tree", "block").applyInPandas(_coordinates, "tree long, block long, node struct<tree:long,level:int,idx:long>"), "merkle-asked")
    levels = [r["level"] for r in asked.select("node.level").distinct().collect()]  # at most 64
    nodes = _union(own + over).where(F.col("level").isin(levels)).select(F.struct("tree", "level", "idx").alias("node"), F.col("digest").alias("found"))
    fetched = join_hot(asked, nodes, ["node"])
    paths = wanted.withColumn("block", block).groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInPandas(_paths, "doc_id long, lang string, altered string, leaf string, subroot string, derived_root string, path array<string>")
    return paths.withColumn("root", F.lit(root["digest"] if root else None).cast("string"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def manifest(docs: DataFrame, chosen: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row against its proof, tampered ones as tampered."""
    proof = F.array_join(F.transform("path", lambda s: F.substring(s, 2, 64)), "")
    rows = prove(docs, chosen).withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_sql_field(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


# The trees level by level, as one list of nodes a language; DuckDB has no crc32, so it is folded from the decimal digits.
ORACLE = rf"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
      lambda c, d: list_reduce(list_prepend(xor(c, d), CAST(range(8) AS BIGINT[])), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) % 7 = 0 THEN {_sql_leaf("n_chars + 1")} END AS altered,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id, {_sql_leaf("n_chars")}) - 1 AS place
  FROM documents
),
up AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM up WHERE len(nodes) > 1
),
subroots AS MATERIALIZED (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM up WHERE len(nodes) = 1),
over_them AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM over_them WHERE len(nodes) > 1
),
steps AS (
  SELECT l.lang, l.place, 0 AS part, level, (l.place >> level) AS i, nodes FROM leaves l JOIN up u ON l.lang IS NOT DISTINCT FROM u.lang AND len(nodes) > 1
  UNION ALL
  SELECT l.lang, l.place, 1, level, (s.place >> level), nodes FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN over_them ON len(nodes) > 1
),
paths AS (
  SELECT lang, place, list(CASE WHEN i % 2 = 1 THEN 'L' || nodes[i] WHEN i + 1 < len(nodes) THEN 'R' || nodes[i + 2] ELSE 'S' END ORDER BY part, level) AS path FROM steps GROUP BY lang, place
),
proved AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT nodes[1] FROM over_them WHERE len(nodes) = 1) AS root,
    sha256(coalesce(array_to_string(list_transform(p.path, lambda x: x[2:]), ''), '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(l.altered, l.leaf), coalesce(p.path, [])), lambda own, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || own ELSE own || s[2:] END)) AS folded_root
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN paths p ON l.lang IS NOT DISTINCT FROM p.lang AND l.place = p.place
)
SELECT *, folded_root = root AS verified FROM proved
"""
