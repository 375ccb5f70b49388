"""Packing of token sequences: linear grouping, configurations for few sizes, then best fit for the small ones.

The plan is made from the number of pieces of each length, at most CAPACITY numbers however many documents there are.
Large lengths are rounded up within groups of equal cardinality; the configuration programme over these few sizes is
solved by column generation, its whole multiples are laid out, the actual pieces take the places of the rounded sizes, and
what is left, with all small pieces, goes to the fullest sequence that still has room. The plan's rows say which ordinals of
a length go to which sequences; Spark numbers the pieces of each length, joins the rows and adds up offsets.

Defined cases: null text counts as empty and is the end id alone; longer documents are cut into full pieces and a rest; rows
that repeat an id are packed each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole_text
from .token_counts import WordEncoder, worker_encoder

CAPACITY = 4096
#: Groups of the large lengths, and the share of the capacity above which a length is large.
GROUPS, LARGE = 40, 1 / 8
#: Parts in which the pieces of one length are numbered.
SPREAD = 256


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size, how many sequences) by column generation on the relaxed programme, rounded down."""
    n, need = len(sizes), np.array(counts, dtype=float)
    basis = np.diag([float(capacity // s) for s in sizes])
    order = np.array(sizes)
    for _ in range(60 * n):
        price = np.linalg.solve(basis.T, np.ones(n))
        # Dearest contents of each capacity: an unbounded knapsack over whole tokens.
        value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(order.min()), capacity + 1):
            fits = np.flatnonzero(order <= c)
            worth = value[c - order[fits]] + price[fits]
            k = int(worth.argmax())
            value[c], last[c] = (worth[k], fits[k]) if worth[k] > value[c - 1] else (value[c - 1], -1)
        if value[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(n), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                column[last[c]] += 1
                c -= sizes[last[c]]
        amount, change = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        up = change > 1e-9
        ratio = np.full(n, np.inf)
        ratio[up] = np.maximum(amount[up], 0) / change[up]
        basis[:, int(ratio.argmin())] = column
    amount = np.linalg.solve(basis, need)
    return [(basis[:, k].round().astype(int), int(x + 1e-6)) for k, x in enumerate(amount) if x >= 1]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first ordinal, past the last ordinal, first sequence, pieces of it in a sequence)."""
    rows: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> (first sequence, how many)
    n_sequences = 0
    large = [(s, c) for s, c in sorted(histogram.items(), reverse=True) if s > capacity * LARGE and c > 0]
    total = sum(c for _, c in large)
    if total:
        each = -(-total // GROUPS)
        # Groups of equal cardinality along falling lengths: parts of (length, count), rounded up to the first length.
        groups: list[list[list[int]]] = [[]]
        for s, c in large:
            while c:
                have = sum(x for _, x in groups[-1])
                if have == each:
                    groups.append([])
                    have = 0
                take = min(c, each - have)
                groups[-1].append([s, take])
                c -= take
        queue: dict[int, list[list[int]]] = defaultdict(list)
        for g in groups:
            queue[g[0][0]] += g
        sizes = sorted(queue, reverse=True)
        left = {s: sum(c for _, c in queue[s]) for s in sizes}
        for pattern, times in configurations(sizes, [left[s] for s in sizes], capacity):
            times = min([times, *(left[s] // a for s, a in zip(sizes, pattern.tolist()) if a)])
            if times <= 0 or not pattern.any():
                continue
            edges, loads = {0, times}, []
            for s, a in zip(sizes, pattern.tolist()):
                left[s] -= a * times
                for _ in range(a):
                    at = 0
                    while at < times:
                        size, have = queue[s][0]
                        take = min(have, times - at)
                        rows.append((size, used[size], used[size] + take, n_sequences + at, 1))
                        loads.append((at, at + take, size))
                        used[size] += take
                        at += take
                        edges.add(at)
                        queue[s][0][1] -= take
                        if not queue[s][0][1]:
                            queue[s].pop(0)
            cuts = sorted(edges)
            load = np.zeros(len(cuts), dtype=np.int64)
            for a, b, size in loads:
                load[bisect_left(cuts, a) : bisect_left(cuts, b)] += size
            for k in range(len(cuts) - 1):
                room[capacity - int(load[k])].append((n_sequences + cuts[k], cuts[k + 1] - cuts[k]))
            n_sequences += times
    free = sorted(r for r in room if room[r] and r > 0)
    for size in sorted(histogram, reverse=True):
        todo = histogram[size] - used[size]
        while todo > 0:
            k = bisect_left(free, size)
            if k < len(free):
                space = free[k]
                first, n = room[space].pop()
                if not room[space]:
                    free.pop(k)
            else:
                space, first, n = capacity, n_sequences, -(-todo // (capacity // size))
                n_sequences += n
            fit = space // size
            full = min(n, todo // fit)
            lots = [(first, full, fit)] if full else []
            if full < n and todo - full * fit:
                lots.append((first + full, 1, todo - full * fit))
            taken = 0
            for start, m, per in lots:
                rows.append((size, used[size], used[size] + m * per, start, per))
                used[size] += m * per
                todo -= m * per
                taken += m
                rest = space - per * size
                if rest:
                    if not room[rest]:
                        insort(free, rest)
                    room[rest].append((start, m))
            if taken < n:
                if not room[space]:
                    insort(free, space)
                room[space].append((first + taken, n - taken))
    return rows


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; with ids also the ids themselves."""
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(WordEncoder, tokenizer)
        for b in batches:
            out = []
            for i, chunks in zip(b["doc_id"], encoder.encode(b["text"].tolist())):
                data = b"".join([*chunks, end])
                for k in range(0, len(data), 4 * capacity):
                    part = data[k : k + 4 * capacity]
                    out.append((i, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, dtype="<i4")] * ids)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * ids)]).astype({"doc_id": "Int64"})

    return whole_text(docs, id_col, text_col).mapInPandas(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pieces() with sequence_id and offset."""
    made = cut(pieces(docs, tokenizer, end_id, capacity, ids, id_col, text_col).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SPREAD))), "pieces")
    counts = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    spark = docs.sparkSession
    steps = spark.createDataFrame(plan(histogram, capacity), "length long, low long, high long, first long, per long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = made.withColumn("k", F.row_number().over(within) - 1).join(base, ["length", "part"]).withColumn("ordinal", F.col("k") + F.col("base"))
    # The plan has a few rows for each length, whatever the number of documents.
    placed = numbered.join(F.broadcast(steps), "length").where("ordinal >= low AND ordinal < high").withColumn("sequence_id", F.col("first") + F.floor((F.col("ordinal") - F.col("low")) / F.col("per")))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] * ids)
    )
