"""Medians of groups that no task may hold, and duplicates at one hot address."""

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hearthline.operators import dedup, market, selection

ROW = "a int, b string, x double, y double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    made = [(1, None, rng.choice([rng.random() * 1000, 5.0, None]), float(rng.randint(0, 3))) for _ in range(3000)]
    made += [(1, "b", rng.random(), None) for _ in range(501)] + [(2, "b", float(k % 5), rng.random()) for k in range(40)] + [(None, None, 1.0, None), (3, None, None, None)] * 30
    return made + [(4, "same", 7.0, 7.0)] * 900


def test_medians_by_selection_equal_statistics(spark, rows):
    held = defaultdict(lambda: ([], []))
    for a, b, x, y in rows:
        for kept, v in zip(held[a, b], (x, y)):
            kept += [v] if v is not None else []
    frame = spark.createDataFrame(rows, ROW).repartition(4)
    mid = lambda v: statistics.median(v) if v else None
    for hot in (25, 100, 100_000):
        got = {(r["a"], r["b"]): (r["median_x"], r["median_y"]) for r in selection.medians(frame, ["a", "b"], ["x", "y"], hot).collect()}
        assert got == {k: (pytest.approx(mid(x)), pytest.approx(mid(y))) for k, (x, y) in held.items()}


def test_a_hot_group_fills_many_ranges(spark, rows):
    frame = spark.createDataFrame(rows, ROW).where("a = 1 AND b IS NULL AND x <> 5.0")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = selection.ranges(frame, ["a", "b"], "x").groupBy("part").agg(F.sum("n").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = sum(r["n"] for r in parts)
    assert len(parts) == 4 and max(r["n"] for r in parts) < 0.5 * total


def test_benchmarks_of_a_hot_segment(spark, monkeypatch):
    rng = random.Random(2)
    made = [(1, "r", None, "other", "rent", "10-30", 20.0, float(rng.randint(1, 10**6)), "2024-05-01") for _ in range(1001)] + [(1, "r", "d", "other", "rent", None, 20.0, 5.0, "2024-05-01")] * 2
    seg = spark.createDataFrame(made, "agency_id int, region string, district string, property_type string, deal_type string, area_band string, area_sqm double, price double, updated_at string").withColumns({"updated_at": F.col("updated_at").cast("timestamp"), "price_m2": F.col("price") / F.col("area_sqm")})
    monkeypatch.setattr(selection.medians, "__defaults__", (100,))
    got = market.benchmarks(seg, "2024-06-01").collect()
    want = statistics.median(r[7] for r in made[:1001])
    assert [(r["median_price"], r["median_price_m2"], r["listing_count"], r["district"]) for r in got] == [(want, want / 20, 1001, None)]


def plain_nearest(rows):
    """The smallest earlier id within tolerance of each row, by looking at all pairs."""
    out = {}
    for i, agency, addr, area, price in rows:
        near = [j for j, g, a, x, p in rows if j < i and (g, a) == (agency, addr) and abs(area - x) <= 0.15 * abs(x) and abs(price - p) <= 0.2 * abs(p)]
        if near:
            out[i] = min(near)
    return out


@pytest.mark.parametrize("order", ["any", "rising", "falling"])
def test_nearest_at_a_hot_address(spark, order):
    rng = random.Random(7)
    ids = list(range(1, 701))
    area = lambda: rng.choice([rng.uniform(10, 90), float(rng.randint(20, 40)), 50.0, 42.5, 57.5, -30.0])
    price = lambda: rng.choice([rng.uniform(1e5, 9e5), 100000.0, 80000.0, 120000.0, float(rng.randint(100, 130)) * 1000])
    points = [(area(), price()) for _ in ids]
    points.sort(key=lambda p: p[1], reverse=order == "falling") if order != "any" else rng.shuffle(points)
    rows = [(i, 1, "hot" if i % 10 else f"cold {i % 50}", a, p) for i, (a, p) in zip(ids, points)]
    frame = spark.createDataFrame(rows, "id long, agency_id int, addr string, area double, price double")
    low = {(r["addr"], r["area"], r["price"]): r["low"] for r in dedup.nearest(frame).collect()}
    got = {i: low[addr, a, p] for i, _, addr, a, p in rows if (addr, a, p) in low and low[addr, a, p] < i}
    assert got == plain_nearest(rows)


def test_a_hot_address_makes_no_pairs(spark):
    """20 000 points within one tolerance box, all near each other: the rows that joins make stay in proportion to them."""
    rows = spark.range(20000).select(F.xxhash64("id").alias("id"), F.lit(1).alias("agency_id"), F.lit("hot").alias("addr"), (100 + F.pmod("id", F.lit(140)) * 0.1).alias("area"), (1e6 + F.floor(F.col("id") / 140) * 1000.0).alias("price"))
    got = dedup.nearest(rows)
    assert got.count() == 20000 - 1 and got.agg(F.min("low")).first()[0] == rows.agg(F.min("id")).first()[0]


def spread_points(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(i, 1, "hot", round(rng.uniform(1, 50), 1) * rng.randint(1, 50), round(rng.uniform(900, 105000), 2)) for i in rng.sample(range(-n, n), n)]


def test_an_address_of_many_spread_points_is_looked_through_in_turn(spark, monkeypatch):
    """800 points in no special order: none is laid on the grid, where each would make 150 rows, and few meet more than the first ids."""
    rows, written, cut = spread_points(800, 5), {}, dedup.cut
    def counted(df, label):
        made = cut(df, label)
        written.setdefault(label, []).append(made.count())
        return made
    monkeypatch.setattr(dedup, "cut", counted)
    got = dedup.nearest(spark.createDataFrame(rows, "id long, agency_id int, addr string, area double, price double")).collect()
    at = {(a, p): i for i, _, _, a, p in rows}
    assert len(at) == 800 and {at[r["area"], r["price"]]: r["low"] for r in got} == plain_nearest(rows)
    assert "dedup-grid" not in written and written["dedup-looked"][0] == 800 and sum(written["dedup-looked"]) < 2 * 800


def test_the_grid_finds_what_the_turns_find(spark, monkeypatch):
    rows = spread_points(300, 6)
    frame = spark.createDataFrame(rows, "id long, agency_id int, addr string, area double, price double")
    monkeypatch.setattr(dedup, "HOT_POINTS", 64)
    at = {(a, p): i for i, _, _, a, p in rows}
    assert {at[r["area"], r["price"]]: r["low"] for r in dedup.nearest(frame).collect()} == plain_nearest(rows)
