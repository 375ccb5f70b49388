"""Increments against one run, snapshots, and tenants that end with no rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hearthline.operators import graph, incremental
from hearthline.sources import listings as S

KEYED = "id long, agency_id int, title string, status string, object_key string, address_key string, contact_key string, source_key string, org_keys array<string>, created_at timestamp, updated_at timestamp"


def keyed(n):
    rng, day = random.Random(8), datetime(2024, 1, 1)
    pick = lambda *v: rng.choice(v)
    return [(i, pick(1, 2), pick("", "t", f"title {i}"), "new", f"o{rng.randint(1, 30)}", pick(None, "", f"a{rng.randint(1, 9)}"), pick(None, f"phone:{rng.randint(1, 9)}"), pick("s1", "s2"), rng.sample(["x", "y", "z"], rng.randint(0, 2)), day + timedelta(days=i % 50), day + timedelta(days=100 + i % 7)) for i in range(n)]


def test_increments_equal_one_run(spark, tmp_path):
    rows = keyed(300)
    at, path = (lambda part: spark.createDataFrame(part, KEYED)), str(tmp_path / "g")
    incremental.merge_graph(path, at(rows[:150]))
    changed = incremental.merge_graph(path, at(rows[140:]))  # ten rows come again
    again = incremental.merge_graph(path, at(rows[299:]))  # and one once more
    table = lambda name, *drop: sorted(map(tuple, incremental.read(spark, f"{path}/{name}").drop(*drop).select(*columns).collect()), key=str)
    for name, whole in (("edges", graph.edges(at(rows))), ("nodes", graph.nodes(at(rows))), ("evidence", graph.evidence(at(rows)))):
        columns = whole.columns
        assert table(name) == sorted(map(tuple, whole.collect()), key=str), name
    assert len(changed["edges"]) > 50 and 0 < len(again["edges"]) <= 6 and 0 < len(again["nodes"]) <= 7


def test_listings_merge_by_version_and_keep_the_first_time(spark, tmp_path):
    day = lambda n: datetime(2024, 1, n)
    schema, path = "id long, updated_at timestamp, run int, published_at timestamp, score double, stage string", str(tmp_path / "l")
    incremental.merge_listings(path, spark.createDataFrame([(1, day(1), 1, day(5), 10.0, "published"), (2, day(1), 1, None, 5.0, "rejected"), (3, day(3), 1, day(5), 7.0, "published")], schema))
    second = spark.createDataFrame([(1, day(2), 2, day(6), 20.0, "published"), (2, day(1), 2, day(6), None, "published"), (3, day(2), 2, day(6), 99.0, "rejected")], schema)
    for _ in range(2):
        incremental.merge_listings(path, second)
    got = {r.id: (r.updated_at, r.run, r.published_at, r.score, r.stage) for r in incremental.read(spark, path).collect()}
    assert got == {1: (day(2), 2, day(5), 20.0, "published"), 2: (day(1), 2, day(6), None, "published"), 3: (day(3), 1, day(5), 7.0, "published")}


def test_snapshots_replace_by_node(spark):
    old = spark.createDataFrame([(1, "phone:1", 5), (2, "phone:2", 6)], "agency_id int, contact_key string, listings int")
    new = spark.createDataFrame([(1, "phone:1", 7)], "agency_id int, contact_key string, listings int")
    stored = graph.snapshots(old, F.lit("t1"))
    got = {(r.agency_id, r.entity_id): (r.payload.listings, r.computed_at, r.node_type, r.feature_type) for r in graph.snapshots(new, F.lit("t2"), stored).collect()}
    assert got == {(1, "phone:1"): (7, "t2", "contact", "contact"), (2, "phone:2"): (6, "t1", "contact", "contact")}


def test_refresh_empties_tenants_of_the_run(spark, tmp_path):
    path, schema = str(tmp_path / "m"), "agency_id string, x int"
    read = lambda: sorted(map(tuple, spark.read.schema("x int, agency_id string").parquet(path).select("agency_id", "x").collect()), key=str)
    S.refresh(spark.createDataFrame([("1", 1), ("2", 2), ("a/b", 3), (None, 4), ("5", 5)], schema), path)
    S.refresh(spark.createDataFrame([("2", 9)], schema), path, tenants=["1", "2", "a/b", "7"])
    assert read() == [("2", 9), ("5", 5), (None, 4)]
    S.refresh(spark.createDataFrame([], schema), path, tenants=[None, "2"])
    assert read() == [("5", 5)]
