import os
import time

from pyspark.sql import functions as F

from hearthline.operators import dedup, graph, scoring
from hearthline.operators.shared import cut, shared_dir
from hearthline.plans import queries
from hearthline.plans.listings_view import listings

from .test_round3 import given


def shuffled(spark):
    """The shuffle files that lie on disk."""
    root = spark.sparkContext.getConf().get("spark.local.dir")
    return {f for _, _, files in os.walk(root) for f in files if f.startswith("shuffle_") and f.endswith(".data")}


def tables(spark):
    """Names of the tables in the shared folder, without what makes them unique."""
    path = shared_dir(spark).removeprefix("file://")
    return {name: name.rsplit("-", 1)[0] for name in os.listdir(path) if "-" in name} if os.path.isdir(path) else {}


def test_what_was_shuffled_to_write_a_table_is_removed(spark):
    before = shuffled(spark)
    made = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")), "sevens")
    until = time.time() + 20
    while (left := shuffled(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and made.count() == 7


def test_decisions_keep_two_tables_and_move_rows_once(spark, tmp_path):
    path = given(spark, tmp_path, [(3, 715, 1, 1, 50.0), (3, 716, 1, 1, 5.0), (7, 716, 1, 1, 5.0), (7, 716, 1, 2, 5.0)])
    before = tables(spark)
    decided = dedup.decisions(listings(spark, path), keep=("title",))
    assert sorted(name for key, name in tables(spark).items() if key not in before) == ["dedup-found", "dedup-rows"]
    plan = decided._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and decided.count() == listings(spark, path).count()


def test_names_alike_with_other_first_signs_are_linked(spark):
    name = "omega trading and storage house"
    contacts = spark.createDataFrame([(1, "phone:1", "a" + name[1:]), (1, "phone:2", "unlike"), (1, "phone:3", "ab")], "agency_id int, contact_key string, name string")
    orgs = spark.createDataFrame([(1, name), (1, "ab"), (2, "unlike")], "agency_id int, name string")
    got = {(r["contact_key"], r["organisation"]) for r in graph.contact_organisations(contacts, orgs).collect()}
    assert got == {("phone:1", name), ("phone:3", "ab")}


def test_what_listings_say_of_themselves_needs_no_aggregate(spark):
    schema = "id long, agency_id int, title string, status string, created_at int, updated_at int, object_key string, address_key string, contact_key string, source_key string, org_keys array<string>"
    rows = spark.createDataFrame([(k, 1, "t" if k else "", "new", k, k + 1, f"o{k % 3}", "street" if k % 2 else None, "phone:7", "s", ["org", f"org{k}"]) for k in range(9)], schema)
    for f in (graph.edges, graph.nodes, graph.node_metadata):
        assert sorted(map(str, f(rows, unique=True).collect())) == sorted(map(str, f(rows).collect()))
    alone = graph.edges(rows, unique=True).where(F.col("edge_type") == "listing_to_source")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in alone and "distinct" not in alone


def test_contact_queries_leave_keys_and_their_result(spark, tmp_path):
    path = given(spark, tmp_path, [(3, 715, 1, 1, 50.0), (4, 716, 1, 1, 5.0), (7, 716, 1, 1, 5.0), (7, 716, 1, 2, 5.0)])
    before = tables(spark)
    queries.contact_features(spark, path)
    left = lambda: sorted(name for key, name in tables(spark).items() if key not in before)
    assert left() == ["contact-features", "keyed"]
    before = tables(spark)
    queries.owner_scores(spark, path)
    assert not {"keyed", "entities", "dedup-rows", "dedup-found", "own-prices", "said-organisations"} & set(left()) and "identities" in left()


def test_texts_are_told_by_narrow_columns(spark):
    schema = "id long, agency_id int, title string, description string, contact_phone string, contact_email string, price_rub double, area_sqm double, address string, price_m2 double, deviation double, below_market boolean, updated_at timestamp, status string"
    rows = spark.createDataFrame([(k, 1, "small rod", "urgent!!! low", "8 900" if k % 2 else None, None, 5.0, 2.0, "a", 2.5, None, False, None, "duplicate" if k else "new") for k in range(4)], schema)
    said = rows.withColumns(scoring.said()).drop("title", "description", "contact_phone", "contact_email", "address")
    assert sorted(map(str, scoring.lead_scores(said, "2024-01-01").collect())) == sorted(map(str, scoring.lead_scores(rows, "2024-01-01").collect()))
