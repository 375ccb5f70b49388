"""Cases of the third review: ids beyond 64 bits, listings without a fingerprint."""

from datetime import datetime

import duckdb
import pytest

from hearthline.operators import dedup, incremental, publish
from hearthline.plans import queries
from hearthline.plans.listings_view import listings

TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "ASIA")]), "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "NATION_0", 0)]),
    "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(15, "a", 0, 1.0, "BUILDING"), (16, "b", 0, 1.0, "BUILDING")]),
    "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(k, f"rod {k}", "Brand#1", "PROMO", 2, 1.0) for k in (715, 716, 1430, 120000)]),
}


def given(spark, path, lines):
    """Tables with these lines: (order, part, supplier, line, quantity); orders that are divisible by 3 have customer 15, who shows no contact."""
    day = datetime(2000, 1, 1)
    orders = [(o, 15 if o % 3 == 0 else 16, "O", 1.0, day, "1-URGENT") for o in sorted({x[0] for x in lines})]
    made = TABLES | {
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string", orders),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp", [(o, p, s, n, q, 100.0 * p, 0.0, 0.0, "A", "O", day) for o, p, s, n, q in lines]),
    }
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_ids_beyond_64_bits(spark, tmp_path):
    lines = [(o, p, s, n, 7.0) for o in (0, 922336, 922337, 8999999) for p in (715, 120000) for s in (9, 59999) for n in (1, 7)]
    path = given(spark, tmp_path, lines)
    exact = [(o * 10**13 + p * 10**8 + s * 10**4 + n * 1000 + int(q) * 10) for o, p, s, n, q in lines]
    want = [(x + 2**63) % 2**64 - 2**63 for x in exact]
    got = [r["id"] for r in listings(spark, path).where("source_channel <> 'repost'").select("id").collect()]
    assert sorted(got) == sorted(want) and len(set(got)) == len(lines) and max(exact) > 2**63
    assert queries.dedup_tally(spark, path).selectExpr("sum(fetched)").first()[0] == listings(spark, path).count()
    assert queries.text_search(spark, path).where("term = 'st'").count() == 0


@pytest.mark.parametrize("name", ["dedup_decisions", "graph_nodes", "graph_edges", "graph_edges_by_increments", "edge_evidence", "node_metadata"])
def test_listings_without_fingerprint(spark, tmp_path, name):
    # Parts divisible by 715 have no address and no area, 50 pieces no price. The first line of an external id says nothing, the next one does.
    path = given(spark, tmp_path, [(3, 715, 1, 1, 50.0), (3, 716, 1, 1, 5.0), (6, 1430, 1, 5, 50.0), (7, 716, 1, 1, 5.0)])
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in (*TABLES, "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * REPLACE ({'CAST(o_orderdate AS TIMESTAMP) AS o_orderdate' if t == 'orders' else 'CAST(l_shipdate AS TIMESTAMP) AS l_shipdate' if t == 'lineitem' else f'{TABLES[t][0].split()[0]} AS {TABLES[t][0].split()[0]}'}) FROM '{path}/{t}.parquet/*.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, path).select(*columns).collect())


def test_edges_alone_of_increments(spark, tmp_path):
    schema = "id long, agency_id int, title string, created_at int, updated_at int, object_key string, address_key string, contact_key string, source_key string, org_keys array<string>"
    rows = spark.createDataFrame([(k, 1, "t", k, k, f"o{k % 3}", "street", "phone:7", "s", ["org", "org"]) for k in range(9)], schema)
    for name, nodes in (("all", True), ("edges", False)):
        for part in (rows.where("id < 6"), rows.where("id >= 4")):
            incremental.merge_graph(f"{tmp_path}/{name}", part, buckets=2, nodes=nodes)
    both = [sorted(map(tuple, incremental.read(spark, f"{tmp_path}/{n}/edges").collect())) for n in ("all", "edges")]
    assert both[0] == both[1] and sorted(r[-1] for r in both[1] if r[1] == "contact_to_organization") == [9]
    assert not (tmp_path / "edges" / "nodes").exists() and (tmp_path / "all" / "nodes").exists()


def test_tasks_of_listings_with_negative_ids(spark):
    tasks = spark.createDataFrame([(1, "-5"), (1, "7"), (1, " -9 "), (1, "x-5"), (1, "--5")], "agency_id int, source_record_id string")
    rows = spark.createDataFrame([(-5, 1, "a"), (7, 1, "a"), (-9, 1, "b"), (-11, 1, "b")], "id long, agency_id int, source string")
    assert sorted(tuple(r) for r in publish.tasks_by_source(tasks, rows).collect()) == [("a", 2), ("b", 1)]


def test_texts_stay_out_of_the_joins_of_the_rules(spark, tmp_path, monkeypatch):
    path, seen, met = given(spark, tmp_path, [(3, 715, 1, 1, 50.0), (3, 716, 1, 1, 5.0), (7, 716, 1, 1, 5.0), (7, 716, 1, 2, 5.0)]), [], dedup._met
    monkeypatch.setattr(dedup, "_met", lambda rows, single, key: seen.extend(rows.columns) or met(rows, single, key))
    plain, rows = dedup.decisions(listings(spark, path)), listings(spark, path)
    got = dedup.decisions(rows, keep=("title", "source_channel", "city"))
    assert got.columns == [*plain.columns, "title", "source_channel", "city"] and not {"title", "city"} & set(seen)
    want = plain.join(rows.select("id", "title", "source_channel", "city"), "id").collect()
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) == rows.count()
