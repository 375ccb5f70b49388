"""Frontier and seeds over several runs, and templates of pages."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hearthline import keywords
from hearthline.operators import discovery

NOW = datetime(2024, 6, 1)
FRONTIER = "url string, domain string, priority int, status string, id long, last_checked_at timestamp"


def test_a_second_run_claims_the_next(spark):
    rows = [(f"u{k}", "d", k % 7, "new" if k % 10 else "processed", k, None) for k in range(200)]
    state, taken = spark.createDataFrame(rows, FRONTIER), []
    for run in range(4):
        best, state = discovery.claim(state, F.lit(NOW + timedelta(days=run)))
        taken.append([r.id for r in best.collect()])
    order = [r[4] for r in sorted((r for r in rows if r[3] == "new"), key=lambda r: (-r[2], -r[4]))]
    assert [sorted(t) for t in taken] == [sorted(order[k : k + 50]) for k in (0, 50, 100, 150)] and len(taken[3]) == 30
    got = {r.id: (r.status, r.last_checked_at) for r in state.collect()}
    assert len(got) == 200 and got[0] == ("processed", None) and got[order[60]] == ("processing", NOW + timedelta(days=1))
    done = discovery.settle(state, spark.createDataFrame([(order[0], False), (order[1], True), (order[1], False)], "id long, failed boolean"))
    assert {r.id: r.status for r in done.collect() if r.id in order[:3]} == {order[0]: "processed", order[1]: "error", order[2]: "processing"}


def test_enqueue_keeps_rows_and_higher_priorities(spark):
    state = spark.createDataFrame([("a", "d", 5, "processed", 1, NOW), ("b", "d", 9, "new", 2, None)], FRONTIER)
    found = spark.createDataFrame([("a", "x", 7), ("a", "x", 3), ("b", "d", 1), ("c", "e", 4)], "url string, domain string, priority int")
    got = {r.url: (r.domain, r.priority, r.status, r.last_checked_at, r.id) for r in discovery.enqueue(state, found, 100).collect()}
    assert got["a"] == ("d", 7, "processed", NOW, 1) and got["b"] == ("d", 9, "new", None, 2) and got["c"][:4] == ("e", 4, "new", None) and got["c"][4] >= 100


def test_seeds_of_six_origins(spark):
    manual = spark.createDataFrame([(1, "url", "m1", 60, "R", True), (2, "keyword", "m2", 90, None, True), (3, "url", "m3", 99, "R", False), (4, "url", "m4", None, "R", True)], "id int, seed_type string, value string, priority int, region string, enabled boolean")
    sources = spark.createDataFrame([(1, "https://www.A.b/x", "R1", True), (2, "", "R2", True), (3, "https://c.d", "R3", False), (4, "e.f/y", "R4", True)], "id int, source_url string, region_code string, is_active boolean")
    results = spark.createDataFrame([(k, u, NOW - timedelta(days=d)) for k, u, d in ((1, "https://old.x/1", 31), (2, "https://g.h/1", 30), (3, None, 1), (4, "https://g.h/2", 0))], "id int, raw_url string, created_at timestamp")
    claimed, _ = discovery.claim(spark.createDataFrame([("f1", "d", 70, "new", 8, None), ("f2", "d", 3, "new", 9, None), ("f3", "d", 70, "new", 10, None)], FRONTIER), F.lit(NOW))
    at = F.lit(NOW)
    every = discovery.seeds(manual, sources, results, claimed, at, cap=100).orderBy("rank").collect()
    pack = [(60, w, "keyword_pack") for w in keywords.SEARCH_PACK]
    want = [(90, "m2", "manual"), (80, "https://www.A.b/x", "active_source"), (80, "e.f/y", "active_source"), (70, "f3", "frontier"), (70, "f1", "frontier"), (65, "a.b", "active_source_domain"), (65, "e.f", "active_source_domain"), (60, "m1", "manual"), *pack, (55, "g.h", "parser_results"), (55, "g.h", "parser_results"), (3, "f2", "frontier"), (0, "m4", "manual")]
    assert [(r.priority, r.value, r.seed_origin) for r in every] == want and len(pack) == 12
    assert [(r.seed_type, r.region, r.frontier_id) for r in every[2:5]] == [("url", "R4", None), ("url", "RU-UDM", 10), ("url", "RU-UDM", 8)]
    assert [r.value for r in discovery.seeds(manual, sources, results, claimed, at, cap=3).orderBy("rank").collect()] == ["m2", "https://www.A.b/x", "e.f/y"]
    assert [r.value for r in discovery.seeds(manual, sources, results, claimed, at, auto=False).orderBy("rank").collect()] == ["m2", "m1", "m4"]


def test_templates(spark):
    cards = lambda html: spark.createDataFrame([(html,)], "h string").select(discovery.card_count(F.col("h")).alias("n")).first().n
    assert cards("<div class='big card'><p class=item><a class=\"card-body\"><b class='Card'><i data-class='card'><u title='class=card' class=\"x  offer\ty\">") == 3 and cards("no tags, class='card'") == 0
    choose = lambda html, n, *known: tuple(spark.createDataFrame([(html,)], "h string").select(discovery.template_choice(F.col("h"), F.lit(n), *known).alias("t")).first().t)
    assert choose("application/ld+json OFFER", 9) == ("jsonld_listing", 0.85) and choose("x", 6) == ("listing_grid_basic", 0.7) and choose("x", 3) == ("listing_grid_basic", 0.5) and choose("x", 2) == (None, 0.0) and choose("x", 6, ("jsonld_listing",)) == (None, 0.0)
