"""Listing operators against literal rows and a sequential restatement of the dedup rules."""

import random

from pyspark.sql import functions as F

from hearthline.functions import extract as X
from hearthline.functions import normalize as N
from hearthline.operators import dedup, discovery, events, graph, market, scoring
from hearthline.sources import listings as S

LISTING = "id long, agency_id int, source_channel string, source_external_id string, address string, area_sqm double, price_rub double, contact_phone string, contact_email string"


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def test_fingerprint_ignores_formats(spark):
    rows = [(1, 1, "a", None, "Ижевск, Ленина 1", 100.0, 1000000.0, "+7 (900) 111-22-33", None), (2, 1, "b", None, "ижевск,  ленина 1", 100.4, 1000400.0, "8 900 111 22 33", None), (3, 1, "b", None, None, None, None, None, None)]
    got = {r["id"]: r for r in dedup.decisions(spark.createDataFrame(rows, LISTING)).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[2]["status"] == "duplicate" and got[2]["duplicate_of_id"] == 1
    assert got[3]["fingerprint"] is None and got[3]["status"] == "new"


def sequential(rows):
    stored, out = [], []
    for r in rows:
        i, agency, channel, ext, address, area, price, phone = r
        key = (phone or "", " ".join((address or "").lower().split()), round(area or 0), round((price or 0) / 1000))
        key = None if key == ("", "", 0, 0) else key
        parent = next((s for s in stored if ext and s["r"][1:4] == (agency, channel, ext)), None)
        status, own = ("duplicate", parent["fp"]) if parent else ("new", key)
        if not parent and key is not None:
            parent = next((s for s in stored if s["r"][1] == agency and s["fp"] == key), None)
            status = "duplicate" if parent else "new"
        if not parent and address and area and price:
            near = lambda a, b, t: bool(b) and abs(a - b) <= t * abs(b)
            parent = next((s for s in stored if s["r"][1] == agency and s["r"][4] and s["r"][4].lower() == address.lower() and s["r"][5] and s["r"][6] and near(area, s["r"][5], 0.15) and near(price, s["r"][6], 0.2)), None)
            status = "possible_duplicate" if parent else "new"
        stored.append({"r": r, "fp": own})
        out.append((i, status, parent["r"][0] if parent else None))
    return out


def test_dedup_equals_sequential_ingest(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2]), rng.choice("ab"), rng.choice([None, "x", "y", "z", "u", "v"]), rng.choice([None, "Main 1", "main 1", "Hill 2"]), rng.choice([None, 0.0, 50.0, 54.0, 60.0, 100.0]), rng.choice([None, 100000.0, 115000.0, 130000.0, 90000.0]), rng.choice([None, "79001112233", "79004445566"])) for i in range(1, 400)]
    df = spark.createDataFrame([(*r[:7], r[7], None) for r in rows], LISTING)
    assert sorted((r["id"], r["status"], r["duplicate_of_id"]) for r in dedup.decisions(df).collect()) == sequential(rows)


def test_scalars(spark):
    assert one(spark, N.phone_strict(F.lit("8 (912) 345-67-89"))) == "+79123456789"
    assert one(spark, N.phone_strict(F.lit("123"))) == "" and one(spark, N.phone_keep(F.lit(" 123 "))) == "123"
    assert one(spark, N.address(F.lit(" Ижевск,  Ленина "))) == "ижевск, ленина"
    assert one(spark, N.query_list(F.lit("#A,#a,x,x"), ["d"])) == ["#A", "x"] and one(spark, N.query_list(F.lit(None).cast("string"), ["d", "e", "f"])) == ["d", "e", "f"]
    assert one(spark, N.organisation(F.lit('ООО "Ромашка"'))) == "ромашка"
    assert one(spark, N.published_at(F.lit("2024-01-01T00:00:00Z"))) is None and one(spark, N.published_at(F.lit("2024-01-01"))) is not None
    assert one(spark, N.safe_float(F.lit("1,5"))) == 1.5 and one(spark, N.clamp_int(F.lit("999"), 5, 1, 10)) == 10
    assert one(spark, N.clean_url(F.lit("example.com/a)."))) == "https://example.com/a" and one(spark, N.domain(F.lit("https://www.Example.com/x"))) == "example.com"
    assert one(spark, N.repair_mojibake(F.lit("Ð\u009fÑ\u0080Ð¸"))) == "При" and one(spark, N.repair_mojibake(F.lit("При"))) == "При"
    assert one(spark, X.price(F.lit("цена 150 000 руб. в месяц"))) == 150000.0 and one(spark, X.area(F.lit("площадь 120,5 м2"))) == 120.5
    assert one(spark, X.labelled_address(F.lit("Адрес: Ижевск, Ленина 1"))) == "Ижевск, Ленина 1"
    assert one(spark, X.district(F.lit("Ленинский район"), ["Устиновский"])) == "Ленинский" and one(spark, X.organisations(F.lit("ооо ромашка, ип иванов"))) == ["ООО ромашка", "ИП иванов"]


def test_market_and_scores(spark):
    assert one(spark, market.area_band(F.lit(30.0))) == "10-30" and one(spark, market.area_band(F.lit(0.0))) is None
    assert one(spark, market.deal_type(F.lit(None).cast("string"), F.lit("Сдам в аренду"), F.lit(""))) == "rent" and one(spark, market.property_type(F.lit(None), F.lit("Тёплый склад"), F.lit(None))) == "warehouse"
    assert one(spark, scoring.freshness(F.lit(6.0))) == 100.0 and one(spark, scoring.freshness(F.lit(721.0))) == 10.0
    assert one(spark, scoring.owner_probability(F.lit("собственник"), F.lit(True))) == 80.0


def test_fuzzy_names_follow_order(spark):
    names = spark.createDataFrame([(1, "ромашка плюс один"), (2, "ромашка плюс одна"), (3, "ромашка плюс один"), (4, "роза")], "id long, name string")
    assert {(r["a_id"], r["b_id"]) for r in graph.fuzzy_pairs(names).collect()} == {(1, 2), (1, 3)}


def test_changes_and_states(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, "a"), (1, 3, "b"), (1, 4, None), (1, 5, None)], "k int, t int, v string")
    assert [(r["t"], r["kind"]) for r in events.changes(rows, ["k"], ["v"], ["t"]).orderBy("t").collect()] == [(2, "filled"), (3, "changed"), (4, "cleared")]
    runs = spark.createDataFrame([(1, t, t < 4) for t in range(1, 7)], "k int, t int, bad boolean")
    assert [r["state"] for r in discovery.streaks(runs, "k", ["t"], F.col("bad")).orderBy("t").collect()] == ["active", "active", "paused", "paused", "active", "active"]


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([('[{"id": 1001, "name": "Офис", "price": "50000000", "description": "площадь 20 м2"}]',)], "value string")
    r = S.json_records(raw).first()
    assert r["source_external_id"] == "1001" and r["price_rub"] == 50000000.0 and r["area_sqm"] == 20.0
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>T1</title><link>http://a</link><description>d</description><enclosure url='http://i'/></item></channel></rss>")
    assert S.rss(spark, str(tmp_path / "feed.xml")).first().asDict() == {"title": "T1", "raw_url": "http://a", "description": "d", "image_url": "http://i"}
    assert S.canonical(spark.createDataFrame([("ab",)], "title string")).first()["region_code"] == "RU-UDM"


def test_streaming_upsert(spark, tmp_path):
    from hearthline.streaming import ingest

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, t int, v string").write.parquet(src)
    stream = spark.readStream.schema("k string, t int, v string").parquet(src)
    ingest.upsert_stream(stream, str(tmp_path / "table"), str(tmp_path / "cp"), ["k"], ["v"], ["t"]).awaitTermination()
    assert {(r["k"], r["v"]) for r in ingest.current(spark, str(tmp_path / "table"), ["k"], ["v"], ["t"]).collect()} == {("a", "x"), ("b", "y")}


def test_contact_candidates(spark):
    from hearthline.operators import contacts

    rows = spark.createDataFrame([(1, "Собственник +7 900 111-22-33, 8 (900) 111-22-33 or Me@Mail.ru", "footer help@site.ru"), (2, None, ""), (3, "agent a@b.ru", "x@site.ru")], "id long, body string, page string")
    rated = contacts.classified(contacts.candidates(rows, "id", [("listing_body", F.col("body")), ("footer", F.col("page"))]), F.lit("site.ru"))
    got = {(r["id"], r["normalized"]): (r["seq"], r["contact_class"], r["confidence"], r["reasons"]) for r in rated.collect()}
    assert got == {
        (1, "+79001112233"): (1, "owner_candidate", 0.95, []), (1, "me@mail.ru"): (2, "owner_candidate", 0.9, []),
        (1, "help@site.ru"): (3, "support_contact", 0.05, ["email_prefix_blocked", "platform_domain", "support_context", "header_footer"]),
        (3, "a@b.ru"): (1, "agent_candidate", 0.75, []), (3, "x@site.ru"): (2, "platform_contact", 0.05, ["platform_domain", "header_footer"]),
    }
    bundle = {r["id"]: r for r in contacts.bundles(rated, "id").collect()}
    assert bundle[1]["selected"]["normalized"] == "+79001112233" and bundle[3]["rejection_reasons"] == ["header_footer", "platform_domain"] and 2 not in bundle


def test_due_sources_and_calls(spark):
    src = spark.sql("SELECT * FROM VALUES (1, true, 90, timestamp'2024-01-01'), (2, true, 10, null), (3, false, 90, null), (4, true, 90, timestamp'2025-01-01') t(id, is_active, priority, next_at)")
    at = F.lit("2024-06-01").cast("timestamp")
    assert [r["id"] for r in discovery.due(src, at).orderBy("id").collect()] == [1, 2]
    assert [r["id"] for r in discovery.due(src, at, high_priority=True).collect()] == [1]
    calls = spark.createDataFrame([(1, 7, "8900"), (2, 9, "8901"), (3, None, None)], "call_id long, lead_id long, from_number string")
    leads = spark.createDataFrame([(7, "Known", "1")], "lead_id long, title string, contact_phone string")
    got = {r["call_id"]: (r["title"], r["contact_phone"], r["is_new"]) for r in events.calls_to_leads(calls, leads).collect()}
    assert got == {1: ("Known", "1", False), 2: ("Call lead 8901", "8901", True), 3: ("Call lead unknown", None, True)}
