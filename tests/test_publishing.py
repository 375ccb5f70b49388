"""Publishing, properties, calls and promotions on hand-made rows."""

from datetime import datetime

from pyspark.sql import functions as F

from hearthline.operators import publish

NOW, OLD = datetime(2024, 6, 1), datetime(2023, 1, 1)


def test_stages_on_the_way_and_first_times(spark):
    rows = spark.createDataFrame([
        (1, 1, "Hall", "a", None, "owner_candidate", None, "new", None, None), (2, 1, "Hall", "a", None, None, "raw", "new", 5.0, None), (3, 1, "Hall", "a", None, None, "published", "new", 5.0, OLD),
        (4, 1, "H", "a", None, None, "parsed", "new", 5.0, None), (5, 1, "H", "a", None, None, "rejected", "rejected", None, OLD), (6, 1, "Hall", "a", None, None, "rejected", "rejected", 1.0, None), (7, 2, "Hall", None, "", None, "scored", "converted_to_lead", 1.0, None),
    ], "id int, agency_id int, title string, address string, city string, contact_class string, stage string, status string, score double, published_at timestamp")
    out = publish.published(rows, F.lit(NOW))
    got = {r.id: (r.reached, r.stage, r.status, r.published_at, r.first_published, r.first_rejected) for r in out.collect()}
    assert got == {
        1: ("contacts_resolved", "published", "new", NOW, True, False), 2: ("scored", "published", "new", NOW, True, False), 3: ("published", "published", "new", OLD, False, False),
        4: ("normalized", "rejected", "rejected", None, False, True), 5: ("rejected", "rejected", "rejected", OLD, False, False), 6: ("rejected", "published", "rejected", NOW, True, False), 7: ("scored", "rejected", "converted_to_lead", None, False, True),
    }
    made = spark.createDataFrame([(1,), (1,)], "agency_id int")
    assert {tuple(r) for r in publish.publish_counters(out, made).select("agency_id", "published", "rejected", "objects_resolved").collect()} == {(1, 3, 1, 2), (2, 0, 1, 0)}


def test_properties_have_all_columns_and_one_key(spark):
    schema = "id long, agency_id int, source_channel string, source_external_id string, title string, description string, address string, city string, region_code string, latitude double, longitude double, area_sqm double, price_rub double, listing_type string"
    rows = spark.createDataFrame([
        (5, 1, "a", "x", "Офис у парка", "d5", "", None, None, 1.0, 2.0, 30.0, 9.0, "продажа"), (4, 1, "a", "x", "Склад", "d4", "Main 1", "Izh", "RU-X", 3.0, 4.0, 50.0, 7.0, None), (6, 1, "a", None, "Земельный участок", "на продажу", "A", "B", "C", None, None, None, None, None),
        (10, 2, "c", "y", "Свободное назначение", None, "A", "B", "C", None, None, None, None, None), (7, 1, "a", None, "Other", "d7", "A", "B", "C", None, None, None, None, "rent"), (8, 1, "b", "x", "Known", "d8", "A", "B", "C", None, None, None, None, None), (9, 2, "a", "x", "Помещение", "торговый зал", None, "", "", None, None, 1.0, 2.0, "sell"),
    ], schema)
    known = spark.createDataFrame([(1, "b", "x", 77)], "agency_id int, source_channel string, source_external_id string, property_id long")
    made = publish.new_properties(rows, known)
    got = {r.id: r for r in made.collect()}
    assert sorted(got) == [4, 6, 9, 10] and (got[10].property_type, got[10].deal_type) == ("other", "rent")
    fields = ("title", "description", "address", "city", "region_code", "latitude", "longitude", "area_sqm", "price_rub", "deal_type", "property_type", "source_external_id")
    assert [tuple(got[i][f] for f in fields) for i in (4, 6, 9)] == [
        ("Склад", "d4", "Main 1", "Izh", "RU-X", 3.0, 4.0, 50.0, 7.0, "rent", "warehouse", "x"), ("Земельный участок", "на продажу", "A", "B", "C", None, None, None, None, "sale", "land", None),
        ("Помещение", "торговый зал", "Без адреса", "Не указан", "RU-UDM", None, None, 1.0, 2.0, "sale", "retail", "x"),
    ]
    linked = {r.id: r.property_id for r in publish.with_property(rows, made.select("agency_id", "source_channel", "source_external_id", "property_id").unionByName(known)).collect()}
    assert linked[5] == linked[4] == got[4].property_id and linked[6] == linked[7] and linked[8] == 77 and None not in linked.values()
    assert publish.new_properties(rows, made).select("id").collect() == [(8,)]


def test_calls_go_by_lead(spark):
    """Two leads of one number are two calls; a loose number counts; other states, empty numbers and called leads do not."""
    leads = spark.createDataFrame([
        (1, 1, "8 900 111-22-33", "11", True, "auto_created"), (2, 1, "8 900 111-22-33", "12", True, "auto_created"), (3, 1, "123", " 13 ", True, "auto_created"), (4, 1, "", "14", True, "auto_created"),
        (5, 1, None, "15", True, "auto_created"), (6, 1, "8", "16", True, "active"), (7, 1, "8", "17", False, "auto_created"), (8, 1, "9", "call:7", True, "auto_created"),
    ], "lead_id long, agency_id int, contact_phone string, source_record_id string, auto_created boolean, lead_state string")
    calls = spark.createDataFrame([(1,), (1,), (None,)], "lead_id long")
    tasks = publish.call_tasks(leads, calls, F.lit(NOW))
    got = {r.lead_id: (r.to_number, r.direction, r.status, r.provider, r.started_at) for r in tasks.collect()}
    assert got == {2: ("8 900 111-22-33", "outbound", "ringing", "parser_pipeline", NOW), 3: ("123", "outbound", "ringing", "parser_pipeline", NOW), 8: ("9", "outbound", "ringing", "parser_pipeline", NOW)}
    listings = spark.createDataFrame([(12, 1, 5, "8 900 111-22-33", " A@b.c"), (13, 1, 5, "123", None), (11, 1, 6, "8 900 1112233", None)], "id long, agency_id int, source int, contact_phone string, contact_email string")
    assert [tuple(r) for r in publish.tasks_by_source(tasks, listings).collect()] == [(5, 2)]
    people = spark.createDataFrame([(1, "phone:+79001112233", "owner_scored", None), (1, "email:a@b.c", "published_to_owners", OLD), (1, "email:x@y.z", "owner_scored", None), (2, "phone:+79001112233", None, None)], "agency_id int, contact_key string, lifecycle_status string, promoted_at timestamp")
    after = {(r.agency_id, r.contact_key): (r.lifecycle_status, r.promoted_at) for r in publish.promoted(people, tasks, listings, F.lit(NOW)).collect()}
    assert after == {(1, "phone:+79001112233"): ("promoted_to_call_center", NOW), (1, "email:a@b.c"): ("promoted_to_call_center", OLD), (1, "email:x@y.z"): ("owner_scored", None), (2, "phone:+79001112233"): (None, None)}
