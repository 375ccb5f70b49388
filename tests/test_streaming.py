"""Streams in several batches against the same rows at once."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hearthline.operators import discovery
from hearthline.streaming import states

EVENT = "id long, source long, at timestamp, bad boolean"


def batches_of(spark, folder, batches, schema):
    """A file for each batch, taken in this order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.startswith("part-"):
                os.rename(f"{folder}/{name}", f"{folder}/{n:03d}.parquet")
                os.utime(f"{folder}/{n:03d}.parquet", (1_600_000_000 + n, 1_600_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_states_of_batches_out_of_order(spark, tmp_path):
    """Whatever the order of arrival, the stream ends with the rows of the batch operator; repeated deliveries count once."""
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    events = [(i, rng.choice([1, 1, 1, 2, 3, None]), start + timedelta(hours=rng.randint(0, 60)), rng.random() < 0.5) for i in range(240)]
    mixed = rng.sample(events, len(events))
    batches = [mixed[k : k + 50] for k in range(0, len(mixed), 50)]
    batches[3] += batches[1][:10]
    stream = batches_of(spark, str(tmp_path / "in"), batches, EVENT)
    states.source_states(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "source", "at", "id", F.col("bad"), "30 days").awaitTermination()
    got = {(r["key"], r["id"], r["at"], r["failed"], r["run"], r["state"]) for r in states.latest_states(spark, str(tmp_path / "out")).where("NOT late").collect()}
    want = discovery.streaks(spark.createDataFrame(events, EVENT), "source", ["at", "id"], F.col("bad"))
    assert got == {(r["source"], r["id"], r["at"], r["failed"], r["run"], r["state"]) for r in want.collect()} and len(got) == 240
    assert len(os.listdir(tmp_path / "out")) == 5


def test_settled_events_are_bounded_and_late_ones_marked(spark, tmp_path):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    batches = [[(1, 7, day(0), True), (2, 7, day(1), True)], [(3, 7, day(20), True)], [(4, 7, day(0.5), False), (5, 7, day(19), False)], [(6, 7, day(21), True)]]
    stream = batches_of(spark, str(tmp_path / "in"), batches, EVENT)
    states.source_states(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "source", "at", "id", F.col("bad"), "5 days").awaitTermination()
    got = {r["id"]: (r["run"], r["state"], r["late"]) for r in states.latest_states(spark, str(tmp_path / "out")).collect()}
    # The third failure pauses at first; a success that comes later but happened before it undoes that. Event 4 comes after its days were settled.
    assert got == {1: (1, "active", False), 2: (2, "active", False), 3: (1, "active", False), 4: (0, "active", True), 5: (1, "active", False), 6: (2, "active", False)}
    first = {r["id"]: r["state"] for r in spark.read.parquet(str(tmp_path / "out" / "batch=1")).collect()}
    assert first == {3: "paused"}
    assert states.folded([True, True, True]) == (True, 3, "paused") and states.folded([True] * 3 + [False] * 2) == (False, 2, "active")



def test_newest_time_is_kept_while_nothing_is_settled(spark, tmp_path):
    """Day -2 is older than the horizon before day 4, seen a batch earlier, and so is settled at once; day -3 comes after that."""
    day = lambda n: datetime(2024, 1, 10) + timedelta(days=n)
    batches = [[(1, 7, day(0), True), (2, 7, day(4), True)], [(3, 7, day(-2), True)], [(4, 7, day(-3), True)]]
    stream = batches_of(spark, str(tmp_path / "in"), batches, EVENT)
    states.source_states(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "source", "at", "id", F.col("bad"), "5 days").awaitTermination()
    got = {r["id"]: (r["run"], r["state"], r["late"]) for r in states.latest_states(spark, str(tmp_path / "out")).collect()}
    assert got == {3: (1, "active", False), 1: (2, "active", False), 2: (3, "paused", False), 4: (0, "active", True)}


LISTING = "id long, agency_id int, source_channel string, source_external_id string, address string, area_sqm double, price_rub double, contact_phone string, contact_email string"


def listings_of(rng, ids):
    for i in ids:
        yield (i, rng.choice([1, 2]), rng.choice("ab"), rng.choice([None, "", "x", "y", "z", "u"]), rng.choice([None, "Main 1", "main  1", "Hill 2", "Lane 3"]), rng.choice([None, 0.0, 50.0, 54.0, 60.0, 100.0]), rng.choice([None, 100000.0, 115000.0, 130000.0, 90000.0, 80000.0]), rng.choice([None, "79001112233", "89004445566"]), None)


def test_dedup_of_batches_equals_one_run(spark, tmp_path):
    """Listings that arrive in batches get the decisions of one run, and no batch reads keys that are not its own."""
    from hearthline.operators import dedup
    from hearthline.streaming import ingest

    rng = random.Random(9)
    rows = list(listings_of(rng, range(1, 161)))
    stream = batches_of(spark, str(tmp_path / "in"), [rows[:70], rows[70:75], rows[75:]], LISTING)
    ingest.dedup_stream(stream, str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    cols = ["id", "agency_id", "status", "duplicate_of_id", "fingerprint"]
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "t" / "decisions")).select(*cols).collect()}
    assert got == {tuple(r) for r in dedup.decisions(spark.createDataFrame(rows, LISTING)).select(*cols).collect()}
    assert {s for _, _, s, _, _ in got} == {"new", "duplicate", "possible_duplicate"}
    keys = spark.read.parquet(str(tmp_path / "t" / "keys"))
    assert keys.count() == keys.select("kind", "agency_id", "source_channel", "key", "area", "price").distinct().count()
    small = dedup.base_rows(spark.createDataFrame(rows[70:72], LISTING))
    asked = [r["bucket"] for r in dedup.asked_buckets(small, ingest.BUCKETS).collect()]
    read = ingest.stored_firsts(spark, str(tmp_path / "t"), "int", asked, 99).inputFiles()
    every = keys.inputFiles()
    assert 0 < len({f.split("bucket=")[1].split("/")[0] for f in read}) <= len(asked) <= 10 < len(every) / 3
    assert dedup.asked_of(ingest.stored_firsts(spark, str(tmp_path / "t"), "int", asked, 99), small).where("kind <> 'address'").count() == dedup.asked_of(keys, small).where("kind <> 'address'").count()


def test_bands_of_prices_are_asked(spark):
    """Every stored point within tolerance of a row lies in a folder that the row asks for."""
    from hearthline.operators import dedup

    rng = random.Random(4)
    pairs = [(p, p * f) for p in (rng.uniform(1, 1e7) for _ in range(300)) for f in (1 / 1.2, 1 / 0.8, rng.uniform(0.834, 1.249))]
    base = spark.createDataFrame([(k, 1, "a", None, "street", 5.0, p, None, e) for k, (p, e) in enumerate(pairs)], "id long, agency_id int, source_channel string, ext string, addr string, area double, price double, own string, e double")
    none = F.lit(None).cast("string")
    at = base.select(dedup.bucket(F.lit("address"), F.col("agency_id"), none, F.col("addr"), F.col("e"), 1 << 20).alias("b"), "id").collect()
    for r in at[:60]:
        asked = {x["bucket"] for x in dedup.asked_buckets(base.where(F.col("id") == r["id"]), 1 << 20).collect()} if r["id"] < 6 else None
        assert asked is None or r["b"] in asked
    band = base.select((dedup.price_band(F.col("e")) - dedup.price_band(F.col("price"))).alias("d")).distinct().collect()
    assert {r["d"] for r in band} <= {-1, 0, 1}


def test_compacted_upserts_read_the_same(spark, tmp_path):
    from hearthline.streaming import ingest

    schema, rng = "k int, t int, v string, w int", random.Random(6)
    rows = [(rng.randint(1, 9), t, rng.choice([None, "a", "b"]), rng.choice([None, 1, 2])) for t in range(60)] + [(99, 1, None, None)]
    stream = batches_of(spark, str(tmp_path / "in"), [rows[:30], rows[30:]], schema)
    ingest.upsert_stream(stream, str(tmp_path / "t"), str(tmp_path / "cp"), ["k"], ["v", "w"], ["t"]).awaitTermination()
    read = lambda table: sorted(map(tuple, ingest.current(spark, str(table), ["k"], ["v", "w"], ["t"]).collect()), key=str)
    want = read(tmp_path / "t")
    assert ingest.compact(spark, str(tmp_path / "t"), str(tmp_path / "u"), ["k"], ["v", "w"], ["t"]).count() <= 21 and read(tmp_path / "u") == want
