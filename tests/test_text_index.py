"""The index finds what a scan finds and reads less."""

import os
import random

import pytest
from pyspark.sql import functions as F

from hearthline.operators import reports, text_index
from hearthline.operators.incremental import bucket_of


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(5)
    words = ["Hall", "склад", "ОФИС", "park", "50% off", "a_b", "Straße", "ab", "x", "hallway", "warehouse 12"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), rng.choice([None, "Main 1", "Hill_2", "back\\slash"]), rng.choice([None, "Izh", "Ижевск"])) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, title string, normalized_address string, city string")
    path = str(tmp_path_factory.mktemp("index"))
    text_index.build(frame, path)
    return frame, path


@pytest.mark.parametrize("text", ["hall", " HALL ", "склад", "оФис", "ль", "ab", "a_b", "50% off", "p%rk", "nothing here", "Straße", "hill_2", "all%12", "x", "", "ижев", "back\\slash", "h_llway"])
def test_same_rows_as_a_scan(spark, indexed, text):
    frame, path = indexed
    every = reports.search(frame, text, published_only=False) if text.strip() else frame
    try:
        want = sorted(r["id"] for r in every.collect())
    except Exception:  # a pattern that LIKE refuses is refused here too
        with pytest.raises(Exception):
            text_index.search(spark, path, text).collect()
        return
    assert sorted(r["id"] for r in text_index.search(spark, path, text).collect()) == want or not text.strip()


def test_a_rare_word_reads_few_folders(spark, indexed, tmp_path):
    frame, path = indexed
    rare = frame.unionByName(spark.createDataFrame([(9999, "unheard zyxwvut", None, None)], frame.schema))
    text_index.build(rare, str(tmp_path / "i"))
    got = text_index.search(spark, str(tmp_path / "i"), "zyxwv")
    assert [r["id"] for r in got.collect()] == [9999]
    read = {f.split("bucket=")[1].split("/")[0] for f in got.inputFiles() if "/rows/" in f}
    assert read == {str(spark.range(9999, 10000).select(bucket_of(["id"], text_index.BUCKETS).alias("b")).first()["b"])} and len(os.listdir(tmp_path / "i" / "rows")) > 100
    assert spark.range(1).select(text_index.grams_of(F.lit("AbCd")).alias("g")).first()["g"] == ["abc", "bcd"]


def test_a_shared_text_has_its_grams_once(spark, tmp_path):
    """The same text in 300 rows, in other letters too, is one text of the index, and a search still finds each of its rows."""
    rows = [(i, "Warehouse Twelve" if i % 2 else "WAREHOUSE twelve", None, None) for i in range(300)] + [(900, "office", None, "warehouse")]
    text_index.build(spark.createDataFrame(rows, "id long, title string, normalized_address string, city string"), str(tmp_path / "i"), buckets=4)
    assert sorted(r["id"] for r in text_index.search(spark, str(tmp_path / "i"), "use twel", buckets=4).collect()) == list(range(300))
    assert spark.read.parquet(str(tmp_path / "i" / "grams")).count() == 14 + 4 + 7
