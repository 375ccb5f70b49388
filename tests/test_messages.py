"""Which messages and channels are relevant, switch by switch."""

from pyspark.sql import functions as F

from hearthline.sources import listings as S


def passes(spark, text, filters=None, context=None):
    frame = spark.createDataFrame([(text, context)], "t string, c string")
    return frame.select(S.message_passes(F.col("t"), filters, None if context is None else F.col("c")).alias("y")).first().y


def test_packs_and_switches(spark):
    full = "Сдам ОФИС 20 м2 в Ижевске, аренда"
    assert passes(spark, full) and not passes(spark, full + " в жилой части") and not passes(spark, None)
    assert not passes(spark, "Офис в Ижевске") and passes(spark, "Офис в Ижевске", {"require_transaction": False})  # no deal is named
    assert not passes(spark, "warehouse for rent, izhevsk") and passes(spark, "warehouse for rent, izhevsk", {"require_estate": False})
    assert not passes(spark, "Сдам гараж, Ижевск") and passes(spark, "Сдам гараж, Ижевск", {"commercial_only": False}) and not passes(spark, "ипотека, Ижевск", {"commercial_only": False})
    assert not passes(spark, "Сдам офис") and passes(spark, "Сдам офис", {"region_only": False}) and passes(spark, "Сдам офис", context="Новости Удмуртии") and not passes(spark, "Сдам офис в Ижевске", context="Казань")
    assert passes(spark, "hall for hire", {"commercial": [" HALL "], "estate": ["hall"], "transaction": ["hire"], "region_only": False, "exclude": []}) and not passes(spark, "квартира: офис, аренда", {"exclude": [" "], "region_only": False})


def test_channels(spark):
    rows = spark.createDataFrame([(1, "izh_office", "Коммерческая недвижимость", ""), (2, "office", "недвижимость", "склад ижевск"), (3, "office", "недвижимость", "склад"), (4, "warehouse", "Izhevsk", ""), (5, "flats", "квартиры, недвижимость, Ижевск", ""), (6, None, None, None)], "id int, u string, t string, q string")
    kept = lambda **f: [r.id for r in rows.where(S.channel_passes(F.col("u"), F.col("t"), F.col("q"), f)).orderBy("id").collect()]
    assert kept() == [2] and kept(region_only=False) == [1, 2, 3] and kept(require_estate=False, commercial_only=False) == [2, 4]
