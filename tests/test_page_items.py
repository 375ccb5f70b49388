"""Pages to canonical listings, contacts included."""

from hearthline.sources import listings as S

OFFICE = """<html><head><title>T</title><meta name="description" content="Офис в аренду, собственник 8 900 111-22-33"></head><body><h1>Офис 20 м2</h1>
<script type="application/ld+json">{"name": "Офис", "price": 5, "address": {"addressLocality": "Ижевск", "streetAddress": "ул. Ленина 1"}, "tel": "8 900 555-66-77"}</script>
<p>Цена 15 000 руб. Ленинский район</p><footer>help@site.ru</footer></body></html>"""


def test_page_items(spark):
    pages = [(1, "https://site.ru/rent/12345", OFFICE), (2, "https://site.ru/x", "<h1>Офис в Казани</h1><p>адрес: Казань, Баумана 1</p>"), (3, "https://site.ru/y", "<title>Склад в Ижевске</title><p>продажа, mail owner@own.er</p>"), (4, "https://site.ru/z", None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in S.page_items(frame, "Ижевск", "RU-UDM").collect()}
    assert sorted(got) == [1, 3]
    r = got[1]
    assert (r.title, r.listing_type, r.normalized_address, r.price_rub, r.area_sqm, r.source_external_id, r.city, r.region_code) == ("Офис 20 м2", "rent", "Ижевск, ул. Ленина 1", 15000.0, 20.0, "12345", "Ижевск", "RU-UDM")
    assert r.address_district == "Ленинский" and r.address_street.startswith("ул. Ленина 1") and r.contact_email is None
    values = {(c.normalized, c.contact_class) for c in r.contact_candidates}
    assert ("+79001112233", "owner_candidate") in values and "+79005556677" in {v for v, _ in values} and r.contact_phone == "+79001112233" and r.contact_name == "Собственник"
    assert "support_context" in r.contact_rejection_reasons or "email_prefix_blocked" in r.contact_rejection_reasons
    assert {c.normalized for c in r.rejected_contacts} == {"help@site.ru"}
    assert (got[3].contact_email, got[3].contact_phone, got[3].listing_type) == ("owner@own.er", None, None)
    assert {r.page_id for r in S.page_items(frame).collect()} == {1, 2, 3, 4}
