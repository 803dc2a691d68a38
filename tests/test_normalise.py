"""Canonical listings and platform rows: rows written by hand from the rules."""

import json

from gleaner.operators.normalise import normalise_dom, normalise_records, platform_rows

SITE = "https://www.site.co.uk/to-rent/"


def _frame(spark, records):
    rows = [(i, None if r is None else r if isinstance(r, str) else json.dumps(r), SITE, "x") for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "n int, raw string, site_url string, other string")


def test_canonical_fields(spark):
    records = [
        {"id": "", "listing_id": 7, "display-address": "1 Elm", "price": None, "deep": {"price": "£1,250 pcm", "Postal Code": "YO1 7HH"}, "images": [{"url": "/a.jpg"}, "b.jpg", {"x": {"src": "/a.jpg"}}], "url": ""},
        {"slug": "elm", "objectID": 9, "department": "Lettings", "agent": {"name": "Ann Lee", "email": "ANN@site.example", "phone": "01904 123456"}},
        {"nested": {"url": "/not-mine"}, "_documentBaseUrl": "https://cdn.example/base/"},
        "{broken", None, "[]", "5",
    ]
    out = {r.n: r for r in normalise_records(_frame(spark, records)).collect()}
    assert (out[0].id, out[0].title, out[0].price, out[0].postcode) == ("7", "1 Elm", "£1,250 pcm", "YO1 7HH")
    assert out[0].images == ["https://www.site.co.uk/a.jpg", "https://www.site.co.uk/to-rent/b.jpg"] and out[0].sourceUrl is None
    assert out[1].sourceUrl == "https://www.site.co.uk/property-to-rent/elm/9" and out[1].id == "elm"
    assert (out[1].agentName, out[1].agentEmail, out[1].agentPhone, out[1].agentContact) == ("Ann Lee", "ANN@site.example", "01904 123456", "ANN@site.example")
    assert out[2].sourceUrl is None  # a link further down is not the record's own
    for n in (3, 4, 5, 6):
        assert out[n].id is None and out[n].title is None and out[n].contact.emails == [] and out[n].other == "x"


def test_records_from_elements(spark):
    records = [{"title": "", "name": "Elm", "price": 0, "numberOfBedrooms": 2, "url": "x/1", "images": ["/a.png", ""]}, {}, None]
    out = {r.n: r for r in normalise_dom(_frame(spark, records)).collect()}
    assert (out[0].title, out[0].price, out[0].bedrooms, out[0].sourceUrl) == ("Elm", None, "2", "https://www.site.co.uk/to-rent/x/1")
    assert out[0].images == ["https://www.site.co.uk/a.png"]
    assert out[1].title is out[2].title is None


def test_platform_fields(spark):
    records = [
        {"title": " Elm ", "address": {"town": "York", "postcode": "YO1", "city": "York"}, "price": "£900", "rentFrequency": "PCM", "receptions": "2 rooms", "features": [" a ", "", 3, "b"], "floorplans": [{"url": "f.png"}, {"url": "f.png"}]},
        {"price": "POA"}, None,
    ]
    rows = platform_rows(normalise_records(_frame(spark, records)), keys=("n",))
    out = {r.n: r for r in rows.collect()}
    assert (out[0].title, out[0].address, out[0].price, out[0].PCM, out[0].PCW, out[0].livingRoom) == ("Elm", "York, YO1", 900.0, 900.0, None, 2.0)
    assert out[0].purpose == "rent" and out[0].currency == "GBP" and out[0].floorPlan == ["f.png"] and out[0].landmark is None
    assert out[0].add_features == ["a", "b"] and out[0].salesPlatform == "site.co.uk" and out[0].isSold is False
    assert out[1].price is None and out[1].currency == "GBP"
    assert out[2]._source.siteUrl == SITE and out[2]._source.contact.names == []
    assert len(rows.columns) == 1 + 27 + 6 + 1


def test_texts_are_not_taken_for_json_and_numbers_are_written_plainly(spark):
    records = [
        {"title": "true love cottage", "id": 12.0, "sqft": 1200.50, "images": ["../a.jpg", "HTTPS://CDN.example:443/x/../b c.jpg", "//cdn.example/d.jpg"], "features": [" a ", "", 3, "b", True]},
        {"title": "null", "address": [{"town": ""}, {"town": "York"}], "price": 250000.0, "features": "one", "longDescription": True},
        {"title": "[2024] Elm", "amount": "\u20ac5", "city": {"name": "x"}, "type": ["", " flat "]},
        {"title": "true", "price": {"amount": 7}, "beds": "3 beds", "listingType": 5, "postcode": 1e-7, "gallery": [{"srcUrl": "/s.jpg"}, {"url": {"src": "n.jpg"}}]},
        {"purpose": False, "channel": "Sales", "country": " uk", "bathrooms": 2.0, "floorPlan": {"srcUrl": "f.png"}},
    ]
    out = {r.n: r for r in platform_rows(normalise_records(_frame(spark, records), keep_record=True), keys=("n", "id", "sqft", "sourceUrl")).collect()}
    assert [out[n].title for n in range(5)] == ["true love cottage", "null", "[2024] Elm", "true", None]
    assert (out[0].id, out[0].sqft, out[0].size) == ("12", "1200.5", "1200.5") and out[0].add_features == ["a", "b"]
    assert out[0].images == ["https://www.site.co.uk/a.jpg", "https://cdn.example/b%20c.jpg", "https://cdn.example/d.jpg"]
    assert (out[1].address, out[1].location, out[1].price, out[1].add_features, out[1].description) == ("York", "York", 250000.0, None, None)
    assert (out[2].currency, out[2].city, out[2].typeOfProperty, out[2].price) == ("EUR", None, "flat", None)
    assert (out[3].price, out[3].bedrooms, out[3].purpose, out[3].floorPlan) == (None, 3.0, "unknown", None)
    assert out[3].images == ["https://www.site.co.uk/s.jpg", "https://www.site.co.uk/to-rent/n.jpg"]
    assert (out[4].purpose, out[4].bathrooms, out[4].floorPlan) == ("rent", 2.0, ["f.png"])
    assert out[3]._source.postcode == "1e-7"


def test_a_column_named_like_a_field_is_replaced_and_others_stay(spark):
    rows = spark.createDataFrame([(json.dumps({"status": "sold"}), SITE, "mine", "old", "kept")], "raw string, site_url string, _entries string, status string, _record2 string")
    out = normalise_records(rows).first()
    assert (out.status, out._entries, out._record2) == ("sold", "mine", "kept")
