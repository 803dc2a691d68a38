"""Recovery of mapped rows, job projections, search endpoints."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from gleaner.functions import urls
from gleaner.operators import jobs, recovery
from gleaner.operators.normalise import normalise_records

PLATFORM = "platform struct<title: string, purpose: string, price: double, images: array<string>, status: string, confidence: double, model: string, unmapped: array<string>, warnings: array<string>>"


def test_recovery_fills_cleans_and_gates(spark):
    raw = {"title": "Elm", "address": "1 Elm Road", "price": "£5", "type": "house", "description": "<p>Long text</p>", "images": ["/a.jpg", "/floor-plan/b.jpg"], "url": "/p/1", "purpose": "Sale"}
    rows = [
        (1, json.dumps(raw), ("", "rent", 0.0, [], "normalized", 0.9, "m", ["x"], None)), (2, json.dumps(raw), ("Sold", None, None, None, "failed", 0.95, None, None, ["w"])), (3, json.dumps(raw), None), (4, None, ("T", "unknown", None, None, "normalized", 1.0, None, None, None)),
    ]
    df = normalise_records(spark.createDataFrame([(i, r, "https://www.a.co.uk/", p) for i, r, p in rows], f"n int, raw string, site_url string, {PLATFORM}"))
    out = {r.n: r for r in recovery.recover_platform(df, keys=["n"]).collect()}
    one, two, three, four = (out[i]._normalization for i in (1, 2, 3, 4))
    assert (out[1].title, out[1].purpose, out[1].price, out[1].description, out[1].images, out[1].floorPlan) == ("Elm", "rent", 0.0, "Long text", ["https://www.a.co.uk/a.jpg"], ["https://www.a.co.uk/floor-plan/b.jpg"])
    assert set(one.recoveredFields) == {"title", "location", "address", "typeOfProperty", "description", "currency", "images", "amount"} and one.unmappedFields == ["x"] and one.warnings == []
    assert (one.publishReady, one.requiresReview, one.criticalMissing, one.imageCount) == (True, False, [], 1) and "landmark" in one.missingFields and "title" not in one.missingFields
    assert out[2].title == "1 Elm Road" and (two.publishReady, two.requiresReview) == (False, True) and two.warnings == ["w"]  # a status is no title
    assert (three.status, three.confidence, three.requiresReview) == ("missing", 0.0, True) and out[3].purpose == "sale"
    assert four.criticalMissing == ["purpose", "price", "typeOfProperty", "description", "address", "images", "sourceUrl"] and four.qualityIssues[0] == "Missing import-required field: purpose" and out[4].currency == "GBP"
    assert len(recovery.recover_platform(df).columns) == 27 + 6 + 2


def test_urls_of_a_job():
    assert jobs.job_urls([" https://a.example/x ", "https://a.example/x", None, "HTTP://b.example"]) == ["https://a.example/x", "HTTP://b.example"]
    assert jobs.job_urls("https://a.example") == ["https://a.example"]
    for bad in ([], [""], None, ["ftp://a.example"], ["x"], ["https://"], [f"https://a.example/{i}" for i in range(11)]):
        with pytest.raises(ValueError):
            jobs.job_urls(bad)


def test_jobs_as_they_are_shown(spark):
    result = "array<struct<url: string, count: int, files: string, contactCoverage: struct<withEmail: int, withPhone: int>>>"
    rows = spark.createDataFrame([("a", "running", ["u", "v"], [("u", 3, "f", (1, None)), ("v", None, "f", None)]), ("b", "failed", [], None)], f"id string, status string, urls array<string>, results {result}")
    assert [r.id for r in jobs.active_jobs(rows).collect()] == ["a"]
    shown = {r.id: r for r in jobs.public_jobs(rows).collect()}
    assert shown["a"].total == 2 and "files" not in shown["a"].results[0].asDict() and shown["b"].results is None
    assert sorted(map(tuple, jobs.job_totals(rows).collect())) == [("a", 3, 1, 0), ("b", 0, 0, 0)]


def test_values_as_they_are_shown(spark):
    rows = spark.createDataFrame([("1,250.5", None), ("POA", "GBP"), ("", None), (None, "EUR"), ("99", "eur"), ("7", "NGN"), ("1.2.3", None)], "p string, c string")
    assert [r[0] for r in rows.select(jobs.shown_price(F.col("p"), F.col("c"))).collect()] == ["£1,251", "POA", "Not stated", "Not stated", "€99", "NGN\u00a07", "1.2.3"]
    contact = spark.createDataFrame([(" ", ["b"], ["c"]), ("a", None, None), (None, [], ["c"]), (None, None, None)], "a string, b array<string>, c array<string>")
    assert [r[0] for r in contact.select(jobs.shown_contact(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["b", "a", "c", None]
    assert jobs.stamp(datetime(2024, 1, 2, 3, 4, 5, tzinfo=UTC)) == "20240102030405" and len(jobs.stamp()) == 14
    times = spark.sql("SELECT timestamp'2024-01-02 03:04:05.678' AS a, timestamp'2024-01-02 03:06:05' AS b")
    assert tuple(times.select(jobs.iso(F.col("a")), jobs.elapsed_minutes(F.col("a"), F.col("b")), jobs.elapsed_minutes(F.col("a"), F.col("a"))).first()) == ("2024-01-02T03:04:05.678Z", 1, 1)


def test_search_endpoint_and_cursor(spark):
    rows = spark.createDataFrame([("https://a.example/properties/lettings/york/page-3/?page=2&beds=2&channel=x",), ("https://a.example",), ("nope",), (None,)], "u string")
    assert [r[0] for r in rows.select(urls.search_endpoint(F.col("u"), F.lit(4))).collect()] == ["https://a.example/search.ljson?beds=2&channel=lettings&fragment=york%2Fpage-4", "https://a.example/search.ljson?channel=sales&fragment=page-4", None, None]
    bodies = spark.createDataFrame([(")]}',\n" + '{"properties":[],"pagination":{"current_page":"2","has_next_page":true,"total_count":9}}',), ('{"properties":[1],"pagination":{"current_page":1}}',), ('{"properties":{},"pagination":{"current_page":1}}',), ("{",), (None,)], "b string")
    assert [r[0] and tuple(r[0]) for r in bodies.select(urls.search_cursor(F.col("b"))).collect()] == [(2, True, 9), (1, False, None), None, None, None]
