"""Operators on small tables: merging against an ordered fold, gates, recipes, pages, answers, streams."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import MERGE_NOISE
from gleaner.operators import merge, quality, recipes, responses, store
from gleaner.sources import json_shapes
from gleaner.sources.tables import read_listing_files, read_recipes


def _fold(rows):
    """Merging row by row in input order."""
    out = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        if r["key"] not in out:
            out[r["key"]] = dict(r)
            continue
        have = out[r["key"]]
        for c in ("title", "description", "price", "images"):
            old, new = have[c], r[c]
            if old in (None, "", []):
                have[c] = new
            elif new in (None, "", []):
                continue
            elif c == "images":
                have[c] = list(dict.fromkeys([*old, *new]))
            elif c == "title" and re.search(MERGE_NOISE.replace("(?i)", ""), old, re.I):
                have[c] = new
            elif c == "description" and len(new) > len(old):
                have[c] = new
    return out


@pytest.mark.parametrize("seed", range(3))
def test_merge_is_an_ordered_fold(spark, seed):
    rng = random.Random(seed)
    rows = [{
        "key": rng.choice("abcd"), "ord": i, "title": rng.choice([None, "", "Load more", "View next", "Elm", "Oak"]),
        "description": rng.choice([None, "", "x", "yy", "zz", "long one"]), "price": rng.choice([None, "", "1", "2"]),
        "images": rng.choice([None, [], ["a"], ["a", "a"], ["b", "c"]]),
    } for i in range(40)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "key string, ord long, title string, description string, price string, images array<string>").repartition(5)
    got = {r.key: r.asDict() for r in merge.merge_by_key(df, "key").collect()}
    for key, want in _fold(rows).items():
        for c in ("ord", "title", "description", "price", "images"):
            assert (got[key][c] or None) == (want[c] or None), (key, c)


def test_record_keys(spark):
    rows = [("", "https://a.example/x/", "1 Elm", "5", "{}"), (" 7 ", None, None, None, "{}"), (None, "https://a.example/x/?utm_source=q#t", None, None, "{}"), (None, None, None, None, '{"z":1}')]
    df = spark.createDataFrame(rows, "id string, url string, address string, price string, raw string")
    got = [r.k for r in df.select(merge.record_key(df.columns, F.col("raw")).alias("k")).collect()]
    assert got == ["1 elm|5", "7", "https://a.example/x", '{"z":1}']


def test_last_and_best_win(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 9), ("b", 4, 1)], "k string, ord long, v int").repartition(3)
    assert {(r.k, r.ord, r.v) for r in merge.last_wins(df, ["k"]).collect()} == {("a", 1, 9), ("b", 4, 1)}
    assert {(r.k, r.ord, r.v) for r in merge.best_wins(df, ["k"], "v").collect()} == {("a", 2, 9), ("b", 4, 1)}


def test_gates_name_what_is_missing(spark):
    full = ("Elm", "sale", 5.0, "GBP", "house", "d" * 40, "1 Elm", None, ["https://a.example/1.jpg"], "https://a.example/p")
    schema = "title string, purpose string, price double, currency string, typeOfProperty string, description string, address string, location string, images array<string>, sourceUrl string"
    names = ["title", "purpose", "price", "currency", "typeOfProperty", "description", "address", None, "images", "sourceUrl"]
    rows = [full] + [tuple(None if j == i else v for j, v in enumerate(full)) for i in range(10)]
    df = spark.createDataFrame(rows, schema).coalesce(1)
    got = [r.m for r in df.select(quality.missing_import_fields(df).alias("m")).collect()]
    assert got == [[]] + [[n] if n else [] for n in names]
    issues = [len(r.m) for r in df.select(quality.export_issues().alias("m")).collect()]
    assert issues == [0, 1, 0, 1, 1, 1, 1, 1, 0, 1, 1]
    assert quality.field_coverage(df.limit(0), ["title"]).first().percent == 0.0


def test_recover_and_sanitise(spark):
    df = spark.createDataFrame([(None, "unknown", None, "1 Elm", ["https://a.example/floorplan/1.jpg", "https://a.example/2.jpg"], None), ("Sold STC", "sale", "x", None, None, None)], "title string, purpose string, address string, location string, images array<string>, floorPlan array<string>").coalesce(1)
    one, two = quality.sanitise(df).collect()
    assert one.title == one.address == "1 Elm" and one.images == ["https://a.example/2.jpg"] and one.floorPlan == ["https://a.example/floorplan/1.jpg"]
    assert two.title == "x"
    got = quality.recover(df, {"title": F.lit("T"), "purpose": F.lit("sale")}).collect()
    assert got[0].recoveredFields == ["title"] and got[0].purpose == "unknown" and got[1].recoveredFields == []


def test_scope_report(spark):
    rows = [("a", "complete", True, 5), ("b", "complete", True, 5), ("b", "complete", False, 0), ("c", "failed", None, None), ("c", "complete", True, 3)]
    got = {r.run: r for r in quality.scope_report(spark.createDataFrame(rows, "run string, status string, complete boolean, expected int"), ["run"]).collect()}
    assert [got[k].status for k in "abc"] == ["complete", "incomplete", "partial"]
    assert [got[k].expected_listings for k in "abc"] == [5, None, None] and got["c"].expected_reported == 3


def test_recipes(spark):
    r = recipes.Recipe.parse("h", {"confidence": 0.9, "mappings": {"price": {"path": "a.p", "transform": "toNumber"}, "images": "pics", "title": {"path": "t", "value": "Fixed"}, "address": {"path": "ad", "transform": "joinAddress", "args": {"keys": ["x", "y"]}}, "nope": "q", "city": {"path": "c", "transform": "run"}, "purpose": {"path": "pp"}}})
    assert sorted(r.warnings) == ["unknown field nope", "unknown transform run for city"] and not r.fresh
    raw = json.dumps({"a": {"p": "£5"}, "pics": [{"url": "https://a.example/1.jpg"}, "https://a.example/1.jpg"], "ad": {"x": "1 Elm", "y": " York "}, "pp": "To Let"})
    rows = spark.createDataFrame([("h", raw), ("h", "{broken"), ("h", None), ("other", raw)], "host string, raw string").coalesce(1)
    mapped, blocked = recipes.apply_recipes(rows, [r])
    one, two, three = mapped.collect()
    assert (one.price, one.images, one.title, one.address, one.purpose, one.mapping_confidence) == (5.0, ["https://a.example/1.jpg"], "Fixed", "1 Elm, York", "rent", 0.6)
    assert two.price is None and three.images is None and blocked.count() == 1
    both = recipes.apply_recipes(rows, [r, recipes.Recipe.parse("other", {"version": 2, "confidence": 0.7, "mappings": {"city": {"value": "York"}, "price": {"path": "a.p", "transform": "toNumber"}}})])
    got = sorted((x.host, x.price, x.title, x.city, x.mapping_confidence) for x in both[0].where("price is not null").collect())
    assert got == [("h", 5.0, "Fixed", None, 0.6), ("other", 5.0, None, "York", 0.7)] and both[1].count() == 0
    assert recipes.apply_recipes(rows, [])[1].count() == 4 and recipes.apply_recipes(rows.selectExpr("cast(null as string) as host", "raw"), [r])[1].count() == 4


def test_json_shapes(spark):
    assert json_shapes.balanced('x = {"a": "}\\"{", "b": [1]} ; {') == '{"a": "}\\"{", "b": [1]}'
    assert json_shapes.balanced("{[") is None and json_shapes.balanced("none") is None
    score, path, rows = json_shapes.best_records({"a": {"items": [None, {"price": 1, "beds": 2, "id": 3}]}, "b": [{"price": 1}]})
    assert (score, path, len(rows)) == (3, "a.items", 1)
    raw = json.dumps({"agent_email": "a@b.example", "deep": {"x": ["call 01904 123456 or c@d.example"]}})
    out = spark.createDataFrame([(raw,), ("{",), (None,)], "x string").select(json_shapes.redact(F.col("x")).alias("y")).collect()
    assert "@" not in out[0].y and "01904" not in out[0].y and out[1].y is None and out[2].y is None


def test_model_answers(spark):
    answers = [("a", '```json\n{"data":{"title":" Elm ","price":"£1,250.50","currency":"gbp","purpose":"To Let","images":["u",""]},"confidence":2}\n```'), ("b", 'Sure: {"title":"Oak","currency":"pounds","confidence":-1} done'), ("c", "no idea")]
    records = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "record_key string")
    got = {r.record_key: r for r in responses.validate(records, spark.createDataFrame(answers, "record_key string, content string")).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a.title, a.price, a.currency, a.purpose, a.images, a.confidence, a.requires_review) == ("Elm", 1250.5, "GBP", "rent", ["u"], 1.0, False)
    assert (b.title, b.currency, b.confidence, b.warnings) == ("Oak", None, 0.0, ["invalid currency"])
    assert c.status == d.status == "failed" and c.requires_review


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, v int, t string")
    store.replace_slice(df, str(tmp_path / "t"), ["k"])
    store.replace_slice(spark.createDataFrame([("b", 9, "q")], df.schema), str(tmp_path / "t"), ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 1), ("a", 2), ("b", 9)}
    assert [r.v for r in store.page(df, ["v", "k"], 2, 2).collect()] == [2]
    jobs = spark.createDataFrame([("running", None), ("completed", None)], "status string, error string")
    assert [r.status for r in store.repair_interrupted(jobs).collect()] == ["failed", "completed"]
    assert df.where(store.matches(["t"], "X")).count() == 1 and df.where(store.matches(["t"], ".*")).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "x-listings.json").write_text('[{"b":1,"a":2},{"c":3}]')
    (tmp_path / "x-listings.report.json").write_text("{}")
    assert read_listing_files(spark, str(tmp_path)).count() == 2
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "h.example.json").write_text('{"version":2,"mappings":{"price":"p"}}')
    assert [(r.host, r.fresh) for r in read_recipes(spark, str(tmp_path / "r"))] == [("h.example", True)]


def test_even_sample(spark):
    df = spark.range(100).repartition(7)
    assert sorted(r.id for r in recipes.even_sample(df, ["id"]).collect()) == [0, 14, 28, 42, 57, 71, 85, 99]
    assert recipes.even_sample(df.limit(3), ["id"]).count() == 3
