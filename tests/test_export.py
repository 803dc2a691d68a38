"""Reports, bundles, downloads and saved slices."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import export
from gleaner.sources.work import work_path


def parts_of(spark, path):
    return sorted(r["f"] for r in spark.read.text(path).select(F.input_file_name().alias("f")).distinct().collect())


def test_joined_files_are_one_json_array(spark):
    rows = spark.range(997).select((996 - F.col("id")).alias("n"), F.when(F.col("id") % 3 == 0, F.lit('q"\n')).alias("t"), F.array(F.lit(None).cast("string")).alias("a.b")).repartition(5)
    path = work_path(spark, "array")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert export.write_json_array(rows, path, ["n"]) == 997
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text = "".join(open(f.removeprefix("file://").removeprefix("file:"), encoding="utf-8").read() for f in parts_of(spark, path))
    got = json.loads(text)
    assert [r["n"] for r in got] == list(range(997)) and got[996] == {"n": 996, "t": 'q"\n', "a.b": [None]} and got[1]["t"] is None
    assert text.startswith("[\n{") and text.endswith("}\n]\n") and len(parts_of(spark, path)) > 1
    one = work_path(spark, "array")
    export.write_json_array(rows.where("n = 5"), one, ["n"])
    assert json.loads("".join(r.value for r in spark.read.text(one).collect()))[0]["n"] == 5
    with pytest.raises(ValueError):
        export.write_json_array(rows.limit(0), work_path(spark, "array"), ["n"])


def slice_of(spark, path, **slice_):
    rows = spark.read.parquet(path)
    for k, v in slice_.items():
        rows = rows.where(F.col(k) == v)
    return [(r["position"], r["v"]) for r in rows.orderBy("position").collect()]


def test_a_slice_is_replaced_whole_or_not_at_all(spark):
    path = work_path(spark, "slices")
    rows = lambda *vs: spark.createDataFrame([(v, i) for i, v in enumerate(vs)], "v string, o int").repartition(3)
    one, two = {"job": "j1", "result": 0, "kind": "raw"}, {"job": "j1", "result": 0, "kind": "mapped"}
    assert export.save_records(rows(*"abcde"), path, one, ["o"]) == 5
    assert export.save_records(rows(*"xy"), path, two, ["o"]) == 2
    assert slice_of(spark, path, kind="raw") == [*enumerate("abcde")]
    assert export.save_records(rows(*"fg"), path, one, ["o"]) == 2
    assert slice_of(spark, path, kind="raw") == [*enumerate("fg")] and slice_of(spark, path, kind="mapped") == [*enumerate("xy")]
    broken = rows(*"hij").withColumn("v", F.when(F.col("o") == 2, F.raise_error(F.lit("disk"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="disk"):
        export.save_records(broken, path, one, ["o"])
    assert slice_of(spark, path, kind="raw") == [*enumerate("fg")]
    assert export.save_records(rows(), path, one, ["o"]) == 0
    assert slice_of(spark, path, kind="raw") == [] and slice_of(spark, path, kind="mapped") == [*enumerate("xy")]


def test_a_write_that_fails_half_way_leaves_the_old_slice(spark, monkeypatch):
    from gleaner.operators import batch

    path, one = work_path(spark, "slices"), {"job": "j", "result": 1, "kind": "raw"}
    export.save_records(spark.createDataFrame([("a", 0)], "v string, o int"), path, one, ["o"])
    monkeypatch.setattr(export, "numbered", lambda *a: batch.numbered(*a).withColumn("v", F.when(F.col("position") > 3, F.raise_error(F.lit("lost"))).otherwise(F.col("v"))))
    with pytest.raises(Exception, match="lost"):
        export.save_records(spark.range(50).select(F.col("id").cast("string").alias("v"), F.col("id").alias("o")), path, one, ["o"])
    assert slice_of(spark, path) == [(0, "a")]


def test_a_bundle_is_seen_whole_or_not_at_all(spark):
    path = work_path(spark, "bundle")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "source string, n int")
    export.write_bundle(spark, path, {"by-source": rows, "combined": rows.select("n")}, {"by-source": "source"})
    assert {tuple(r) for r in export.read_bundle(spark, path, "by-source").select("source", "n").collect()} == {("a", 1), ("b", 2)}
    with pytest.raises(Exception, match="half"):
        export.write_bundle(spark, path, {"by-source": rows.limit(1), "combined": rows.select(F.when(F.col("n") == 2, F.raise_error(F.lit("half"))).otherwise(F.col("n")).alias("n"))})
    assert export.read_bundle(spark, path, "by-source").count() == 2 and export.read_bundle(spark, path, "combined").count() == 2
    export.write_bundle(spark, path, {"combined": rows.select("n").limit(0)})
    assert export.read_bundle(spark, path, "combined").count() == 0


RECORD = "run string, title string, images array<string>, contact struct<emails: array<string>, phones: array<string>>, platform struct<images: array<string>, ready: boolean, review: boolean>, _source struct<title: string>"


def test_run_report(spark):
    records = spark.createDataFrame([
        ("a", "x", ["1"], (["e"], None), (["1", "2"], True, False), ("",)), ("a", None, None, None, None, None), ("a", "", [], ([], ["p"]), ([], False, True), ("s",)),
        ("b", "x", ["1", "2", "3"], None, None, None), ("b", "y", None, None, None, None),
    ], RECORD)
    scopes = spark.createDataFrame([("a", "complete", True, 5), ("c", "failed", None, None), ("c", "complete", False, 0)], "run string, status string, complete boolean, expected int")
    out = {r["run"]: r for r in export.run_report(records, scopes, ["run"], ["title"]).collect()}
    a, b, c = out["a"], out["b"], out["c"]
    assert (a.status, a.expected_listings, a.unique_listings, a.with_any_contact, a.with_email, a.with_phone) == ("complete", 5, 3, 2, 1, 1)
    assert [tuple(x) for x in a.field_coverage] == [("title", 1, 33.3)]  # the record's source stands for it, an empty text too
    assert (a.needs_review, a.import_ready, a.blocked_from_import, a.with_images, a.without_images, a.total_images, a.average_images) == (1, 1, 1, 1, 1, 2, 1.0)
    assert (b.status, b.blocked_from_import, b.with_images, b.without_images, b.total_images, b.average_images) == (None, None, 1, 1, 3, 1.5)
    assert (c.status, c.unique_listings, c.scopes_failed, c.scopes_incomplete, [tuple(x) for x in c.field_coverage], c.average_images) == ("partial", 0, 1, 1, [("title", 0, 0.0)], 0.0)
    assert export.report_path("out/x-listings.json") == "out/x-listings.report.json" and export.report_path("x") == "x.report.json"


def test_contacts_of_a_source_come_in_order_and_once(spark):
    rows = spark.createDataFrame([("s", 2, (["B", "A"], ["e"], None)), ("s", 1, (["A", " "], [], None)), (None, 1, (None, ["f"], ["1"])), ("t", 1, None)], "source string, position int, contact struct<names: array<string>, emails: array<string>, phones: array<string>>")
    got = {r["source"]: (r["names"], r["emails"], r["phones"]) for r in export.contacts_by(rows, "source").collect()}
    assert got == {"s": (["A", " ", "B"], ["e"], []), None: ([], ["f"], ["1"]), "t": ([], [], [])}


def test_platform_rows_alone(spark):
    rows = spark.createDataFrame([(1, ("t", 2.0)), (2, None)], "n int, platform struct<title: string, price: double>")
    assert {tuple(r) for r in export.platform_only(rows).collect()} == {("t", 2.0), (None, None)}


def test_payload_has_all_fields(spark):
    out = export.import_payload(spark.createDataFrame([("t", 5, "x")], "title string, price int, extra string"))
    assert len(out.columns) == 33 and out.first().title == "t" and out.first().price == 5.0 and out.first().isSold is None and "extra" not in out.columns
