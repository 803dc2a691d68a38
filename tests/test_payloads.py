"""Captured payloads: scores, arrays, groups, model inputs."""

import json

from pyspark.sql import functions as F

from gleaner.sources import payloads as p

LISTING = {"id": 1, "price": 5, "beds": 2, "address": "x", "title": "t"}
ROWS = [
    ("https://a/x", "GET", 200, "xhr", ")]}',\n" + json.dumps({"data": {"items": [LISTING, {"id": 2}]}}), 1), ("https://a/x", "GET", 200, "fetch", json.dumps([{"id": 1}]), 2), ("https://a/y", "GET", 404, "xhr", json.dumps([LISTING]), 3),
    ("https://a/z?listings", "POST", 200, "document", json.dumps([LISTING]), 0), ("https://a/w", "GET", 200, "xhr", "{broken", 4), ("https://a/v", "GET", 200, "xhr", None, 5), ("https://a/u/listings", "GET", 200, "xhr", json.dumps({"id": 1, "price": 2}), 6),
]
SCHEMA = "url string, method string, status int, resource_type string, body string, ord int"


def test_page_discovery_and_match(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert [(r.url, r.path, r.n) for r in p.page_payloads(rows).collect()] == [("https://a/x", "data.items", 2)]
    ranked = [(r.url, r.score, r["first"]) for r in p.rank_endpoints(rows).collect()]
    assert ranked == [("https://a/z?listings", 5, 0), ("https://a/x", 5, 1), ("https://a/u/listings", 2, 6)]
    assert [r.ord for r in p.matching(rows, "listings").collect()] == [0, 6]
    assert p.rank_endpoints(rows.limit(0)).count() == 0


def walk(node, wanted):
    """The rule, on plain values."""
    if isinstance(node, list):
        first = next((x for x in node if isinstance(x, dict)), None)
        return node if first is not None and all(k in first for k in wanted) else None
    if isinstance(node, dict):
        order = sorted((k for k in node if k.isdigit() and (k == "0" or k[0] != "0")), key=int) + [k for k in node if not (k.isdigit() and (k == "0" or k[0] != "0"))]
        return next((y for k in order if (y := walk(node[k], wanted)) is not None), None)
    return None


def test_first_array_with_all_keys(spark):
    bodies = [
        {"z": [{"a": 1}], "b": {"c": [{"a": 1, "k": 2}], "d": [{"a": 1, "k": 3}]}, "y": [{"k": 1, "a": 1}]}, [{"k": 1, "a": None}], [[{"a": 1, "k": 1}]], {"10": [{"a": 1, "k": 10}], "9": [{"a": 1, "k": 9}], "x": 1, "09": [{"a": 1, "k": 0}]},
        {"s": '[{"a":1,"k":1}]'}, {"e": [], "n": [None, 5, {"a": {"q": [1]}, "k": "t"}]}, {}, [], 5, "text", None, {"a.b": {"k'\"": [{"a": 1, "k": 1}]}}, {"p": {"q": {"r": {"s": {"t": [{"a": 2, "k": 2}]}}}}},
    ]
    rows = [(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(90, "{broken"), (91, None), (92, ""), (93, ")]}',\n" + json.dumps(bodies[1]))]
    out = {r["id"]: r for r in p.array_with_keys(spark.createDataFrame(rows, "id int, body string").repartition(3), "id", ["a", "k"]).collect()}
    want = {i: y for i, b in enumerate(bodies) if (y := walk(b, ["a", "k"])) is not None} | {93: bodies[1]}
    assert {i: [None if x is None else json.loads(x) for x in r["items"]] for i, r in out.items()} == want
    assert out[0]["path"] == "b.c" and out[1]["path"] == "(root array)" and out[3]["path"] == "9" and out[5]["n"] == 3
    deep = p.arrays_in(spark.createDataFrame(rows, "id int, body string"), "id", depth=2).where("id = 12")
    assert deep.count() == 0


def test_best_group_of_batches(spark):
    batches = [("p", 0, 4, [{"id": 1, "price": 1}, {"id": 2}]), ("p", 1, 6, [{"x": 1}]), ("p", 2, 6, [{"price": 9, "id": 2}, {"id": 3}]), ("p", 3, 5, [{"id": 1, "q": 1}] * 9), ("q", 0, 1, [{"u": 1}, {"u": 2}]), ("q", 1, 1, [{"v": 1}, {"v": 1}]), (None, 7, 3, [{"id": 5}])]
    rows = [(page, c, i, s, json.dumps(r)) for page, c, s, rs in batches for i, r in enumerate(rs)]
    out = p.schema_groups(spark.createDataFrame(rows, "page string, candidate int, ord int, score int, raw string").repartition(4)).collect()
    assert {(r.page, r.signature, r.score, r.n, r.candidate, r.ord) for r in out} == {("p", "id|price", 6, 3, 0, 0), ("p", "id|price", 6, 3, 0, 1), ("p", "id|price", 6, 3, 2, 1), ("q", "u", 1, 2, 0, 0), ("q", "u", 1, 2, 0, 1), (None, "id", 3, 1, 7, 0)}


def test_model_input_on_both_sides_of_the_limit(spark):
    texts = ["a" * 11_000, "a" * 12_000]
    rows = spark.createDataFrame([(i, json.dumps({"description": t, "more": [t, t, t], "email": "a@b.example"})) for i, t in enumerate(texts)] + [(2, None)], "id int, raw string")
    out = {r["id"]: json.loads(r["x"]) for r in rows.select("id", p.model_input(F.to_json(F.struct("id")), F.col("raw")).alias("x")).collect()}
    assert set(out[0]) == {"currentNormalized", "sourceRecord"} and set(out[0]["sourceRecord"]) == {"description", "more"}
    assert out[1]["sourceRecord"] == {"description": "a" * 8000} and "truncated" in out[1]["warning"]
    assert out[2] == {"currentNormalized": {"id": 2}, "sourceRecord": {}}


def test_prompt_record(spark):
    rows = spark.createDataFrame([(json.dumps({"long": 'x"' * 1500, "n": 1.5, "none": None, "deep": {"long": "y" * 2500, "phone": "1"}, "_rankingInfo": {"a": 1}, "platform": {}, 'k"e': "v"}),), ("[1]",), (None,), ("{",)], "raw string")
    out = [r[0] and json.loads(r[0]) for r in rows.select(p.prompt_record(F.col("raw"))).collect()]
    assert out[0] == {"deep": {"long": "y" * 2500}, 'k"e': "v", "long": ('x"' * 1000) + "…", "n": 1.5, "none": None} and out[1:] == [None, None, None]
