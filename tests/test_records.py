"""Batches, paging, enrichment: against plain loops, and on odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import batch, collect, enrich


@pytest.mark.parametrize("seed", [1, 2])
def test_collected_pages_are_those_of_a_crawl(spark, seed):
    draw = random.Random(seed)
    rows = [(s, draw.choice([1, 2, 3, 4, 6]), i, draw.choice("abcdefgh") if draw.random() < 0.9 else None) for i, s in enumerate(draw.choices(["x", "y", "z", None], k=120))]
    rows += [("w", p, 1000 + p, f"k{min(p, 3)}") for p in (1, 2, 3, 4, 5)]
    got = {tuple(r) for r in collect.collect_pages(spark.createDataFrame(rows, "source string, page int, ord long, k string").repartition(3), F.col("k"), max_pages=4).select("source", "page", "ord", "k").collect()}
    want = set()
    for source in {r[0] for r in rows}:
        seen = set()
        for page in range(1, 5):
            new = []
            for r in sorted((r for r in rows if r[0] == source and r[1] == page), key=lambda r: r[2]):
                if r[3] not in seen:
                    seen.add(r[3])
                    new.append(r)
            if not new:
                break
            want |= set(new)
    assert got == want
    assert ("w", 4, 1004, "k3") not in got


def test_growth_and_key(spark):
    rows = spark.createDataFrame([("s", 1, 1, "u", "", "{}"), ("s", 1, 2, "", "t", "{}"), ("s", 2, 1, None, None, "{1}")], "source string, page int, ord int, url string, title string, raw string")
    assert [r["k"] for r in rows.select(collect.listing_key(rows.columns, F.col("raw")).alias("k")).collect()] == ["u", "t", "{1}"]
    assert [tuple(r)[1:] for r in collect.page_growth(rows).orderBy("page").collect()] == [(1, 2, 2), (2, 1, 3)]


def test_positions_are_dense_in_every_file(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), draw.randrange(50), i) for i in range(400)]
    got = batch.numbered(spark.createDataFrame(rows, "file string, o int, id int").repartition(5), ["file"], ["o", "id"]).collect()
    want = {}
    for f in ("a", "b", None):
        want |= {r[2]: i for i, r in enumerate(sorted((r for r in rows if r[0] == f), key=lambda r: r[1:]))}
    assert {r["id"]: r["position"] for r in got} == want
    assert batch.numbered(spark.createDataFrame([], "file string, o int"), ["file"], ["o"]).count() == 0


def test_a_file_of_another_length_is_left_alone(spark):
    listings = spark.createDataFrame([(f, i, None) for f, n in (("a", 3), ("b", 2), (None, 1)) for i in range(n)], "file string, position long, platform string")
    saved = spark.createDataFrame([("a", 0, "x"), ("a", 1, None), ("a", 2, "failed"), ("b", 0, "y"), ("b", 1, "y"), ("b", 2, "y"), (None, 0, "z")], "file string, position long, platform string")
    told = lambda **o: {(r["file"], r["position"]): r["platform"] for r in batch.resume(listings, saved, **o).collect()}
    assert told() == {("a", 0): "x", ("a", 1): None, ("a", 2): "failed", ("b", 0): None, ("b", 1): None, (None, 0): "z"}
    assert told(failed=F.col("platform") == "failed")[("a", 2)] is None


def test_budget_goes_by_file_and_position_and_is_written_back(spark):
    rows = spark.createDataFrame([(f, i, "old" if i == 1 else None) for f in ("b", "a", None) for i in range(3)], "file string, position long, platform string")
    picked = batch.select_budget(rows, batch.pending(F.col("platform")), 3)
    assert {(r["file"], r["position"]) for r in picked.where("selected").collect()} == {(None, 0), (None, 2), ("a", 0)}
    done = batch.write_back(picked, picked.where("selected").select("file", "position", F.when(F.col("file") == "a", "bad").otherwise(F.lit(None)).alias("platform")))
    assert {(r["file"], r["position"]): r["platform"] for r in done.collect()}[("a", 0)] == "bad"
    report = {r["file"]: tuple(r)[1:] for r in batch.batch_report(done, F.col("platform") == "bad").collect()}
    assert report == {None: (3, 2, 0, 2, 0), "a": (3, 1, 1, 0, 1), "b": (3, 0, 2, 0, 0)}


def test_source_url_and_output_file(spark):
    rows = spark.createDataFrame([("a", 0, "", "no url"), ("a", 1, None, "https://X.example/p?q"), ("a", 2, "https://site/", None), ("b", 0, None, None)], "file string, position int, sourceSiteUrl string, sourceUrl string")
    assert {r["file"]: r["source_url"] for r in batch.source_url_of(rows, "https://unknown.example").collect()} == {"a": "https://x.example", "b": "https://unknown.example"}
    assert batch.output_file("in/a-listings.json", "out/") == "out/a-listings.json" and batch.output_file("a", out_file="b") == "b"
    with pytest.raises(ValueError):
        batch.output_file("a", out_file="b", single=False)


def test_best_rows_of_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") % 7).alias("need"), "id")
    got = {(r["g"], r["id"]) for r in enrich.top_per_group(rows, ["g"], [F.desc("need"), F.asc("id")], 5).collect()}
    want = sorted(((i % 7, -i) for i in range(5000) if i % 10 < 9), reverse=True)[:5]
    assert {i for g, i in got if g == "hot"} == {-i for _, i in want} and len(got) == 505


LISTING = "listing_id long, source_url string, url string, title string, images array<string>, ord long"


def test_enrichment_takes_the_neediest_of_the_same_origin(spark):
    listings = spark.createDataFrame([
        (1, "https://a.example/s", "/p1", "View more items", None, 1), (2, "https://a.example/s", "https://A.example/p2", "Two", ["x"], 2), (3, "https://a.example/s", "https://b.example/p3", "Three", None, 3),
        (4, "https://a.example/s", "/p4", "Four", None, 4), (5, "https://a.example/s", None, "Five", None, 5), (6, None, "/p1", "Six", None, 6),
    ], LISTING)
    details = spark.createDataFrame([("https://a.example/p1", "One", ["y"], "text"), ("https://a.example/p2", "Zwei", ["y"], "text")], "detail_url string, title string, images array<string>, description string")
    need = F.when(F.size("images") > 0, 0).otherwise(5)
    got = {r["listing_id"]: (r["title"], r["images"], r["description"], r["enriched"]) for r in enrich.enrich(listings, details, need, 2).collect()}
    assert got == {1: ("One", ["y"], "text", True), 2: ("Two", ["x"], None, None), 3: ("Three", None, None, None), 4: ("Four", None, None, False), 5: ("Five", None, None, None), 6: ("Six", None, None, None)}
    report = enrich.enrichment_report(enrich.enrich(listings, details, need, 9)).where("source_url is not null").collect()
    assert [tuple(r) for r in report] == [("https://a.example/s", 3, 2)]  # a host's capitals make no difference


def test_pair_merge_is_the_merge_of_two_rows(spark):
    from gleaner.operators import merge

    from test_merge import SCHEMA, row

    draw = random.Random(8)
    text, some = lambda: draw.choice([None, "", "a", "bb", "Show more", "ccc"]), lambda: draw.choice([None, [], ["a"], ["b", "b"]])
    record = lambda k: {"id": k, "price": draw.choice([None, 1, 2]), "summaryTitle": text(), "images": some(), "notes": draw.choice([text, some])(), "contact": draw.choice([None, {"name": text(), "description": text(), "emails": some(), "office": draw.choice([None, {"phone": text(), "location": text(), "ways": draw.choice([text, some])()}])}])}
    old, new = (spark.createDataFrame([row(o, record(str(k))) for k in range(60)], SCHEMA) for o in (0, 1))
    want = {r["id"]: r for r in merge.merge_by_key(old.unionByName(new), "id").drop("ord").collect()}
    fields = [f for f in old.schema.fields if f.name not in ("id", "ord")]
    both = old.select("id", F.struct(*[f.name for f in fields]).alias("o")).join(new.select("id", F.struct(*[f.name for f in fields]).alias("n")), "id")
    got = both.select("id", *[merge.merged_pair(F.col("o")[f.name], F.col("n")[f.name], f.dataType, f.name).alias(f.name) for f in fields]).collect()

    def plain(v):
        if isinstance(v, dict):
            return {k: x for k, y in v.items() if (x := plain(y)) is not None} or None
        return v if v not in ("", []) else None

    assert all(plain(r.asDict(True)) == plain(want[r["id"]].asDict(True)) for r in got)


def test_older_enrichment_fills_what_is_false(spark):
    rows = spark.createDataFrame([(1, "", 0, "keep"), (2, "t", 5, None), (3, None, None, "x")], "id int, title string, beds int, note string")
    details = spark.createDataFrame([(1, "T", 2, ""), (2, "U", 9, "n")], "id int, title string, beds int, note string")
    assert [tuple(r) for r in enrich.fill_falsy(rows, details, "id").orderBy("id").collect()] == [(1, "T", 2, "keep"), (2, "t", 5, "n"), (3, None, None, "x")]


def test_sitemap_pages_become_records(spark):
    found = spark.createDataFrame([("s", f"u{i}", i) for i in range(6)] + [("t", "u1", 0)], "source_url string, url string, ord int")
    details = spark.createDataFrame([("u0", None, "a", None), ("u1", "https://x.example/p/", "b", None), ("u2", "https://x.example/p#f", "", "long"), ("u5", None, "z", None)], "page_url string, url string, title string, description string")
    rows, attempted = enrich.crawl_details(found, details, 4)
    assert {(r["source_url"], r["url"], r["title"], r["description"]) for r in rows.collect()} == {("s", "u0", "a", None), ("s", "https://x.example/p/", "b", "long"), ("t", "https://x.example/p/", "b", None)}
    assert {tuple(r) for r in attempted.collect()} == {("s", 4), ("t", 1)}


def test_page_data(spark):
    rows = spark.createDataFrame([("<a id=___gatsby>", "https://a.example/x/y?q"), ("gatsby", "https://a.example"), ("plain", "https://a.example/"), ("gatsby", "nope"), (None, None)], "h string, u string")
    assert [r[0] for r in rows.select(enrich.page_data_url(F.col("h"), F.col("u"))).collect()] == ["https://a.example/page-data/x/y/page-data.json", "https://a.example/page-data/page-data.json", None, None, None]
    bodies = spark.createDataFrame([('{"result":{"data":{"property":{"a":1}}}}',), ('{"result":{"data":{"strapiProperty":{"b":2},"property":{}}}}',), ("{",), (None,)], "b string")
    assert [r[0] for r in bodies.select(enrich.page_data_record(F.col("b"))).collect()] == ['{"a":1}', '{"b":2}', None, None]
