"""Sitemap crawls against the queue that they stand for; locations."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from gleaner.sources import sitemaps


def test_locations(spark):
    xml = "<urlset><loc> https://a.example/x?a=1&amp;b=2 </loc><LOC lang='x'>\n<![CDATA[ https://a.example/<y> ]]></LOC><loc></loc><loc>q&lt;&gt;&quot;&#39;</loc>"
    rows = spark.createDataFrame([(xml,), (None,), ("",)], "x string")
    assert [r[0] for r in rows.select(sitemaps.locations(F.col("x"))).collect()] == [["https://a.example/x?a=1&b=2", "https://a.example/<y>", "q<>\"'"], None, []]
    robots = spark.createDataFrame([("User-agent: *\r\n sitemap : https://a.example/1.xml \r\nSitemap: two words\nSITEMAP:/2.xml",)], "x string")
    assert robots.select(sitemaps.robots_sitemaps(F.col("x"))).first()[0] == ["https://a.example/1.xml", "/2.xml"]


def queue(site, files, most, cap):
    """The crawl of one site, one sitemap at a time. ``files``: path to (index, entries)."""
    todo, seen, found = deque([*files.get("/robots.txt", []), "/sitemap.xml"]), [], []
    while todo and len(seen) < most and len(found) < cap:
        at = todo.popleft()
        if at in seen:
            continue
        seen.append(at)
        index, entries = files.get(at, (False, []))
        for e in entries:
            if index or e.endswith("sitemap.xml"):
                todo.append(e)
            else:
                found.append(e)
                if len(found) >= cap:
                    break
    return [site + u[1:] for u in dict.fromkeys(found)]


@pytest.mark.parametrize(("seed", "most", "cap"), [(1, 20, 10_000), (2, 4, 7), (3, 3, 25)])
def test_crawl_is_the_queue(spark, seed, most, cap):
    draw = random.Random(seed)
    sites, rows, want = {}, [], {}
    for s in range(6):
        site, names = f"https://s{s}.example/", ["/sitemap.xml", *[f"/m{i}.xml" for i in range(5)], "/deep-sitemap.xml"]
        files = {"/robots.txt": draw.sample(names, 2)} if s % 2 else {}
        for n in names[:draw.randrange(1, 8)]:
            index = draw.random() < 0.5
            files[n] = (index, [draw.choice(names if index else [*[f"/p/{i}" for i in range(12)], "/deep-sitemap.xml"]) for _ in range(draw.randrange(8))])
        sites[site] = files
        want[site] = queue(site, files, most, cap)
        for n, x in files.items():
            if n == "/robots.txt":
                body = "".join(f"Sitemap: {u}\n" for u in x) + "Sitemap: https://elsewhere.example/x.xml\n"
            else:
                body = f"<{'sitemapindex' if x[0] else 'urlset'}>" + "".join(f"<loc>{draw.choice([site[:-1], ''])}{u}</loc>" for u in x[1]) + "<loc>https://elsewhere.example/y</loc>"
            rows.append((site[:-1] + n, body))
    rows.append(("https://s0.example/other.txt", "not a sitemap"))
    found = sitemaps.crawl(spark.createDataFrame(rows, "url string, body string").repartition(3), spark.createDataFrame([(s,) for s in sites], "site string"), most, cap)
    got = {s: [] for s in sites}
    for r in sorted(found.collect(), key=lambda r: r["ord"]):
        got[r["site"]].append(r["loc"])
    assert got == want
    counts = {r["site"]: r["urls"] for r in sitemaps.discovery_summary(found).collect()}
    assert counts == {s: len(u) for s, u in want.items() if u}


def test_no_files_and_no_sites(spark):
    files, sites = spark.createDataFrame([], "url string, body string"), spark.createDataFrame([("https://a.example/",)], "site string")
    assert sitemaps.crawl(files, sites).count() == 0 == sitemaps.crawl(files, sites.limit(0)).count()
