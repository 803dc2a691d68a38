"""Sitemaps followed from a site's root: robots lines, indexes of indexes, URL lists.

A site's crawl is a queue: robots lines first, then /sitemap.xml; a sitemap that is read appends what it
lists. Levels of a queue are levels of a breadth-first search, so all sites advance together, a join a
level, until no site has a sitemap left. Whatever a site's queue says of order is kept as a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from .work import written

#: Limits of a site's crawl: sitemaps asked for, URLs kept, characters of a file.
MAX_SITEMAPS, MAX_URLS, MAX_CHARACTERS = 20, 10_000, 8_000_000
_LOC = r"(?is)<loc\b[^>]*>\s*(?:<!\[CDATA\[.*?\]\]>|[^<]+?)\s*</loc>"


def locations(xml: Column) -> Column:
    """The text of every <loc> in order, CDATA or not, its five entities decoded; empty ones are left out."""
    inner = lambda m: F.regexp_replace(m, r"(?is)^<loc\b[^>]*>\s*(?:<!\[CDATA\[)?|(?:\]\]>)?\s*</loc>$", "")
    out = F.transform(F.regexp_extract_all(xml, F.lit(_LOC), F.lit(0)), inner)

    def decoded(u: Column) -> Column:
        for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
            u = F.regexp_replace(u, f"(?i){entity}", sign)
        return F.trim(u)

    return F.filter(F.transform(out, decoded), lambda u: u != "")


def robots_sitemaps(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)[ \t]*\r?$"), F.lit(1))


def _entries(files: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, sitemap, at, loc, nested): what every sitemap lists, of the same origin as its site."""
    readable = F.col("body").rlike(r"(?i)<(?:urlset|sitemapindex)\b") & (F.length("body") <= MAX_CHARACTERS)
    index = F.col("body").rlike(r"(?i)<sitemapindex\b")
    rows = files.where(readable).select(F.col("url").alias("sitemap"), index.alias("index"), F.posexplode(locations(F.col("body"))).alias("at", "loc"))
    rows = rows.withColumn("origin", urls.origin(F.col("sitemap"))).join(sites, "origin").withColumn("loc", urls.absolute(F.col("loc"), F.col("site")))
    rows = rows.where(urls.same_origin(F.col("loc"), F.col("site")))
    nested = F.col("index") | urls.path(F.col("loc")).rlike(r"(?i)(?:sitemap|_sitemap)\.xml(?:\.gz)?$")
    return rows.select("site", "sitemap", "at", "loc", nested.alias("nested"))


def crawl(files: DataFrame, sites: DataFrame, max_sitemaps: int = MAX_SITEMAPS, max_urls: int = MAX_URLS) -> DataFrame:
    """(site, ord, loc) of the URLs that the sitemaps of each site lead to, each once, in order.

    ``files`` has (url, body) of robots.txt and sitemaps, each URL once; ``sites`` has the distinct ``site``,
    each its own origin's root URL. A site asks for ``max_sitemaps`` at most, found or not, each once, whatever
    circles they lead in, and for none once it has ``max_urls``. Links to other origins are left out.
    """
    sites = sites.select("site").distinct().withColumn("origin", urls.origin(F.col("site")))
    files = files.withColumn("url", urls.absolute(F.col("url"), F.lit(None).cast("string")))
    entries = written(_entries(files, sites), "sitemap-entries")
    robots = sites.join(files.where(urls.path(F.col("url")) == "/robots.txt").select(urls.origin(F.col("url")).alias("origin"), robots_sitemaps(F.col("body")).alias("found")), "origin", "left")
    queue = F.concat(F.coalesce("found", F.array().cast("array<string>")), F.array(F.concat("origin", F.lit("/sitemap.xml"))))
    level = robots.select("site", F.posexplode(queue).alias("at", "loc")).withColumn("sitemap", urls.absolute(F.col("loc"), F.col("site")))
    level = level.where(urls.same_origin(F.col("sitemap"), F.col("site"))).select("site", "sitemap", F.lit(0).cast("long").alias("parent"), "at")
    seen = None
    while True:
        firsts = level.groupBy("site", "sitemap").agg(F.min(F.struct("parent", "at")).alias("place"))
        if seen is not None:
            firsts = firsts.join(seen.select("site", "sitemap"), ["site", "sitemap"], "left_anti").join(seen.groupBy("site").agg(F.count(F.lit(1)).alias("n")), "site", "left")
        else:
            firsts = firsts.withColumn("n", F.lit(0).cast("long"))
        turn = F.row_number().over(Window.partitionBy("site").orderBy("place")) + F.coalesce("n", F.lit(0))
        new = firsts.withColumn("turn", turn.cast("long")).where(F.col("turn") <= max_sitemaps).select("site", "sitemap", "turn")
        new = written(new, "sitemap-level")
        done, seen = new.isEmpty(), new if seen is None else seen
        if done:
            break
        seen = new if new is seen else written(seen.unionByName(new), "sitemaps-seen")  # max_sitemaps rows a site at most
        level = entries.where("nested").join(new, ["site", "sitemap"]).select("site", F.col("loc").alias("sitemap"), F.col("turn").alias("parent"), "at")
    listed = entries.where("not nested").join(seen, ["site", "sitemap"])
    # A crawl stops at max_urls, repeats counted; then each URL stays once.
    before = Window.partitionBy("site").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    sizes = listed.groupBy("site", "sitemap", "turn").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("site", "sitemap").orderBy("at")) - 1
    listed = listed.withColumn("ord", within).join(sizes.select("site", "sitemap", "base"), ["site", "sitemap"]).withColumn("ord", (F.col("ord") + F.col("base")).cast("long"))
    return listed.where(F.col("ord") < max_urls).groupBy("site", "loc").agg(F.min("ord").alias("ord")).select("site", "ord", "loc")


def discovery_summary(found: DataFrame) -> DataFrame:
    """(site, urls, scopes, details): what a crawl found, by kind."""
    scope, detail = urls.is_scope(F.col("loc")), urls.is_detail(F.col("loc"))
    return found.groupBy("site").agg(F.count(F.lit(1)).alias("urls"), F.count_if(scope).alias("scopes"), F.count_if(detail).alias("details"))
