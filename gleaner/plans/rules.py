"""Queries of single rules over the driver's tables: usability, keys, pictures, transforms, readiness, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import merge, quality, recipes
from ..sources import json_shapes
from ..sources.tables import retryable, table
from . import pages  # noqa: F401
from .queries import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN false ELSE p_partkey % 5 <> 0 OR p_partkey % 3 <> 0 END AS usable FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 2 = 0 OR p_partkey % 11 <> 0""")
def usable_listings(spark, d):
    """Parts as listings: some named like a control of a page, some without a price, of these some with pictures but
    no detail; those that have neither title nor address are left out."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").where("p_partkey % 7 = 0 or p_partkey % 2 = 0 or p_partkey % 11 <> 0").select(
        k, F.when(k % 7 == 0, "View more items").when(k % 2 == 0, F.col("p_name")).otherwise(" ").alias("title"), F.when(k % 2 == 1, F.col("p_type")).alias("address"), F.when(k % 5 != 0, F.col("p_retailprice").cast("string")).otherwise(" ").alias("price"),
        F.when(k % 3 != 0, F.array(F.lit("u"))).alias("images"), F.lit("").alias("description"), F.when(k % 2 == 0, F.col("p_size").cast("string")).alias("bedrooms"), F.when(k % 2 == 1, F.col("p_type")).alias("propertyType"),
    )
    return rows.select("p_partkey", quality.is_usable(rows).alias("usable"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN lower(p_name) || '|' || p_size WHEN 2 THEN 'https://a.example/P/' || p_partkey || '?b=1' WHEN 3 THEN '{"id":" ","listing_id":null,"price":null,"title":""}' ELSE '|' || p_size END AS key FROM part""")
def record_keys(spark, d):
    """Keys of parts as records: an id, an empty id that stops the search, a URL with what only tracks, nothing at all."""
    k, n = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    url = F.concat(F.lit("HTTPS://A.example/P/"), n, F.lit("?utm_source=x&b=1#top"))
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(k == 0, n).alias("listing_id"), F.when(k == 2, url).when(k.isin(1, 3), " ").alias("id"), F.when(k == 1, F.concat(F.lit(" "), "p_name")).when(k == 3, "").alias("title"), F.when(k.isin(1, 4), F.col("p_size")).alias("price"),
    )
    raw = F.to_json(F.struct("id", "listing_id", "price", "title"), {"ignoreNullFields": "false"})
    return rows.select("p_partkey", merge.record_key(rows.columns, raw).alias("key"))


@query("""
SELECT page_id, 'https://x.example/' || page_id || '.jpg?size=800x600,https://x.example/b.jpg' AS images, 'https://x.example/1.jpg|https://x.example/2.jpg' AS breakpoints, '/a.jpg|/b.jpg' AS plain, page_id % 3 <> 0 AS picture FROM pages""")
def image_rules(spark, d):
    """Pictures of pages: the largest variant of each, marks and drawings left out; sets of both forms; which are pictures."""
    n = F.col("page_id").cast("string")
    x = lambda tail: F.concat(F.lit("https://x.example/"), n, F.lit(tail))
    found = F.array(x(".jpg?size=80x60"), F.lit("https://x.example/logo/a.png"), F.lit("https://x.example/b.jpg?w"), x(".jpg?size=800x600"), F.lit("https://x.example/b.jpg"), x(".svg"), x(".jpg"))
    kind = F.when(F.col("page_id") % 3 != 0, x("/photo.jpg")).when(F.col("page_id") % 2 == 0, x("/favicon.ico")).otherwise("data:image/png;base64,x")
    return table(spark, d, "pages").select(
        "page_id", F.array_join(urls.clean_images(found), ",").alias("images"), F.array_join(urls.srcset(F.lit(">768:https://x.example/1.jpg , >1200:https://x.example/2.jpg 2x")), "|").alias("breakpoints"),
        F.array_join(urls.srcset(F.lit(" /a.jpg 1x, /b.jpg 2x ,")), "|").alias("plain"), urls.is_image(kind).alias("picture"),
    )


@query("""
SELECT p_partkey, p_name || chr(10) || 'size ' || p_size || ' & more' AS description, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, p_brand || ', ' || p_type AS address, p_name AS landmark,
 'https://x.example/' || p_partkey AS images, 'GBP' AS currency, CASE WHEN p_size % 2 = 0 THEN 'short-let' ELSE 'sale' END AS purpose FROM part""")
def recipe_transforms(spark, d):
    """The recipe's transforms over parts as records."""
    k = F.col("p_partkey").cast("string")
    raw = F.to_json(F.struct(
        F.concat(F.lit("<p>"), "p_name", F.lit("<br>size "), F.col("p_size").cast("string"), F.lit("</p> &amp; more")).alias("html"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("a"), F.lit(" ").alias("b"), F.col("p_type").alias("c")).alias("place"),
        F.array("p_name", "p_type").alias("names"), F.struct(F.concat(F.lit("https://x.example/"), k).alias("u"), F.array(F.concat(F.lit("https://x.example/"), k)).alias("v")).alias("pics"), F.lit("&pound;5 pcm").alias("cost"),
        F.when(F.col("p_size") % 2 == 0, " Short").otherwise("for SALE").alias("kind"),
    ))
    told = lambda path, transform, **args: {"path": path, "transform": transform, "args": args}
    recipe = recipes.Recipe.parse("parts", {"version": 2, "mappings": {
        "description": told("html", "stripHtml"), "title": told("name", "titleCase"), "address": told("place", "joinAddress", keys=["a", "b", "c"]), "landmark": told("names", "firstElement"),
        "images": told("pics", "extractUrls"), "currency": told("cost", "currencyFromSymbol"), "purpose": told("kind", "purposeMap", short="short-let"),
    }})
    rows = recipes.apply_recipe(table(spark, d, "part").select("p_partkey", raw.alias("raw")), recipe)
    return rows.select("p_partkey", "description", "title", "address", "landmark", F.array_join("images", ",").alias("images"), "currency", "purpose")


@query("""
SELECT source, count(*) FILTER (WHERE quality = 0 OR n_chars < 500) AS needs_review, count(*) FILTER (WHERE n_chars >= 500) AS import_ready, count(*) FILTER (WHERE n_chars < 500) AS blocked_from_import FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""")
def readiness_by_source(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rows = rows.withColumn("missing", F.when(F.col("n_chars") < 500, F.array(F.lit("description"))).otherwise(F.array().cast("array<string>")))
    return rows.groupBy("source").agg(*quality.readiness("missing", F.coalesce(F.col("quality") == 0, F.lit(False)) | (F.col("n_chars") < 500)))


@query("SELECT user_id, count(*) FILTER (WHERE (400 + event_id % 105) IN (408, 425, 429, 500, 502, 503, 504)) AS again, count(*) AS n FROM events GROUP BY user_id")
def retry_rule(spark, d):
    status = (400 + F.col("event_id") % 105).cast("int")
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(retryable(status)).alias("again"), F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT user_id, event_id, event_id % 4 AS score, event_id % 3 AS n, event_type AS path FROM events)
SELECT user_id, score, n, path FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, n DESC, length(path), path, event_id) = 1""")
def candidate_ranks(spark, d):
    """Events as candidate sets of users: the best by score, size, length of path."""
    rows = table(spark, d, "events").select("user_id", (F.col("event_id") % 4).alias("score"), (F.col("event_id") % 3).alias("n"), F.col("event_type").alias("path"), F.lit(0).alias("ord"))
    return json_shapes.rank_sets(rows, ["user_id"]).select("user_id", "score", "n", "path")
