"""Queries that take raw records to canonical listings and platform rows; parts stand in for listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.normalise import normalise_dom, normalise_records, platform_rows
from ..sources.tables import table
from .queries import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]

_SITE = "https://www.homes.co.uk/lettings/"


def _raw_parts(spark, d):
    """Each part as the JSON record of a site: some fields at its top, some a level down."""
    extra = F.struct(F.col("p_type").alias("property_type"), F.col("p_size").alias("floor-area"), F.array(F.col("p_brand"), F.lit(" "), F.col("p_brand")).alias("photos"))
    frequency = F.when(F.col("p_size") > 25, "pcm").otherwise("per week")
    raw = F.struct(
        F.lit("").alias("id"), F.col("p_partkey").alias("listing_id"), extra.alias("extra"), F.col("p_name").alias("displayAddress"),
        F.col("p_retailprice").alias("askingPrice"), F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("detail_url"), frequency.alias("rentFrequency"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Agent"), F.col("p_partkey").cast("string"), F.lit("@Homes.example"))).alias("branch_email"),
    )
    return table(spark, d, "part").select("p_partkey", F.to_json(raw).alias("raw"), F.lit(_SITE).alias("site_url"))


@query("""
SELECT p_partkey, p_partkey::VARCHAR AS id, p_name AS title, p_name AS address, p_type AS "propertyType", p_size::VARCHAR AS sqft, p_retailprice AS price,
 'https://www.homes.co.uk/p/' || p_partkey AS "sourceUrl", 'https://www.homes.co.uk/lettings/' || p_brand AS images, 'https://www.homes.co.uk/lettings/' AS "sourceSiteUrl",
 CASE WHEN p_partkey % 3 = 0 THEN 'agent' || p_partkey || '@homes.example' END AS contact_email FROM part""")
def normalised_listings(spark, d):
    rows = normalise_records(_raw_parts(spark, d))
    return rows.select(
        "p_partkey", "id", "title", "address", "propertyType", "sqft", F.col("price").cast("double").alias("price"), "sourceUrl",
        F.array_join("images", ",").alias("images"), "sourceSiteUrl", F.get("contact.emails", F.lit(0)).alias("contact_email"),
    )


@query("""
SELECT p_partkey, p_name AS title, p_name AS location, 'rent' AS purpose, p_retailprice AS price, p_retailprice AS amount, p_type AS "typeOfProperty", p_size::VARCHAR AS size, 'GBP' AS currency,
 CASE WHEN p_size > 25 THEN p_retailprice END AS "PCM", CASE WHEN p_size <= 25 THEN p_retailprice END AS "PCW", 'homes.co.uk' AS "salesPlatform", p_partkey::VARCHAR AS source_id, NULL::VARCHAR AS landmark FROM part""")
def platform_derivation(spark, d):
    rows = platform_rows(normalise_records(_raw_parts(spark, d), keep_record=True), keys=("p_partkey",))
    return rows.select("p_partkey", "title", "location", "purpose", "price", "amount", "typeOfProperty", "size", "currency", "PCM", "PCW", "salesPlatform", F.col("_source.id").alias("source_id"), "landmark")


@query("""
SELECT s_suppkey, s_name AS title, CASE WHEN s_acctbal <> 0 THEN s_acctbal END AS price, 'Nation ' || s_nationkey AS city, 'https://site.example/s/' || s_suppkey AS "sourceUrl" FROM supplier""")
def dom_listings(spark, d):
    record = F.struct(F.lit("").alias("title"), F.col("s_name").alias("headline"), F.col("s_acctbal").alias("price"), F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("addressLocality"), F.concat(F.lit("s/"), F.col("s_suppkey").cast("string")).alias("url"))
    rows = table(spark, d, "supplier").select("s_suppkey", F.to_json(record).alias("raw"), F.lit("https://site.example/").alias("site_url"))
    return normalise_dom(rows).select("s_suppkey", "title", F.col("price").cast("double").alias("price"), "city", "sourceUrl")


@query("""
WITH e AS (SELECT event_id, event_id % 6 AS k, value, event_type FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'true love ' || event_id WHEN 1 THEN 'null' WHEN 2 THEN '[' || event_id || '] Elm' WHEN 3 THEN event_id::VARCHAR WHEN 4 THEN 'York, YO' || event_id % 9 END AS title,
 CASE WHEN k = 4 THEN 'York, YO' || event_id % 9 WHEN k = 5 THEN event_type END AS address, CASE WHEN k = 2 THEN value END AS bedrooms, CASE WHEN k IN (0, 3) THEN event_id * 10.0 END AS price,
 CASE k WHEN 1 THEN 'EUR' WHEN 0 THEN 'USD' ELSE 'GBP' END AS currency, CASE WHEN k = 3 THEN 'a,' || event_type END AS features,
 CASE k WHEN 0 THEN 'https://www.homes.co.uk/' || event_id || '.jpg' WHEN 1 THEN 'https://cdn.example/a/' || event_id || '%20x.jpg' WHEN 2 THEN 'https://www.homes.co.uk/lettings/n/' || event_id END AS images FROM e""")
def odd_listings(spark, d):
    """Events as records of odd shapes: texts that look like JSON, numbers in place of texts, arrays with all kinds
    of values, address objects in an array, links that climb up folders."""
    k, n = F.col("event_id") % 6, F.col("event_id").cast("string")
    when = lambda i, c: F.when(k == i, c)
    quoted = lambda c: F.to_json(F.struct(c.alias("x"))).substr(6, 10_000)  # a value and the closing brace
    value = lambda c: F.regexp_replace(quoted(c), r"\}$", "")
    pair = lambda key, c: F.concat(F.lit(f'"{key}":'), c)
    raw = F.concat(F.lit("{"), F.concat_ws(
        ",",
        when(0, F.concat_ws(",", pair("title", value(F.concat(F.lit("true love "), n))), pair("images", F.concat(F.lit('["../'), n, F.lit('.jpg"]'))), pair("price", value(F.concat(F.lit("$"), n, F.lit("0")))))),
        when(1, F.concat_ws(",", pair("name", F.lit('"null"')), pair("amount", F.lit('"&euro;5"')), pair("photo", F.concat(F.lit('{"src":"HTTPS://CDN.example:443/x/../a/'), n, F.lit(' x.jpg"}'))))),
        when(2, F.concat_ws(",", pair("headline", F.concat(F.lit('"['), n, F.lit('] Elm"'))), pair("beds", F.col("value").cast("string")), pair("media", F.concat(F.lit('[{"url":{"href":"./n/'), n, F.lit('"}},null,3]'))))),
        when(3, F.concat_ws(",", pair("title", F.concat(n, F.lit(".0"))), pair("features", F.concat(F.lit('[" a ","",3,true,'), value(F.col("event_type")), F.lit("]"))), pair("askingPrice", F.concat(n, F.lit("0.00"))))),
        when(4, F.concat_ws(",", pair("title", F.lit("true")), pair("address", F.concat(F.lit('[{"town":" "},{"town":"York","postcode":"YO'), (F.col("event_id") % 9).cast("string"), F.lit('"}]'))))),
        when(5, F.concat_ws(",", pair("title", F.lit("[]")), pair("street", value(F.col("event_type"))), pair("features", F.lit('"none"')))),
    ), F.lit("}"))
    rows = table(spark, d, "events").select("event_id", raw.alias("raw"), F.lit(_SITE).alias("site_url"))
    out = platform_rows(normalise_records(rows, keep_record=True), keys=("event_id",))
    title = F.when(F.col("event_id") % 6 == 5, F.nullif("title", "address")).otherwise(F.col("title"))  # an address stands in for a title
    return out.select("event_id", title.alias("title"), "address", "bedrooms", "price", "currency", F.array_join("add_features", ",").alias("features"), F.array_join("images", ",").alias("images"))
