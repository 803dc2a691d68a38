"""The engine's queries over the driver's tables, each with its DuckDB form.

No driver table holds listings, so every operator runs over the table of like shape: documents are
free-text listings, pages are sites, orders are runs, events are saved batches and JSON records.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import listing, numbers, text, urls
from ..operators import merge, quality, recipes, store
from ..sources import json_shapes
from ..sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Patterns that both engines read alike.
_EMAIL = r"(?i)([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})"
_PHONE = r"((?:\+\s?\d{1,3}[\s().-]*)?(?:\d[\s().-]*){7,15})"
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _x(url: str, i: int) -> str:
    return f"regexp_extract({url}, '{_URL}', {i})"


_ORIGIN = f"lower({_x('url', 1)} || '://' || {_x('url', 2)})"
_CANON = f"regexp_replace({_ORIGIN} || CASE WHEN {_x('url', 3)} = '' THEN '/' ELSE {_x('url', 3)} END || {_x('url', 4)}, '/$', '')"
_PARTS = f"list_filter(string_split({_x('url', 4)}[2:], '&'), lambda p: p <> '' AND NOT list_contains({urls.TRACKING_KEYS}, lower(string_split(p, '=')[1])))"
_DEDUPE = f"regexp_replace({_ORIGIN} || CASE WHEN {_x('url', 3)} = '' THEN '/' ELSE {_x('url', 3)} END || CASE WHEN len({_PARTS}) > 0 THEN '?' || array_to_string({_PARTS}, '&') ELSE '' END, '/$', '')"
_TITLE = r"regexp_extract(html, '<title>([^<]*)</title>', 1)"
_PHONE_OK = f"length(regexp_replace(regexp_extract(text, '{_PHONE}', 1), '\\D', '', 'g')) BETWEEN 7 AND 15"


def _title():
    return F.regexp_extract("html", "<title>([^<]*)</title>", 1)


@query("""
WITH j AS (SELECT c_nationkey AS source, o_totalprice, o_orderstatus, o_orderdate, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
last AS (SELECT source, o_orderstatus, o_totalprice, o_orderdate FROM j QUALIFY row_number() OVER (PARTITION BY source ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT source, count(*) AS runs, round(sum(j.o_totalprice), 2) AS total, any_value(last.o_orderstatus) AS latest_status, any_value(last.o_totalprice) AS latest_count, any_value(last.o_orderdate) AS last_run_at
FROM j JOIN last USING (source) GROUP BY source""")
def source_rollup_latest(spark, d):
    runs = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_nationkey", "source")
    out = store.roll_up(runs, ["source"], ["o_orderdate", "o_orderkey"], {"latest_status": "o_orderstatus", "latest_count": "o_totalprice", "last_run_at": "o_orderdate"}, {"total": "o_totalprice"})
    return out.withColumn("total", F.round("total", 2))


@query(f"""
SELECT (SELECT count(*) FROM orders) AS total_runs, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS completed_runs, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS failed_runs,
 (SELECT count(*) FROM documents) AS saved_records, (SELECT count(*) FROM labels) AS mapped_records, (SELECT count(*) FROM documents WHERE regexp_matches(text, '{_EMAIL}')) AS with_email,
 (SELECT count(*) FROM documents WHERE {_PHONE_OK}) AS with_phone, (SELECT count(DISTINCT source) FROM documents) AS source_count""")
def dashboard_counts(spark, d):
    docs = table(spark, d, "documents").agg(
        F.count(F.lit(1)).alias("saved_records"), F.count_if(listing.clean_email(F.col("text")).isNotNull()).alias("with_email"),
        F.count_if(listing.clean_phone(F.col("text")).isNotNull()).alias("with_phone"), F.count_distinct("source").alias("source_count"),
    )
    runs = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("total_runs"), F.count_if(F.col("o_orderstatus") == "F").alias("completed_runs"), F.count_if(F.col("o_orderstatus") == "P").alias("failed_runs"))
    mapped = table(spark, d, "labels").agg(F.count(F.lit(1)).alias("mapped_records"))
    return runs.crossJoin(docs).crossJoin(mapped)  # one row each


@query(f"""
SELECT source AS url, count(*) AS records, max(doc_id) AS last_saved, count(*) FILTER (WHERE regexp_matches(text, '{_EMAIL}')) AS with_email, count(*) FILTER (WHERE {_PHONE_OK}) AS with_phone FROM documents GROUP BY source""")
def property_sources(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("url")).agg(
        F.count(F.lit(1)).alias("records"), F.max("doc_id").alias("last_saved"),
        F.count_if(listing.clean_email(F.col("text")).isNotNull()).alias("with_email"), F.count_if(listing.clean_phone(F.col("text")).isNotNull()).alias("with_phone"),
    )


@query("""
SELECT doc_id, source, lang, n_chars FROM documents WHERE lang = 'en' AND (contains(lower(text), 'license') OR contains(lower(source), 'license')) ORDER BY doc_id DESC LIMIT 10 OFFSET 10""")
def property_page(spark, d):
    docs = table(spark, d, "documents").where(F.col("lang") == "en").where(store.matches(["text", "source"], "License"))
    return store.page(docs.select("doc_id", "source", "lang", "n_chars"), [F.desc("doc_id")], 2, 10)


@query("SELECT o_orderkey, o_orderstatus, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def recent_jobs(spark, d):
    return store.page(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"), [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1")
def point_lookup(spark, d):
    return table(spark, d, "lineitem").where("l_orderkey = 7 and l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


@query("""
WITH b AS (SELECT event_type, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, user_id DESC) = 1)
SELECT event_id, event_type, user_id, value FROM events JOIN b USING (event_type, user_id)""")
def latest_batch_per_source(spark, d):
    return store.latest_batch(table(spark, d, "events"), "event_type", "user_id", "ts").select("event_id", "event_type", "user_id", "value")


@query(f"""
WITH r AS (SELECT d.doc_id, text AS description, lang, nullif(regexp_extract(text, '{_EMAIL}', 1), '') AS email, CASE WHEN {_PHONE_OK} THEN 'x' END AS phone, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
n AS (SELECT count(*) AS n FROM r)
SELECT field, c AS count, round(c * 100 / n, 1) AS percent FROM n, (
 SELECT 'id' AS field, count(doc_id) AS c FROM r UNION ALL SELECT 'description', count(*) FILTER (WHERE description <> '') FROM r UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang <> '') FROM r
 UNION ALL SELECT 'email', count(email) FROM r UNION ALL SELECT 'phone', count(phone) FROM r UNION ALL SELECT 'quality', count(quality) FROM r)""")
def field_coverage(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = rows.select(F.col("doc_id").alias("id"), F.col("text").alias("description"), "lang", listing.clean_email(F.col("text")).alias("email"), listing.clean_phone(F.col("text")).alias("phone"), "quality")
    return quality.field_coverage(rows, ["id", "description", "lang", "email", "phone", "quality"])


@query("""
WITH p AS (SELECT len(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS n FROM pages)
SELECT count(*) FILTER (WHERE n > 0) AS with_links, count(*) FILTER (WHERE n = 0) AS without_links, sum(n)::BIGINT AS total_links, round(avg(n), 1) AS average_links FROM p""")
def media_coverage(spark, d):
    links = table(spark, d, "pages").select(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)).alias("links"))
    return quality.array_coverage(links, {"links": "links"})


def _platform(spark, d):
    """Documents and labels as platform rows."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.select(
        "doc_id", "source", F.element_at(F.split("text", "\n"), 1).alias("title"), F.when(F.col("toxic") == 1, "unknown").when(F.col("toxic") == 0, "sale").alias("purpose"),
        F.when(F.col("n_chars") > 500, F.col("n_chars").cast("double")).otherwise(0.0).alias("price"), F.when(F.col("lang").isin("en", "de"), "EUR").alias("currency"),
        F.when(F.col("quality") == 1, "RealEstateListing").otherwise("house").alias("typeOfProperty"), F.col("text").alias("description"),
        F.nullif(F.col("lang"), F.lit("fr")).alias("address"), F.lit(None).cast("string").alias("location"),
        F.when(F.col("doc_id") % 3 != 0, F.array(F.concat(F.lit("https://x.example/"), "doc_id", F.lit(".jpg")))).alias("images"),
        F.concat(F.lit("https://"), "source", F.lit("/"), "doc_id").alias("sourceUrl"), "quality",
    )


_PLATFORM = """
WITH p AS (SELECT d.doc_id, source, string_split(text, chr(10))[1] AS title, CASE toxic WHEN 1 THEN 'unknown' WHEN 0 THEN 'sale' END AS purpose, CASE WHEN n_chars > 500 THEN n_chars::DOUBLE ELSE 0 END AS price,
 CASE WHEN lang IN ('en', 'de') THEN 'EUR' END AS currency, CASE WHEN quality = 1 THEN 'RealEstateListing' ELSE 'house' END AS kind, text AS description, nullif(lang, 'fr') AS address, d.doc_id % 3 <> 0 AS pics, quality
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query(_PLATFORM + """,
m AS (SELECT *, list_filter([CASE WHEN coalesce(title, '') IN ('', 'unknown') THEN 'title' END, CASE WHEN coalesce(purpose, 'unknown') = 'unknown' THEN 'purpose' END, CASE WHEN currency IS NULL THEN 'currency' END,
 CASE WHEN coalesce(description, '') IN ('', 'unknown') THEN 'description' END, CASE WHEN address IS NULL THEN 'address' END, CASE WHEN NOT pics THEN 'images' END], lambda x: x IS NOT NULL) AS missing FROM p)
SELECT doc_id, array_to_string(missing, ',') AS missing, len(missing) = 0 AS publish_ready, coalesce(quality = 0, true) OR len(missing) > 0 AS requires_review FROM m""")
def import_gate(spark, d):
    rows = _platform(spark, d)
    missing = quality.missing_import_fields(rows)
    review = quality.requires_review(F.col("quality").cast("double"), missing, F.lit(False))
    return rows.select("doc_id", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("publish_ready"), review.alias("requires_review"))


_ISSUES = _PLATFORM + """,
i AS (SELECT source, doc_id, pics, list_filter([CASE WHEN coalesce(title, '') = '' OR regexp_matches(title, '(?i)properties?\\s+archive|search\\s+results?|\\.st\\d+\\s*\\{|fill\\s*:|<svg|@keyframes') THEN 'invalid title' END,
 CASE WHEN address IS NULL THEN 'missing address/location' END, CASE WHEN NOT price > 0 THEN 'missing/invalid price' END, CASE WHEN currency IS NULL THEN 'missing currency' END,
 CASE WHEN kind = 'RealEstateListing' THEN 'missing/schematic property type' END, CASE WHEN coalesce(length(description), 0) < 40 THEN 'missing/short description' END,
 CASE WHEN NOT pics THEN 'missing images' END], lambda x: x IS NOT NULL) AS issues FROM p)"""


@query(_ISSUES + " SELECT source, issue, count(*) AS n FROM (SELECT source, unnest(issues) AS issue FROM i) GROUP BY source, issue")
def export_gate_histogram(spark, d):
    return _platform(spark, d).select("source", F.explode(quality.export_issues()).alias("issue")).groupBy("source", "issue").agg(F.count(F.lit(1)).alias("n"))


@query(_ISSUES + """ SELECT coalesce(source, 'all') AS source, count(*) AS raw_records, count(*) FILTER (WHERE len(issues) = 0) AS ready, count(*) FILTER (WHERE len(issues) > 0) AS blocked,
 count(*) FILTER (WHERE pics) AS total_images, max(CASE WHEN pics THEN 1 ELSE 0 END)::INT AS most_images FROM i GROUP BY ROLLUP (source)""")
def export_totals_rollup(spark, d):
    rows = _platform(spark, d).withColumn("issues", quality.export_issues()).withColumn("n_images", F.coalesce(F.size("images"), F.lit(0)))
    return rows.rollup("source").agg(
        F.count(F.lit(1)).alias("raw_records"), F.count_if(F.size("issues") == 0).alias("ready"), F.count_if(F.size("issues") > 0).alias("blocked"),
        F.sum("n_images").alias("total_images"), F.max("n_images").alias("most_images"),
    ).withColumn("source", F.coalesce("source", F.lit("all")))


@query(f"""
WITH c AS (SELECT source, doc_id, lower(nullif(regexp_extract(text, '{_EMAIL}', 1), '')) AS email FROM documents),
f AS (SELECT source, email, min(doc_id) AS first_doc FROM c WHERE email IS NOT NULL GROUP BY source, email)
SELECT source, string_agg(email, ',' ORDER BY first_doc, email) AS emails, count(*) AS n FROM f GROUP BY source""")
def contacts_by_source(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", listing.clean_email(F.col("text")).alias("email")).where("email is not null")
    firsts = rows.groupBy("source", "email").agg(F.min("doc_id").alias("at"))
    emails = F.transform(F.array_sort(F.collect_list(F.struct("at", "email"))), lambda x: x["email"])
    return firsts.groupBy("source").agg(F.array_join(emails, ",").alias("emails"), F.count(F.lit(1)).alias("n"))


@query(r"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))) AS text_md5,
 regexp_matches(html[1:20000], '(?i)\.well-known/sgcaptcha|cf-chl-|captcha|verify you are human|checking your browser') AS blocked FROM pages""")
def clean_text(spark, d):
    plain = F.trim(F.regexp_replace(text.without_tags(F.col("html")), r"[ \t\n\r\f]+", " "))
    return table(spark, d, "pages").select("page_id", F.md5(plain).alias("text_md5"), text.is_blocked_page(F.col("html")).alias("blocked"))


@query(rf"""
SELECT page_id, {_TITLE} AS title FROM pages WHERE {_TITLE} <> '' AND NOT regexp_matches({_TITLE}, '(?i)\.st\d+|search\s+results?|\*\*\*|page\s+\d+\s+of\s+\d+')""")
def title_noise_filter(spark, d):
    rows = table(spark, d, "pages").select("page_id", _title().alias("title"))
    return rows.where((F.col("title") != "") & ~quality.page_title_noise(F.col("title")) & ~F.col("title").rlike(r"(?i)\.st\d+|search\s+results?|\*\*\*"))


@query(f"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages)
SELECT {_ORIGIN} || array_to_string(list_transform(string_split(link, ''), lambda c: CASE WHEN regexp_matches(c, '[^\x21-\x7e]') THEN url_encode(c) ELSE c END), '') AS target, count(*) AS n, min(page_id) AS first_page FROM l GROUP BY 1""")
def page_links_absolute(spark, d):
    links = table(spark, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))
    target = urls.absolute(F.col("link"), F.col("url"))
    return links.where(urls.same_origin(target, F.col("url"))).groupBy(target.alias("target")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@query(rf"""
SELECT page_id, regexp_replace(lower({_x('url', 2)}), '^www\.', '') AS host, regexp_replace(regexp_replace(lower({_x('url', 2)}), '^www\.', ''), '[^a-z0-9]+', '-', 'g') AS slug FROM pages""")
def url_host_slug(spark, d):
    return table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.host_slug(F.col("url")).alias("slug"))


@query(f"SELECT {_DEDUPE} AS key, min(page_id) AS page_id, count(*) AS n, arg_min(url, page_id) AS url FROM pages GROUP BY 1")
def canonical_url_dedupe(spark, d):
    rows = table(spark, d, "pages").select(urls.dedupe_key(F.col("url")).alias("key"), "page_id", "url")
    return rows.groupBy("key").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"), F.min_by("url", "page_id").alias("url"))


@query(rf"""
WITH u AS (SELECT *, lower({_x('url', 3)}) AS path, lower({_x('url', 4)}[2:]) AS q FROM pages)
SELECT CASE WHEN regexp_matches(path, '^(/[^/]*)*/(property|properties)/[^/]+') OR regexp_matches(path, '/(?:property-details|details)/') THEN 'detail'
 WHEN regexp_matches(path, '/(?:properties?|search|for-sale|to-rent|sales|lettings)(?:/|$)') OR regexp_matches(q, '(^|&)[^=&]*(address|location|area|place|postcode|instruction|search|branch|bid)[^=&]*(=|&|$)') THEN 'scope' ELSE 'other' END AS kind,
 CASE WHEN regexp_matches(q, '(^|&)page=\d+') THEN 'page' END AS paging, count(*) AS n FROM u GROUP BY 1, 2""")
def url_class_counts(spark, d):
    u = F.col("url")
    kind = F.when(urls.is_detail(u), "detail").when(urls.is_scope(u), "scope").otherwise("other")
    return table(spark, d, "pages").groupBy(kind.alias("kind"), urls.paging(u)["kind"].alias("paging")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH r AS (SELECT {_DEDUPE} AS key, page_id, {_TITLE} AS title, html AS description, regexp_extract_all(html, 'href="([^"]+)"', 1) AS links FROM pages)
SELECT key, min(page_id) AS ord, arg_min(title, page_id) FILTER (WHERE title <> '') AS title, md5(arg_max(description, length(description) * 1000000 - page_id)) AS description_md5 FROM r GROUP BY key""")
def document_dedupe_merge(spark, d):
    rows = table(spark, d, "pages").select(urls.dedupe_key(F.col("url")).alias("key"), F.col("page_id").alias("ord"), _title().alias("title"), F.col("html").alias("description"))
    out = merge.merge_by_key(rows, "key")
    return out.select("key", "ord", "title", F.md5("description").alias("description_md5"))


@query("SELECT lower(lang || source) AS key, min(doc_id) AS ord, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1")
def last_wins_dedupe(spark, d):
    rows = table(spark, d, "documents").select(F.lower(F.concat("lang", "source")).alias("key"), F.col("doc_id").alias("ord"), "doc_id", "n_chars")
    return merge.last_wins(rows, ["key"])


@query("SELECT user_id, event_id AS ord, value AS score, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def best_score_wins(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("ord"), F.col("value").alias("score"), "event_type")
    return merge.best_wins(rows, ["user_id"], "score")


@query(rf"""
WITH p AS (SELECT page_id, {_CANON} AS key, {_TITLE} AS title FROM pages), ref AS (SELECT key, arg_max(title, page_id) AS ref_title FROM p WHERE page_id % 2 = 0 GROUP BY key)
SELECT page_id, ref_title IS NOT NULL AS matched, CASE WHEN ref_title IS NOT NULL AND (title = '' OR contains(title, '***')) THEN ref_title ELSE title END AS title,
 ref_title IS NOT NULL AND (title = '' OR contains(title, '***')) AND ref_title <> title AS changed FROM p LEFT JOIN ref USING (key)""")
def url_repair_join(spark, d):
    rows = table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("key"), _title().alias("title"))
    ref = rows.where("page_id % 2 = 0").groupBy("key").agg(F.max_by("title", "page_id").alias("ref_title"))
    told = rows.join(ref, "key", "left")
    bad = F.col("ref_title").isNotNull() & (text.blank(F.col("title")) | F.col("title").contains("***"))
    return told.select("page_id", F.col("ref_title").isNotNull().alias("matched"), F.when(bad, F.col("ref_title")).otherwise(F.col("title")).alias("title"), (bad & (F.col("ref_title") != F.col("title"))).alias("changed"))


_RECIPE = recipes.Recipe.parse("events", {"version": 2, "confidence": 0.9, "mappings": {"price": {"path": "k", "transform": "toNumber"}, "size": {"path": "k", "transform": "appendUnit", "args": {"unit": "sqft"}}, "currency": {"value": "gbp"}, "purpose": {"path": "k", "transform": "purposeMap", "args": {"69": "sale"}}}})


@query("""
WITH e AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT event_id, k AS price, CASE WHEN k <> 0 THEN k::BIGINT || ' sqft' END AS size, 'GBP' AS currency, CASE WHEN k = 69 THEN 'sale' WHEN k IS NOT NULL THEN 'unknown' END AS purpose, 0.9::DOUBLE AS mapping_confidence FROM e""")
def recipe_map_events(spark, d):
    rows = recipes.apply_recipe(table(spark, d, "events").select("event_id", F.col("props").alias("raw")), _RECIPE)
    return rows.select("event_id", "price", "size", "currency", "purpose", "mapping_confidence")


@query(r"""
SELECT p_partkey, trim(p_name) AS title, p_retailprice AS price, p_size || ' sqft' AS size, CASE WHEN regexp_matches(p_type, '(?i)\b(?:house|home|residence)\b') THEN 'house' END AS "typeOfProperty" FROM part""")
def recipe_map_parts(spark, d):
    raw = F.to_json(F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_retailprice").alias("amount")).alias("price"), F.col("p_size").alias("size"), F.col("p_type").alias("type")))
    fields = {"title": "name", "price": {"path": "price.amount", "transform": "toNumber"}, "size": {"path": "size", "transform": "appendUnit", "args": {"unit": "sqft"}}, "typeOfProperty": {"path": "type", "transform": "propertyTypeFromText"}}
    recipe = recipes.Recipe.parse("parts", {"version": 2, "mappings": fields})
    rows = table(spark, d, "part").select("p_partkey", raw.alias("raw"), F.lit("parts").alias("host"))
    return recipes.apply_recipes(rows, [recipe])[0].select("p_partkey", "title", "price", "size", "typeOfProperty")


@query(r"""
WITH c AS (SELECT c_custkey, lower(trim(c_mktsegment)) AS t, c_mktsegment AS s FROM customer)
SELECT c_custkey, CASE WHEN t = 'unknown' THEN t WHEN regexp_matches(t, 'short[\s-]?(let|term)|holiday') THEN 'short-let' WHEN regexp_matches(t, 'rent|let|lease') THEN 'rent' WHEN regexp_matches(t, 'sale|buy|purchase') THEN 'sale' WHEN t <> '' THEN 'unknown' END AS purpose,
 CASE WHEN regexp_matches(upper(trim(s)), '^[A-Z]{3}$') THEN upper(trim(s)) END AS currency FROM c""")
def purpose_currency(spark, d):
    c = F.col("c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", listing.purpose(c).alias("purpose"), listing.currency_from_symbol(c).alias("currency"))


@query(r"""
WITH t AS (SELECT doc_id, coalesce(regexp_extract(text, '([£$€]?\s?\d[\d,]*(?:\.\d+)?)', 1), '') AS t FROM documents)
SELECT doc_id, try_cast(nullif(regexp_extract(replace(t, ',', ''), '(-?\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS first_number, CASE WHEN t <> '' THEN try_cast(regexp_replace(t, '[£$€₦,\s]', '', 'g') AS DOUBLE) END AS to_number FROM t""")
def number_dialects(spark, d):
    t = F.coalesce(F.regexp_extract("text", r"([£$€]?\s?\d[\d,]*(?:\.\d+)?)", 1), F.lit(""))
    return table(spark, d, "documents").select("doc_id", numbers.first_number(t).alias("first_number"), numbers.to_number(t).alias("to_number"))


def _type_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for n, p in listing.PROPERTY_TYPES) + " END"


@query(f"SELECT kind, count(*) AS n FROM (SELECT {_type_sql('p_name || chr(32) || p_type')} AS kind FROM part) GROUP BY kind")
def property_type_from_text(spark, d):
    return table(spark, d, "part").groupBy(listing.property_type(F.concat_ws(" ", "p_name", "p_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH n AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, lang FROM n WHERE i IN (SELECT floor(k * (n - 1) / 7.0 + 0.5) FROM range(8) t(k))""")
def even_sample(spark, d):
    return recipes.even_sample(table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"])


@query("SELECT source, doc_id FROM documents ORDER BY source, doc_id LIMIT 120")
def record_budget(spark, d):
    return store.budget(table(spark, d, "documents").select("source", "doc_id"), ["source", "doc_id"], 120)


@query(f"""
SELECT d.doc_id, (CASE WHEN quality = 1 THEN 0 ELSE 5 END + CASE WHEN n_chars >= 400 THEN 0 ELSE 3 END + CASE WHEN {_PHONE_OK} THEN 0 ELSE 1 END)::INT AS need
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY need DESC, doc_id LIMIT 100""")
def need_score_topk(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    need = store.need_score(F.col("quality") == 1, F.col("n_chars") >= 400, listing.clean_phone(F.col("text")).isNotNull())
    return rows.select("doc_id", need.alias("need")).orderBy(F.desc("need"), "doc_id").limit(100)


@query(f"SELECT DISTINCT {_CANON} AS url FROM pages WHERE page_id % 2 = 1 AND {_CANON} NOT IN (SELECT {_CANON} FROM pages WHERE page_id % 2 = 0)")
def anti_new_scopes(spark, d):
    rows = table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("url"))
    return rows.where("page_id % 2 = 1").select("url").distinct().join(rows.where("page_id % 2 = 0"), "url", "left_anti")


@query("""
SELECT d.doc_id, CASE WHEN quality = 1 THEN 'kept' WHEN quality = 0 THEN 'retry' ELSE 'pending' END AS state, coalesce(quality, 0) <> 1 AS pending FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def resume_merge(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    state = F.when(F.col("quality") == 1, "kept").when(F.col("quality") == 0, "retry").otherwise("pending")
    return rows.select("doc_id", state.alias("state"), (state != "kept").alias("pending"))


@query("""
WITH j AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE value < 5) AS failed, round(sum(value), 2) AS records FROM events GROUP BY user_id)
SELECT user_id, total, failed, records, CASE WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status, round(failed * 100 / total)::DOUBLE AS percent FROM j""")
def job_status_fold(spark, d):
    jobs = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") < 5).alias("failed"), F.round(F.sum("value"), 2).alias("records"))
    percent = store.progress_percent(F.col("failed"), F.lit(0), F.col("total"), F.lit(False))
    return jobs.withColumns({"status": store.job_status(F.col("total"), F.col("failed")), "percent": percent.cast("double")})


@query("""
WITH s AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'failed' ELSE 'complete' END AS status, value > 10 AS complete, event_id % 50 AS expected FROM events),
a AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE status = 'failed') AS f, count(*) FILTER (WHERE NOT complete) AS o, nullif(sum(expected), 0)::BIGINT AS t, count(*) FILTER (WHERE status = 'complete' AND complete) AS c FROM s GROUP BY user_id)
SELECT user_id, CASE WHEN f > 0 THEN 'partial' WHEN o > 0 THEN 'incomplete' ELSE 'complete' END AS status, CASE WHEN n = 1 THEN t END AS expected_listings, t AS expected_reported, c AS scopes_completed, o AS scopes_incomplete, f AS scopes_failed FROM a""")
def run_report(spark, d):
    scopes = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "purchase", "failed").otherwise("complete").alias("status"), (F.col("value") > 10).alias("complete"), (F.col("event_id") % 50).alias("expected"))
    return quality.scope_report(scopes, ["user_id"])


@query("SELECT lang AS file, count(*) AS attempted, count(*) FILTER (WHERE n_chars >= 400) AS normalized, count(*) FILTER (WHERE n_chars < 400) AS failed FROM documents GROUP BY lang")
def batch_summary(spark, d):
    ok = F.col("n_chars") >= 400
    return table(spark, d, "documents").groupBy(F.col("lang").alias("file")).agg(F.count(F.lit(1)).alias("attempted"), F.count_if(ok).alias("normalized"), F.count_if(~ok).alias("failed"))


@query(f"""
WITH u AS (SELECT {_CANON} AS url, 0 AS rank, page_id AS ord FROM pages UNION ALL SELECT {_DEDUPE}, 1, page_id FROM pages),
f AS (SELECT url, min(rank * 1000000000 + ord) AS k FROM u GROUP BY url)
SELECT url, (k // 1000000000)::INT AS rank, (k % 1000000000)::BIGINT AS ord FROM f ORDER BY k, url LIMIT 200""")
def set_union_distinct(spark, d):
    pages = table(spark, d, "pages")
    own = pages.select(urls.canonical(F.col("url")).alias("url"), F.lit(0).alias("rank"), F.col("page_id").alias("ord"))
    other = pages.select(urls.dedupe_key(F.col("url")).alias("url"), F.lit(1).alias("rank"), F.col("page_id").alias("ord"))
    return merge.ordered_unique(own.unionByName(other), "url", ["rank", "ord"], 200)


@query("""
SELECT event_id, ((event_type IS NOT NULL)::INT + (value IS NOT NULL)::INT + 1) AS score FROM events""")
def json_shape_score(spark, d):
    record = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("Type"), F.col("value").alias("price"), "props"))
    return table(spark, d, "events").select("event_id", json_shapes.flat_shape_score(record).alias("score"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def latest_by_key(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", (-F.col("event_id")).alias("turn"))
    return store.latest_by_key(rows, ["user_id", "event_type"], ["turn"]).drop("turn")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_page_dedupe(spark, d):
    from ..streaming.jobs import dedupe_stream, run_to_table

    root = tempfile.mkdtemp(prefix="gleaner-") if spark.sparkContext.master.startswith("local[") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_stream"
    base = spark.conf.get("spark.checkpoint.dir", None) or root
    import uuid

    base = f"{base}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    unique = dedupe_stream(source.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type")
    run_to_table(unique, f"{base}/out", f"{base}/state", available_now=True).awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query(rf"""
SELECT conv_id, turn, '{{"role": ' || to_json(role) || ', "text": ' || to_json(regexp_replace(regexp_replace(text, '{_EMAIL}', '[email]', 'g'), '{_PHONE}', '[phone]', 'g')[1:12000]) || '}}' AS redacted FROM conversations""")
def redact_record(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "text", F.lit("a@b.example").alias("agent_email"))).alias("raw"))
    return rows.select("conv_id", "turn", json_shapes.redact(F.col("raw")).alias("redacted"))


@query(_PLATFORM + rf""",
c AS (SELECT *, nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), '') AS t FROM p),
n AS (SELECT *, CASE WHEN regexp_matches(t, '{text.PAGE_NOISE}') OR regexp_matches(t, '{text.STYLE_RULES_ONLY}') THEN NULL ELSE t END AS u FROM c)
SELECT doc_id, CASE WHEN u IS NULL OR regexp_matches(u, '{text.STATUS_ONLY_TITLE}') THEN address ELSE u END AS title, purpose, price, currency, kind AS "typeOfProperty", address, address AS location,
 CASE WHEN pics THEN 'https://x.example/' || doc_id || '.jpg' END AS images, 'https://x.example/floor-plan/1.png' AS "floorPlan" FROM n""")
def sanitised_platform(spark, d):
    rows = _platform(spark, d).withColumn("images", F.concat("images", F.array(F.lit("https://x.example/floor-plan/1.png"), F.lit("https://x.example/logo/a.png")))).drop("description", "quality", "source", "sourceUrl")
    rows = rows.withColumn("floorPlan", F.array(F.lit("https://x.example/floor-plan/1.png")))
    out = quality.sanitise(rows)
    return out.select("doc_id", "title", "purpose", "price", "currency", "typeOfProperty", "address", "location", F.array_join("images", ",").alias("images"), F.array_join("floorPlan", ",").alias("floorPlan"))
