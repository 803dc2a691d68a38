"""Queries of what pages hold: parts put on pages of listings, a page for each size, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import responses
from ..sources import json_shapes, sitemaps
from ..sources import page_steps as steps
from ..sources.nodes import attr, nodes
from ..sources.tables import table
from ..sources.work import written
from . import records  # noqa: F401
from .queries import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]

_SITE = "https://www.homes.example/list/"


def _pages(spark, d):
    """A page for each size of part: a head, linked data about an agency and the first part, every part as a card, in
    a script's list where the size divides by four, marked up where it leaves one, a gallery, contacts, a list of
    places, a link to what follows. Tags are left open as they often are. Pages come in pieces, (page_id, place, html), since one
    may hold any number of parts."""
    s, price = F.col("p_size").cast("string"), F.format_number(F.floor("p_retailprice"), 0)
    key, beds = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 5 + 1).cast("string")
    cat = lambda *bits: F.concat(*[F.lit(b) if isinstance(b, str) else b for b in bits])
    kind = F.when(F.col("p_partkey") % 2 == 0, "card b").otherwise("b  card")
    card = cat('<li class="', kind, '"><style>.x{fill:red}</style><h3> ', F.col("p_name"), ' </h3> <a href="/about">More</a> <a href="/property/', key, '-x">£', price, "</a> ", beds, ' bed house, 12 Elm Road YO1 7HH <img data-src="/i/', key, '.jpg"><a href="mailto:', key, '@Homes.example?x">m</a>')
    state = cat('{"id":', key, ',"price":"£', price, '","beds":', beds, ',"address":"x"}')
    rows = table(spark, d, "part").where("p_size is not null").select("p_size", "p_partkey", card.alias("card"), state.alias("state"), F.col("p_name").alias("name"), price.alias("price"))
    first = F.col("first")
    linked = cat('{"@graph":[{"@type":"Organization","name":"Agency ', s, '","email":"Desk', s, '@Homes.example","contactPoint":[{"@type":"ContactPoint","telephone":"0', s, ' 555"}]},[1],{"@type":["Thing","House"],"name":"', first["name"], '","offers":[{"price":', F.regexp_replace(first["price"], ",", ""), '.0,"priceCurrency":"GBP"}],"address":{"streetAddress":"', s, ' Elm","postalCode":"YO1"},"numberOfRooms":3,"image":["a.jpg",{"contentUrl":"b.jpg"},{}],"seller":{"name":"Ann","contactPoint":{"email":"ann@x"}}}]}')
    head = cat(
        '<!DOCTYPE html><html><head><title>Homes</title><meta property="og:title" content=" Flat ', s, ' for sale"><meta name="description" content="', s, ' bedroom flat"><meta property="og:image" content="/og.png"><link rel="canonical" href="/c/', s, '"><script type="application/LD+json">', linked, "</script>",
        F.when(F.col("p_size") % 4 == 0, '<script>let x=1; var resultsData = {list:1}; const homeListings = {"a":{"list":[').otherwise('<input type="hidden" name="f" value="[1]"><script>var y = "Data"</script>'),
    )
    body = cat(F.when(F.col("p_size") % 4 == 0, "]}};</script>").otherwise(""), '</head><body><nav class="pagination"><p>pages<ul><li class="next"><a href="?page=', s, '">On</a></ul></nav><select name="Area"><option value="york">York<option value="">Any<option></select><ul>')
    tail = cat(
        '</ul><div class="x gallery"><a href="/g/', s, '.webp"><img src="/g/', s, '.jpg" srcset="/g/', s, '-2.jpg 2x, /logo/a.png 3x"></a><a href="/page">p</a></div><img src="/other.jpg"><a href="tel: +44 ', s, ' 0000000">t</a>',
        F.when(F.col("p_size") % 4 == 1, cat('<div itemscope itemtype="https://schema.org/Apartment"><b itemprop="name">Oak ', s, '</b><i itemprop="price" content="', s, '">many</i><i itemprop="name"> Oak two </i></div>')).otherwise(""), "<p><b>open",
    )
    piece = lambda part, n, html: F.struct(F.struct(F.lit(part).alias("part"), n.cast("long").alias("n")).alias("place"), html.alias("html"))
    frames = rows.groupBy("p_size").agg(F.min(F.struct("p_partkey", "card", "state", "name", "price")).alias("first")).select("p_size", F.explode(F.array(*[piece(i, F.lit(0), html) for i, html in ((0, head), (2, body), (4, tail))])).alias("e"))
    listed = rows.where("p_size % 4 = 0 and state is not null").withColumn("n", F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey", "state")))
    listed = listed.select("p_size", piece(1, F.col("n"), F.concat(F.when(F.col("n") > 1, ",").otherwise(""), "state")).alias("e"))
    pieces = frames.unionByName(listed).unionByName(rows.select("p_size", piece(3, F.col("p_partkey"), F.col("card")).alias("e")))
    return pieces.select(F.col("p_size").alias("page_id"), "e.place", "e.html")


def _sites(spark, d):
    return table(spark, d, "part").select(F.col("p_size").alias("page_id"), F.lit(_SITE).alias("url")).distinct()


def _nodes(spark, d):
    return nodes(_pages(spark, d), place="place")


def _own(spark, d, wanted=None):
    """Elements of the pages, or those that are wanted, parsed once for steps that take them several times."""
    rows = _nodes(spark, d)
    return written(rows if wanted is None else rows.where(wanted), "page-nodes")


_P = "WITH p AS (SELECT *, p_size AS page_id, p_size::VARCHAR AS s, format('{:,}', floor(p_retailprice)::BIGINT) AS price, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS i FROM part)"


@query(_P + """ SELECT page_id, p_partkey, p_name AS title, '£' || price AS price, (p_partkey % 5 + 1)::VARCHAR AS bedrooms, '/property/' || p_partkey || '-x' AS url, '/i/' || p_partkey || '.jpg' AS images, '12 Elm Road' AS address, 'YO1 7HH' AS postcode, p_partkey || '@Homes.example' AS emails
 FROM p WHERE (SELECT count(*) FROM p q WHERE q.page_id = p.page_id) > 1""")
def page_cards(spark, d):
    rows = steps.card_listings(_own(spark, d))
    return rows.select("page_id", F.regexp_extract("url", r"(\d+)-x", 1).cast("long").alias("p_partkey"), "title", "price", "bedrooms", "url", F.array_join("images", ",").alias("images"), "address", "postcode", F.array_join("contact.emails", ",").alias("emails"))


@query(_P + """ SELECT page_id, p_name AS title, 'GBP' || floor(p_retailprice)::BIGINT AS price, s || ' Elm, YO1' AS address, 'YO1' AS postcode, '3' AS bedrooms, 'Thing,House' AS "propertyType", 'a.jpg,b.jpg' AS images, 'Ann' AS names, 'ann@x' AS emails FROM p WHERE i = 0""")
def page_linked_data(spark, d):
    rows = steps.linked_listings(_nodes(spark, d))
    price = F.regexp_replace("price", r"\.0+$", "")
    return rows.select("page_id", "title", price.alias("price"), "address", "postcode", "bedrooms", "propertyType", F.array_join("images", ",").alias("images"), F.array_join("contact.names", ",").alias("names"), F.array_join("contact.emails", ",").alias("emails"))


@query(_P + """ SELECT DISTINCT page_id, 'https://schema.org/Apartment' AS kind, 'Oak two' AS name, s AS price FROM p WHERE page_id % 4 = 1""")
def page_marked_up(spark, d):
    return steps.marked_up(_own(spark, d, attr("itemtype").isNotNull() | F.map_contains_key("attrs", "itemprop"))).select("page_id", "kind", F.col("record")["name"].alias("name"), F.col("record")["price"].alias("price"))


@query(_P + """ SELECT DISTINCT page_id, 'Flat ' || s || ' for sale' AS title, s || ' bedroom flat' AS description, CASE WHEN page_id % 4 = 1 THEN s END AS price, s AS bedrooms, 'Flat' AS "propertyType", '/c/' || s AS url, '/og.png' AS image FROM p""")
def page_open_graph(spark, d):
    return steps.open_graph(_nodes(spark, d))


@query(_P + """ SELECT DISTINCT page_id, 'https://www.homes.example/g/' || s || '.webp,https://www.homes.example/g/' || s || '.jpg,https://www.homes.example/g/' || s || '-2.jpg' AS images FROM p""")
def page_gallery(spark, d):
    rows = steps.gallery(_own(spark, d), _sites(spark, d))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "image"))), lambda x: x["image"])
    return rows.groupBy("page_id").agg(F.array_join(ordered, ",").alias("images"))


@query(_P + """ SELECT page_id, string_agg(lower(p_partkey || '@homes.example'), ',' ORDER BY p_partkey) || ',Desk' || s || '@Homes.example' AS emails, '+44 ' || s || ' 0000000,0' || s || ' 555' AS phones, 'Agency ' || s AS names FROM p GROUP BY page_id, s""")
def page_contacts(spark, d):
    rows = steps.page_contacts(_own(spark, d, F.col("tag").isin("a", "script")))
    of = lambda f: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("place", "value")))), lambda x: x["value"]), ",")
    return rows.groupBy("page_id").agg(of("emails").alias("emails"), of("phones").alias("phones"), of("names").alias("names"))


@query(_P + """ SELECT DISTINCT page_id, 'https://www.homes.example/list/?page=' || s AS next_url FROM p""")
def page_next(spark, d):
    return steps.next_page(_own(spark, d, (F.col("tag") == "a") | attr("class").isNotNull()), _sites(spark, d))


@query(_P + """ SELECT DISTINCT page_id, place, 'area' AS name, CASE place WHEN 0 THEN 'york' ELSE '' END AS value, CASE place WHEN 0 THEN 'York' ELSE 'Any' END AS label FROM p CROSS JOIN (SELECT unnest([0, 1])::INT AS place)""")
def page_places(spark, d):
    return steps.place_options(_own(spark, d, F.col("tag").isin("select", "option")))


@query(_P + """ SELECT page_id, 0 AS rank, 'inline:homeListings' AS source, 4 AS score, 'a.list' AS path, count(*)::INT AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS ids FROM p WHERE page_id % 4 = 0 GROUP BY page_id""")
def page_embedded(spark, d):
    rows = steps.embedded_sets(_own(spark, d, F.col("tag").isin("script", "input", "textarea")))
    return rows.select("page_id", "rank", "source", "score", "path", "n", F.array_join(F.transform("records", lambda r: F.get_json_object(r, "$.id")), ",").alias("ids"))


@query(_P + """ SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'embedded' ELSE 'linked' END AS strategy, i::INT AS pos, CASE WHEN page_id % 4 = 0 THEN p_partkey::VARCHAR ELSE p_name END AS told FROM p WHERE page_id % 4 = 0 OR i = 0""")
def page_strategy(spark, d):
    rows = steps.first_strategy(_own(spark, d))
    return rows.select("page_id", "strategy", "pos", F.coalesce(F.get_json_object("raw", "$.id"), F.get_json_object("raw", "$.title")).alias("told"))


@query(_P + """, c AS (SELECT page_id, count(*) FILTER (WHERE p_partkey % 2 = 0) AS even, count(*) FILTER (WHERE p_partkey % 2 = 1) AS odd, count(*) AS n FROM p GROUP BY page_id)
SELECT page_id, selector, n FROM (SELECT page_id, 'a.' AS selector, n FROM c UNION ALL SELECT page_id, 'li.card b', even FROM c UNION ALL SELECT page_id, 'li.b  card', odd FROM c) WHERE n > 0""")
def repeated_selectors(spark, d):
    rows = steps.repeated_selectors(_nodes(spark, d))
    return rows.where(F.col("selector").rlike(r"^(?:a\.|li\.)")).select("page_id", "selector", "n")


@query(_P + """, c AS (SELECT page_id, count(*) AS n FROM p GROUP BY page_id)
SELECT page_id, 'card' AS kind, n FROM c WHERE n > 1 UNION ALL SELECT page_id, 'linked', 1 FROM c UNION ALL SELECT page_id, 'marked up', 1 FROM c WHERE page_id % 4 = 1 UNION ALL SELECT page_id, 'open graph', 1 FROM c
UNION ALL SELECT page_id, 'image', 3 FROM c UNION ALL SELECT page_id, 'embedded', 1 FROM c WHERE page_id % 4 = 0 UNION ALL SELECT page_id, 'contact', n + 4 FROM c UNION ALL SELECT page_id, 'next page', 1 FROM c UNION ALL SELECT page_id, 'place', 2 FROM c""")
def page_records(spark, d):
    """How much of each kind a page of listings holds: all steps over its elements, written once. Each step's counts are
    written too, since a plan of all steps weighs on a driver."""
    own, at = _own(spark, d), _sites(spark, d)
    found = {
        "card": steps.card_listings(own), "linked": steps.linked_listings(own), "marked up": steps.marked_up(own), "open graph": steps.open_graph(own), "image": steps.gallery(own, at),
        "embedded": steps.embedded_sets(own), "contact": steps.page_contacts(own), "next page": steps.next_page(own, at), "place": steps.place_options(own),
    }
    out = None
    for kind, rows in found.items():
        rows = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).select("page_id", F.lit(kind).alias("kind"), "n")
        rows = written(rows, "page-kinds")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(_P + """ SELECT CASE WHEN page_id % 4 = 0 THEN 'embedded' ELSE 'linked' END AS strategy, count(DISTINCT page_id) AS pages, count(*) FILTER (WHERE page_id % 4 = 0 OR i = 0) AS records FROM p GROUP BY 1""")
def strategy_cascade(spark, d):
    return steps.first_strategy(_own(spark, d)).groupBy("strategy").agg(F.count_distinct("page_id").alias("pages"), F.count(F.lit(1)).alias("records"))


_TAGS = ["a", "article", "b", "h1", "head", "li", "nav", "p", "script", "style", "title", "ul"]


@query(f"""
WITH t AS (SELECT unnest({_TAGS}) AS tag), c AS (SELECT page_id, tag, len(regexp_extract_all(html, '<' || tag || '[ >]')) AS n FROM pages CROSS JOIN t)
SELECT page_id, tag, n FROM c WHERE n > 0""")
def page_extract(spark, d):
    """Elements of all driver pages, by tag."""
    rows = nodes(table(spark, d, "pages")).where(F.col("tag").isin(_TAGS))
    return rows.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id % 7 AS site, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) - 1 AS at_place, url AS loc FROM pages")
def sitemap_locs(spark, d):
    """The pages' URLs as seven sitemaps, in character data for some, read back."""
    escaped = F.regexp_replace("url", "&", "&amp;")
    loc = F.concat(F.lit("<url><loc>"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<![CDATA[ "), escaped, F.lit(" ]]>"))).otherwise(escaped), F.lit(" </loc></url>"))
    rows = table(spark, d, "pages").select((F.col("page_id") % 7).alias("site"), F.struct("page_id", loc.alias("x")).alias("line")).groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda r: r["x"]), "\n").alias("xml"))
    return rows.select("site", F.posexplode(sitemaps.locations(F.col("xml"))).alias("at_place", "loc")).withColumn("at_place", F.col("at_place").cast("long"))


@query(_P + """ SELECT page_id, 4 AS score, 'data.items' AS path, count(*) OVER (PARTITION BY page_id)::INT AS n, i::INT AS ord, p_partkey FROM p WHERE page_id % 3 = 0""")
def payload_candidates(spark, d):
    """Parts of a size as the listings of a payload; other sizes' payloads are broken or empty."""
    item = F.struct(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.lit(2).alias("beds"), F.col("p_name").alias("address"))
    rows = table(spark, d, "part").groupBy(F.col("p_size").alias("page_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    body = F.concat(F.lit(")]}',\n"), F.to_json(F.struct(F.struct(F.lit("v").alias("meta"), F.col("items")).alias("data"))))
    rows = rows.select("page_id", F.when(F.col("page_id") % 3 == 0, body).when(F.col("page_id") % 3 == 1, "{broken").otherwise("[]").alias("body"))
    return json_shapes.candidates(rows, "page_id", "body").select("page_id", "score", "path", "n", "ord", F.get_json_object("raw", "$.id").cast("long").alias("p_partkey"))


@query("""
WITH k AS (SELECT doc_id, doc_id % 5 AS k, n_chars FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'T' || doc_id WHEN 1 THEN 'Oak' END AS title, CASE WHEN k = 0 THEN n_chars + 0.5 END::DOUBLE AS price, CASE WHEN k = 0 THEN 'GBP' END AS currency, CASE k WHEN 0 THEN 'rent' WHEN 4 THEN 'sale' ELSE 'unknown' END AS purpose,
 CASE WHEN k = 4 THEN 3.0 END::DOUBLE AS bedrooms, CASE WHEN k = 0 THEN 'u' END AS images, CASE k WHEN 0 THEN 1.0 WHEN 4 THEN 0.85 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN k IN (2, 3) THEN 'failed' ELSE 'normalized' END AS status,
 CASE k WHEN 1 THEN 'invalid currency' WHEN 2 THEN 'no valid answer' WHEN 3 THEN 'no valid answer' ELSE '' END AS warnings, k NOT IN (0, 4) AS requires_review FROM k""")
def model_response_validate(spark, d):
    """Answers of five kinds about documents: fenced, in prose, without JSON, none at all, partial."""
    docs, k = table(spark, d, "documents"), F.col("doc_id") % 5
    fenced = F.concat(F.lit('```json\n{"data":{"title":" T'), F.col("doc_id").cast("string"), F.lit(' ","price":"£'), F.col("n_chars").cast("string"), F.lit('.5","currency":"gbp","purpose":"To Let","images":["u",""]},"confidence":2}\n```'))
    content = F.when(k == 0, fenced).when(k == 1, 'Sure: {"title":"Oak","currency":"pounds","confidence":-1} done').when(k == 2, "no idea").otherwise('{"data":{"bedrooms":3,"price":null,"purpose":"For sale"},"confidence":0.85}')
    out = responses.validate(docs.select("doc_id"), docs.where(k != 3).select("doc_id", content.alias("content")), "doc_id")
    return out.select("doc_id", "title", "price", "currency", "purpose", "bedrooms", F.array_join("images", ",").alias("images"), "confidence", "status", F.array_join("warnings", ",").alias("warnings"), "requires_review")


@query("""
SELECT c_custkey, c_name AS names, 'a' || c_custkey || '@b.example' AS emails, regexp_extract(c_name, '\\d+') || ',01904 ' || lpad(c_custkey::VARCHAR, 6, '0') AS phones FROM customer""")
def record_contacts(spark, d):
    """Customers as the agents of records: an id that looks like a number is none, a name that holds
    one is."""
    key = F.col("c_custkey").cast("string")
    agent = F.struct(F.col("c_name").alias("name"), F.concat(F.lit("01904 "), F.lpad(key, 6, "0")).alias("phone"), F.lit("1234567").alias("id"))
    raw = F.to_json(F.struct(agent.alias("agent"), F.concat(F.lit("mailto:A"), key, F.lit("@B.example?x")).alias("email")))
    rows = table(spark, d, "customer").select("c_custkey", json_shapes.public_contacts(raw).alias("c"))
    return rows.select("c_custkey", *[F.array_join(f"c.{f}", ",").alias(f) for f in ("names", "emails", "phones")])
