"""Queries of record work: nested merges, detail enrichment, batches, paging, payloads and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import listing, urls
from ..operators import batch, collect, enrich, export, jobs, merge, recovery, store
from ..operators.normalise import normalise_records
from ..sources import payloads, sitemaps
from ..sources.tables import table
from . import listings  # noqa: F401
from .queries import _EMAIL, _ISSUES, _ORIGIN, _PHONE, _PHONE_OK, _TITLE, QUERIES, SQL, _platform, _title, _x, query

__all__ = ["QUERIES", "SQL"]


@query(r"""
WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Show more items' ELSE role END AS name, text[1:40 + 7 * (turn % 5)::INT] AS summary, [role, text[1:2]] AS tags,
  CASE WHEN turn % 4 < 2 THEN text[1:5] END AS one, CASE WHEN turn % 4 = 2 THEN [text[1:3], role] END AS many FROM conversations),
a AS (SELECT *, min(turn) FILTER (many IS NOT NULL) OVER (PARTITION BY conv_id) AS first FROM r),
g AS (SELECT conv_id, min(turn) AS ord, coalesce(arg_min(name, turn) FILTER (name <> '' AND NOT starts_with(name, 'Show more')), arg_max(name, turn) FILTER (name <> '')) AS name,
  arg_max(summary, length(summary) * 100000 - turn) FILTER (summary <> '') AS summary, flatten(list(tags ORDER BY turn)) AS tags, count(*) AS n, any_value(first) AS first,
  arg_min(one, turn) FILTER (one <> '' AND (first IS NULL OR turn < first)) AS one, list(coalesce(many, [one]) ORDER BY turn) FILTER (many IS NOT NULL OR (turn > first AND one <> '')) AS lists FROM a GROUP BY conv_id),
m AS (SELECT *, CASE WHEN one IS NULL THEN lists ELSE list_concat([[one]], lists) END AS l FROM g)
SELECT conv_id, ord, name, summary, array_to_string(CASE WHEN n = 1 THEN tags ELSE list_filter(tags, lambda x, i: list_position(tags, x) = i) END, '|') AS tags, CASE WHEN first IS NULL THEN one END AS one,
  CASE WHEN first IS NULL THEN NULL WHEN len(l) = 1 THEN array_to_string(l[1], '|') ELSE array_to_string(list_filter(flatten(l), lambda x, i: list_position(flatten(l), x) = i), '|') END AS many FROM m""")
def nested_merge(spark, d):
    """Turns of a conversation merged into one nested record: an agent with name, summary and tags, and
    notes that are a text in some turns and a list in others."""
    cut = lambda n: F.substr("text", F.lit(1), n)
    name = F.when(F.col("turn") % 3 == 0, "Show more items").otherwise(F.col("role"))
    agent = F.struct(name.alias("name"), cut((40 + 7 * (F.col("turn") % 5)).cast("int")).alias("summary"), F.array("role", cut(F.lit(2))).alias("tags"))
    notes = F.struct(F.when(F.col("turn") % 4 < 2, cut(F.lit(5))).alias("one"), F.when(F.col("turn") % 4 == 2, F.array(cut(F.lit(3)), "role")).alias("many"))
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), agent.alias("agent"), F.struct(notes.alias("notes")).alias("more"))
    out = merge.merge_by_key(rows, "conv_id")
    return out.select("conv_id", "ord", "agent.name", "agent.summary", F.array_join("agent.tags", "|").alias("tags"), F.col("more.notes.one").alias("one"), F.array_join("more.notes.many", "|").alias("many"))


_HEADING, _PARAGRAPH = "<h1>([^<]*)</h1>", "<p>([^<]*)</p>"


@query(rf"""
WITH p AS (SELECT page_id, {_ORIGIN} AS origin, {_x('url', 3)} AS path, {_TITLE} AS title, regexp_extract(html, '{_HEADING}', 1) AS h1, regexp_extract(html, '{_PARAGRAPH}', 1) AS para FROM pages),
e AS (SELECT origin || path AS url, arg_min(h1, page_id) AS title, min(page_id) AS id FROM p WHERE page_id % 2 = 1 GROUP BY 1),
s AS (SELECT origin || path AS url, arg_min(title, page_id) AS title, arg_min(para, page_id) AS description, min(page_id) AS id FROM p GROUP BY 1),
d AS (SELECT url, coalesce(nullif(e.title, ''), nullif(s.title, '')) AS title, CASE WHEN s.description = '' OR length(s.title) > length(s.description) THEN nullif(s.title, '') ELSE s.description END AS description,
  CASE WHEN e.id IS NULL THEN ['o' || s.id] ELSE ['e' || e.id, 'o' || s.id] END AS images FROM s LEFT JOIN e USING (url)),
l AS (SELECT page_id, origin, origin || path AS url, CASE WHEN page_id % 4 = 0 THEN 'Show more items' ELSE title END AS title, CASE WHEN page_id % 5 > 1 THEN nullif(title[1:10], '') END AS description,
  CASE WHEN page_id % 2 = 0 THEN ['i' || page_id] END AS images, page_id % 7 <> 0 AS linked FROM p),
c AS (SELECT page_id FROM l WHERE linked QUALIFY row_number() OVER (PARTITION BY origin ORDER BY CASE WHEN images IS NULL THEN 5 ELSE 0 END + CASE WHEN description IS NULL THEN 3 ELSE 0 END DESC, page_id) <= 1),
j AS (SELECT l.*, c.page_id IS NOT NULL AS wanted, d.title AS dt, d.description AS dd, d.images AS di FROM l LEFT JOIN c USING (page_id) LEFT JOIN d ON d.url = l.url AND c.page_id IS NOT NULL)
SELECT page_id, CASE WHEN dt IS NOT NULL AND (title = '' OR title = 'Show more items') THEN dt ELSE title END AS title, CASE WHEN coalesce(length(dd), 0) > coalesce(length(description), 0) THEN dd ELSE description END AS description,
  array_to_string(CASE WHEN di IS NULL THEN images WHEN images IS NULL THEN di ELSE list_concat(images, di) END, '|') AS images, CASE WHEN wanted THEN di IS NOT NULL END AS enriched FROM j""")
def detail_enrichment(spark, d):
    """Pages as listings, enriched from the pages at the same URL: each of these tells a heading, a title with a
    first paragraph, and pictures, merged in this order; one page for each origin."""
    where = F.concat(urls.origin(F.col("url")), urls.path(F.col("url")))
    pages = table(spark, d, "pages").select("page_id", "url", where.alias("detail_url"), _title().alias("title"), F.regexp_extract("html", _HEADING, 1).alias("h1"), F.regexp_extract("html", _PARAGRAPH, 1).alias("para"))
    picture = lambda kind: F.array(F.concat(F.lit(kind), F.col("page_id").cast("string"))).alias("images")
    at = ["detail_url", F.col("page_id").alias("ord")]
    embedded = pages.where("page_id % 2 = 1").select(*at, F.col("h1").alias("title"), picture("e"))
    static = pages.select(*at, "title", F.col("para").alias("description"))
    graph = pages.select(*at, F.col("title").alias("description"), picture("o"))
    details = enrich.detail_records([embedded, static, graph], "detail_url")
    link = F.when(F.col("page_id") % 7 == 0, "mailto:x").when(F.col("page_id") % 3 == 0, urls.path(F.col("url"))).otherwise(F.col("detail_url"))
    rows = pages.select(
        "page_id", F.concat(urls.origin(F.col("url")), F.lit("/")).alias("source_url"), link.alias("url"), F.when(F.col("page_id") % 4 == 0, "Show more items").otherwise(F.col("title")).alias("title"),
        F.when(F.col("page_id") % 5 > 1, F.nullif(F.substring("title", 1, 10), F.lit(""))).alias("description"), F.when(F.col("page_id") % 2 == 0, picture("i")).alias("images"), F.col("page_id").alias("ord"),
    )
    need = store.need_score(F.size("images") > 0, F.col("description") != "", F.lit(False))
    out = enrich.enrich(rows, details, need, 1, "page_id")
    return out.select("page_id", "title", "description", F.array_join("images", "|").alias("images"), "enriched")


_BATCH = """
WITH l AS (SELECT doc_id, lang AS file, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS position FROM documents WHERE lang <> 'es'),
s AS (SELECT lang AS file, quality, row_number() OVER (PARTITION BY lang ORDER BY d.doc_id) - 1 AS position FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (lang = 'fr' AND d.doc_id % 10 = 3)),
same AS (SELECT file FROM (SELECT file, count(*) AS n FROM l GROUP BY file) JOIN (SELECT file, count(*) AS n FROM s GROUP BY file) USING (file, n)),
r AS (SELECT l.*, CASE WHEN quality = 1 AND file IN (FROM same) THEN 'ok' END AS saved FROM l LEFT JOIN s USING (file, position)),
p AS (SELECT *, saved IS NULL AS pending, saved IS NULL AND row_number() OVER (PARTITION BY saved IS NULL ORDER BY file, position) <= 150 AS selected FROM r),
w AS (SELECT doc_id, file, position, pending, selected, CASE WHEN selected THEN CASE WHEN n_chars < 400 THEN 'failed' ELSE 'ok' END ELSE saved END AS status, CASE WHEN selected THEN 'second' WHEN saved IS NOT NULL THEN 'first' END AS run FROM p)"""


def _batches(spark, d):
    """Documents as files of listings, a file a language. An earlier run saved rows for all of them but a few
    French ones, so that file starts again; Spanish ones are platform rows alone and are skipped. The
    second run takes 150 rows that have none or failed, and is written back by position."""
    docs, labels = table(spark, d, "documents").select("doc_id", F.col("lang").alias("file"), "n_chars"), table(spark, d, "labels").select("doc_id", "quality")
    rows = batch.numbered(docs, ["file"], ["doc_id"])
    spanish = F.col("file") == "es"
    rows = rows.join(batch.lossy_files(rows, spanish, ~spanish, F.lit(False)), "file", "left_anti")
    before = docs.where("not (file = 'fr' and doc_id % 10 = 3)").join(labels, "doc_id", "left")
    told = lambda status, run: F.struct(status.alias("status"), F.lit(run).alias("run"))
    platform = F.when(F.col("quality").isNotNull(), told(F.when(F.col("quality") == 1, "ok").otherwise("failed"), "first"))
    saved = batch.numbered(before.select("doc_id", "file", platform.alias("platform")), ["file"], ["doc_id"])
    failed = F.col("platform.status") == "failed"
    rows = batch.resume(rows, saved, failed=failed)
    rows = batch.select_budget(rows, batch.pending(F.col("platform"), failed), 150)
    new = rows.where("selected").select("file", "position", told(F.when(F.col("n_chars") < 400, "failed").otherwise("ok"), "second").alias("platform"))
    return batch.write_back(rows, new)


@query(_BATCH + " SELECT * FROM w")
def resumed_batches(spark, d):
    return _batches(spark, d).select("doc_id", "file", "position", "pending", "selected", "platform.status", "platform.run")


@query(_BATCH + """ SELECT file, count(*) AS total, count(*) FILTER (WHERE selected) AS attempted, count(*) FILTER (WHERE pending AND NOT selected) AS remaining,
 count(*) FILTER (WHERE selected AND status = 'ok') AS normalized, count(*) FILTER (WHERE selected AND status = 'failed') AS failed FROM w GROUP BY file""")
def resumed_batch_report(spark, d):
    return batch.batch_report(_batches(spark, d), F.col("platform.status") == "failed")


@query("""
WITH r AS (SELECT user_id, event_id // 1000 + 1 AS page, event_id, event_type || ':' || floor(value / 15)::BIGINT AS key FROM events),
f AS (SELECT user_id, key, min(event_id) AS event_id, min(page) AS page FROM r WHERE page <= 8 GROUP BY user_id, key),
g AS (SELECT user_id, page, count(*) AS added FROM f GROUP BY user_id, page),
stop AS (SELECT user_id, min(p) AS stop FROM (SELECT DISTINCT user_id FROM r) u CROSS JOIN range(1, 10) t(p) WHERE NOT EXISTS (FROM g WHERE g.user_id = u.user_id AND g.page = p) GROUP BY user_id)
SELECT user_id, page, event_id, key FROM f JOIN stop USING (user_id) WHERE page < stop""")
def page_collection(spark, d):
    """Events as the records of pages: a user's pages are followed while they bring new kinds of events."""
    rows = table(spark, d, "events").select("user_id", F.expr("event_id div 1000 + 1").alias("page"), "event_id", F.concat_ws(":", "event_type", F.floor(F.col("value") / 15).cast("string")).alias("key"))
    return collect.collect_pages(rows, F.col("key"), "user_id", "page", "event_id", 8).select("user_id", "page", "event_id", "key")


@query("""
WITH RECURSIVE p AS (SELECT page_id, page_id % 5 AS s, page_id // 5 AS i FROM pages),
e AS (SELECT s, CASE WHEN i % 3 = 0 THEN 'index' || i % 7 || '.xml' WHEN i % 3 = 1 THEN 'sitemap.xml' ELSE 'part' || i % 11 || '.xml' END AS file, page_id AS pos,
  CASE WHEN i % 3 = 0 THEN CASE WHEN i % 2 = 0 THEN 'index' || i % 5 || '.xml' ELSE 'part' || i % 13 || '.xml' END WHEN i % 3 = 1 THEN 'index' || i % 4 || '.xml' ELSE 'p/' || page_id // 2 END AS loc, i % 3 < 2 AS nested FROM p),
e2 AS (SELECT s, file, loc, nested, row_number() OVER (PARTITION BY s, file ORDER BY pos) - 1 AS pos FROM e),
q AS (SELECT s, ARRAY['index1.xml', 'sitemap.xml'] AS todo, ARRAY[]::VARCHAR[] AS done FROM (SELECT DISTINCT s FROM p)
  UNION ALL SELECT q.s, CASE WHEN list_contains(done, todo[1]) THEN todo[2:] ELSE list_concat(todo[2:], coalesce((SELECT list(loc ORDER BY pos) FROM e2 WHERE e2.s = q.s AND e2.file = todo[1] AND nested), [])) END,
   CASE WHEN list_contains(done, todo[1]) THEN done ELSE list_append(done, todo[1]) END FROM q WHERE len(todo) > 0 AND len(done) < 12),
v AS (SELECT s, unnest(done) AS file, unnest(range(1, len(done) + 1)) AS turn FROM q QUALIFY row_number() OVER (PARTITION BY s ORDER BY len(done) DESC) = 1),
l AS (SELECT s, loc, row_number() OVER (PARTITION BY s ORDER BY turn, pos) - 1 AS ord FROM v JOIN e2 USING (s, file) WHERE NOT nested)
SELECT 'https://s' || s || '.example/' AS site, min(ord) AS ord, 'https://s' || s || '.example/' || loc AS loc FROM l WHERE ord < 9 GROUP BY s, loc""")
def sitemap_crawl(spark, d):
    """Pages as lines of the sitemaps of five sites: indexes that lead to each other in circles and to lists of
    URLs, some repeated; twelve sitemaps and nine URLs a site at most."""
    part = F.expr("page_id div 5")
    name = lambda kind, m: F.concat(F.lit(kind), (part % m).cast("string"), F.lit(".xml"))
    file = F.when(part % 3 == 0, name("index", 7)).when(part % 3 == 1, "sitemap.xml").otherwise(name("part", 11))
    loc = F.when(part % 3 == 0, F.when(part % 2 == 0, name("index", 5)).otherwise(name("part", 13))).when(part % 3 == 1, name("index", 4)).otherwise(F.concat(F.lit("p/"), F.expr("page_id div 2").cast("string")))
    host = F.concat(F.lit("https://s"), (F.col("page_id") % 5).cast("string"), F.lit(".example/"))
    rows = table(spark, d, "pages").select(host.alias("site"), F.concat(host, file).alias("url"), F.struct("page_id", F.concat(F.lit("<loc>"), F.when(part % 2 == 0, host).otherwise(""), loc, F.lit("</loc>")).alias("x")).alias("line"), (part % 3 == 2).alias("list"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda r: r["x"]), "\n")
    files = rows.groupBy("url", "list").agg(lines.alias("lines"))
    body = F.concat(F.when(F.col("list"), "<urlset>").otherwise("<sitemapindex>"), "lines")
    robots = rows.select("site").distinct().select(F.concat("site", F.lit("robots.txt")).alias("url"), F.concat(F.lit("User-agent: *\nSitemap: /index1.xml\nsitemap: https://other.example/x.xml\n")).alias("body"))
    return sitemaps.crawl(files.select("url", body.alias("body")).unionByName(robots), rows.select("site"), 12, 9)


@query("""
WITH RECURSIVE e AS (SELECT user_id AS job, epoch_us(ts) AS at_us, CASE event_type WHEN 'signup' THEN 'queue' WHEN 'click' THEN 'start' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'source_ok' WHEN 'error' THEN 'source_failed' END AS kind,
  CASE WHEN event_type = 'signup' THEN 6 ELSE value END AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT job, 0::BIGINT AS i, NULL::BIGINT AS at_us, NULL::VARCHAR AS status, 0 AS done, 0 AS failed, 0::DOUBLE AS percent, NULL::BIGINT AS progress_at, 0 AS refused, NULL::VARCHAR AS why FROM e WHERE i = 1
 UNION ALL SELECT s.job, e.i, e.at_us,
  CASE WHEN kind = 'queue' AND status IS NULL THEN 'queued' WHEN kind = 'start' AND status = 'queued' THEN 'running' WHEN status = 'running' AND kind LIKE 'source%' AND done = 5 THEN CASE WHEN failed > 0 OR kind = 'source_failed' THEN 'partial' ELSE 'completed' END ELSE status END,
  done + (coalesce(status, '') = 'running' AND kind LIKE 'source%')::INT, failed + (coalesce(status, '') = 'running' AND kind = 'source_failed')::INT,
  CASE WHEN coalesce(status, '') <> 'running' THEN percent WHEN kind = 'progress' THEN value WHEN kind LIKE 'source%' THEN 100 ELSE percent END,
  CASE WHEN coalesce(status, '') <> 'running' THEN progress_at WHEN kind = 'progress' AND (progress_at IS NULL OR e.at_us - progress_at > 36000000000) THEN e.at_us WHEN kind LIKE 'source%' THEN NULL ELSE progress_at END,
  refused + CASE WHEN kind = 'queue' THEN status IS NOT NULL WHEN kind = 'start' THEN coalesce(status, '') <> 'queued' ELSE coalesce(status, '') <> 'running' END::INT,
  CASE WHEN kind = 'queue' AND status IS NULL THEN 'queued' WHEN kind = 'start' AND status = 'queued' THEN 'started' WHEN coalesce(status, '') <> 'running' THEN NULL WHEN kind = 'progress' THEN CASE WHEN progress_at IS NULL OR e.at_us - progress_at > 36000000000 THEN 'progress' END
   WHEN kind LIKE 'source%' THEN CASE WHEN done = 5 THEN 'ended' ELSE 'source' END END
 FROM s JOIN e ON e.job = s.job AND e.i = s.i + 1)
SELECT job, at_us, status, done, failed, percent, refused, why FROM s WHERE why IS NOT NULL""")
def job_lifecycle(spark, d):
    """Events as a stream of what happens to jobs, a job a user: the rows that are persisted, progress at most
    every ten hours."""
    from ..sources.work import work_path
    from ..streaming.jobs import run_to_table
    from ..streaming.lifecycle import job_stream

    kinds = {"signup": "queue", "click": "start", "view": "progress", "purchase": "source_ok", "error": "source_failed"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()])
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events = source.select(F.col("user_id").alias("job"), at.alias("at"), kind.alias("kind"), F.when(F.col("event_type") == "signup", 6.0).otherwise(F.col("value")).alias("value"))
    base = work_path(spark, "lifecycle")
    run_to_table(job_stream(events, every=36_000), f"{base}/out", f"{base}/state", available_now=True).awaitTermination()
    return spark.read.parquet(f"{base}/out").withColumnRenamed("at", "at_us")


_EXPORT = _ISSUES + """,
x AS (SELECT i.source, i.doc_id, i.pics, i.issues, d.lang, 'https://' || i.source || '/' || i.doc_id % 40 AS url, p.address, p.price, p.title FROM i JOIN documents d ON d.doc_id = i.doc_id JOIN p ON p.doc_id = i.doc_id),
l AS (SELECT source, arg_max(lang, doc_id) AS lang FROM x GROUP BY source),
b AS (SELECT x.* FROM x JOIN l USING (source, lang)),
m AS (SELECT * FROM b WHERE length(source) % 3 <> 0),
r AS (SELECT source, url, min(doc_id) AS position, arg_max({'pics': pics::INT, 'address': address, 'price': price, 'title': title}, doc_id) AS v FROM m WHERE len(issues) = 0 GROUP BY source, url)"""


def _exported(spark, d):
    """(sources, latest batches, recipes, gated rows, ready rows): documents as listings, a batch a language; sources
    with names of some lengths have no recipe, and one that is configured has nothing."""
    rows = _platform(spark, d).withColumn("sourceUrl", F.concat(F.lit("https://"), "source", F.lit("/"), (F.col("doc_id") % 40).cast("string"))).withColumn("salesPlatform", F.col("source"))
    rows = rows.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").withColumnRenamed("source", "source_url").withColumnRenamed("doc_id", "position")
    last = store.latest_batch(rows, "source_url", "lang", "position")
    batches = last.groupBy("source_url").agg(F.max("lang").alias("job"), F.max("position").alias("saved_at"), F.count(F.lit(1)).alias("raw_count"))
    sources = rows.select("source_url").unionByName(spark.range(1).select(F.lit("none.example").alias("source_url"))).distinct().withColumn("host", F.col("source_url"))
    recipes = sources.where("length(host) % 3 <> 0 or host = 'none.example'").select("host")
    gate = export.gated(last.join(recipes, F.col("source_url") == F.col("host"), "left_semi"))
    return sources, batches, recipes, gate, export.ready_rows(gate, "source_url")


@query(_EXPORT + """,
g AS (SELECT source, count(*) FILTER (WHERE len(issues) > 0) AS blocked FROM m GROUP BY source),
s AS (SELECT source, count(*) AS ready, sum(v.pics)::BIGINT AS total, round(avg(v.pics), 1) AS average, max(v.pics)::BIGINT AS most FROM r GROUP BY source),
w AS (SELECT source, string_agg(issue || ':' || n, ',' ORDER BY issue) AS why FROM (SELECT source, issue, count(*) AS n FROM (SELECT source, unnest(issues) AS issue FROM m WHERE len(issues) > 0) GROUP BY source, issue) GROUP BY source),
c AS (SELECT source, count(*) AS raw FROM b GROUP BY source),
a AS (SELECT DISTINCT source FROM documents UNION SELECT 'none.example'),
t AS (SELECT source AS source_url, coalesce(raw, 0) AS raw_count, CASE WHEN raw IS NULL THEN 'No usable raw listings were recovered from the live source.' WHEN length(source) % 3 = 0 THEN 'No reviewed mapping recipe is available.' END AS reason,
  coalesce(ready, 0) AS ready_count, CASE WHEN raw IS NULL THEN 0 WHEN length(source) % 3 = 0 THEN raw ELSE blocked END AS blocked_count, coalesce(total, 0) AS total_images, coalesce(average, 0) AS average_images, coalesce(most, 0) AS maximum_images, why
  FROM a LEFT JOIN c USING (source) LEFT JOIN g USING (source) LEFT JOIN s USING (source) LEFT JOIN w USING (source))
SELECT *, CASE WHEN reason IS NOT NULL THEN 'blocked' WHEN blocked_count = 0 THEN 'ready' WHEN ready_count > 0 THEN 'partial' ELSE 'blocked' END AS status FROM t""")
def export_sources(spark, d):
    sources, batches, recipes, gate, ready = _exported(spark, d)
    report = export.source_report(sources, batches, recipes, gate, ready)
    why = F.array_join(F.transform("blocked_reasons", lambda r: F.concat_ws(":", r["issue"], r["count"].cast("string"))), ",")
    return report.select("source_url", "status", "reason", "raw_count", "ready_count", "blocked_count", "total_images", "average_images", "maximum_images", F.nullif(why, F.lit("")).alias("why"))


_COMBINED = _EXPORT + """,
k AS (SELECT lower(source || '|' || coalesce(v.address, 'null') || '|' || v.price::BIGINT) AS key, source, position, url, v FROM r),
q AS (SELECT min({'source': source, 'position': position}) AS place, arg_max({'url': url, 'v': v, 'source': source}, {'source': source, 'position': position}) AS x FROM k GROUP BY key)"""


@query(_COMBINED + " SELECT place.source AS first_source, place.position AS first_position, x.source AS \"salesPlatform\", x.url AS url, x.v.title AS title, x.v.address AS address, x.v.price AS price, x.v.pics::BIGINT AS n_images, false AS \"isPaid\", NULL::VARCHAR AS landmark FROM q")
def export_combined(spark, d):
    *_, ready = _exported(spark, d)
    combined = export.combined_rows(ready, F.struct("source_url", "position"))
    rows = export.import_payload(combined.withColumn("isPaid", F.lit(False)), ("place", "sourceUrl"))
    return rows.select(F.col("place.source_url").alias("first_source"), F.col("place.position").alias("first_position"), "salesPlatform", F.col("sourceUrl").alias("url"), "title", "address", "price", F.size("images").cast("long").alias("n_images"), "isPaid", "landmark")


@query(_COMBINED + """ SELECT (SELECT count(DISTINCT source) + 1 FROM documents) AS sources_requested, (SELECT count(DISTINCT source) FROM r) AS sources_with_ready_data, (SELECT count(*) FROM b) AS raw_records_assessed,
 (SELECT count(*) FROM b WHERE len(issues) > 0 OR length(source) % 3 = 0) AS blocked_records, (SELECT count(*) FROM q) AS porting_ready_records, (SELECT sum(x.v.pics)::BIGINT FROM q) AS images""")
def export_totals(spark, d):
    sources, batches, recipes, gate, ready = _exported(spark, d)
    return export.export_totals(export.source_report(sources, batches, recipes, gate, ready), export.combined_rows(ready, F.struct("source_url", "position")))


@query(rf"""
WITH c AS (SELECT source, doc_id, lower(nullif(regexp_extract(text, '{_EMAIL}', 1), '')) AS email, CASE WHEN {_PHONE_OK} THEN regexp_replace(trim(regexp_extract(text, '{_PHONE}', 1)), '\s+', ' ', 'g') END AS phone, lang FROM documents),
v AS (SELECT source, 'email' AS f, email AS x, doc_id FROM c UNION ALL SELECT source, 'phone', phone, doc_id FROM c UNION ALL SELECT source, 'name', lang, doc_id FROM c),
g AS (SELECT source, f, x, min(doc_id) AS at_doc FROM v WHERE x <> '' GROUP BY source, f, x)
SELECT source, coalesce(string_agg(x, ',' ORDER BY at_doc) FILTER (WHERE f = 'name'), '') AS names, coalesce(string_agg(x, ',' ORDER BY at_doc) FILTER (WHERE f = 'email'), '') AS emails, coalesce(string_agg(x, ',' ORDER BY at_doc) FILTER (WHERE f = 'phone'), '') AS phones FROM g GROUP BY source""")
def export_contacts(spark, d):
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    contact = F.struct(one(F.col("lang")).alias("names"), one(listing.clean_email(F.col("text"))).alias("emails"), one(listing.clean_phone(F.col("text"))).alias("phones"))
    rows = export.contacts_by(table(spark, d, "documents").select("source", F.col("doc_id").alias("position"), contact.alias("contact")), "source")
    return rows.select("source", *[F.array_join(c, ",").alias(c) for c in ("names", "emails", "phones")])


@query(rf"""
WITH r AS (SELECT lang, d.doc_id, string_split(text, chr(10))[1] AS title, CASE WHEN n_chars > 500 THEN source END AS address, regexp_matches(text, '{_EMAIL}') AS email, quality, toxic, d.doc_id % 3 AS pics FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT lang, source, count(*) AS expected, min(n_chars) < 20 AS failed, max(n_chars) > 5000 AS complete FROM documents GROUP BY lang, source),
t AS (SELECT lang, CASE WHEN bool_or(failed) THEN 'partial' WHEN NOT bool_and(complete) THEN 'incomplete' ELSE 'complete' END AS status, sum(expected)::BIGINT AS expected_reported, count(*) FILTER (WHERE failed) AS scopes_failed, count(*) FILTER (WHERE NOT complete) AS scopes_incomplete FROM s GROUP BY lang),
n AS (SELECT lang, count(*) AS unique_listings, count(*) FILTER (WHERE title <> '') AS titles, count(address) AS addresses, count(*) FILTER (WHERE email) AS with_email, count(*) FILTER (WHERE quality = 0) AS needs_review,
  count(*) FILTER (WHERE quality = 1) AS import_ready, count(*) FILTER (WHERE quality = 0) AS blocked, count(*) FILTER (WHERE quality IS NOT NULL AND pics > 0) AS with_images, count(*) FILTER (WHERE quality IS NOT NULL AND pics = 0) AS without_images,
  coalesce(sum(pics) FILTER (WHERE quality IS NOT NULL), 0)::BIGINT AS total_images, round(avg(pics) FILTER (WHERE quality IS NOT NULL), 1) AS average_images FROM r GROUP BY lang)
SELECT lang, status, expected_reported, scopes_failed, scopes_incomplete, unique_listings, 'title:' || titles || ':' || round(titles * 100 / unique_listings, 1) || ',address:' || addresses || ':' || round(addresses * 100 / unique_listings, 1) AS coverage,
 with_email AS with_any_contact, with_email, 0::BIGINT AS with_phone, needs_review, import_ready, blocked AS blocked_from_import, with_images, without_images, total_images, average_images FROM n JOIN t USING (lang)""")
def run_report_full(spark, d):
    """A run for each language: documents as its records, labels as mapped rows, sources as its scopes."""
    docs = table(spark, d, "documents")
    rows = docs.join(table(spark, d, "labels"), "doc_id", "left")
    pictures = F.when(F.col("doc_id") % 3 > 0, F.array_repeat(F.lit("u"), (F.col("doc_id") % 3).cast("int")))
    mapped = F.when(F.col("quality").isNotNull(), F.struct(pictures.alias("images"), (F.col("quality") == 1).alias("ready"), (F.col("quality") == 0).alias("review")))
    none = F.lit(None).cast("array<string>")
    emails = F.when(listing.clean_email(F.col("text")).isNotNull(), F.array(F.lit("x")))
    source = F.struct(F.when(F.col("n_chars") > 500, F.col("source")).alias("address"))
    records = rows.select("lang", F.element_at(F.split("text", "\n"), 1).alias("title"), F.lit("own").alias("address"), source.alias("_source"), F.struct(emails.alias("emails"), none.alias("phones")).alias("contact"), F.array(F.lit("raw")).alias("images"), mapped.alias("platform"))
    scopes = docs.groupBy("lang", "source").agg(F.when(F.min("n_chars") < 20, "failed").otherwise("complete").alias("status"), (F.max("n_chars") > 5000).alias("complete"), F.count(F.lit(1)).alias("expected"))
    report = export.run_report(records, scopes, ["lang"], ["title", "address"])
    coverage = F.array_join(F.transform("field_coverage", lambda c: F.concat_ws(":", c["field"], c["count"].cast("string"), c["percent"].cast("string"))), ",")
    return report.select("lang", "status", "expected_reported", "scopes_failed", "scopes_incomplete", "unique_listings", coverage.alias("coverage"), "with_any_contact", "with_email", "with_phone", "needs_review", "import_ready", "blocked_from_import", "with_images", "without_images", "total_images", "average_images")


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'z.list' WHEN 1 THEN 'a.b.c' WHEN 2 THEN '(root array)' WHEN 3 THEN '7.rows' END AS path, CASE event_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 1 END AS n,
 CASE event_id % 5 WHEN 0 THEN 'null|' || p || '|5' WHEN 1 THEN p WHEN 2 THEN p || '|' || p ELSE p END AS items FROM (SELECT event_id, replace(props, ' ', '') AS p FROM events) WHERE event_id % 5 < 4""")
def payload_arrays(spark, d):
    """Events' properties inside payloads of five shapes: the first array whose first object has the key."""
    p, shape_ = F.col("props"), F.col("event_id") % 5
    build = lambda *bits: F.concat(*[F.lit(b) if isinstance(b, str) else b for b in bits])
    body = (
        F.when(shape_ == 0, build(")]}',", '{"z":{"list":[null,', p, ',5]},"a":{"meta":[1,{"x":2}],"k":[],"t":"[', F.lit(""), ']"}}'))
        .when(shape_ == 1, build('{"q":[{"other":[', p, ']}],"a":{"b":{"c":[', p, ']}},"y":[', p, ",", p, "]}")).when(shape_ == 2, build("[", p, ",", p, "]"))
        .when(shape_ == 3, build('{"b":{"rows":[', p, ",", p, ']},"7":{"rows":[', p, "]}}")).otherwise(build('{"k":', p, ',"broken"'))
    )
    found = payloads.array_with_keys(table(spark, d, "events").select("event_id", body.alias("body")), "event_id", ["k"])
    return found.select("event_id", "path", "n", F.array_join(F.transform("items", lambda x: F.coalesce(x, F.lit("null"))), "|").alias("items"))


@query("""
WITH c AS (SELECT user_id AS page, event_id // 500 AS candidate, event_id AS ord, event_id % 37 AS id, event_type FROM events),
s AS (SELECT page, candidate, arg_min(event_type, ord) IN ('click', 'view') AS wide, max(ord % 4) AS score FROM c GROUP BY page, candidate),
k AS (SELECT page, wide, id, min(ord) AS ord, max(score) AS score FROM c JOIN s USING (page, candidate) GROUP BY page, wide, id),
g AS (SELECT page, wide, max(score) AS score, count(*) AS n, min(ord) AS first FROM k GROUP BY page, wide),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, n DESC, first) = 1)
SELECT page, CASE WHEN wide THEN 'id|kind' ELSE 'id' END AS signature, b.score, n, ord // 500 AS candidate, ord, id FROM k JOIN b USING (page, wide)""")
def payload_groups(spark, d):
    """Events as records of batches, 500 ids a batch of each user: a batch is told by its first record."""
    batch_of = F.expr("event_id div 500")
    wide = F.col("event_type").isin("click", "view")
    raw = F.when(wide, F.to_json(F.struct(F.col("event_type").alias("kind"), (F.col("event_id") % 37).alias("id")))).otherwise(F.to_json(F.struct((F.col("event_id") % 37).alias("id"))))
    rows = table(spark, d, "events").select(F.col("user_id").alias("page"), batch_of.alias("candidate"), F.col("event_id").alias("ord"), raw.alias("raw"), (F.col("event_id") % 4).alias("score"))
    best = payloads.schema_groups(rows)
    return best.select("page", "signature", "score", "n", "candidate", "ord", F.get_json_object("raw", "$.id").cast("long").alias("id"))


@query(r"""
WITH w AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z ]', '', 'g')[1:12000] AS t FROM documents),
i AS (SELECT doc_id, t, '{"currentNormalized":{"id": ' || doc_id || '},"sourceRecord":{"description": "' || t || '", "parts": ["' || t || '", "' || t || '", "' || t || '", "' || t || '"]}}' AS whole FROM w)
SELECT doc_id, length(whole) > 45000 AS cut, md5(CASE WHEN length(whole) <= 45000 THEN whole ELSE '{"currentNormalized":{"id": ' || doc_id || '},"sourceRecord":{"description":"' || t[1:8000] || '"},"warning":"Source record was truncated before being sent to the model."}' END) AS input_md5 FROM i""")
def model_inputs(spark, d):
    """Documents, their letters alone, as records that a model is sent: on both sides of the limit."""
    t = F.regexp_replace("text", "[^A-Za-z ]", "")
    rows = table(spark, d, "documents").select("doc_id", t.alias("t"))
    record = F.to_json(F.struct(F.col("t").alias("description"), F.array("t", "t", "t", "t").alias("parts"), F.lit("x@y.example").alias("agentEmail")))
    rows = rows.select("doc_id", payloads.model_input(F.to_json(F.struct(F.col("doc_id").alias("id"))), record).alias("input"))
    return rows.select("doc_id", F.col("input").contains("was truncated").alias("cut"), F.md5("input").alias("input_md5"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, p_partkey % 3 = 0 AS sure, p_partkey % 11 = 0 AS failed, p_name, p_type, p_retailprice, p_brand FROM part)
SELECT p_partkey, CASE WHEN k = 1 THEN 'Mapped ' || p_partkey ELSE p_name END AS title, CASE WHEN k = 2 THEN 'unknown' ELSE 'rent' END AS purpose, CASE WHEN k = 3 THEN 5.0 ELSE p_retailprice END AS price, p_type AS "typeOfProperty",
 CASE WHEN k = 1 THEN 'A description of the mapped row' END AS description, array_to_string(list_filter([CASE WHEN k <> 1 THEN 'title' END, CASE WHEN k <> 2 THEN 'purpose' END, 'location', 'address', 'typeOfProperty', 'currency', CASE WHEN k <> 3 THEN 'price' END, 'amount', 'images'], lambda x: x IS NOT NULL), ',') AS recovered,
 array_to_string(list_filter([CASE WHEN k = 2 THEN 'purpose' END, CASE WHEN k <> 1 THEN 'description' END], lambda x: x IS NOT NULL), ',') AS critical, 1 AS image_count, k = 1 AND sure AND NOT failed AS publish_ready, NOT (k = 1 AND sure AND NOT failed) AS requires_review, 'homes.co.uk' AS "salesPlatform" FROM p""")
def platform_recovery(spark, d):
    """Parts as listings with mapped rows that lack fields: recovered, cleaned and gated in one pass."""
    k, n = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    raw = F.to_json(F.struct(F.col("p_name").alias("displayAddress"), F.col("p_type").alias("property_type"), F.col("p_retailprice").alias("price"), F.array("p_brand").alias("photos"), F.concat(F.lit("/p/"), n).alias("url")))
    mapped = F.struct(
        F.when(k == 1, F.concat(F.lit("<b>Mapped</b>  "), n)).otherwise("").alias("title"), F.when(k == 2, "unknown").alias("purpose"), F.when(k == 3, 5.0).alias("price"), F.when(k == 1, "A description of the mapped row").alias("description"),
        F.when(F.col("p_partkey") % 11 == 0, "failed").otherwise("normalized").alias("status"), F.when(F.col("p_partkey") % 3 == 0, 0.8).otherwise(0.79).alias("confidence"),
    )
    rows = table(spark, d, "part").select("p_partkey", raw.alias("raw"), F.lit("https://www.homes.co.uk/lettings/").alias("site_url"), mapped.alias("platform"))
    out = recovery.recover_platform(normalise_records(rows, keep_record=True), keys=["p_partkey"])
    told = "_normalization."
    return out.select("p_partkey", "title", "purpose", "price", "typeOfProperty", "description", F.array_join(told + "recoveredFields", ",").alias("recovered"), F.array_join(told + "criticalMissing", ",").alias("critical"), F.col(told + "imageCount").alias("image_count"), F.col(told + "publishReady").alias("publish_ready"), F.col(told + "requiresReview").alias("requires_review"), "salesPlatform")


@query("""
WITH o AS (SELECT o_custkey, list({'status': o_orderstatus, 'price': o_totalprice} ORDER BY o_orderkey) AS r, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY o_custkey)
SELECT o_custkey AS id, len(r)::INT AS total, list_sum([round(x.price)::BIGINT FOR x IN r])::BIGINT AS records, len([x FOR x IN r IF x.status = 'F'])::BIGINT AS "withEmail", 0::BIGINT AS "withPhone",
 strftime(a, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS started, greatest(1, (epoch_ms(b) - epoch_ms(a)) // 60000)::BIGINT AS minutes, '£' || format('{:,}', floor(r[1].price + 0.5)::BIGINT) AS price FROM o""")
def job_projections(spark, d):
    """Customers as jobs with their orders as results: totals, times and prices as they are shown."""
    result = F.struct(F.round("o_totalprice").cast("long").alias("count"), F.struct(F.when(F.col("o_orderstatus") == "F", 1).alias("withEmail"), F.lit(None).cast("int").alias("withPhone")).alias("contactCoverage"), F.lit("file").alias("files"), F.col("o_totalprice").alias("price"))
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", result.alias("r")))).alias("r"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    rows = rows.withColumns({"results": F.transform("r", lambda x: x["r"]), "urls": F.transform("r", lambda x: x["o_orderkey"].cast("string")), "status": F.lit("completed")})
    shown = jobs.public_jobs(rows).select("id", "total").join(jobs.job_totals(rows), "id")
    first = F.get("results", F.lit(0))["price"].cast("decimal(20,2)").cast("string")
    times = rows.select("id", jobs.iso(F.col("a")).alias("started"), jobs.elapsed_minutes(F.col("a"), F.col("b")).alias("minutes"), jobs.shown_price(first, F.lit(None).cast("string")).alias("price"))
    return shown.join(times, "id")


@query("""
WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS o, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS p, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)
SELECT page_id, o || '/search.ljson?' || array_to_string(list_concat(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(x, 'page=')), ['channel=sales', 'fragment=' || replace(array_to_string(list_concat(list_filter(string_split(p, '/'), lambda x: x <> ''), ['page-' || page_id % 3]), '/'), '/', '%2F')]), '&') AS endpoint FROM u""")
def search_endpoints(spark, d):
    return table(spark, d, "pages").select("page_id", urls.search_endpoint(F.col("url"), F.col("page_id") % 3).alias("endpoint"))
