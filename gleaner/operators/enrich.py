"""Listings enriched from the pages about them.

A listing on a search page tells little; its own page tells more, in up to three ways (embedded state,
marked-up data, Open Graph), which are merged by precedence. Which listings get a page is decided for
each source by what they lack, within a cap. Pages are a table here, joined by URL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from . import merge

#: Groups that a source's rows are dealt to before its best rows meet.
SPREAD = 64


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread: int = SPREAD) -> DataFrame:
    """The first ``k`` rows of each group in ``order``, which should leave no ties. Rows are first ranked in
    ``spread`` parts of a group, so a group that holds most rows is ranked by many tasks, and no task
    sees more than ``k`` rows of each part afterwards."""
    told = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    rows = df.withColumn("_spread", F.pmod(F.hash(*told), F.lit(spread)))
    for by in ([*keys, "_spread"], [*keys]):
        rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k)
    return rows.drop("_spread", "_rank")


def detail_records(sources: Sequence[DataFrame], key: str, order: str = "ord") -> DataFrame:
    """One record for each page: the first record that each of ``sources`` has for it, merged, earlier
    sources first. Sources may lack columns of others. Pages without any record have none."""
    ranked = None
    for rank, source in enumerate(sources):
        rest = [c for c in source.columns if c not in (key, order)]
        first = source.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first")).select(key, F.lit(rank).alias("_rank"), "_first.*")
        ranked = first if ranked is None else ranked.unionByName(first, allowMissingColumns=True)
    return merge.merge_by_key(ranked, key, "_rank").drop("_rank")


def detail_candidates(listings: DataFrame, need: Column, cap: int, url: str = "url", source: str = "source_url", order: str = "ord") -> DataFrame:
    """Listings whose page is worth a visit: a URL of the source's own origin; of each source those that
    ``need`` most, in input order where they tie, ``cap`` at most. Adds ``detail_url``, made absolute."""
    rows = listings.withColumn("detail_url", urls.absolute(F.col(url), F.col(source))).withColumn("_need", need)
    rows = rows.where(F.coalesce(F.col("detail_url") != "", F.lit(False)) & urls.same_origin(F.col("detail_url"), F.col(source)))
    return top_per_group(rows, [source], [F.desc("_need"), F.asc(order)], cap).drop("_need")


def enrich(listings: DataFrame, details: DataFrame, need: Column, cap: int, key: str = "listing_id", url: str = "url", source: str = "source_url", order: str = "ord", detail_key: str = "detail_url") -> DataFrame:
    """``listings`` with what their own pages add, and ``enriched``: true where a page was merged, false
    where it was wanted and is missing, null where none was wanted.

    ``details`` has one row for each URL. Columns of the same name and type are merged, the listing's value first; others
    of the page are added. ``key`` tells listings apart.
    """
    wanted = detail_candidates(listings, need, cap, url, source, order).select(key, "detail_url")
    rest = [f for f in details.schema.fields if f.name != detail_key]
    found = wanted.join(details.select(F.col(detail_key).alias("detail_url"), F.struct(*[f.name for f in rest]).alias("_detail")), "detail_url", "left")
    rows = listings.join(found.select(key, "_detail", F.col("_detail").isNotNull().alias("enriched")), key, "left")
    kinds = {f.name: f.dataType for f in listings.schema.fields}
    merged = {}
    for f in rest:
        new = F.col("_detail")[f.name]
        merged[f.name] = merge.merged_pair(F.col(f.name), new, f.dataType, f.name) if kinds.get(f.name) == f.dataType else new if f.name not in kinds else F.col(f.name)
    return rows.withColumns({n: c for n, c in merged.items() if n not in (key, source, order)}).drop("_detail")


def enrichment_report(enriched: DataFrame, source: str = "source_url") -> DataFrame:
    """Pages attempted and merged, for each source."""
    return enriched.groupBy(source).agg(F.count("enriched").alias("attempted"), F.count_if("enriched").alias("enriched"))


def fill_falsy(listings: DataFrame, details: DataFrame, on: str) -> DataFrame:
    """The older rule: fields that are null, empty, zero or false take the page's value, others stay."""
    falsy = lambda c: c.isNull() | c.cast("string").isin("", "0", "0.0", "-0.0", "false", "NaN")
    extra = {f.name: f.dataType for f in details.schema.fields if f.name != on}
    rows = listings.join(details.select(on, F.struct(*extra).alias("_detail")), on, "left")
    new = lambda n: F.when(~F.coalesce(falsy(F.col("_detail")[n]), F.lit(True)), F.col("_detail")[n])
    own = {n: F.when(falsy(F.col(n)), F.coalesce(new(n), F.col(n))).otherwise(F.col(n)) for n in extra if n in listings.columns}
    return rows.withColumns(own | {n: new(n) for n in extra if n not in listings.columns}).drop("_detail")


def crawl_details(found: DataFrame, details: DataFrame, cap: int, source: str = "source_url", url: str = "url", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Records of the pages that a source's sitemap lists, the first ``cap`` URLs of each, and (source,
    attempted). ``details`` has a row for each page_url; one without a link of its own gets the list's.
    Records of a source with the same key are merged in the order of the list."""
    listed = top_per_group(found.select(source, url, order), [source], [F.asc(order), F.asc(url)], cap)
    own = [F.nullif(F.col(c), F.lit("")) for c in ("url", "permalink", "link") if c in details.columns]
    rows = listed.select(source, F.col(url).alias("page_url"), order).join(details, "page_url").withColumn("url", F.coalesce(*own, "page_url")).drop("page_url")
    keyed = rows.withColumn("_key", F.struct(source, merge.record_key(rows.columns, F.to_json(F.struct(*rows.columns))).alias("k")))
    return merge.merge_by_key(keyed, "_key", order).drop("_key"), listed.groupBy(source).agg(F.count(F.lit(1)).alias("attempted"))


def page_data_url(html: Column, url: Column) -> Column:
    """Where a framework that renders pages ahead keeps a page's data; null for other pages."""
    folder = F.when(urls.path(url) == "", "/").otherwise(urls.path(url))
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(F.coalesce(html.rlike("(?i)gatsby"), F.lit(False)) & urls.is_absolute(url), F.concat(urls.origin(url), F.lit("/page-data"), folder, F.lit("page-data.json")))


def page_data_record(body: Column) -> Column:
    """JSON text of the record in such data: under its usual paths; null where there is none."""
    at = lambda name: F.try_variant_get(F.try_parse_json(body), f"$.result.data.{name}", "variant")
    record = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v))
    return F.coalesce(record(at("strapiProperty")), record(at("property")))
