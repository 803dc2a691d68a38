"""Records collected page by page, as a crawl does that stops when a page brings nothing new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def listing_key(columns: list[str], raw: Column) -> Column:
    """The first of url, title and price that is filled, else the whole record."""
    named = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("url", "title", "price") if c in columns]
    return F.coalesce(*named, raw)


def collect_pages(records: DataFrame, key: Column, source: str = "source", page: str = "page", order: str = "ord", max_pages: int = 20) -> DataFrame:
    """The records that a source's crawl keeps: of each key the first one, and none from the first page on
    that brings no new key, is missing or lies beyond ``max_pages``. Pages count from 1.

    A page before the stop brings something new exactly if some key occurs on it first, so first occurrences
    are one aggregate, and the stop is the first number that is no such page. Keys are never gathered; pages
    of a source are ``max_pages`` at most. Records of one page with the same key are one. A null key is a key.
    """
    rest = [c for c in records.columns if c not in (source,)]
    within = records.where(F.col(page).between(1, max_pages)).withColumn("_key", key)
    firsts = within.groupBy(source, "_key").agg(F.min_by(F.struct(*rest), F.struct(page, order)).alias("_row")).select(source, "_row.*")
    grown = firsts.select(source, page).distinct()
    grown = grown.withColumn("_at", F.row_number().over(Window.partitionBy(source).orderBy(page))).where(F.col("_at") == F.col(page))
    grown = grown.select(F.col(source).alias("_s"), F.col(page).alias("_p"))
    return firsts.join(grown, F.col(source).eqNullSafe(F.col("_s")) & (F.col(page) == F.col("_p")), "left_semi")


def page_growth(collected: DataFrame, source: str = "source", page: str = "page") -> DataFrame:
    """(source, page, added, total): records that each page added, and all up to it."""
    added = collected.groupBy(source, page).agg(F.count(F.lit(1)).alias("added"))
    return added.withColumn("total", F.sum("added").over(Window.partitionBy(source).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)))
