"""Gates, recovery, sanitising and coverage reports over listings and platform rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import PAGE_NOISE, STATUS_ONLY_TITLE, UI_TITLE, blank, clean_text

#: The platform row. Field names, by type.
STRING_FIELDS = ["title", "purpose", "location", "address", "landmark", "radius", "city", "typeOfProperty", "size", "tenureOfProperty", "description", "currency", "video_link", "virtual_tour_link", "subType"]
NUMBER_FIELDS = ["price", "bedrooms", "bathrooms", "toilets", "livingRoom", "amount", "minimum_offer", "PCM", "PCW"]
ARRAY_FIELDS = ["images", "add_features", "floorPlan"]
SYSTEM_FIELDS = {"justAddedExpiration": False, "isPaid": False, "isSold": False, "isArchive": False, "profilePicture": None}
COVERED = ["id", "title", "price", "currency", "address", "bedrooms", "bathrooms", "images", "description", "sourceUrl"]
IMAGE_NOISE = r"(?i)%3e\d+:https?:|https?://[^/]+/https?://|blank\.gif|broadbandavailability|broadband(?:uk)?[-_]?badge"
EXPORT_TITLE_NOISE = r"(?i)properties?\s+archive|search\s+results?|\.st\d+\s*\{|fill\s*:|<svg|@keyframes"


def present(df_or_types, name: str) -> Column:
    """Not null, not an empty text, not an empty array."""
    kind = dict(df_or_types.dtypes)[name]
    if kind.startswith("array"):
        return F.coalesce(F.size(name) > 0, F.lit(False))
    return F.col(name).isNotNull() & (F.col(name) != "") if kind == "string" else F.col(name).isNotNull()


def is_usable(df: DataFrame) -> Column:
    """Names something, is no control of a page, and has a price or pictures with a detail."""
    title = F.trim(F.coalesce("title", F.lit("")))
    named = (title != "") | (F.trim(F.coalesce("address", F.lit(""))) != "")
    priced = F.trim(F.coalesce(F.col("price").cast("string"), F.lit(""))) != ""
    detail = present(df, "description") | present(df, "bedrooms") | present(df, "propertyType")
    return ~title.rlike(UI_TITLE) & named & (priced | (present(df, "images") & detail))


def missing_import_fields(df: DataFrame, source_url: str = "sourceUrl") -> Column:
    """Names of what an import still needs, in a fixed order."""
    checks = [(f, present(df, f) & (F.col(f).cast("string") != "unknown")) for f in ("title", "purpose", "price", "currency", "typeOfProperty", "description")]
    checks += [("address", present(df, "address") | present(df, "location")), ("images", present(df, "images")), ("sourceUrl", present(df, source_url))]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks]))


def export_issues(source_url: str = "sourceUrl") -> Column:
    """What stops a row from being exported; purpose and confidence do not matter here."""
    no = lambda c: F.coalesce(c, F.lit(True))
    pictures = F.coalesce(F.size("images") > 0, F.lit(False))
    checks = [
        ("invalid title", no(blank(F.col("title")) | F.col("title").rlike(EXPORT_TITLE_NOISE))),
        ("missing address/location", blank(F.col("address")) & blank(F.col("location"))),
        ("missing/invalid price", no(~(F.col("price") > 0))),
        ("missing currency", blank(F.col("currency"))),
        ("missing/schematic property type", no(blank(F.col("typeOfProperty")) | (F.col("typeOfProperty") == "RealEstateListing"))),
        ("missing/short description", no(F.length("description") < 40)),
        ("missing images", ~pictures),
        ("invalid/noisy image URL", pictures & F.exists("images", lambda u: ~u.rlike("(?i)^https?://") | u.rlike(IMAGE_NOISE))),
        ("missing source listing URL", no(~F.col(source_url).rlike("(?i)^https?://"))),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks]))


def requires_review(confidence: Column, missing: Column, failed: Column) -> Column:
    return F.coalesce(confidence < 0.8, F.lit(True)) | (F.size(missing) > 0) | F.coalesce(failed, F.lit(False))


def recover(df: DataFrame, fallback: dict[str, Column]) -> DataFrame:
    """Fills empty fields of ``df`` from ``fallback`` and names them in recoveredFields. A purpose that
    is unknown counts as there, an unknown fallback as missing."""
    took = []
    for name, value in fallback.items():
        usable = F.when(value.cast("string") != "unknown", value)
        took.append((name, ~present(df, name) & usable.isNotNull(), F.when(present(df, name), F.col(name)).otherwise(usable)))
    names = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t, _ in took]))
    return df.withColumns({"recoveredFields": names, **{n: v for n, _, v in took}})


def sanitise(df: DataFrame) -> DataFrame:
    """Cleans texts and pictures, moves floor plans out of the pictures, and lets address and location
    stand in for each other and for a title that only tells a status."""
    have = set(df.columns)
    df = df.withColumns({c: clean_text(F.col(c), c) for c in STRING_FIELDS if c in have})
    df = df.withColumns({c: urls.clean_images(F.col(c)) for c in ("images", "floorPlan") if c in have})
    if "add_features" in have:
        kept = F.array_distinct(F.filter(F.transform("add_features", lambda x: clean_text(x)), lambda x: x.isNotNull()))
        df = df.withColumn("add_features", F.when(F.size(kept) > 0, kept))
    if {"images", "floorPlan"} <= have:
        plan = F.filter("images", lambda u: u.rlike(urls.FLOOR_PLAN))
        rest = F.filter("images", lambda u: ~u.rlike(urls.FLOOR_PLAN))
        moved = urls.clean_images(F.concat(F.coalesce("floorPlan", F.array().cast("array<string>")), plan))
        df = df.withColumns({"floorPlan": F.when(F.size(plan) > 0, moved).otherwise(F.col("floorPlan")), "images": F.when(F.size(rest) > 0, rest)})
    if {"title", "address", "location"} <= have:
        df = df.withColumns({"address": F.coalesce("address", "location"), "location": F.coalesce("location", "address")})
        bare = F.col("title").isNull() | F.col("title").rlike(STATUS_ONLY_TITLE)
        df = df.withColumn("title", F.when(bare, F.coalesce("address", "location")).otherwise(F.col("title")))
    return df


def field_coverage(df: DataFrame, fields: Sequence[str] = COVERED) -> DataFrame:
    """(field, count, percent) in the order of ``fields``, from one pass over the rows."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(present(df, f)).alias(f"_{i}") for i, f in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{i}").alias("count")) for i, f in enumerate(fields)])
    told = counts.select("_n", F.explode(rows).alias("r")).select("r.*", "_n")
    return told.select("field", "count", F.when(F.col("_n") > 0, F.round(F.col("count") * 100 / F.col("_n"), 1)).otherwise(0.0).alias("percent"))


def array_coverage(df: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """For each name and array column: rows with, rows without, all values and their mean a row."""
    aggs = []
    for name, c in arrays.items():
        n = F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
        aggs += [F.count_if(n > 0).alias(f"with_{name}"), F.count_if(n == 0).alias(f"without_{name}"), F.coalesce(F.sum(n.cast("long")), F.lit(0)).alias(f"total_{name}"), F.coalesce(F.round(F.avg(n), 1), F.lit(0.0)).alias(f"average_{name}")]
    return df.agg(*aggs)


def readiness(missing: str, review: Column) -> list[Column]:
    """Aggregates: rows to review, ready for import and blocked (null where nothing was mapped)."""
    ready = F.size(missing) == 0
    return [F.count_if(review).alias("needs_review"), F.count_if(ready).alias("import_ready"), F.when(F.count(F.lit(1)) > 0, F.count_if(~ready)).alias("blocked_from_import")]


def scope_report(scopes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Status and totals of a run's scopes (status, complete, expected): a failed scope makes the run
    partial, an unfinished one incomplete. Several scopes may overlap, so only one expects a total."""
    failed, open_ = F.count_if(F.col("status") == "failed"), F.count_if(~F.coalesce("complete", F.lit(True)))
    total = F.nullif(F.coalesce(F.sum(F.col("expected").cast("long")), F.lit(0)), F.lit(0))
    return scopes.groupBy(*keys).agg(
        F.when(failed > 0, "partial").when(open_ > 0, "incomplete").otherwise("complete").alias("status"),
        F.when(F.count(F.lit(1)) == 1, total).alias("expected_listings"), total.alias("expected_reported"),
        F.count_if((F.col("status") == "complete") & F.coalesce("complete", F.lit(True))).alias("scopes_completed"),
        open_.alias("scopes_incomplete"), failed.alias("scopes_failed"),
    )


def page_title_noise(c: Column) -> Column:
    return F.coalesce(c.rlike(PAGE_NOISE), F.lit(False))
