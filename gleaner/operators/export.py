"""Run reports, the export bundle and its files.

Everything about a source is counted in one pass over its rows, by conditional aggregates, and joined to
what its scopes, its latest batch and its recipe tell. Files that belong together are written apart first;
a manifest, put in place last, makes them the ones that readers see.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import blank
from . import merge, quality
from .batch import numbered

MANIFEST = "MANIFEST.json"


def run_report(records: DataFrame, scopes: DataFrame, keys: Sequence[str], fields: Sequence[str] = quality.COVERED) -> DataFrame:
    """One row for each run: how its scopes went (see ``quality.scope_report``), unique_listings, coverage of
    ``fields`` as an array of (field, count, percent), contacts, pictures and readiness.

    ``records`` has the fields, ``contact`` (emails, phones), and may have ``platform`` (images, ready, review): a
    mapped row, null where none was made. If any row of a run is mapped, pictures are those of mapped
    rows. ``_source``, where there is one, stands for the record's own fields of the same name. A run
    without records has zeros, one without scopes null statuses.
    """
    kinds = dict(records.dtypes)
    inside = {f.name for f in records.schema["_source"].dataType.fields} if "_source" in kinds else set()
    own = lambda f: F.when(F.col("_source").isNotNull(), F.col("_source")[f]).otherwise(F.col(f)) if f in inside and f in kinds else F.col(f)
    seen = records.withColumns({f"_f{i}": own(f) for i, f in enumerate(fields)} | {"_contact": own("contact"), "_pictures": own("images")})
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    have = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long") if c is not None else F.lit(0)
    size = lambda c: F.greatest(have(c), F.lit(0))
    mapped = F.col("platform").isNotNull() if "platform" in kinds else F.lit(False)
    ready, review = (F.coalesce(F.col(f"platform.{n}"), F.lit(False)) if "platform" in kinds else F.lit(False) for n in ("ready", "review"))
    plain, drawn = size(F.col("_pictures")), size(F.col("platform.images")) if "platform" in kinds else F.lit(0)
    n_mapped = F.count_if(mapped)
    picture = lambda f: F.when(n_mapped > 0, f(mapped, drawn)).otherwise(f(F.lit(True), plain))
    rows = seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_listings"), *[F.count_if(quality.present(seen, f"_f{i}")).alias(f"_n{i}") for i in range(len(fields))],
        F.count_if(some(F.col("_contact.emails")) | some(F.col("_contact.phones"))).alias("with_any_contact"),
        F.count_if(some(F.col("_contact.emails"))).alias("with_email"), F.count_if(some(F.col("_contact.phones"))).alias("with_phone"),
        F.count_if(review).alias("needs_review"), F.count_if(mapped & ready).alias("import_ready"), F.when(n_mapped > 0, F.count_if(mapped & ~ready)).alias("blocked_from_import"),
        picture(lambda on, n: F.count_if(on & (n > 0))).alias("with_images"), picture(lambda on, n: F.count_if(on & (n == 0))).alias("without_images"),
        picture(lambda on, n: F.coalesce(F.sum(F.when(on, n)), F.lit(0))).alias("total_images"), picture(lambda on, n: F.coalesce(F.round(F.avg(F.when(on, n)), 1), F.lit(0.0))).alias("average_images"),
    )
    percent = lambda c: F.round(c * 100 / F.col("unique_listings"), 1)
    coverage = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_n{i}").alias("count"), percent(F.col(f"_n{i}")).alias("percent")) for i, f in enumerate(fields)])
    rows = rows.withColumn("field_coverage", coverage).drop(*[f"_n{i}" for i in range(len(fields))])
    out = rows.join(quality.scope_report(scopes, keys), [*keys], "full")
    empty = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("percent")) for f in fields])
    zero = {c: F.coalesce(c, F.lit(0).cast(t)) for c, t in rows.dtypes if c not in (*keys, "field_coverage", "blocked_from_import")}
    return out.withColumns(zero | {"field_coverage": F.coalesce("field_coverage", empty)})


def report_path(out_file: str) -> str:
    """Where the report of an output file goes: beside it."""
    folder, name = posixpath.split(out_file)
    return posixpath.join(folder, f"{posixpath.splitext(name)[0]}.report.json")


def import_payload(platform: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, the platform's 27 fields and its own six, those that are missing null."""
    kind = {**dict.fromkeys(quality.STRING_FIELDS, "string"), **dict.fromkeys(quality.NUMBER_FIELDS, "double"), **dict.fromkeys(quality.ARRAY_FIELDS, "array<string>")}
    kind |= {n: "string" if n in ("salesPlatform", "profilePicture") else "boolean" for n in (*quality.SYSTEM_FIELDS, "salesPlatform")}
    return platform.select(*keys, *[(F.col(n) if n in platform.columns else F.lit(None)).cast(t).alias(n) for n, t in kind.items()])


def platform_only(records: DataFrame, platform: str = "platform") -> DataFrame:
    """The platform rows of records alone, all fields null where a record has none."""
    return records.select(f"{platform}.*")


def gated(mapped: DataFrame, source_url: str = "sourceUrl") -> DataFrame:
    """Adds ``issues``, what stops a row from being exported, and ``ready``: nothing does."""
    return mapped.withColumn("issues", quality.export_issues(source_url)).withColumn("ready", F.size("issues") == 0)


def ready_rows(gate: DataFrame, source: str, url: str = "sourceUrl", order: str = "position") -> DataFrame:
    """Ready rows of each source, the last one of each listing URL, at the place of the first."""
    return merge.last_wins(gate.where("ready").withColumn("_at", F.col(order)), [source, url], "_at").drop(order).withColumnRenamed("_at", order)


def combined_rows(ready: DataFrame, place: Column) -> DataFrame:
    """Ready rows of all sources, the last one of each seller, address and price, in the order of first ones."""
    text = lambda c: F.coalesce(c, F.lit("null"))
    key = F.lower(F.concat_ws("|", text(F.col("salesPlatform")), text(F.col("address")), text(numbers.number_text(F.col("price")))))
    return merge.last_wins(ready.withColumn("_key", key).withColumn("_place", place), ["_key"], "_place").drop("_key").withColumnRenamed("_place", "place")


def contacts_by(rows: DataFrame, source: str, contact: str = "contact", order: str = "position") -> DataFrame:
    """Names, emails and phones of each source, each once, in the order in which they are met. Values are
    counted before they are gathered, so a source's list is as long as what it tells."""
    out = rows.select(source).distinct()
    for field in ("names", "emails", "phones"):
        values = rows.select(source, order, F.posexplode(F.col(contact)[field]).alias("_i", "_v")).where(~blank(F.col("_v")))
        firsts = values.groupBy(source, "_v").agg(F.min(F.struct(order, "_i")).alias("_at"))
        lists = firsts.groupBy(source).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(field))
        out = out.join(lists.withColumnRenamed(source, "_s"), F.col(source).eqNullSafe(F.col("_s")), "left").drop("_s")
        out = out.withColumn(field, F.coalesce(field, F.array().cast("array<string>")))
    return out


def source_report(sources: DataFrame, batches: DataFrame, recipes: DataFrame, gate: DataFrame, ready: DataFrame, source: str = "source_url", host: str = "host") -> DataFrame:
    """A row for each configured source: what its latest batch holds and what of it can be exported.

    ``sources``: (source, host). ``batches``: (source, job, saved_at, raw_count) of the latest batch; ``recipes``: (host) that
    have one. A source that lacks either is blocked, and ``reason`` says which; its whole batch counts as
    blocked. ``gate`` has (source, issues, ready) of mapped rows, ``ready`` the rows that are exported.
    """
    size = F.coalesce(F.size("images"), F.lit(0)).cast("long")
    counts = gate.groupBy(source).agg(F.count_if(~F.col("ready")).alias("n_blocked"))
    shown = ready.groupBy(source).agg(F.count(F.lit(1)).alias("n_ready"), F.sum(size).alias("total_images"), F.round(F.avg(size), 1).alias("average_images"), F.max(size).alias("maximum_images"))
    why = gate.where("not ready").select(source, F.explode("issues").alias("issue")).groupBy(source, "issue").agg(F.count(F.lit(1)).alias("count"))
    why = why.groupBy(source).agg(F.array_sort(F.collect_list(F.struct("issue", "count"))).alias("blocked_reasons"))
    told = sources.join(batches, source, "left").join(recipes.select(host).distinct().withColumn("_recipe", F.lit(True)), host, "left")
    told = told.join(counts, source, "left").join(shown, source, "left").join(why, source, "left")
    no_batch, no_recipe = F.col("raw_count").isNull(), F.col("_recipe").isNull()
    number = lambda c: F.when(no_batch | no_recipe, F.lit(0).cast("long")).otherwise(F.coalesce(c, F.lit(0).cast("long")))
    raw = F.coalesce("raw_count", F.lit(0).cast("long"))
    told = told.withColumns({
        "reason": F.when(no_batch, "No usable raw listings were recovered from the live source.").when(no_recipe, "No reviewed mapping recipe is available."),
        "raw_count": raw, "ready_count": number(F.col("n_ready")), "blocked_count": F.when(no_batch | no_recipe, raw).otherwise(F.coalesce("n_blocked", F.lit(0).cast("long"))),
        "total_images": number(F.col("total_images")), "maximum_images": number(F.col("maximum_images")), "average_images": F.when(no_batch | no_recipe, 0.0).otherwise(F.coalesce("average_images", F.lit(0.0))),
        "blocked_reasons": F.when(~no_batch & ~no_recipe, F.coalesce("blocked_reasons", F.array().cast("array<struct<issue:string,count:bigint>>"))),
    })
    status = F.when(F.col("reason").isNotNull(), "blocked").when(F.col("blocked_count") == 0, "ready").when(F.col("ready_count") > 0, "partial").otherwise("blocked")
    return told.withColumn("status", status).drop("_recipe", "n_ready", "n_blocked")


def export_totals(report: DataFrame, combined: DataFrame) -> DataFrame:
    """One row over all sources."""
    totals = report.agg(
        F.count(F.lit(1)).alias("sources_requested"), F.count_if(F.col("ready_count") > 0).alias("sources_with_ready_data"),
        F.coalesce(F.sum("raw_count"), F.lit(0)).alias("raw_records_assessed"), F.coalesce(F.sum("blocked_count"), F.lit(0)).alias("blocked_records"),
    )
    rows = combined.agg(F.count(F.lit(1)).alias("porting_ready_records"), F.coalesce(F.sum(F.coalesce(F.size("images"), F.lit(0))), F.lit(0)).alias("images"))
    return totals.crossJoin(rows)  # one row each


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def write_bundle(spark: SparkSession, path: str, parts: dict[str, DataFrame], partition_by: dict[str, str] | None = None) -> str:
    """Writes ``parts`` as JSON lines below a folder of their own in ``path`` and, when all are there, a manifest that
    names them; returns the folder. Readers follow the manifest, so a bundle is seen whole or not at all: a
    write that fails leaves the one before. ``partition_by`` splits a part into a folder for each value."""
    folder = f"bundle-{uuid.uuid4().hex}"
    for name, df in parts.items():
        writer = df.write
        if column := (partition_by or {}).get(name):
            writer = writer.partitionBy(column)
        writer.json(f"{path}/{folder}/{name}")
    told = {"folder": folder, "parts": {name: df.schema.jsonValue() for name, df in parts.items()}}
    fs, at = _fs(spark, path)
    new = at(f"{path}/{folder}/{MANIFEST}")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(new, at(f"{path}/{MANIFEST}"), options)
    return f"{path}/{folder}"


def read_bundle(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A part of the bundle that the manifest names."""
    from pyspark.sql.types import StructType

    told = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/{MANIFEST}").collect()))
    return spark.read.schema(StructType.fromJson(told["parts"][name])).json(f"{path}/{told['folder']}/{name}")


def write_json_array(df: DataFrame, path: str, order: Sequence[str]) -> int:
    """Writes rows, in order, as text files whose bytes, joined in the order of their names, are one JSON array;
    returns the number of rows. Each task writes its range. Without rows there is no file but an error."""
    rows = numbered(df, [], order, "_at")
    n = rows.count()
    if not n:
        raise ValueError("no records to download")
    one = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    line = F.concat(F.when(F.col("_at") == 0, "[\n").otherwise(""), one, F.when(F.col("_at") == n - 1, "\n]").otherwise(","))
    rows.select("_at", line.alias("value")).orderBy("_at").select("value").write.text(path)
    return n


def save_records(df: DataFrame, path: str, slice_: dict[str, object], order: Sequence[str]) -> int:
    """Saves ``df`` as the slice of the table at ``path`` that ``slice_`` names (its partition columns and their values), in
    place of what it holds, with dense positions from 0 in ``order``; returns the number of rows.

    Positions are written once, before the slice is; the slice's files are staged and moved when all are there,
    so a failure at any point leaves the old slice. No rows empty it. Other slices are not touched.
    """
    rows = numbered(df.drop(*slice_), [], order, "position")
    n = rows.count()
    keys = [*slice_]
    if not n:
        fs, at = _fs(df.sparkSession, path)
        fs.delete(at("/".join([path, *[f"{k}={v}" for k, v in slice_.items()]])), True)
        return 0
    rows = rows.withColumns({k: F.lit(v) for k, v in slice_.items()})
    rows.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return n
