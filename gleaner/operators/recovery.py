"""Mapped platform rows made whole: what is missing is recovered from the listing, texts and pictures are cleaned,
and the row is told fit for import or not, with the reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality
from .normalise import derive_platform, read_records, source_envelope, system_defaults

FIELDS = [*quality.STRING_FIELDS, *quality.NUMBER_FIELDS, *quality.ARRAY_FIELDS]
#: Confidence from which a row is published without review.
CONFIDENT = 0.8


def recover_platform(listings: DataFrame, platform: str = "platform", raw: str = "raw", keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, the platform's 27 fields, its own six, _source and _normalization of canonical ``listings`` that have a
    mapped row in ``platform``: a struct of some of the fields, status, confidence, model, unmapped and warnings.

    Fields that the mapped row lacks come from the listing and its raw record, but for an unknown purpose, and are
    named in recoveredFields; then all are cleaned. missingFields are those that are null in the end,
    criticalMissing what an import needs. A null ``platform`` is recovered whole, with confidence 0.
    """
    df = listings if "_record" in listings.columns else listings.withColumn("_record", read_records(F.col(raw)))
    df, derived = derive_platform(df)
    have = {f.name for f in listings.schema[platform].dataType.fields}
    kind = {**dict.fromkeys(quality.STRING_FIELDS, "string"), **dict.fromkeys(quality.NUMBER_FIELDS, "double"), **dict.fromkeys(quality.ARRAY_FIELDS, "array<string>")}
    told = lambda n, t: (F.col(platform)[n] if n in have else F.lit(None)).cast(t)
    rows = df.select(
        *keys, *[told(n, t).alias(n) for n, t in kind.items()], *[derived.get(n, F.lit(None)).cast(t).alias(f"_d_{n}") for n, t in kind.items()],
        *[c.alias(n) for n, c in system_defaults(F.col("sourceSiteUrl")).items()], source_envelope(F.col("_record.entries"), raw).alias("_source"), F.col("sourceUrl").alias("_url"),
        F.coalesce(told("status", "string"), F.lit("missing")).alias("_status"), F.coalesce(told("confidence", "double"), F.lit(0.0)).alias("_confidence"), told("model", "string").alias("_model"),
        *[F.coalesce(told(n, "array<string>"), F.array().cast("array<string>")).alias(f"_{n}") for n in ("unmapped", "warnings")],
    )
    rows = quality.recover(rows, {n: F.col(f"_d_{n}") for n in kind}).drop(*[f"_d_{n}" for n in kind])
    rows = quality.sanitise(rows)
    rows = rows.withColumn("_critical", quality.missing_import_fields(rows, "_url"))
    failed = F.col("_status") == "failed"
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in kind]))
    normalization = F.struct(
        F.col("_status").alias("status"), F.col("_model").alias("model"), F.col("_confidence").alias("confidence"),
        ((F.col("_confidence") < CONFIDENT) | (F.size("_critical") > 0) | failed).alias("requiresReview"), missing.alias("missingFields"), F.col("_critical").alias("criticalMissing"),
        F.col("_unmapped").alias("unmappedFields"), F.col("_warnings").alias("warnings"), "recoveredFields",
        F.transform("_critical", lambda f: F.concat(F.lit("Missing import-required field: "), f)).alias("qualityIssues"), F.greatest(F.coalesce(F.size("images"), F.lit(0)), F.lit(0)).alias("imageCount"),
        ((F.size("_critical") == 0) & (F.col("_confidence") >= CONFIDENT) & ~failed).alias("publishReady"),
    )
    return rows.withColumn("_normalization", normalization).select(*keys, *kind, *system_defaults(F.lit("")), "_source", "_normalization")
