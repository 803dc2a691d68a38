"""Model answers as an input table: JSON found in prose, typed and checked, failures kept as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import listing, numbers
from ..functions.text import filled
from .quality import ARRAY_FIELDS, NUMBER_FIELDS, STRING_FIELDS


def answer_json(content: Column) -> Column:
    """The answer as a variant: without a code fence, else from the first brace to the last."""
    bare = F.trim(F.regexp_replace(content, r"(?is)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    object_only = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.nullif(object_only, F.lit(""))))


def validate(records: DataFrame, responses: DataFrame, key: str = "record_key") -> DataFrame:
    """A platform row for each record: typed fields, purpose and currency by rule, confidence within 0
    and 1, warnings; records without a usable answer have confidence 0 and need review."""
    rows = records.select(key).join(responses, key, "left").withColumn("_v", answer_json(F.col("content")))
    root = F.when(F.try_variant_get("_v", "$.data", "variant").isNotNull(), F.try_variant_get("_v", "$.data", "variant")).otherwise(F.col("_v"))
    rows = rows.withColumn("_d", F.when(F.schema_of_variant(root).startswith("OBJECT"), root))
    out = {}
    for f in STRING_FIELDS:
        out[f] = filled(F.try_variant_get("_d", f"$.{f}", "string"))
    for f in NUMBER_FIELDS:
        out[f] = numbers.first_number(F.try_variant_get("_d", f"$.{f}", "string"))
    for f in ARRAY_FIELDS:
        kept = F.filter(F.transform(F.try_variant_get("_d", f"$.{f}", "array<string>"), filled), lambda x: x.isNotNull())
        out[f] = F.when(F.size(kept) > 0, kept)
    bad_currency = out["currency"].isNotNull() & ~F.upper(out["currency"]).rlike("^[A-Z]{3}$")
    out["purpose"] = F.coalesce(listing.purpose(out["purpose"]), F.lit("unknown"))
    out["currency"] = F.when(~bad_currency, F.upper(out["currency"]))
    told = F.try_variant_get("_v", "$.confidence", "string").try_cast("double")
    failed = F.col("_d").isNull()
    out["confidence"] = F.when(failed | told.isNull() | F.isnan(told), 0.0).otherwise(F.least(F.greatest(told, F.lit(0.0)), F.lit(1.0)))
    out["status"] = F.when(failed, "failed").otherwise("normalized")
    out["warnings"] = F.array_compact(F.array(F.when(bad_currency, F.lit("invalid currency")), F.when(failed, F.lit("no valid answer"))))
    return rows.withColumns(out).select(key, *STRING_FIELDS, *NUMBER_FIELDS, *ARRAY_FIELDS, "confidence", "status", "warnings", (F.col("confidence") < 0.8).alias("requires_review"))
