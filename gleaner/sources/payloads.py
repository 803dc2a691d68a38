"""Captured payloads: which hold listings, where in them, and which of them belong together.

Payloads are rows of (url, method, status, resource_type, body, ord), in the order in which they came. Shape
scores walk the text in a worker; paths, arrays and groups are found in the JVM, on variants for types and
on the text for the order of keys, which a variant does not keep.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import merge
from .json_shapes import _load, best_records, redact

#: Limits of a body, in bytes, on a page and in discovery; score that a page's payload needs.
PAGE_BYTES, DISCOVERY_BYTES, PAGE_SCORE = 4_000_000, 12_000_000, 4
#: Limits of what a model is sent: characters in all, of a description that stands for the rest, of one text.
MODEL_INPUT, MODEL_DESCRIPTION, PROMPT_TEXT = 45_000, 8_000, 2_000
DEPTH = 8


def shape(body: Column) -> Column:
    """struct<score, path, n, keys> of the record set in a JSON body that looks most like listings; null for
    what is no JSON."""

    @F.pandas_udf("score int, path string, n int, keys array<string>")
    def run(bodies: pd.Series) -> pd.DataFrame:
        out = []
        for text in bodies:
            value = _load(text)
            score, path, records = best_records(value)
            out.append((score, path, len(records), [*records[0]] if records else []) if value is not None else (None, None, None, None))
        return pd.DataFrame(out, columns=["score", "path", "n", "keys"])

    return run(body)


def _told(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_shape", shape(F.col("body"))).select(*rows.columns, "_shape.*")


def page_payloads(payloads: DataFrame) -> DataFrame:
    """What a page's own requests brought: no errors, no large bodies, listings with ``PAGE_SCORE`` groups."""
    own = F.lower("resource_type").isin("xhr", "fetch") & (F.col("status") < 400) & (F.octet_length("body") <= PAGE_BYTES)
    return _told(payloads.where(own)).where((F.col("score") >= PAGE_SCORE) & (F.col("n") > 0))


def rank_endpoints(payloads: DataFrame) -> DataFrame:
    """Discovery: of each endpoint the payload with the highest score, the first of several; the best endpoints
    first, those that tie in the order of their first payloads."""
    fit = _told(payloads.where((F.col("status") < 400) & (F.octet_length("body") <= DISCOVERY_BYTES))).where("score > 0")
    best = fit.groupBy("url").agg(F.min("ord").alias("first"), F.max_by(F.struct("method", "score", "path", "n", "keys"), F.struct("score", -F.col("ord"))).alias("_b"))
    return best.select("url", "first", "_b.*").orderBy(F.desc("score"), "first")


def matching(payloads: DataFrame, match: str) -> DataFrame:
    """Payloads whose URL contains ``match`` and that hold listings at all, the best first."""
    fit = payloads.where(F.col("url").contains(match) & (F.octet_length("body") <= DISCOVERY_BYTES))
    return _told(fit).where("score > 0").orderBy(F.desc("score"), "ord")


def _turn(text: Column, key: Column) -> Column:
    """Place of a key as a script walks an object: whole numbers first, by size, then the others as they stand."""
    number = F.when(key.rlike(r"^(?:0|[1-9]\d{0,8})$"), key.try_cast("long"))
    return F.coalesce(number, F.lit(1 << 33) + F.array_position(F.json_object_keys(text), key))


def arrays_in(payloads: DataFrame, key: str, body: str = "body", depth: int = DEPTH) -> DataFrame:
    """(key, at, path, n, keys, items): every array that objects lead to, ``depth`` levels down at most, with the keys
    of its first object and its items as JSON. ``at`` orders a payload's arrays as a walk meets them.
    What is inside an array is not walked. Null, broken and scalar bodies have none."""
    spark = payloads.sparkSession
    rows = payloads.select(F.col(key).alias("_k"), F.regexp_replace(body, r"^\)\]\}',?\s*", "").alias("text"), F.lit("").alias("path"), F.array().cast("array<bigint>").alias("at"))
    level, found = rows.withColumn("v", F.try_parse_json("text")).where("v is not null"), None
    for _ in range(depth + 1):
        kind = F.schema_of_variant("v")
        arrays = level.where(kind.startswith("ARRAY"))
        found = arrays if found is None else found.unionByName(arrays)
        inside = level.where(kind.startswith("OBJECT")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        inside = inside.where(F.schema_of_variant("value").rlike("^(?:ARRAY|OBJECT)"))
        level = inside.select(
            "_k", F.try_element_at(F.from_json("text", "map<string,string>"), F.col("key")).alias("text"), F.concat_ws(".", F.nullif("path", F.lit("")), "key").alias("path"),
            F.concat("at", F.array(_turn(F.col("text"), F.col("key")))).alias("at"), F.col("value").alias("v"),
        )
    items = F.try_variant_get("v", "$", "array<variant>")
    first = F.get(F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT")), F.lit(0))
    return found.select(F.col("_k").alias(key), "at", F.coalesce(F.nullif("path", F.lit("")), F.lit("(root array)")).alias("path"), F.size(items).alias("n"), F.json_object_keys(F.to_json(first)).alias("keys"), F.from_json("text", "array<string>").alias("items"))


def array_with_keys(payloads: DataFrame, key: str, wanted: list[str], body: str = "body", depth: int = DEPTH) -> DataFrame:
    """(key, path, n, items): of each payload the first array whose first object has all ``wanted`` keys."""
    fit = arrays_in(payloads, key, body, depth).where(F.col("keys").isNotNull() & (F.size(F.array_except(F.array(*map(F.lit, wanted)), "keys")) == 0))
    return fit.groupBy(key).agg(F.min_by(F.struct("path", "n", "items"), "at").alias("_a")).select(key, "_a.*")


def schema_groups(candidates: DataFrame, page: str = "page", candidate: str = "candidate", order: str = "ord") -> DataFrame:
    """(page, signature, score, n, candidate, ord, raw): the records of the group that a page's batches form best.

    Batches whose first records have the same keys, in any order, are a group; its score is the best of its batches', its
    records are those of all of them, in order, one for each record key (the first). The group
    with the highest score wins, then the larger one, then the one that came first.
    """
    # A batch's signature is an aggregate, so a batch of any size is read by many tasks.
    sample = candidates.groupBy(page, candidate).agg(F.min_by("raw", order).alias("_sample"), F.max("score").alias("_score"))
    signed = sample.select(F.col(page).alias("_p"), F.col(candidate).alias("_c"), "_score", F.array_join(F.array_sort(F.coalesce(F.json_object_keys("_sample"), F.array().cast("array<string>"))), "|").alias("signature"))
    rows = candidates.join(signed, F.col(page).eqNullSafe(F.col("_p")) & F.col(candidate).eqNullSafe(F.col("_c")))
    names = [*merge.KEY_FIELDS, "addressWithCommas", "address", "displayAddress", "title", "priceValue", "price"]
    fields = rows.select(page, "signature", "_score", F.struct(candidate, order).alias("_at"), "raw", *[F.get_json_object("raw", f"$.{n}").alias(n) for n in names])
    keyed = fields.select(page, "signature", "_score", "_at", "raw", merge.record_key(names, F.col("raw")).alias("_key"))
    unique = keyed.groupBy(page, "signature", "_key").agg(F.min_by("raw", "_at").alias("raw"), F.min("_at").alias("_at"), F.max("_score").alias("_score"))
    groups = unique.groupBy(page, "signature").agg(F.max("_score").alias("score"), F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    best = groups.groupBy(page).agg(F.min_by(F.struct("signature", "score", "n"), F.struct(-F.col("score"), -F.col("n"), "_first")).alias("_b"))
    best = best.select(F.col(page).alias("_p"), F.col("_b.signature").alias("_s"), F.col("_b.score").alias("score"), F.col("_b.n").alias("n"))
    out = unique.join(best, F.col(page).eqNullSafe(F.col("_p")) & (F.col("signature") == F.col("_s")))
    return out.select(page, "signature", "score", "n", f"_at.{candidate}", f"_at.{order}", "raw")


def model_input(normalised: Column, raw: Column) -> Column:
    """What a model is sent of a listing: its fields and its record, both JSON text, without personal data. More than
    ``MODEL_INPUT`` characters are not sent: then the record's description stands for it."""
    plain = lambda c: F.coalesce(redact(c), F.lit("{}"))

    def told(x: Column) -> Column:
        whole = F.concat(F.lit('{"currentNormalized":'), x["n"], F.lit(',"sourceRecord":'), x["r"], F.lit("}"))
        short = F.to_json(F.struct(F.substring(F.coalesce(F.get_json_object(x["r"], "$.description"), F.lit("")), 1, MODEL_DESCRIPTION).alias("description")))
        cut = F.concat(F.lit('{"currentNormalized":'), x["n"], F.lit(',"sourceRecord":'), short, F.lit(',"warning":"Source record was truncated before being sent to the model."}'))
        return F.when(F.length(whole) <= MODEL_INPUT, whole).otherwise(cut)

    return F.get(F.transform(F.array(F.struct(plain(normalised).alias("n"), plain(raw).alias("r"))), told), F.lit(0))


def prompt_record(raw: Column) -> Column:
    """A raw record, JSON text, as an example in a prompt: what a search engine added goes, long texts of its
    own keys are cut, personal data goes. Null where it is no object."""
    dropped = ["_highlightResult", "_rankingInfo", "_distinctSeqID", "platform"]
    text = lambda v: F.try_variant_get(v, "$", "string")
    long = lambda v: (F.schema_of_variant(v) == "STRING") & (F.length(text(v)) > PROMPT_TEXT)
    quoted = lambda s: F.regexp_replace(F.to_json(F.array(s)), r"(?s)^\[|\]$", "")
    value = lambda v: F.when(long(v), quoted(F.concat(F.substring(text(v), 1, PROMPT_TEXT), F.lit("…")))).otherwise(F.to_json(v))
    fields = F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>")
    kept = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(dropped))
    told = F.transform(kept, lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.coalesce(value(e["value"]), F.lit("null"))))
    return redact(F.when(fields.isNotNull(), F.concat(F.lit("{"), F.array_join(told, ","), F.lit("}"))))
