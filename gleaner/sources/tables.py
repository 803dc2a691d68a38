"""Sources and sinks: parquet tables, captured payloads, recipe and listing files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETRY_STATUS = [408, 425, 429, 500, 502, 503, 504]
MAX_CAPTURE = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retryable(status):
    return status.isin(RETRY_STATUS)


def captured_json(payloads: DataFrame) -> DataFrame:
    """XHR and fetch responses that parse: no errors, no more than MAX_CAPTURE bytes, prefix stripped."""
    body = F.regexp_replace("body", r"^\)\]\}',?\s*", "")
    kept = payloads.where(F.col("resource_type").isin("xhr", "fetch") & (F.col("status") < 400) & (F.octet_length("body") <= MAX_CAPTURE))
    return kept.withColumn("body", body).where(F.try_parse_json("body").isNotNull())


def read_listing_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, ord, raw) of every *-listings.json: a JSON array each."""
    whole = spark.read.option("wholetext", True).option("pathGlobFilter", "*-listings.json").text(folder).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.from_json("value", "array<variant>")).alias("ord", "v")).select("file", "ord", F.to_json("v").alias("raw"))


def read_recipes(spark: SparkSession, folder: str) -> list:
    """The recipes of a folder, one JSON file a host. Their number is that of configured sites."""
    from ..operators.recipes import Recipe

    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder).select(F.input_file_name().alias("f"), "value").collect()
    return [Recipe.parse(r.f.rsplit("/", 1)[-1].removesuffix(".json"), json.loads(r.value)) for r in rows]


def write_listings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
