"""URL filter: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

Native: DataFrame functions only. Each distinct (host, path) expands into the pairs of its host's
suffixes at label borders and of its path's prefixes of the lengths that rules have. A pair's
SHA-256 is joined to the rules' on its first 32 bits; the whole digest then confirms the match, and
the longest rule wins (ties: the longer host, then the larger text; of one rule with both verdicts, block).

A null url, or one without ``://``, has an empty host and path, fits no rule and gets the default
verdict. Repeated rows each get a row. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_az

#: Fixed values: (verdict, host, path prefix).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
DEFAULT_VERDICT = "allow"
PREFIX_HEX = 8
#: Rule tables up to this many rows are broadcast; larger ones are shuffled on the hash prefix.
BROADCAST_RULES = 10_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = lower_az(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    df = spark.createDataFrame([tuple(r) for r in rules], "verdict string, rule_host string, rule_path string")
    digest = F.sha2(F.concat(F.col("rule_host"), F.col("rule_path")), 256)
    return df.select("verdict", F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("host_len"), digest.alias("digest"), F.substring(digest, 1, PREFIX_HEX).alias("short"))


def judge_urls(pages: DataFrame, rules: DataFrame, path_lengths: list[int], n_rules: int, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``path_lengths``: the lengths of the rules' paths."""
    host, path = host_and_path(F.col(url_col))
    pages = pages.withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels) - i + 1)))
    prefixes = F.transform(F.array(*[F.lit(n) for n in path_lengths]), lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = (
        pages.where("host <> ''").select("host", "path").distinct()
        .withColumn("suffix", F.explode(F.array_distinct(suffixes)))
        .withColumn("prefix", F.explode(F.array_distinct(prefixes)))
        .withColumn("full", F.sha2(F.concat("suffix", "prefix"), 256))
        .withColumn("short", F.substring("full", 1, PREFIX_HEX))
    )
    side = F.broadcast(rules) if n_rules <= BROADCAST_RULES else rules
    best = (
        pairs.join(side, "short").where("full = digest")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("host_len"), "rule", "verdict")).alias("hit"))
    )
    return pages.join(best, ["host", "path"], "left").select(
        *[c for c in pages.columns if c not in ("host", "path")], "host", "path",
        F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
    )


def filter_urls(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """``judge_urls`` for rules given as (verdict, host, path) in the driver. Any columns named host,
    path, rule or verdict in the input are replaced."""
    pages = pages.drop("host", "path", "rule", "verdict")
    table = rule_table(pages.sparkSession, rules)
    return judge_urls(pages, table, sorted({len(r[2]) for r in rules}), len(rules), url_col)
