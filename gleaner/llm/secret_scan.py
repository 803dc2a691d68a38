"""Secret scan over an incremental ledger of content-addressed blobs.

Native: DataFrame functions only. Every version of every path is addressed by the SHA-256 of its
text. The ledger holds the findings of each (blob, rule version) pair that was ever scanned, clean
ones too; a run scans only pairs that it lacks, one copy of each blob, appends them, and joins the
findings back to all paths.

Positions count code points. ``split`` gives the text between the matches of a rule and
``regexp_extract_all`` the matches, so running sums of their lengths give the spans.

Null texts count as empty. Null paths, and repeated rows, each get their row. Findings of equal
texts are equal. An empty table gives an empty result. Other columns are kept, but for those named
blob or spans in any case of letters, which the result's own replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, work_path

RULES_VERSION = 1
#: Kind, pattern, group whose length counts, least length.
RULES = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
LEDGER_SCHEMA = "blob string, rules_version int, spans array<struct<start:bigint,kind_no:int,stop:bigint,kind:string>>"


def _spans(text: Column, kind_no: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of a rule's leftmost, non-overlapping matches that are long enough."""
    if group == 0:
        # Short matches are maximal runs that hold no long one, so the pattern may demand the length.
        fixed = pattern.index("[")
        pattern = f"{pattern[:-1]}{{{least - fixed},}}"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    cells = F.arrays_zip(whole.alias("m"), parts.alias("p"), F.slice(between, 1, F.size(whole)).alias("b"))
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,stop:bigint,kind:string>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["b"])
        stop = first + F.length(x["m"])
        span = F.struct(first.alias("start"), F.lit(kind_no).alias("kind_no"), stop.alias("stop"), F.lit(kind).alias("kind"))
        return F.struct(stop.alias("at"), F.when(F.length(x["p"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(cells, start, step, lambda acc: acc["out"])).otherwise(empty)


def scan_text(text: Column, rules=RULES) -> Column:
    """All spans of a text as an array sorted by start, then by the rules' order."""
    found = [_spans(text, i, *rule) for i, rule in enumerate(rules)]
    return F.array_sort(F.concat(*found))


def scan(paths: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules=RULES, version: int = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """(``paths`` without text but with blob and spans, the new ledger).

    One copy of each blob is scanned: the row with the least path, found from ids and digests alone,
    so that a text crosses the network once at most and a blob with many paths makes no large group.
    """
    text, content = fresh(paths, "_text")[0], F.coalesce(F.col(text_col), F.lit(""))
    versions = paths.withColumns({"blob": F.sha2(content, 256), text: content})
    least, other = fresh(versions, "_id", "_blob")
    seen = versions.groupBy("blob").agg(F.min(id_col).alias(least))
    if ledger is not None:
        seen = seen.join(ledger.where(F.col("rules_version") == version).select("blob"), "blob", "left_anti")
    unseen = seen.select(F.col("blob").alias(other), least)
    picked = versions.join(unseen.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(least)) & (F.col("blob") == F.col(other)), "left_semi")
    scanned = (
        picked.select("blob", scan_text(F.col(text), rules).alias("spans"))
        .groupBy("blob").agg(F.first("spans").alias("spans"))
        .select("blob", F.lit(version).alias("rules_version"), "spans")
    )
    path = work_path(paths.sparkSession, "ledger")
    scanned.write.parquet(path)
    scanned = paths.sparkSession.read.schema(LEDGER_SCHEMA).parquet(path)
    ledger = scanned if ledger is None else ledger.unionByName(scanned)
    known = ledger.where((F.col("rules_version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    joined = versions.drop(text, text_col, "spans").join(known, "blob", "left")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(known.schema["spans"].dataType))), ledger


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def report(scanned: DataFrame, id_col: str = "doc_id", rules=RULES) -> DataFrame:
    """Counts for each kind, the joined spans and their digest for each path."""
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in rules]
    return scanned.select(id_col, "blob", *counts, F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
