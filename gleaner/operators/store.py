"""Store queries: dashboards, roll-ups, paging, search, latest batches, slices that are replaced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(columns: Sequence[str], search: str) -> Column:
    """Whether any column holds the first 80 characters of ``search``, in either case."""
    wanted = search[:80].lower()
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(F.col(c)).contains(wanted), F.lit(False))
    return found


def page(df: DataFrame, order: Sequence[Column | str], number: int = 1, size: int = 25) -> DataFrame:
    """Page ``number`` of ``size`` rows, in an order that should leave no ties."""
    number, size = max(1, min(number, 100_000)), max(1, min(size, 100))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def roll_up(df: DataFrame, keys: Sequence[str], when: Sequence[str], latest: dict[str, str], sums: dict[str, str] | None = None) -> DataFrame:
    """Runs, sums and the latest run's columns for each key, the latest by ``when``."""
    last = F.struct(*when)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(n) for n, c in (sums or {}).items()],
        *[F.max_by(F.col(c), last).alias(n) for n, c in latest.items()],
    )


def latest_batch(df: DataFrame, source: str, batch: str, when: str) -> DataFrame:
    """All rows of each source's latest batch. Sources and their batches are aggregated first, so a
    source with very many rows meets no window; the join can be split where it is skewed."""
    last = df.groupBy(source).agg(F.max_by(F.col(batch), F.struct(when, batch)).alias(batch))
    return df.join(last, [source, batch], "left_semi")


def latest_by_key(df: DataFrame, keys: Sequence[str], when: Sequence[str]) -> DataFrame:
    """An upserted table as it reads: the last written row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*when)).alias("_row")).select(*keys, "_row.*")


def replace_slice(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Writes ``df`` in place of the slices that it has rows of; others stay. The swap is staged."""
    df.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def repair_interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs that were queued or running when the engine stopped have failed."""
    hit = F.col("status").isin("queued", "running")
    return jobs.withColumn("error", F.when(hit, F.coalesce("error", F.lit("interrupted"))).otherwise(F.col("error"))).withColumn("status", F.when(hit, "failed").otherwise(F.col("status")))


def budget(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in order."""
    return df.orderBy(*order).limit(n)


def job_status(total: Column, failed: Column) -> Column:
    """A run with any failed source is partial, even if all failed."""
    return F.when(failed > 0, "partial").otherwise("completed")


def progress_percent(index: Column, fraction: Column, total: Column, running: Column) -> Column:
    done = F.round((index + fraction) * 100 / total)
    return F.when(running, F.least(done, F.lit(96.0))).otherwise(done)


def need_score(images: Column, description: Column, phone: Column) -> Column:
    """What a listing lacks: pictures weigh 5, a description 3, a phone number 1."""
    lacks = lambda c, w: F.when(F.coalesce(c, F.lit(False)), 0).otherwise(w)
    return lacks(images, 5) + lacks(description, 3) + lacks(phone, 1)
