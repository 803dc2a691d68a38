"""Files of listings in batches that stop and resume: positions, reuse of what was saved, budgets, write-back.

A row is known by its file and its position in it. Positions are dense in each file and dealt by ranges
that are written out, so they are counted once and a file of any size is numbered by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..sources.work import written


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "position", start: int = 0) -> DataFrame:
    """Adds ``name``: dense numbers in ``order`` within ``keys``, from ``start``.

    Rows are dealt by range of keys and order and written; each range is counted by itself, and the
    ranges' own counts, a row for each range and key, tell where it begins. Nulls come first. Rows that tie in
    all of ``order`` are numbered arbitrarily, once.
    """
    by = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in [*keys, *order]]
    ranged = written(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "numbered")
    whole = F.lit(0) if not keys else F.struct(*keys)
    ranged = ranged.withColumn("_of", whole)
    counts = ranged.groupBy("_of", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_of").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_of", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_of", "_range").orderBy(*by[len(keys):])
    rows = ranged.withColumn(name, F.row_number().over(inner)).join(counts, ["_of", "_range"])
    return rows.withColumn(name, (F.col(name) + F.col("_base") - 1 + start).cast("long")).drop("_of", "_range", "_base")


def resume(listings: DataFrame, saved: DataFrame, file: str = "file", position: str = "position", platform: str = "platform", failed: Column | None = None) -> DataFrame:
    """``listings`` with the platform rows that an earlier run saved, zipped by position.

    A file is taken only if it was saved with as many rows as it has now; else it starts again. Rows that
    match ``failed``, a condition on the saved platform, are not reused: pass it to try those again. What a
    listing has itself stays where nothing is reused.
    """
    sizes = listings.groupBy(file).agg(F.count(F.lit(1)).alias("_n"))
    same = saved.groupBy(F.col(file).alias("_f")).agg(F.count(F.lit(1)).alias("_m"))
    same = sizes.join(same, (F.col(file).eqNullSafe(F.col("_f"))) & (F.col("_n") == F.col("_m"))).select("_f")
    good = saved.where(F.col(platform).isNotNull() & (F.lit(True) if failed is None else ~F.coalesce(failed, F.lit(False))))
    good = good.select(F.col(file).alias("_f"), F.col(position).alias("_p"), F.col(platform).alias("_saved"))
    good = good.join(same.withColumnRenamed("_f", "_g"), F.col("_f").eqNullSafe(F.col("_g")), "left_semi")
    rows = listings.join(good, F.col(file).eqNullSafe(F.col("_f")) & (F.col(position) == F.col("_p")), "left")
    own = F.col(platform) if platform in listings.columns else F.lit(None)
    return rows.withColumn(platform, F.coalesce("_saved", own)).drop("_f", "_p", "_saved")


def pending(platform: Column, failed: Column | None = None) -> Column:
    """Rows that still want a platform row; ``failed`` tells those that are tried again."""
    return platform.isNull() if failed is None else platform.isNull() | F.coalesce(failed, F.lit(False))


def lossy_files(listings: DataFrame, normalised: Column, has_raw: Column, has_platform: Column, file: str = "file") -> DataFrame:
    """Files whose rows are all platform rows without the record that they come from: (file). They are
    skipped, since a second pass over them would lose what the first did not keep."""
    bare = normalised & ~has_raw & ~has_platform
    return listings.groupBy(file).agg(F.bool_and(F.coalesce(bare, F.lit(False))).alias("_bare")).where("_bare").select(file)


def select_budget(rows: DataFrame, is_pending: Column, budget: int, file: str = "file", position: str = "position") -> DataFrame:
    """Adds ``selected``: the first ``budget`` pending rows, files in order of their names."""
    flagged = rows.withColumn("_pending", is_pending)
    turn = numbered(flagged.where("_pending").select(file, position), [], [file, position], "_turn").where(F.col("_turn") < budget)
    turn = turn.select(F.col(file).alias("_f"), F.col(position).alias("_p"), F.lit(True).alias("selected"))
    out = flagged.join(turn, F.col(file).eqNullSafe(F.col("_f")) & (F.col(position) == F.col("_p")), "left").drop("_f", "_p")
    return out.withColumn("selected", F.coalesce("selected", F.lit(False))).withColumnRenamed("_pending", "pending")


def write_back(rows: DataFrame, results: DataFrame, platform: str = "platform", file: str = "file", position: str = "position") -> DataFrame:
    """``rows`` with the platform rows in ``results`` put in at their file and position."""
    new = results.select(F.col(file).alias("_f"), F.col(position).alias("_p"), F.struct(platform).alias("_new"))
    out = rows.join(new, F.col(file).eqNullSafe(F.col("_f")) & (F.col(position) == F.col("_p")), "left")
    return out.withColumn(platform, F.when(F.col("_new").isNotNull(), F.col("_new")[platform]).otherwise(F.col(platform))).drop("_f", "_p", "_new")


def batch_report(rows: DataFrame, failed: Column, file: str = "file") -> DataFrame:
    """Per file: total, attempted, remaining, normalized and failed, from ``selected``, ``pending`` and the
    condition ``failed`` on a selected row's result."""
    bad = F.col("selected") & F.coalesce(failed, F.lit(False))
    return rows.groupBy(file).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("selected").alias("attempted"), F.count_if(F.col("pending") & ~F.col("selected")).alias("remaining"),
        F.count_if(F.col("selected") & ~bad).alias("normalized"), F.count_if(bad).alias("failed"),
    )


def source_url_of(listings: DataFrame, unknown: str, file: str = "file", position: str = "position") -> DataFrame:
    """(file, source_url): that of the first record which tells its site, or else the origin of its own URL."""
    site = F.nullif(F.col("sourceSiteUrl"), F.lit(""))
    told = F.coalesce(site, urls.origin(F.col("sourceUrl")))
    return listings.groupBy(file).agg(F.coalesce(F.min_by(told, F.when(told.isNotNull(), F.col(position))), F.lit(unknown)).alias("source_url"))


def output_file(input_file: str, out_dir: str | None = None, out_file: str | None = None, single: bool = True) -> str:
    """Where a file's result goes: ``out_file`` with a single input alone, else its name below ``out_dir``."""
    if out_file:
        if not single:
            raise ValueError("out_file needs a single input file")
        return out_file
    if not out_dir:
        raise ValueError("out_dir or out_file is needed")
    return f"{out_dir.rstrip('/')}/{input_file.rstrip('/').rsplit('/', 1)[-1]}"
