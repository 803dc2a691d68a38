"""What the operators of this subpackage share: work tables, word rules and ordered offsets."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: bytes.translate table that lower-cases A-Z and leaves every other byte alone.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Rows that a Python stage over texts takes at a time.
BATCH_ROWS = 500


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches held to BATCH_ROWS rows: texts may be very long, and what
    a batch takes is taken several times over in a worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return bounded(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only, so that no locale or Unicode rule decides what is equal."""
    return F.translate(text, UPPER, LOWER)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir.

    Where the setting is absent a local session gets a temporary folder; on a cluster the
    warehouse folder stands in, since it is shared by definition.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master == "local" or master.startswith("local["):
            root = tempfile.mkdtemp(prefix="gleaner-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir") + "/_work"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/gleaner/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes a work table and reads it back: cuts the lineage, and survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(session: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to; else they wait for the driver's next collection."""
    gc.collect()
    session.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes a work table that no later step reads, and lets Spark drop shuffle files out of use."""
    session = df.sparkSession
    hadoop = session.sparkContext._jvm.org.apache.hadoop.fs
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop.Path(folder)
        path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    release(session)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores added until none is a column of ``df``, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits and bits a row of the filter that ``perhaps_in`` broadcasts: 8 MB, whatever the size of the tables.
FILTER_BITS, FILTER_ROW = 1 << 26, 1 << 15


def perhaps_in(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be in the only column of ``wanted``: all that are, and a few
    that are not. A bitmap of hashes, of fixed size, spares the others a shuffle; a semi join follows."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    told = wanted.select(place(wanted.columns[0]).alias("at"))
    bitmaps = told.groupBy(F.expr(f"at div {FILTER_ROW}").alias("_row")).agg(F.bitmap_construct_agg(F.expr(f"at % {FILTER_ROW}")).alias("_bits"))
    bit = F.expr(f"shiftright(cast(conv(hex(substring(_bits, cast(_at % {FILTER_ROW} div 8 as int) + 1, 1)), 16, 10) as int), cast(_at % 8 as int)) & 1")
    rows = df.withColumn("_at", place(column)).withColumn("_row", F.expr(f"_at div {FILTER_ROW}"))
    return rows.join(F.broadcast(bitmaps), "_row").where(bit == 1).select(*df.columns)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+``; bytes.split() splits on exactly those bytes."""
    return text.translate(LOWER_BYTES).split() if text else []


def running_totals(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one, in ``order`` within ``keys``.

    Rows are dealt by range of (keys, order), so a hot key spreads over many partitions. Each
    partition is summed alone; the partitions' own sums, a table of about as many rows as there are
    partitions and keys, give the offsets. ``keys`` hold no nulls. ``order`` should tell rows apart;
    rows that tie in all of it get their turn arbitrarily.
    """
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    ranged = save(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys, "_part").orderBy(*by[len(keys):]).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(sums, [*keys, "_part"])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("_part", "_base")
    )
