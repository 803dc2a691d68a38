"""Jobs as state machines: the step, a batch and a stream of several files."""

import random

from pyspark.sql import functions as F

from gleaner.sources.work import work_path
from gleaner.streaming.jobs import run_to_table
from gleaner.streaming.lifecycle import Job, fold_jobs, job_stream, latest, step

SCHEMA = "job string, at long, kind string, value double"
SECOND = 1_000_000


def followed(events, every=5 * SECOND):
    job, out = Job(), []
    for at, kind, value in events:
        job, why = step(job, at, kind, value, every)
        if why:
            out.append((at, job.status, job.done, job.failed, job.percent, job.refused, why))
    return job, out


def test_legal_and_refused_steps():
    job, out = followed([(0, "start", None), (1, "queue", 2.0), (2, "queue", 9.0), (3, "source_ok", None), (4, "start", None), (5, "source_failed", None), (6, "source_ok", None), (7, "progress", 5.0), (8, "crash", None), (9, None, None)])
    assert (job.status, job.done, job.failed, job.refused) == ("partial", 2, 1, 6)
    assert [(o[1], o[-1]) for o in out] == [("queued", "queued"), ("running", "started"), ("running", "source"), ("partial", "ended")]
    assert followed([(0, "queue", None), (1, "crash", None), (2, "start", None)])[0].status == "failed"
    assert followed([(0, "queue", 1.0), (1, "start", None), (2, "source_ok", None)])[0].status == "completed"


def test_progress_is_persisted_once_in_so_many_seconds_and_anew_for_each_source():
    events = [(0, "queue", 2.0), (0, "start", None)] + [(s * SECOND, "progress", float(s)) for s in range(1, 13)] + [(13 * SECOND, "source_ok", None), (14 * SECOND, "progress", 1.0)]
    assert [o[0] // SECOND for o in followed(events)[1] if o[-1] == "progress"] == [1, 7, 14]


def events_of(seed):
    draw = random.Random(seed)
    kinds = ["queue", "start", "progress", "progress", "source_ok", "source_failed", "crash", "odd", None]
    return [(f"j{draw.randrange(12)}", i * SECOND, "queue" if i < 30 else draw.choices(kinds, [2, 6, 9, 9, 4, 2, 0.3, 1, 1])[0], draw.choice([None, 3.0, 40.0])) for i in range(600)]


def test_batch_and_stream_give_what_the_steps_give(spark):
    rows = events_of(3)
    want = {(j, *o) for j in {r[0] for r in rows} for o in followed([r[1:] for r in rows if r[0] == j])[1]}
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in fold_jobs(df.repartition(7)).collect()} == want
    base = work_path(spark, "test-lifecycle")
    for lo in range(0, 600, 200):  # files that are read as micro-batches of their own, in order
        df.where(F.col("at").between(lo * SECOND, (lo + 199) * SECOND)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    run_to_table(job_stream(source), f"{base}/out", f"{base}/state", available_now=True).awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    assert {tuple(r[c] for c in ("job", "at", "status", "done", "failed", "percent", "refused", "why")) for r in out.collect()} == want
    last = {r["job"]: r["status"] for r in latest(out).collect()}
    assert last == {j: max((w for w in want if w[0] == j), key=lambda w: w[1])[2] for j in last}
    assert fold_jobs(df.limit(0)).count() == 0


def test_silent_jobs_are_interrupted(spark):
    base = work_path(spark, "test-silent")
    rows = [[("quiet", 0, "queue", 2.0), ("quiet", SECOND, "start", None), ("busy", 0, "queue", 1.0), ("over", 0, "queue", 1.0), ("over", 0, "start", None), ("over", SECOND, "source_ok", None)], [("busy", 100 * SECOND, "start", None)], [("busy", 150 * SECOND, "progress", 1.0)], [("busy", 160 * SECOND, "progress", 2.0)]]
    for part in rows:
        part = [(j, at + 10 * SECOND, k, v) for j, at, k, v in part]  # what is not after the watermark, at first zero, is late
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    run_to_table(job_stream(source, silent="120 seconds"), f"{base}/out", f"{base}/state", available_now=True).awaitTermination()
    last = {r["job"]: (r["status"], r["at"]) for r in latest(spark.read.parquet(f"{base}/out")).collect()}
    assert last["quiet"] == ("failed", 131 * SECOND) and last["over"][0] == "completed" and last["busy"][0] == "running"
