"""Jobs as state machines over their events: queued, running, then completed, partial or failed.

One step function says what an event does to a job. The stream keeps a job's state between micro-batches
and takes its events in order of time; a batch of events is folded by the same function, streamed through
sorted partitions. Both give the rows that are persisted: every change of state and every source that
ends, and of progress the first of each source and then at most one in so many seconds.

Events are (job, at, kind, value): at in microseconds, value a percentage or, with queue, the number of
sources. What a state does not allow is refused: it is counted and changes nothing. Null kinds are
refused; events of a job at the same time are taken by kind, then value. A job that is queued or running
and silent for longer than a limit was interrupted and has failed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: States from which each kind of event is allowed.
ALLOWED = {"queue": (None,), "start": ("queued",), "progress": ("running",), "source_ok": ("running",), "source_failed": ("running",), "crash": ("queued", "running")}
STATE = "status string, total int, done int, failed int, percent double, progress_at long, refused int, last_at long"
PERSISTED = "at long, status string, done int, failed int, percent double, refused int, why string"


class Job(NamedTuple):
    status: str | None = None
    total: int = 0
    done: int = 0
    failed: int = 0
    percent: float = 0.0
    #: When progress was last persisted for the source at hand.
    progress_at: int | None = None
    refused: int = 0
    last_at: int | None = None


def step(job: Job, at: int, kind: str | None, value: float | None, every: int) -> tuple[Job, str | None]:
    """The job after an event, and why it is persisted, if it is. ``every``: microseconds."""
    job = job._replace(last_at=at)
    if job.status not in ALLOWED.get(kind, ()):
        return job._replace(refused=job.refused + 1), None
    if kind == "queue":
        return job._replace(status="queued", total=max(1, int(value or 1))), "queued"
    if kind == "start":
        return job._replace(status="running"), "started"
    if kind == "crash":
        return job._replace(status="failed"), "failed"
    if kind == "progress":
        job = job._replace(percent=float(value or 0))
        due = job.progress_at is None or at - job.progress_at > every
        return (job._replace(progress_at=at), "progress") if due else (job, None)
    job = job._replace(done=job.done + 1, failed=job.failed + (kind == "source_failed"), percent=100.0, progress_at=None)
    if job.done < job.total:
        return job, "source"
    return job._replace(status="partial" if job.failed else "completed"), "ended"


def _row(job: Job, at: int, why: str) -> tuple:
    return at, job.status, job.done, job.failed, job.percent, job.refused, why


def _ordered(rows: pd.DataFrame) -> Iterator[tuple[int, str | None, float | None]]:
    found = [(int(a), None if k is None or k != k else k, None if v is None or v != v else float(v)) for a, k, v in zip(rows["at"], rows["kind"], rows["value"], strict=True)]
    return iter(sorted(found, key=lambda e: (e[0], e[1] or "", e[2] or 0.0)))


def job_stream(events: DataFrame, every: float = 5.0, silent: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Persisted rows of a stream of (job, at, kind, value), in append mode. ``silent``: an interval; a job that
    the watermark, ``late`` behind the newest event, finds silent for so long is interrupted."""
    schema = [f.strip().split(" ")[0] for f in PERSISTED.split(",")]
    limit = int(pd.Timedelta(silent).total_seconds() * 1e6) if silent else None
    kind = dict(events.dtypes)["job"]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = Job(*state.get) if state.exists else Job()
        out = []
        if state.hasTimedOut:
            if job.status in ("queued", "running"):
                job = job._replace(status="failed")
                out.append(_row(job, job.last_at + limit, "interrupted"))
        else:
            for at, what, value in _ordered(pd.concat(list(batches))):
                job, why = step(job, at, what, value, int(every * 1e6))
                if why:
                    out.append(_row(job, at, why))
        state.update(tuple(job))
        if limit and job.status in ("queued", "running"):
            state.setTimeoutTimestamp(max((job.last_at + limit) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=schema).assign(job=key[0])[["job", *schema]]

    timed = events.withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", late)
    timeout = GroupStateTimeout.EventTimeTimeout if silent else GroupStateTimeout.NoTimeout
    return timed.groupBy("job").applyInPandasWithState(run, f"job {kind}, {PERSISTED}", STATE, "append", timeout)


def fold_jobs(events: DataFrame, every: float = 5.0) -> DataFrame:
    """The same rows of a table of events. Jobs are dealt by hash and sorted, so a task holds one job's state
    at a time, however many events it has."""
    schema = [f.strip().split(" ")[0] for f in PERSISTED.split(",")]
    kind = dict(events.dtypes)["job"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, job = None, None
        for rows in batches:
            out = []
            for k, at, what, value in zip(rows["job"], rows["at"], rows["kind"], rows["value"], strict=True):
                if job is None or k != key:
                    key, job = k, Job()
                what = None if what is None or what != what else what
                job, why = step(job, int(at), what, None if value is None or value != value else float(value), int(every * 1e6))
                if why:
                    out.append((k, *_row(job, int(at), why)))
            yield pd.DataFrame(out, columns=["job", *schema])

    rows = events.where("job is not null").select("job", "at", "kind", "value").repartition("job")
    rows = rows.sortWithinPartitions("job", "at", F.coalesce("kind", F.lit("")), F.coalesce("value", F.lit(0.0)))
    return rows.mapInPandas(run, f"job {kind}, {PERSISTED}")


def latest(persisted: DataFrame) -> DataFrame:
    """Each job as it was last persisted."""
    rest = [c for c in persisted.columns if c != "job"]
    return persisted.groupBy("job").agg(F.max_by(F.struct(*rest), F.struct("at", "done", "why")).alias("_row")).select("job", "_row.*")
