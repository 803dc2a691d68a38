"""Jobs as they are asked for and shown."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import filled

MAX_URLS = 10
ACTIVE = ["queued", "running"]
PUBLIC = ["id", "status", "createdAt", "startedAt", "completedAt", "currentIndex", "currentUrl", "stage", "stageMessage", "sourceProgress", "updatedAt", "error"]


def job_urls(value: object) -> list[str]:
    """The pages of a new job: trimmed, each once, ten at most, http or https alone; a driver-side check."""
    given = value if isinstance(value, (list, tuple)) else [value]
    found = [*dict.fromkeys(t for x in given if (t := str(x or "").strip()))]
    if not found:
        raise ValueError("a run needs the URL of a listing page")
    if len(found) > MAX_URLS:
        raise ValueError(f"a run has {MAX_URLS} URLs at most")
    for u in found:
        scheme, _, rest = u.partition("://")
        if scheme.lower() not in ("http", "https") or not rest.strip("/"):
            raise ValueError(f"unsupported URL: {u}")
    return found


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that count against the limit of jobs at a time."""
    return jobs.where(F.col("status").isin(ACTIVE))


def public_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs as they are shown: how many pages they have, their results without the places of files."""
    result = jobs.schema["results"].dataType.elementType.names
    shown = F.transform("results", lambda r: F.struct(*[r[n].alias(n) for n in result if n != "files"]))
    return jobs.select(*[c for c in PUBLIC if c in jobs.columns], F.size("urls").alias("total"), shown.alias("results"))


def job_totals(jobs: DataFrame) -> DataFrame:
    """(id, records, withEmail, withPhone): sums over each job's results; what is not told counts as none."""
    total = lambda get: F.aggregate(F.coalesce("results", F.array().cast(jobs.schema["results"].dataType)), F.lit(0).cast("long"), lambda n, r: n + F.coalesce(get(r).cast("long"), F.lit(0).cast("long")))
    return jobs.select("id", total(lambda r: r["count"]).alias("records"), total(lambda r: r["contactCoverage"]["withEmail"]).alias("withEmail"), total(lambda r: r["contactCoverage"]["withPhone"]).alias("withPhone"))


def shown_contact(agent: Column, own: Column, source: Column) -> Column:
    """The contact that is shown: the agent's field, else the first of the row's own, else of its source's."""
    return F.coalesce(filled(agent), F.get(own, F.lit(0)), F.get(source, F.lit(0)))


def shown_price(price: Column, currency: Column) -> Column:
    """A price, as text, in its currency, pounds where none is told, without pence; texts stay as they are."""
    number = F.when(~price.rlike(r"[^\d.,]"), numbers.whole_number(F.regexp_replace(price, ",", "")))
    code = F.upper(F.coalesce(filled(currency), F.lit("GBP")))
    sign = F.coalesce(*[F.when(code == c, s) for c, s in (("GBP", "£"), ("EUR", "€"), ("USD", "US$"))], F.concat(code, F.lit("\u00a0")))
    whole = F.format_number(F.floor(number + 0.5), 0)
    return F.when(F.coalesce(price, F.lit("")) == "", "Not stated").when(number.isNull(), price).otherwise(F.concat(sign, whole))


def stamp(when: datetime | None = None) -> str:
    """Fourteen digits of a moment, for names of runs."""
    return (when or datetime.now(UTC)).astimezone(UTC).strftime("%Y%m%d%H%M%S")


def iso(when: Column) -> Column:
    """A moment as text with milliseconds, in UTC: texts sort as moments do."""
    return F.date_format(F.to_utc_timestamp(when.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def elapsed_minutes(start: Column, end: Column) -> Column:
    """Whole minutes between two moments, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor((F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))) / 60_000))
