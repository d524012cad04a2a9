"""Posting dates, ages, search windows, back-off; built-in expressions only."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
# Days of the search windows, and the results at which the cascade stops.
CASCADE = (7, 14, 30, 0)
CASCADE_ENOUGH = 5
DEFAULT_MAX_AGE = 30


def instant(now: datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def lenient_timestamp(text: Column) -> Column:
    """ISO, date-only (UTC) and RFC-1123 texts; anything else is undated."""
    plain = F.trim(text)
    mail = F.regexp_replace(F.regexp_replace(plain, r"^[A-Za-z]{3},\s*", ""), r"\s+(?:GMT|UTC|UT|Z)\s*$", " +0000")
    return F.coalesce(F.try_to_timestamp(plain), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(plain, F.lit("MMMM d, yyyy")))


def posted_days_ago(posted: Column, now: datetime | Column) -> Column:
    """Whole days of 24 hours; the future counts as 0; null if undated."""
    return F.greatest(F.lit(0), F.floor((F.unix_millis(instant(now)) - F.unix_millis(posted.cast("timestamp"))) / DAY_MS)).cast("long") + F.when(posted.isNull(), None).otherwise(0)


def job_age(posted: Column, now: datetime | Column) -> Column:
    """new (7 days), older (30), stale, or undated."""
    days = posted_days_ago(posted, now)
    return F.when(posted.isNull(), "undated").when(days <= 7, "new").when(days <= 30, "older").otherwise("stale")


def within_window(posted: Column, days: int, now: datetime | Column) -> Column:
    """Posted within so many days; 0 and less take everything, the undated too."""
    if days <= 0:
        return F.lit(True)
    return F.coalesce(F.unix_millis(posted.cast("timestamp")) >= F.unix_millis(instant(now)) - days * DAY_MS, F.lit(False))


def relative_date(label: Column, now: datetime | Column) -> Column:
    """Listing labels: today, yesterday, N days ago; a plus adds a day. A date, or null."""
    text = F.lower(F.trim(label))
    count = F.regexp_extract(text, r"([0-9]+)\+?\s*days?\s*ago", 1)
    days = F.when(text.rlike(r"(?<![a-z0-9_])today(?![a-z0-9_])"), 0).when(text.rlike(r"(?<![a-z0-9_])yesterday(?![a-z0-9_])"), 1)
    days = days.when(count != "", F.try_to_number(count, F.lit("999999999")).cast("int") + F.contains(text, F.lit("+")).cast("int"))
    return F.date_sub(F.to_date(instant(now)), days)


def relative_timestamp(label: Column, now: datetime | Column) -> Column:
    """The portal's labels: 24 hours, days, weeks, a month (30 days), more than a month (45 days)."""
    text = F.lower(label)
    days = F.regexp_extract(text, r"([0-9]+)\s*days?", 1)
    weeks = F.regexp_extract(text, r"([0-9]+)\s*weeks?", 1)
    back = (
        F.when(text.rlike("24 hours|today"), 0)
        .when(days != "", F.try_to_number(days, F.lit("999999999")).cast("int"))
        .when(weeks != "", 7 * F.try_to_number(weeks, F.lit("999999999")).cast("int"))
        .when(F.contains(text, F.lit("more than 1 month")), 45)
        .when(F.contains(text, F.lit("1 month")), 30)
    )
    return F.timestamp_millis(F.unix_millis(instant(now)) - back.cast("long") * DAY_MS)


def lead_backoff_seconds(failures: Column) -> Column:
    """A minute, doubled with every failure, seven days at most."""
    return F.least(F.lit(7 * 86_400.0), 60 * F.pow(F.lit(2.0), failures - 1))


def http_backoff_ms(attempt: Column, retry_after_s: Column) -> Column:
    """The server's wish up to 30 s, else 500 ms doubled with every attempt."""
    return F.coalesce(F.when(retry_after_s.isNotNull(), F.least(retry_after_s * 1000.0, F.lit(30_000.0))), 500 * F.pow(F.lit(2.0), attempt))


# HTTP statuses worth another try.
TRANSIENT = [429, 502, 503, 504, 520]


def is_transient(status: Column) -> Column:
    return status.isin(TRANSIENT)


def newer_version(latest: Column, current: Column) -> Column:
    """Dotted numbers, compared part by part; missing parts are 0."""
    parts = lambda v: F.transform(F.slice(F.concat(F.split(F.regexp_replace(v, "^v", ""), r"\."), F.array_repeat(F.lit("0"), 4)), 1, 4), lambda x: F.coalesce(F.regexp_extract(x, "^[0-9]+", 0).try_cast("int"), F.lit(0)))
    return parts(latest) > parts(current)
