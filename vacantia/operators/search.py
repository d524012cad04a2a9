"""Search over postings: predicates, the cascade of age windows, stable pages."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, experience, geo, text


@dataclass(frozen=True)
class SearchQuery:
    query: str | None = None
    location: str | None = None
    country: str | None = None
    remote: bool | None = None
    experience_years: float | None = None
    include_unknown_experience: bool = False
    max_age_days: int | None = None
    offset: int = 0
    limit: int = 50


def indexed_tokens() -> Column:
    """Tokens a posting is found by: title, company, and its skills or else the description's."""
    skills = F.coalesce(F.col("skills"), text.extract_skills(F.col("description")))
    return text.haystack(F.concat_ws(" ", "title", "company", skills))


def search_predicate(q: SearchQuery) -> Column:
    """All of: every term as a token, the place as a substring, eligibility, the remote flag."""
    out = F.lit(True)
    if terms := text.search_terms_of(q.query):
        out = out & text.matches_terms(indexed_tokens(), terms)
    if q.location:
        out = out & F.contains(geo.normalize_location(F.col("location")), F.lit(geo.normalize_location_of(q.location)))
    if q.country:
        out = out & geo.eligible_for(q.country)
    if q.remote is not None:
        out = out & (F.col("remote") == q.remote)
    return out


def cascade_steps(rows: DataFrame, posted: str, now: datetime | Column, windows: tuple[int, ...] = dates.CASCADE, enough: int = dates.CASCADE_ENOUGH) -> DataFrame:
    """One row: results of every window, the window used, whether it was widened. One pass, one aggregate."""
    counts = rows.agg(*[F.coalesce(F.count_if(dates.within_window(F.col(posted), d, now)), F.lit(0)).alias(f"results_{d}") for d in windows])
    pick = F.lit(windows[-1])
    for d in reversed(windows[:-1]):
        pick = F.when(F.col(f"results_{d}") >= enough, d).otherwise(pick)
    used = counts.withColumn("days_used", pick)
    return used.withColumn("widened", F.col("days_used") != windows[0])


def in_cascade(rows: DataFrame, posted: str, now: datetime | Column, windows: tuple[int, ...] = dates.CASCADE, enough: int = dates.CASCADE_ENOUGH) -> DataFrame:
    """Rows of the window the cascade stops at, with ``days_used``; the one-row aggregate is broadcast."""
    steps = cascade_steps(rows, posted, now, windows, enough).select("days_used", F.col("widened"))
    age = (F.unix_millis(dates.instant(now)) - F.unix_millis(F.col(posted).cast("timestamp"))) <= F.col("days_used").cast("long") * dates.DAY_MS
    return rows.join(F.broadcast(steps), (F.col("days_used") <= 0) | F.coalesce(age, F.lit(False)))


def page(rows: DataFrame, posted: str, key: str, offset: int, limit: int, always: bool = False) -> DataFrame:
    """Newest first, undated last, ties by key; with the total and where the next page begins (null at the end).

    Only a page is sorted out (top-k with offset); the total is a second, unsorted aggregate. With ``always``, a page
    without rows, past the end too, is one row of nulls that still has the total.
    """
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    top = rows.orderBy(F.desc_nulls_last(posted), F.asc(key)).offset(offset).limit(limit)
    following = F.when(F.col("total") > offset + limit, F.lit(offset + limit)).cast("long")
    return total.join(top, F.lit(True), "left" if always else "inner").select(*rows.columns, "total").withColumn("next_offset", following)


def windows_of(q: SearchQuery) -> tuple[int, ...]:
    return dates.CASCADE if q.max_age_days is None else (q.max_age_days,)


def search(jobs: DataFrame, q: SearchQuery, now: datetime, always: bool = False) -> DataFrame:
    """The summaries of a page: predicate, experience, windows, order; the description is left out."""
    found = jobs.where(search_predicate(q))
    if q.experience_years is not None:
        found = experience.with_experience(found).where(experience.experience_filter(F.col("experience"), q.experience_years, q.include_unknown_experience))
    shown = page(in_cascade(found, "updated_at", now, windows_of(q)), "updated_at", "id", q.offset, q.limit, always)
    return shown.drop("description").withColumns({"posted_days_ago": dates.posted_days_ago(F.col("updated_at"), now), "age": dates.job_age(F.col("updated_at"), now)})


def excerpt(value: Column, limit: int = 280) -> Column:
    return F.when(F.length(value) > limit, F.concat(F.rtrim(F.substring(value, 1, limit)), F.lit("…"))).otherwise(value)


def lookup(jobs: DataFrame, details: DataFrame, job_id: str) -> DataFrame:
    """One job; a blank description is taken from the details table (``job_id, description``)."""
    more = details.select(F.col("job_id"), F.col("description").alias("_detail"))
    found = jobs.where(F.col("id") == job_id).join(more, F.col("id") == F.col("job_id"), "left")
    whole = F.when(F.trim(F.coalesce("description", F.lit(""))) != "", F.col("description")).otherwise(F.col("_detail"))
    return found.withColumn("description", whole).select(*jobs.columns)
