"""Country coverage and freshness reports: joins, exact distinct counts, zero-filled histograms."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, geo

# Freshness buckets by age in days.
FRESHNESS = ["future", "fresh_24_hours", "age_1_to_7_days", "age_8_to_14_days", "older_than_14_days"]
CONFIDENCE = ["explicit", "inferred", "unknown"]


def percent(part: Column, whole: Column) -> Column:
    """Two decimals, half up; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole * 100, 2))


def jobs_per_country(jobs: DataFrame, countries: str = "eligible_countries") -> DataFrame:
    """A job counts once for each of its countries."""
    return jobs.select(F.explode(F.array_distinct(countries)).alias("country")).groupBy("country").agg(F.count(F.lit(1)).alias("jobs"))


def employer_key() -> Column:
    """The domain without www.; a board that only its provider vouches for counts by its token; others not at all."""
    domain = F.regexp_replace(F.lower("company_domain"), r"^www\.", "")
    board = F.when(F.col("domain_evidence_kind") == "provider_board", F.concat_ws(":", F.lit("board"), F.col("ats"), F.lower("token")))
    return F.coalesce(domain, board)


def country_coverage(jobs: DataFrame, catalog: DataFrame, countries: list[str]) -> DataFrame:
    """Per requested country: sources with an eligible job, eligible jobs, distinct employers. Zero rows stay.

    One pass: each job is exploded to the requested countries it is open to.
    """
    open_to = F.array_compact(F.array(*[F.when(geo.eligible_for(c), F.lit(c)) for c in countries]))
    held = jobs.select("source_slug", F.explode(open_to).alias("country")).join(catalog.select("source_slug", employer_key().alias("employer")), "source_slug")
    asked = jobs.sparkSession.createDataFrame([(c,) for c in countries], "country string")
    counted = held.groupBy("country").agg(F.count_distinct("source_slug").alias("sources"), F.count(F.lit(1)).alias("jobs"), F.count_distinct("employer").alias("employers"))
    return asked.join(counted, "country", "left").fillna(0, ["sources", "jobs", "employers"])


def covered_keys(left: DataFrame, facts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Keys of a dimension without facts, and of facts without a dimension row."""
    return left.join(facts, key, "left_anti").select(key).distinct(), facts.join(left, key, "left_anti").select(key).distinct()


def counts_by(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def pivot_counts(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row with a count for each of a fixed list of values, zeros too."""
    return rows.agg(*[F.coalesce(F.count_if(F.col(key) == v), F.lit(0)).alias(v) for v in values])


def freshness_bucket(at: Column, now: datetime | Column) -> Column:
    age = F.unix_millis(dates.instant(now)) - F.unix_millis(at.cast("timestamp"))
    day = dates.DAY_MS
    return F.when(age < 0, FRESHNESS[0]).when(age <= day, FRESHNESS[1]).when(age <= 7 * day, FRESHNESS[2]).when(age <= 14 * day, FRESHNESS[3]).otherwise(FRESHNESS[4])


def freshness(partitions: DataFrame, at: str, now: datetime | Column) -> DataFrame:
    """Partitions by age: how many, and the oldest and newest of each bucket."""
    dealt = partitions.withColumn("bucket", freshness_bucket(F.col(at), now))
    return dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("oldest"), F.max(at).alias("newest"))


def freshness_members(partitions: DataFrame, key: str, at: str, now: datetime | Column) -> DataFrame:
    """Which partitions lie in which bucket, a row each, so that no bucket is one row."""
    return partitions.select(freshness_bucket(F.col(at), now).alias("bucket"), key)


def corpus_metrics(catalog: DataFrame, jobs: DataFrame, country: str) -> DataFrame:
    """One row: companies, jobs, jobs open to a country."""
    held = jobs.agg(F.count(F.lit(1)).alias("jobs"), F.count_if(geo.eligible_for(country)).alias("country_jobs"))
    return catalog.agg(F.count(F.lit(1)).alias("companies")).crossJoin(held)  # one row with one row


def metrics_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed between two one-row metrics."""
    old = before.select(*[F.col(c).alias(f"_{c}") for c in before.columns])
    return after.crossJoin(old).select(*[(F.col(c) - F.col(f"_{c}")).alias(c) for c in before.columns])  # one row with one row


def staleness(partitions: DataFrame, at: str, now: datetime | Column, max_age_days: int = 14) -> DataFrame:
    """The oldest partition decides; none at all is stale."""
    day = dates.DAY_MS
    return partitions.agg(F.count(F.lit(1)).alias("partitions"), F.min(at).alias("oldest"), F.max(at).alias("newest")).select(
        "partitions",
        F.floor((F.unix_millis(dates.instant(now)) - F.unix_millis(F.col("oldest").cast("timestamp"))) / day).alias("oldest_age_days"),
        F.coalesce(F.unix_millis(dates.instant(now)) - F.unix_millis(F.col("oldest").cast("timestamp")) > max_age_days * day, F.lit(True)).alias("stale"),
    )


def valid_snapshot(crawl: DataFrame) -> Column:
    """No more outcomes than sources were selected."""
    return F.col("succeeded") + F.col("failed") <= F.col("selected")


def coverage_report(catalog: DataFrame, candidates: DataFrame, leads: DataFrame, jobs: DataFrame, partitions: DataFrame, country: str, now: datetime) -> dict[str, DataFrame]:
    """The sections of the country report, each a DataFrame; a malformed input fails the whole report."""
    from .registry import state_histograms
    from .verification import promoted

    bad = jobs.where(F.col("id").isNull() | F.col("title").isNull() | F.col("eligible_countries").isNull() | ~F.col("eligibility_confidence").isin(CONFIDENCE))
    if bad.limit(1).count():
        raise ValueError("the snapshot holds a malformed job")
    if partitions.where(F.col("fetched_at").cast("timestamp") > F.lit(now).cast("timestamp")).limit(1).count():
        raise ValueError("the snapshot holds a partition from the future")
    indexed = jobs.join(catalog.select("source_slug", "ats"), "source_slug")
    eligible = indexed.where(geo.eligible_for(country))
    never, orphaned = covered_keys(catalog, partitions, "source_slug")
    sources = catalog.agg(F.count(F.lit(1)).alias("verified_sources"), F.count_if(F.array_contains("cohorts", country)).alias("cohort_sources"))
    held = catalog.join(partitions, "source_slug", "left_semi").agg(F.count(F.lit(1)).alias("indexed_sources"))
    both = sources.crossJoin(held)
    return {
        "sources": both.withColumn("catalog_coverage_percent", percent(F.col("indexed_sources"), F.col("verified_sources"))),
        "providers": counts_by(catalog, "ats"),
        "indexed_providers": counts_by(catalog.join(partitions, "source_slug", "left_semi"), "ats"),
        "never_indexed": never,
        "orphaned": orphaned,
        "confidence_all": pivot_counts(indexed, "eligibility_confidence", CONFIDENCE),
        "confidence_eligible": pivot_counts(eligible, "eligibility_confidence", CONFIDENCE),
        "country": country_coverage(jobs, catalog, [country]),
        "freshness": freshness(partitions, "fetched_at", now),
        "freshness_members": freshness_members(partitions, "source_slug", "fetched_at", now),
        "candidates": candidates.agg(F.count(F.lit(1)).alias("candidates")),
        "promoted_candidates": promoted(candidates, catalog).agg(F.count(F.lit(1)).alias("promoted_candidates")),
        "leads": state_histograms(leads, now),
    }


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
