"""What changes between runs: partitions replaced, rows seen, crawl order and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates

SEEN_CAP = 4_000
DESCRIBE_BUDGET, DESCRIBE_DAYS = 150, 30


def replace_partitions(old: DataFrame, new: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """Fetched partitions replace theirs, others keep their rows; with ``known`` (a full run) strangers go."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    if known is not None:
        kept = kept.join(known.select(key).distinct(), key, "left_semi")
    return kept.unionByName(new)


def new_since(found: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows not seen before."""
    return found.join(seen, keys, "left_anti")


def update_seen(found: DataFrame, seen: DataFrame, watch: str, id_: str, cap: int = SEEN_CAP) -> DataFrame:
    """New ids first, then the old ones, at most ``cap`` a watch. Both sides have ``ordinal``."""
    fresh = found.join(seen.select(watch, id_), [watch, id_], "left_anti").select(watch, id_, "ordinal", F.lit(0).alias("_old"))
    both = fresh.unionByName(seen.select(watch, id_, "ordinal", F.lit(1).alias("_old")))
    turn = F.row_number().over(Window.partitionBy(watch).orderBy("_old", "ordinal"))
    return both.withColumn("ordinal", turn).where(F.col("ordinal") <= cap).drop("_old")


def crawl_due(sources: DataFrame, fetched_at: str, cutoff: datetime | Column) -> Column:
    """Fetched at or before the cutoff, or never."""
    return F.coalesce(F.col(fetched_at).cast("timestamp") <= dates.instant(cutoff), F.lit(True))


def crawl_order(sources: DataFrame, fetched_at: str, ordinal: str, limit: int) -> DataFrame:
    """Never fetched first, then the oldest; the rest is deferred."""
    return sources.orderBy(F.asc_nulls_first(fetched_at), F.asc(ordinal)).limit(limit)


def pending(sources: DataFrame, partitions: DataFrame, key: str, fetched_at: str, cutoff: datetime | Column) -> DataFrame:
    """State of every source: missing, stale (strictly before the cutoff) or fresh."""
    held = sources.join(partitions.select(key, fetched_at), key, "left")
    at = F.col(fetched_at).cast("timestamp")
    return held.withColumn("state", F.when(at.isNull(), "missing").when(at < dates.instant(cutoff), "stale").otherwise("fresh"))


def pending_counts(states: DataFrame) -> DataFrame:
    hit = lambda s: F.count_if(F.col("state") == s).alias(s)
    return states.agg(F.count(F.lit(1)).alias("sources"), hit("fresh"), hit("stale"), hit("missing"), F.count_if(F.col("state") != "fresh").alias("pending"))


def ready(counts: DataFrame, share: float = 0.95) -> DataFrame:
    """Preparation is done when so much of the sources is fresh."""
    return counts.withColumn("ready", F.coalesce(F.col("fresh") / F.nullif(F.col("sources"), F.lit(0)) >= share, F.lit(True)))


def crawl_report(attempts: DataFrame, considered: int, eligible: int) -> DataFrame:
    """Totals of a run from attempt rows ``source, outcome, status, backoff_ms``."""
    return attempts.agg(
        F.count_distinct("source").alias("selected"),
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("status") == 429).alias("throttles"),
        F.coalesce(F.sum("backoff_ms"), F.lit(0)).alias("backoff_ms"),
        F.count_if(F.col("outcome") == "success").alias("succeeded"),
    ).withColumns({"cached": F.lit(considered - eligible), "deferred": F.lit(eligible) - F.col("selected")})


def carry_experience(fresh: DataFrame, previous: DataFrame, version: int = 2) -> DataFrame:
    """Experience that was read before in the present version, for jobs of which nothing was read now."""
    old = previous.where(F.col("experience_version") == version).select("id", *[F.col(c).alias(f"_{c}") for c in ("experience", "experience_state", "experience_version")])
    joined = fresh.join(old, "id", "left")
    take = (F.col("experience_state") == "unread") & F.col("_experience_version").isNotNull()
    return joined.select(*[(F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c.startswith("experience") else F.col(c)) for c in fresh.columns])


def describe_budget(jobs: DataFrame, wanted: list[str], now: datetime, budget: int = DESCRIBE_BUDGET) -> DataFrame:
    """Jobs without a description that are worth a request: recent, those of wanted countries first, a budget each source."""
    from .precedence import country_rank

    recent = jobs.where((F.trim(F.coalesce("description", F.lit(""))) == "") & dates.within_window(F.col("updated_at"), DESCRIBE_DAYS, now))
    turn = F.row_number().over(Window.partitionBy("source_slug").orderBy(country_rank("eligible_countries", wanted), "ordinal"))
    return recent.withColumn("turn", turn).where(F.col("turn") <= budget)


def preserved_catalog(catalog: DataFrame, verified: DataFrame, rejected: DataFrame, soft: list[str]) -> DataFrame:
    """Verified entries, untouched ones, and old ones whose rejection was soft, unless a verified one has their slug, domain or source."""
    touched = verified.select("source_key").unionByName(rejected.select("source_key")).distinct()
    untouched = catalog.join(touched, "source_key", "left_anti")
    kept = catalog.join(rejected.where(F.col("reason").isin(soft)).select("source_key"), "source_key", "left_semi")
    old = untouched.unionByName(kept).distinct()
    for key in ("slug", "company_domain", "source_key"):
        old = old.join(verified.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*catalog.columns)
    return verified.select(*catalog.columns).unionByName(old)


def next_wave(attempts: DataFrame, waves: int = 2) -> DataFrame:
    """Sources to try again in this run: their last attempt failed, and they had fewer than ``waves``. Rows: source, outcome, ordinal."""
    tried = attempts.groupBy("source").agg(F.count(F.lit(1)).alias("attempts"), F.max_by("outcome", "ordinal").alias("last"))
    return tried.where((F.col("last") != "success") & (F.col("attempts") < waves)).select("source", "attempts")


def least_advanced(queries: DataFrame) -> DataFrame:
    """The order of an index campaign: queries with the fewest pages done first, never begun before all."""
    return queries.orderBy(F.asc_nulls_first("pages_done"), "id")
