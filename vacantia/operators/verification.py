"""Funnels of source verification and discovery over recorded probes; every rejection is a row with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, urls

# Channels of discovery, kinds of domain evidence.
CHANNELS = ["search", "career_page", "provider_directory", "community", "dataset", "legacy"]
EVIDENCE = ["authoritative_dataset", "company_registry", "company_redirect", "company_page_link"]
LEGAL_FORMS = r"(?<![a-z0-9_])(?:inc|llc|ltd|limited|corp|corporation|company)(?![a-z0-9_])"


def candidate_error() -> Column:
    """The first rule that a candidate breaks, null if none."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return (
        F.when(blank("company_name"), "company_name is required")
        .when(F.col("slug").isNotNull() & ~F.col("slug").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), "slug must contain lowercase letters, numbers and single hyphens")
        .when(~F.coalesce(F.col("company_domain").rlike(r"(?i)^[a-z0-9.-]+\.[a-z]{2,}$"), F.lit(False)), "company_domain must be a hostname")
        .when(blank("source_url"), "source_url is required")
        .when(~F.coalesce(F.col("channel").isin(CHANNELS), F.lit(False)) | blank("reference"), "provenance must have a supported channel and reference")
    )


def normal_name(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), LEGAL_FORMS, ""), "[^a-z0-9]", "")


def identity_matches(expected: Column, domain: Column, observed: Column, token: Column) -> Column:
    """Names contain each other or the token, and the domain label too; of three letters and more."""
    a, b, t = normal_name(expected), normal_name(observed), normal_name(token)
    label = normal_name(F.split(urls.bare_host(domain), r"\.")[0])
    same = F.contains(a, b) | F.contains(b, a) | F.contains(a, t) | F.contains(t, a)
    return (F.length(a) >= 3) & (F.length(label) >= 3) & same & (F.contains(a, label) | F.contains(label, a))


def verify(candidates: DataFrame, probes: DataFrame, jobs: DataFrame, country: str | None = None) -> DataFrame:
    """Candidates with the first reason against them (null: verified), from recorded probes and jobs.

    ``probes``: source_key, status, observed_name. Stages: validate, resolve, probe, identity, country gate.
    The precedence fold over what is left is ``precedence.dedupe_verified``.
    """
    board = urls.resolve(F.col("source_url"))
    rows = candidates.withColumn("error", candidate_error()).withColumn("board", board)
    rows = rows.withColumns({"ats": F.col("board.ats"), "token": F.col("board.token"), "source_key": urls.source_key(F.col("board.ats"), F.col("board.token"))})
    rows = rows.join(probes.select("source_key", "status", "observed_name"), "source_key", "left")
    if country:
        open_here = jobs.where(geo.eligible_for(country)).select("source_key", F.lit(True).alias("_open")).distinct()
        rows = rows.join(open_here, "source_key", "left")
    else:
        rows = rows.withColumn("_open", F.lit(True))
    observed = F.coalesce(F.nullif("observed_name", F.lit("")), "token")
    reason = (
        F.when(F.col("error").isNotNull(), "invalid_candidate").when(F.col("board").isNull(), "unsupported_source").when(F.coalesce(F.col("status"), F.lit(0)) != 200, "probe_failed")
        .when(~identity_matches(F.col("company_name"), F.col("company_domain"), observed, F.col("token")), "identity_mismatch").when(F.col("_open").isNull(), "no_country_jobs")
    )
    return rows.withColumn("reason", reason).drop("board", "_open")


def report(rows: DataFrame) -> DataFrame:
    """The funnel in numbers."""
    return rows.groupBy(F.coalesce("reason", F.lit("verified")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def dedupe_discovered(rows: DataFrame) -> DataFrame:
    """One row a source: accepted beats unresolved, then the first."""
    turn = F.row_number().over(Window.partitionBy("source_key").orderBy(F.col("accepted").desc(), "ordinal"))
    return rows.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def verification_order(candidates: DataFrame, attempts: DataFrame, catalog: DataFrame, limit: int) -> DataFrame:
    """Oldest attempt first (never before all), new before known, then the oldest check, then input order."""
    last = attempts.groupBy("source_key").agg(F.max("attempted_at").alias("attempted_at"))
    known = catalog.select("source_key", "checked_at", F.lit(1).alias("known"))
    rows = candidates.join(last, "source_key", "left").join(known, "source_key", "left").fillna(0, ["known"])
    return rows.orderBy(F.asc_nulls_first("attempted_at"), "known", F.asc_nulls_first("checked_at"), "ordinal").limit(limit)


def merge_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by source: cohorts united and sorted, the first evidence stays; rows of one new source are one."""
    rest = [c for c in new.columns if c not in ("source_key", "cohorts")]
    new = new.groupBy("source_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cohorts")))).alias("cohorts"), *[F.min(c).alias(c) for c in rest])
    b = new.select(F.col("source_key"), *[F.col(c).alias(f"_{c}") for c in new.columns if c != "source_key"])
    both = old.join(b, "source_key", "full")
    none = F.array().cast("array<string>")
    cohorts = F.array_sort(F.array_union(F.coalesce("cohorts", none), F.coalesce("_cohorts", none)))
    return both.select(*[F.col(c) if c == "source_key" else cohorts.alias(c) if c == "cohorts" else F.coalesce(c, f"_{c}").alias(c) for c in old.columns])


def resolve_employers(names: DataFrame, boards: DataFrame) -> DataFrame:
    """The first confirmed board of each employer: its guessed tokens against recorded boards ``ats, token, rank``."""
    from ..functions import text

    guesses = names.select("name", F.posexplode(text.token_guesses(F.col("name"))).alias("guess", "token"))
    met = guesses.join(boards.withColumn("token", F.lower("token")), "token")
    return met.groupBy("name").agg(F.min_by(F.struct("ats", "token"), F.struct("guess", "rank")).alias("board")).select("name", "board.*")


def viability(qualified: Column, jobs: Column, with_id: Column, with_country: Column) -> Column:
    """A structured-data probe is worth going on: 5 companies, 20 jobs, 80 % with ids, 95 % with countries."""
    share = lambda part: F.when(jobs > 0, part / jobs).otherwise(0.0)
    return (qualified >= 5) & (jobs >= 20) & (share(with_id) >= 0.8) & (share(with_country) >= 0.95)


def directory_companies(rows: DataFrame, country_name: str) -> DataFrame:
    """Directory entries whose places name a country, the first of each domain."""
    hit = F.col("locations").rlike(rf"(?i)(?<![A-Za-z0-9_]){country_name}(?![A-Za-z0-9_])")
    own = rows.where(hit).withColumn("domain", urls.bare_host(urls.host(F.col("website")))).where("domain IS NOT NULL")
    return own.groupBy("domain").agg(F.min_by("name", "ordinal").alias("name"), F.min("ordinal").alias("ordinal"))


def promoted(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Candidates that stand in the catalog: one provider, token and domain, whatever their case; without an address none does."""
    if "source_url" not in candidates.columns:
        return candidates.limit(0)
    lower = lambda c: F.lower(F.col(c))
    held = catalog.select(F.col("ats").alias("_ats"), lower("token").alias("_token"), lower("company_domain").alias("_domain")).distinct()
    board = candidates.withColumn("_board", urls.resolve(F.col("source_url")))
    met = (F.col("_board.ats") == F.col("_ats")) & (F.lower("_board.token") == F.col("_token")) & (lower("company_domain") == F.col("_domain"))
    return board.join(held, met, "left_semi").drop("_board")


def against_catalog(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``standing``: new; known (slug, domain and address agree); conflict (the slug is another's)."""
    held = catalog.select(F.col("slug").alias("_slug"), F.lower("company_domain").alias("_domain"), F.lower("source_url").alias("_url"))
    same = F.lower("company_domain").eqNullSafe(F.col("_domain")) & F.lower("source_url").eqNullSafe(F.col("_url"))
    out = candidates.join(held, F.col("slug") == F.col("_slug"), "left")
    return out.withColumn("standing", F.when(F.col("_slug").isNull(), "new").when(same, "known").otherwise("conflict")).drop("_slug", "_domain", "_url")


def verifiable(candidates: DataFrame, registry: DataFrame, now) -> DataFrame:
    """Candidates that may be tried: those the registry does not know, and those whose retry is due. Adds ``retry``."""
    from .registry import retry_disposition

    states = registry.select("source_key", retry_disposition(now).alias("retry"))
    out = candidates.join(states, "source_key", "left").withColumn("retry", F.coalesce("retry", F.lit("fresh")))
    return out.where(F.col("retry").isin("fresh", "retryable"))


def discover_and_promote(discovered: DataFrame, catalog: DataFrame, probes: DataFrame, jobs: DataFrame, country: str | None = None) -> DataFrame:
    """Discovery, then verification: one row a source, those that the catalog lacks, verified or with a reason."""
    once = dedupe_discovered(discovered)
    fresh = against_catalog(once, catalog).where("standing = 'new'").drop("standing", "source_key")
    return verify(fresh, probes, jobs, country)


def board_origins(boards: DataFrame, origins: DataFrame, queries: DataFrame) -> DataFrame:
    """``key, index_id``: the indexes that each board was seen in, each once; a row a pair, in order."""
    met = boards.select("key").join(origins.select(F.col("board_key").alias("key"), "query_id"), "key").join(queries.select(F.col("id").alias("query_id"), "index_id"), "query_id")
    return met.select("key", "index_id").distinct().orderBy("key", "index_id")


def campaign_totals(boards: DataFrame, known: DataFrame, records: int, rejected: int) -> DataFrame:
    """One row: boards, those the catalog knows, new ones, records read, lines rejected."""
    marked = boards.select("key").distinct().join(known.select("key", F.lit(1).alias("_known")).distinct(), "key", "left")
    return marked.agg(F.count(F.lit(1)).alias("boards"), F.count("_known").alias("known_boards"), F.count_if(F.col("_known").isNull()).alias("new_board_leads")).withColumns({"records": F.lit(records), "rejected_records": F.lit(rejected)})


def site_yield(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals of a site probe, and its sites by postings. Rows: domain, career_url, robots_blocked, pages_fetched, postings, with_date, with_identifier, country_postings."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    totals = sites.agg(
        F.count(F.lit(1)).alias("checked"), F.count("career_url").alias("with_careers_page"), F.count_if(F.col("postings") > 0).alias("with_postings"), F.count_if("robots_blocked").alias("robots_blocked"),
        *map(total, ["pages_fetched", "postings", "with_date", "with_identifier", "country_postings"]),
    )
    return totals, sites.orderBy(F.desc("postings"), "domain")


def probe_phases(companies: DataFrame, order: str, size: int = 10, phases: int = 2) -> DataFrame:
    """The companies that a structured-data probe looks at, in phases of a size; the later phase runs only if the first is ``viability``-proven."""
    first = companies.orderBy(order).limit(size * phases)
    return first.withColumn("phase", F.ceil(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order)) / size).cast("int"))  # so many rows at most
