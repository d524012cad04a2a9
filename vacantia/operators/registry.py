"""The identity registry: states derived from facts, retries, upserts; array expressions, no state is stored.

A lead has ``source_key, source_url, ats, token, discovered_from, company_matches, identity_evidence,
attempts`` (arrays of structs) and ``promoted_at``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ranks of identity evidence.
RANKS = {"provider_structured_domain": 4, "company_redirect": 3, "company_page_link": 3, "company_registry": 2, "authoritative_dataset": 1}
# Providers whose evidence must be of the strongest kinds.
STRICT_PROVIDERS = ["lever", "ashby"]
STRICT_KINDS = [k for k, r in RANKS.items() if r >= 3]
REPEATED = 3

EVIDENCE = "array<struct<company_name:string,company_domain:string,kind:string,reference:string,observed_at:timestamp>>"
ATTEMPTS = "array<struct<attempted_at:timestamp,outcome:string,category:string,detail:string,next_eligible_at:timestamp,evidence_rank:int>>"
LEAD = (
    "source_key string, source_url string, ats string, token string, discovered_from array<struct<channel:string,reference:string>>, "
    f"company_matches array<struct<company_name:string,company_domain:string,method:string,reference:string>>, identity_evidence {EVIDENCE}, attempts {ATTEMPTS}, promoted_at timestamp"
)


def bare_domain(domain: Column) -> Column:
    return F.regexp_replace(F.lower(domain), r"^www\.", "")


def rank_of(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])[kind], F.lit(0))


def latest_attempt() -> Column:
    return F.try_element_at(F.col("attempts"), F.lit(-1))


def strongest_rank() -> Column:
    return F.coalesce(F.array_max(F.transform("identity_evidence", lambda e: rank_of(e["kind"]))), F.lit(0))


def _superseded() -> Column:
    """A mismatch that later and stronger evidence overtakes."""
    last = latest_attempt()
    newer = lambda e: (e["observed_at"] > last["attempted_at"]) & (rank_of(e["kind"]) > F.coalesce(last["evidence_rank"], F.lit(0)))
    return (F.coalesce(last["category"], F.lit("")) == "identity_mismatch") & F.exists("identity_evidence", newer)


def qualifying_evidence() -> Column:
    return F.filter("identity_evidence", lambda e: ~F.col("ats").isin(STRICT_PROVIDERS) | e["kind"].isin(STRICT_KINDS))


def winning_domains() -> Column:
    """Distinct domains of the qualifying evidence of the top rank."""
    evidence = qualifying_evidence()
    top = F.array_max(F.transform(evidence, lambda e: rank_of(e["kind"])))
    return F.array_distinct(F.transform(F.filter(evidence, lambda e: rank_of(e["kind"]) == top), lambda e: bare_domain(e["company_domain"])))


def lead_state() -> Column:
    """unresolved, matched, evidence_ready, verified or rejected."""
    outcome = F.coalesce(latest_attempt()["outcome"], F.lit(""))
    verified = F.col("promoted_at").isNotNull() & (outcome == "success")
    domains = winning_domains()
    agreed = F.exists("company_matches", lambda m: bare_domain(m["company_domain"]) == F.get(domains, F.lit(0)))
    return (
        F.when((outcome == "permanent_failure") & ~_superseded(), "rejected")
        .when(F.size("company_matches") == 0, F.when(verified, "verified").otherwise("unresolved"))
        .when(F.size(qualifying_evidence()) == 0, F.when(verified, "verified").otherwise("matched"))
        .when((F.size(domains) != 1) | ~agreed, "rejected")
        .otherwise(F.when(verified, "verified").otherwise("evidence_ready"))
    )


def trailing_failures(attempts: str = "attempts") -> Column:
    """Transient failures at the end of the history."""
    step = lambda a, x: F.struct((a["n"] + F.when(a["on"] & (x["outcome"] == "transient_failure"), 1).otherwise(0)).alias("n"), (a["on"] & (x["outcome"] == "transient_failure")).alias("on"))
    return F.aggregate(F.reverse(attempts), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), step, lambda a: a["n"])


def retry_disposition(now: datetime) -> Column:
    last = latest_attempt()
    return (
        F.when(F.size("attempts") == 0, "fresh")
        .when(last["outcome"] != "transient_failure", "retryable")
        .when(F.coalesce(last["next_eligible_at"] > F.lit(now).cast("timestamp"), F.lit(False)), "cooling_down")
        .when(trailing_failures() >= REPEATED, "repeatedly_failing")
        .otherwise("retryable")
    )


def board_cooling_down(now: datetime) -> Column:
    """A permanent failure cools a board for 30 days, a transient one for a day."""
    last = latest_attempt()
    days = F.when(last["outcome"] == "permanent_failure", 30).when(last["outcome"] == "transient_failure", 1)
    age = (F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(last["attempted_at"])) / F.lit(86_400_000)
    return F.coalesce(age < days, F.lit(False))


def board_funnel(boards: DataFrame, supported: list[str], excluded: DataFrame, catalog: DataFrame, now: datetime) -> DataFrame:
    """Why each board is skipped (null: it is probed), by the first rule that holds. Adds ``skip``."""
    key = F.concat_ws(":", "ats", F.lower("token"))
    out = boards.withColumn("_key", key)
    out = out.join(excluded.select(F.lower("key").alias("_key"), F.lit(True).alias("_out")).distinct(), "_key", "left")
    out = out.join(catalog.select(key.alias("_key"), F.lit(True).alias("_in")).distinct(), "_key", "left")
    skip = (
        F.when(~F.col("ats").isin(supported), "unsupported")
        .when(F.col("_out"), "excluded")
        .when(F.col("_in"), "in_catalog")
        .when(test_board(F.col("token")), "test_board")
        .when(board_cooling_down(now), "cooling_down")
    )
    return out.withColumn("skip", skip).drop("_key", "_out", "_in")


def test_board(token: Column) -> Column:
    """Generated names: a letter, and either five digits in a row or eight characters and more without a vowel."""
    return token.rlike("(?i)[a-z]") & (token.rlike("[0-9]{5}") | ((F.length(token) >= 8) & ~token.rlike("(?i)[aeiou]")))


FACTS = ["discovered_from", "company_matches", "identity_evidence", "attempts"]


def united_additions(additions: DataFrame) -> DataFrame:
    """One row a source: the facts of its rows united, the first (smallest) of other columns, the last promotion."""
    rest = [c for c in additions.columns if c not in ("source_key", "promoted_at", *FACTS)]
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in FACTS if c in additions.columns]
    promoted = [F.max("promoted_at").alias("promoted_at")] if "promoted_at" in additions.columns else []
    return additions.groupBy("source_key").agg(*united, *[F.min(c).alias(c) for c in rest], *promoted).select(*additions.columns)


def merge_leads(registry: DataFrame, additions: DataFrame) -> DataFrame:
    """Upsert: facts are united and sorted, the first URL stays, the last promotion wins; additions of one key are one lead."""
    facts = FACTS
    additions = united_additions(additions)
    b = additions.select(F.col("source_key"), *[F.col(c).alias(f"_{c}") for c in additions.columns if c != "source_key"])
    both = registry.join(b, "source_key", "full")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(registry.schema[c.lstrip("_")].dataType))
    united = {c: F.array_sort(F.array_distinct(F.concat(none(c), none(f"_{c}")))) for c in facts}
    kept = {c: F.coalesce(c, f"_{c}") for c in ("source_url", "ats", "token")}
    return both.select(*[(united | kept | {"promoted_at": F.coalesce("_promoted_at", "promoted_at")}).get(c, F.col(c)).alias(c) for c in registry.columns])


def identities_per_token(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Per token: quarantined if it has several domains, excluded if the domain is known, else matched."""
    grouped = rows.groupBy("token").agg(F.collect_set(bare_domain(F.col("domain"))).alias("domains"))
    known = existing.select(bare_domain(F.col("domain")).alias("domain"), F.lit(True).alias("_known")).distinct()
    one = grouped.withColumn("domain", F.when(F.size("domains") == 1, F.get("domains", F.lit(0))))
    state = F.when(F.size("domains") != 1, "quarantined").when(F.col("_known"), "excluded").otherwise("matched")
    return one.join(known, "domain", "left").select("token", "domain", state.alias("state"))


def lead_company_matches(leads: DataFrame, companies: DataFrame) -> DataFrame:
    """Leads whose token is the normal name or domain label of companies of exactly one domain."""
    from .precedence import unique_match

    squash = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    label = F.split(bare_domain(F.col("company_domain")), r"\.")[0]
    return unique_match(leads, companies.withColumn("company_domain", bare_domain(F.col("company_domain"))), F.array(squash("token")), F.array(squash("company_name"), squash(label)), "source_key", "company_domain")


def trailing_failures_of(attempts: DataFrame, key: str, order: list[str], outcome: Column) -> DataFrame:
    """The same count from attempts as rows, without gathering histories: failures after the last other outcome. ``key, failures``."""
    at = F.struct(*order)
    failed = outcome == "transient_failure"
    last = attempts.groupBy(key).agg(F.max(F.when(~failed, at)).alias("_last"))
    later = F.coalesce(at > F.col("_last"), F.lit(True))
    return attempts.withColumn("_failed", failed).join(last, key).groupBy(key).agg(F.count_if(F.col("_failed") & later).alias("failures"))


def state_histograms(leads: DataFrame, now: datetime) -> DataFrame:
    """Leads by derived state and by retry disposition: ``kind, name, n``."""
    named = leads.select(F.explode(F.array(F.struct(F.lit("state").alias("kind"), lead_state().alias("name")), F.struct(F.lit("retry").alias("kind"), retry_disposition(now).alias("name")))).alias("x"))
    return named.groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).alias("n")).select("kind", "name", "n")


def record_outcomes(registry: DataFrame, outcomes: DataFrame, now: datetime) -> DataFrame:
    """Append an attempt to the leads that a verification run decided (``source_key, outcome, category, detail``), others stay.

    A success promotes; a transient failure sets the time of the next try by the run of failures before it; a permanent
    one keeps the rank of the evidence it was judged on.
    """
    from ..functions.dates import lead_backoff_seconds

    at = F.lit(now).cast("timestamp")
    wait = F.when(F.col("outcome") == "transient_failure", F.timestamp_millis(F.unix_millis(at) + (lead_backoff_seconds(trailing_failures() + 1) * 1000).cast("long")))
    attempt = F.struct(
        at.alias("attempted_at"), F.col("outcome"), F.when(F.col("outcome") != "success", F.col("category")).alias("category"), F.when(F.col("outcome") != "success", F.col("detail")).alias("detail"),
        wait.alias("next_eligible_at"), F.when(F.col("outcome") == "permanent_failure", strongest_rank()).cast("int").alias("evidence_rank"),
    )
    decided = registry.join(outcomes.dropDuplicates(["source_key"]), "source_key", "left")
    hit = F.col("outcome").isNotNull()
    changed = {"attempts": F.when(hit, F.concat("attempts", F.array(attempt))).otherwise(F.col("attempts")), "promoted_at": F.when(F.col("outcome") == "success", at).otherwise(F.col("promoted_at"))}
    return decided.select(*[changed.get(c, F.col(c)).alias(c) for c in registry.columns])


def career_leads(companies: DataFrame, leads: DataFrame) -> DataFrame:
    """The first lead (by ``ordinal``) whose token is the company's normal name or domain label: ``company_domain, source_key``."""
    from .verification import normal_name

    tenant = F.when(F.contains("token", F.lit("myworkdayjobs.com/")), F.split("token", "/")[1]).otherwise(F.col("token"))
    known = leads.select("source_key", "ordinal", normal_name(tenant).alias("key")).where(F.length("key") >= 3)
    label = F.split(bare_domain(F.col("company_domain")), r"\.")[0]
    keys = F.explode(F.array_distinct(F.array(normal_name(F.col("company_name")), normal_name(label)))).alias("key")
    return companies.select("company_domain", keys).join(known, "key").groupBy("company_domain").agg(F.min_by("source_key", "ordinal").alias("source_key"))
