"""Ranking of postings against a resume: hard filters with all their reasons, scores, classes, order.

Requirement terms and screening are read in Arrow batches; everything after is Column expressions.
Scores never depend on the age window, so jobs are scored once and windows are filters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, experience, geo, text
from . import requirements
from .profile import Profile, validate_profile

# Titles of role families, generic ones, and the words that corroborate these.
TITLES = {
    "backend": [
        "platform engineer", "api engineer", "api developer", "distributed systems engineer", "server-side engineer", "services engineer", "software engineer", "software developer",
        "application developer",
    ],
    "frontend": ["ui engineer", "web engineer", "web developer", "client engineer", "software engineer"],
    "data": ["data engineer", "analytics engineer", "machine learning engineer", "ml engineer", "data platform engineer"],
    "infrastructure": ["infrastructure engineer", "cloud engineer", "devops engineer", "site reliability engineer", "sre", "platform engineer"],
}
GENERIC_TITLES = ["software engineer", "software developer"]
SIGNALS = {
    "backend": ["backend", "api", "java", "golang", "python", "node.js", "spring", "microservices", "distributed systems"],
    "frontend": ["frontend", "front-end", "javascript", "typescript", "react", "angular", "vue", "css"],
    "data": ["data pipeline", "analytics", "machine learning", "spark", "airflow", "dbt", "snowflake"],
    "infrastructure": ["infrastructure", "cloud", "aws", "azure", "gcp", "kubernetes", "terraform", "site reliability", "devops"],
}
# Fixed patterns: words of a requested role that name a family.
ROLE_WORDS = {
    "backend": r"\b(?:backend|api|server-side|distributed systems)\b", "frontend": r"\b(?:frontend|front-end|ui|web)\b",
    "data": r"\b(?:data|analytics|machine learning|ml)\b", "infrastructure": r"\b(?:infrastructure|cloud|devops|site reliability|sre)\b",
}
SENIORITY = ["manager", "principal", "staff", "lead", "senior", "mid", "junior", "intern"]
LEAST_YEARS = {"senior": 5, "lead": 6, "staff": 7, "principal": 8, "manager": 6}
_A = r"(?<![A-Za-z0-9_])"
_Z = r"(?![A-Za-z0-9_])"
SPECIALIST = rf"(?i){_A}(?:product manager|qa|quality assurance|test|support|site reliability|sre|devops|front(?:end|-end)|data|machine learning|ai|ml){_Z}"
ENGINEER = rf"(?i){_A}(?:engineer|developer){_Z}"
GENERIC_SOFTWARE = rf"(?i){_A}(?:software engineer|software developer|application developer|full[- ]stack developer){_Z}"
KEYWORD_STOP = ["engineer", "engineering", "developer", "development", "senior", "staff", "principal", "lead", "technology"]
# Requirement, skills that carry over to it, by which kind; the table is empty until an edge has a rationale.
TRANSFERS: list[tuple[str, str, str]] = []
FIT_RANK = {"strong": 3, "good": 2, "stretch": 1}


@dataclass
class Intent:
    roles: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)
    remote: bool | None = None
    seniority: list[str] = field(default_factory=list)
    required_skills: list[str] = field(default_factory=list)
    excluded_terms: list[str] = field(default_factory=list)
    excluded_countries: list[str] = field(default_factory=list)
    excluded_locations: list[str] = field(default_factory=list)
    excluded_roles: list[str] = field(default_factory=list)
    max_age_days: int | None = None


def reasons(*rules: tuple[Column, Column]) -> Column:
    """All reasons that hold, in order."""
    return F.array_compact(F.array(*[F.when(rule, reason) for rule, reason in rules])) if rules else F.array().cast("array<string>")


def reason_histogram(rows: DataFrame, kept: str = "(kept)") -> DataFrame:
    """Rows by kind of reason (what stands before a colon), each row under all of its kinds; and those without."""
    all_ = F.when(F.size("reasons") > 0, F.array_distinct(F.transform("reasons", lambda r: F.substring_index(r, ":", 1)))).otherwise(F.array(F.lit(kept)))
    return rows.select(F.explode(all_).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def hard_filter(intent: Intent, now: datetime) -> Column:
    title, place = F.col("title"), geo.normalize_location(F.col("location"))
    rules: list[tuple[Column, Column]] = []
    if intent.countries:
        nowhere = ~_any([geo.eligible_for(c) for c in intent.countries])
        rules += [(nowhere, F.lit(f"country_not_eligible:{c.upper()}")) for c in intent.countries]
    rules += [(geo.eligible_for(c), F.lit(f"country_excluded:{c.upper()}")) for c in intent.excluded_countries]
    within = lambda loc: F.contains(place, F.lit(geo.normalize_location_of(loc)))
    if intent.locations:
        rules.append((~_any([within(x) for x in intent.locations]), F.lit("location_mismatch")))
    rules += [(within(x), F.lit(f"location_excluded:{x}")) for x in intent.excluded_locations]
    rules += [(text.includes_phrase(title, r) | (text.token_overlap(r, title) == 1), F.lit(f"role_excluded:{r}")) for r in intent.excluded_roles]
    days = dates.DEFAULT_MAX_AGE if intent.max_age_days is None else intent.max_age_days
    if days > 0:
        old = ~dates.within_window(F.col("updated_at"), days, now)
        rules.append((old if intent.max_age_days is not None else old & F.col("updated_at").isNotNull(), F.lit(f"posted_too_old:{days}d")))
    if intent.remote is True:
        rules.append((F.col("work_mode") != "remote", F.lit("remote_required")))
    if intent.remote is False:
        rules.append((F.col("work_mode").isin("remote", "unknown"), F.lit("non_remote_required")))
    searchable = F.concat_ws("\n", "title", "company", "location", "description")
    rules += [(text.includes_phrase(searchable, t), F.lit(f"excluded_term:{t}")) for t in intent.excluded_terms]
    return reasons(*rules)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def role_families(profile: Profile, intent: Intent) -> list[tuple[str, bool, int]]:
    """(family, asked for, number of facts behind it)."""
    asked = {f for role in intent.roles for f, p in ROLE_WORDS.items() if re.search(p, role, re.I | re.ASCII)}
    if any(text.includes_phrase_of(r, "platform engineer") for r in intent.roles):
        asked |= {"backend", "infrastructure"}
    held = {i.value: len(i.fact_ids) for i in profile.inferences if i.kind == "role_family"}
    return [(f, f in asked, 0 if f in asked else held[f]) for f in TITLES if f in asked or f in held]


def title_expansion(families: list[tuple[str, bool, int]]) -> Column:
    """The first family title a job has: asked-for families, then more facts, then by name. Null if none."""
    ranked = sorted(((not asked, -facts, family, alias) for family, asked, facts in families for alias in TITLES[family]))
    out = F.lit(None).cast("string")
    for _, _, family, alias in reversed(ranked):
        hit = text.includes_phrase(F.col("title"), alias)
        if alias in GENERIC_TITLES:
            hit = hit & _any([text.includes_phrase(F.col("description"), s) for s in SIGNALS[family]])
        out = F.when(hit, F.lit(f"{family}:{alias}")).otherwise(out)
    return out


def role_score(targets: list[str], asked: bool, expansion: Column) -> Column:
    title = F.col("title")
    if not targets:
        return F.lit(0.0)
    close = lambda t: text.token_overlap(t, title) >= 0.5
    if not asked:
        return F.when(_any([close(t) for t in targets]), 4.0).when(expansion.isNotNull(), 3.0).otherwise(0.0)
    backend = [t for t in targets if text.includes_phrase_of(t, "backend")]
    plain = [t for t in targets if t not in backend]
    special = title.rlike(SPECIALIST)
    exact = ~special & title.rlike(ENGINEER) & _any([text.includes_phrase(title, t) | (text.token_overlap(t, title) == 1) | text.includes_phrase(title, "backend") for t in backend])
    near = F.lit(bool(backend)) & title.rlike(GENERIC_SOFTWARE) & ~special
    return (
        F.when(exact, 6.0).when(_any([close(t) for t in plain]), 4.0).when(near, 3.0).when(expansion.isNotNull(), 3.0).otherwise(-6.0 if backend else 0.0)
    )


def seniority_score(profile: Profile, intent: Intent) -> Column:
    years = profile.years
    level = F.lit(None).cast("string")
    for s in reversed(SENIORITY):
        level = F.when(text.includes_phrase(F.col("title"), s), s).otherwise(level)
    wanted = [s.lower() for s in intent.seniority] if intent.seniority else [str(i.value) for i in profile.inferences if i.kind == "seniority"]
    if wanted:
        by_title = F.when(level.isNull(), 0).when(level.isin(wanted), 2).otherwise(-2)
    elif years is None:
        by_title = F.lit(0)
    else:
        fits = [s for s in SENIORITY if (years <= 2 if s in ("intern", "junior") else 2 <= years <= 6 if s == "mid" else years >= LEAST_YEARS[s])]
        by_title = F.when(level.isNull(), 0).when(level.isin(fits) if fits else F.lit(False), 2).otherwise(-2)
    if years is None or intent.seniority:
        return by_title
    e = F.col("experience")
    fits = (F.lit(years) >= e["min"] - 1) & (e["max"].isNull() | F.coalesce(e["max_open"], F.lit(False)) | (F.lit(years) <= e["max"] + 3))
    return F.when(e.isNull(), by_title).when(fits, 3).otherwise(-3)


def fit_class(score: Column, gaps: Column, shortfalls: Column) -> Column:
    return F.when(shortfalls > 0, "stretch").when((score >= 8) & (gaps == 0), "strong").when(score >= 4, "good").otherwise("stretch")


def fit_rank(fit: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in FIT_RANK.items() for x in pair])[fit]


def explicit_evidence(profile: Profile, requirement: str) -> list[str]:
    """Ids of the facts that show a requirement: exact skills by name, others as a phrase (certifications do not count)."""
    if requirements.needs_exact_skill(requirement):
        return [f.id for f in profile.facts if f.kind == "skill" and requirements.exact_skill_matches(requirement, f.value)]
    return [f.id for f in profile.facts if f.kind != "certification" and text.includes_phrase_of(f.value, requirement)]


_READ = "struct<supported:array<string>,gaps:array<string>,n_requirements:int,screened:int,screened_supported:int,screened_partial:int,keywords:int,keywords_found:int,focus:int>"


def unique_terms(values: list[str]) -> list[str]:
    return list({v.strip().lower(): v for v in reversed(values) if v.strip()}.values())[::-1]


def _reader(profile: Profile, intent: Intent):
    """What a posting asks for against what the resume shows, in Arrow batches."""
    education = profile.values("education")
    years, resume, focus_terms = profile.years, profile.text, unique_terms(intent.required_skills)

    def read(title: str, description: str) -> dict:
        needs = requirements.detected_requirements(description)
        screened = requirements.screening(description, years, education)
        focus = [s for s in focus_terms if text.includes_phrase_of(f"{title}\n{description}", s)]
        supported = list({n.lower(): n for n in needs if explicit_evidence(profile, n)}.values())
        short = [s.requirement for s in screened if s.status != "supported"]
        gaps = [g for g in dict.fromkeys([*needs, *focus, *short]) if not explicit_evidence(profile, g)]
        words = [w for w in re.findall("[a-z0-9+#.]+", title.lower()) if len(w) > 2 and w not in KEYWORD_STOP]
        keywords = unique_terms([*words, *requirements.detect_terms(description), *(s.requirement for s in screened)])
        found = [k for k in keywords if text.includes_phrase_of(resume, k) or text.hyphenated_phrase_of(resume, k)]
        return {
            "supported": supported, "gaps": gaps, "n_requirements": len({x.lower() for x in [*supported, *gaps]}), "screened": len(screened),
            "screened_supported": sum(s.status == "supported" for s in screened), "screened_partial": sum(s.status == "partial" for s in screened),
            "keywords": len(keywords), "keywords_found": len(found), "focus": len(focus),
        }

    @F.pandas_udf(_READ)
    def run(title: pd.Series, description: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(t or "", d or "") for t, d in zip(title, description, strict=True)], columns=["supported", "gaps", "n_requirements", "screened", "screened_supported", "screened_partial", "keywords", "keywords_found", "focus"])

    return run


def score_jobs(jobs: DataFrame, profile: Profile, intent: Intent, now: datetime) -> DataFrame:
    """Every job with its hard-filter reasons; scores where there are none."""
    errors = validate_profile(profile)
    if errors:
        raise ValueError(f"invalid_candidate_profile: {errors[0]}")
    rows = experience.with_experience(jobs).withColumn("reasons", hard_filter(intent, now))
    inferred = [*profile.values("role"), *(f"{i.value} engineer" for i in profile.inferences if i.kind == "role_family")]
    targets = intent.roles or inferred
    rows = rows.withColumn("expansion", title_expansion(role_families(profile, intent)))
    rows = rows.withColumn("role_score", role_score(targets, bool(intent.roles), F.col("expansion"))).withColumn("seniority_score", seniority_score(profile, intent))
    rows = rows.withColumn("_r", F.when(F.size("reasons") == 0, _reader(profile, intent)(F.col("title"), F.col("description"))))
    r = F.col("_r")
    short = r["screened"] - r["screened_supported"]
    supported, gaps = F.size(r["supported"]), F.size(r["gaps"])
    score = F.col("role_score") + 2 * supported + 3 * r["focus"] + F.col("seniority_score") - 2 * gaps - 6 * short
    role_points = F.lit(0.0) if not targets else F.when(F.col("role_score") >= 4, 30.0).when(F.col("role_score") >= 3, 22.5).otherwise(0.0)
    share = F.when(r["n_requirements"] > 0, supported / r["n_requirements"] * 50).otherwise(0.0)
    screened = F.when(r["screened"] > 0, (r["screened_supported"] + r["screened_partial"] * 0.5) / r["screened"] * 20).otherwise(F.when(F.col("seniority_score") > 0, 20.0).when(F.col("seniority_score") < 0, 0.0).otherwise(10.0))
    cap = F.when(short > 0, 79).otherwise(100)
    half_up = lambda c: F.floor(c + 0.5)
    direct = _any([text.includes_phrase(F.col("title"), t) | (text.token_overlap(t, F.col("title")) == 1) for t in targets])
    out = rows.withColumns({
        "supported": r["supported"], "gaps": r["gaps"], "score": score, "fit": fit_class(score, gaps, short),
        "evidence_percent": F.least(half_up(role_points + share + screened), cap).cast("int"),
        "keyword_percent": F.when(r["keywords"] > 0, F.least(half_up(r["keywords_found"] / r["keywords"] * 100), cap)).otherwise(0).cast("int"),
    })
    category = F.when(F.col("fit") == "stretch", "stretch").when(direct, "direct").when(F.col("expansion").isNotNull(), "hidden").otherwise("stretch")
    return out.withColumn("category", category).drop("_r")


def match_jobs(jobs: DataFrame, profile: Profile, intent: Intent, now: datetime, limit: int = 20, mode: str = "evidence", minimum_percent: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The best matches in order, and the jobs filtered out with all their reasons. ``jobs`` has an ``ordinal``."""
    scored = score_jobs(jobs, profile, intent, now)
    selected = F.col(f"{mode}_percent")
    if minimum_percent is not None:
        below = (F.size("reasons") == 0) & (selected < minimum_percent)
        scored = scored.withColumn("reasons", F.when(below, F.array(F.concat(F.lit(f"below_minimum_{mode}_score:"), selected.cast("string")))).otherwise(F.col("reasons")))
    kept = scored.where(F.size("reasons") == 0)
    best = kept.orderBy(selected.desc(), fit_rank(F.col("fit")).desc(), F.desc("score"), F.desc_nulls_last("updated_at"), "ordinal").limit(max(0, limit))
    shown = best.withColumns({"posted_days_ago": dates.posted_days_ago(F.col("updated_at"), now), "age": dates.job_age(F.col("updated_at"), now)})
    return shown, scored.where(F.size("reasons") > 0).select("id", "reasons")


def best_of(scored: DataFrame, intent: Intent, now: datetime, limit: int) -> tuple[DataFrame, DataFrame]:
    """Matches of the first window with enough of them, in order, and the window's one-row description."""
    from . import search

    windows = dates.CASCADE if intent.max_age_days is None else (intent.max_age_days,)
    inside = search.in_cascade(scored, "updated_at", now, windows)
    best = inside.orderBy(F.desc("evidence_percent"), fit_rank(F.col("fit")).desc(), F.desc("score"), F.desc_nulls_last("updated_at"), "ordinal").limit(limit)
    return best.withColumn("description", search.excerpt(F.col("description"))), search.cascade_steps(scored, "updated_at", now, windows)


def recommend(jobs: DataFrame, profile: Profile, intent: Intent, now: datetime, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """``best_of`` all jobs without a reason against them; scored once for all windows."""
    scored = score_jobs(jobs, profile, Intent(**{**intent.__dict__, "max_age_days": 0}), now)
    return best_of(scored.where(F.size("reasons") == 0), intent, now, limit)


def filtered_out(jobs: DataFrame, intent: Intent, now: datetime) -> DataFrame:
    """``id, reasons`` of the jobs that the hard filters of an intent keep out; nothing is scored for it."""
    return jobs.select("id", hard_filter(intent, now).alias("reasons")).where(F.size("reasons") > 0)


def transferable(needs: DataFrame, skills: DataFrame, edges: DataFrame) -> DataFrame:
    """Requirements (``id, requirement``) that a held skill (``skill, fact_id``) carries over to, through ``edges`` (``target, source, via``).

    Equal names count as supported and not as transferable.
    """
    lower = lambda c: F.lower(F.col(c))
    held = skills.select(lower("skill").alias("source"), "fact_id")
    reached = edges.select(lower("target").alias("target"), lower("source").alias("source"), "via").join(held, "source")
    met = needs.join(reached, lower("requirement") == F.col("target")).join(held.select(F.col("source").alias("own")).distinct(), lower("requirement") == F.col("own"), "left_anti")
    return met.groupBy("id", "requirement", "via").agg(F.array_sort(F.collect_set("fact_id")).alias("fact_ids"))


def transfer_edges(spark) -> DataFrame:
    return spark.createDataFrame(TRANSFERS, "target string, source string, via string")
