"""Stored searches: what is kept of a resume, what matches, what is new since last time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import state
from .profile import Profile

CAP = 40


@dataclass
class WatchProfile:
    skills: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    seniority: str | None = None
    role_families: list[str] = field(default_factory=list)
    years: int | None = None
    countries: list[str] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)
    remote_only: bool = False
    excluded_terms: list[str] = field(default_factory=list)


def _clean(values: list[str], cap: int = CAP) -> list[str]:
    """Lower-cased short values, each once; what reads like a sentence is resume text and is not kept."""
    out: dict[str, None] = {}
    for raw in values:
        value = raw.strip().lower()[:64]
        if value and len(value.split()) <= 5:
            out[value] = None
    return list(out)[:cap]


def to_watch(profile: Profile, countries: list[str] = (), locations: list[str] = (), remote: bool | None = None, excluded_terms: list[str] = ()) -> WatchProfile:
    level = next((str(i.value) for i in profile.inferences if i.kind == "seniority"), None)
    families = [str(i.value) for i in profile.inferences if i.kind == "role_family"]
    return WatchProfile(
        _clean(profile.values("skill")), _clean(profile.values("role"), 12), level, _clean(families, 6), profile.years, [c.upper() for c in _clean(list(countries), 8)],
        _clean(list(locations), 12), remote is True, _clean(list(excluded_terms), 16),
    )


def describe(w: WatchProfile) -> str:
    """What is held, in the candidate's words."""
    listed = lambda lead, values, n: f"{lead}{', '.join(values[:n])}" if values else ""
    parts = [
        listed("roles like ", w.roles, 3), f"at {w.seniority} level" if w.seniority else "", f"around {w.years} years of experience" if w.years is not None else "",
        listed("skills including ", w.skills, 6), listed("open to ", w.countries, len(w.countries)), listed("in ", w.locations, 4), "remote only" if w.remote_only else "", listed("not ", w.excluded_terms, 4),
    ]
    return "; ".join(filter(None, parts)) or "no details were derived from the resume"


def _held(values: list[str], where: Column) -> Column:
    """The values that a text contains, as substrings."""
    return F.array_compact(F.array(*[F.when(F.contains(where, F.lit(v)), F.lit(v)) for v in values])) if values else F.array().cast("array<string>")


def match_watch(jobs: DataFrame, w: WatchProfile, limit: int = 20) -> DataFrame:
    """Jobs worth telling of, best first: twice the title words plus the skills found. ``jobs`` has an ``ordinal``."""
    title = F.lower(F.coalesce("title", F.lit("")))
    everything = F.concat(title, F.lit(" "), F.lower(F.coalesce("skills", F.lit(""))))
    words = list(dict.fromkeys(x for role in w.roles for x in role.split() if len(x) > 3))
    rows = jobs.withColumns({"title_hits": _held(words, title), "skill_hits": _held(w.skills, everything)}).where((F.size("title_hits") > 0) | (F.size("skill_hits") > 0))
    for term in w.excluded_terms:
        rows = rows.where(~F.contains(title, F.lit(term)))
    if w.remote_only:
        rows = rows.where("remote")
    if w.countries:
        rows = rows.where(F.arrays_overlap("eligible_countries", F.array(*map(F.lit, w.countries))))
    if w.locations:
        rows = rows.where(F.col("remote") | (F.size(_held(w.locations, F.lower(F.coalesce("location", F.lit(""))))) > 0))
    if w.years is not None:
        rows = rows.where(F.coalesce(F.col("experience.min") <= w.years + 3, F.lit(True)))
    scored = rows.withColumn("score", 2 * F.size("title_hits") + F.size("skill_hits"))
    return scored.orderBy(F.desc("score"), "ordinal").limit(limit)


def check(found: DataFrame, seen: DataFrame, peek: bool = False) -> tuple[DataFrame, DataFrame]:
    """Matches (``watch_id, id, ordinal``) that are new, and the seen set after; a peek leaves it as it was."""
    fresh = state.new_since(found, seen, ["watch_id", "id"])
    return fresh, seen if peek else state.update_seen(found, seen, "watch_id", "id")
