"""The tools of the service as one Python facade over tables: validated inputs, scopes, whole answers."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import geo
from .operators import coverage, fit, matching, search, state, watches
from .operators.matching import Intent
from .operators.profile import Profile, parse_resume
from .operators.search import SearchQuery
from .sources import sinks

JOBS_SCOPE, RESUME_SCOPE = "jobs.read", "resume.analyze"
# The scope that each tool needs.
SCOPES = {
    "prepare_job_search": JOBS_SCOPE, "get_job_coverage": JOBS_SCOPE, "search_jobs": JOBS_SCOPE, "get_job": JOBS_SCOPE, "list_watches": JOBS_SCOPE, "check_watch": JOBS_SCOPE,
    "recommend_jobs": RESUME_SCOPE, "analyze_job_fit": RESUME_SCOPE, "optimize_resume": RESUME_SCOPE, "watch_jobs": RESUME_SCOPE, "stop_watch": RESUME_SCOPE,
}
LISTS = ["roles", "countries", "locations", "seniority", "required_skills", "excluded_terms", "excluded_countries", "excluded_locations", "excluded_roles"]
MAX_COUNTRIES, PREPARE_AT_ONCE, READY_SHARE, MAX_TOKEN = 20, 25, 0.95, 16_384
FRESH_DAYS, ENOUGH_MATCHES, CACHE_SECONDS = 14, 5, 300


class InvalidInput(ValueError):
    pass


def known_keys(value: dict, allowed: list[str], name: str) -> None:
    for key in value:
        if key not in allowed:
            raise InvalidInput(f"Unknown field: {name}.{key}")


def _number(value: dict, key: str, low: float, high: float, whole: bool = True) -> None:
    x = value.get(key)
    if x is None:
        return
    if isinstance(x, bool) or not isinstance(x, int if whole else (int, float)) or not low <= x <= high:
        raise InvalidInput(f"{key} must be {'an integer' if whole else 'a number'} between {low} and {high}")


def _kind(value: dict, key: str, kind: type) -> None:
    if value.get(key) is not None and not isinstance(value[key], kind):
        raise InvalidInput(f"{key} must be a {'boolean' if kind is bool else 'string'}")


def _codes(values: list, key: str) -> None:
    if not all(isinstance(c, str) and re.fullmatch("[A-Za-z]{2}", c) for c in values):
        raise InvalidInput(f"{key} must contain two-letter country codes")


def intent_of(value: dict | None) -> Intent:
    if value is None:
        return Intent()
    if not isinstance(value, dict):
        raise InvalidInput("intent must be an object")
    known_keys(value, [*LISTS, "remote", "max_age_days"], "intent")
    for key in LISTS:
        items = value.get(key, [])
        if not isinstance(items, list) or not all(isinstance(x, str) and x.strip() for x in items):
            raise InvalidInput(f"{key} must be an array of non-empty strings")
        if len({*items}) != len(items):
            raise InvalidInput(f"{key} must not contain duplicate values")
    _codes(value.get("countries", []), "countries")
    _codes(value.get("excluded_countries", []), "excluded_countries")
    _kind(value, "remote", bool)
    _number(value, "max_age_days", 0, 365)
    return Intent(**value)


def search_query_of(value: dict) -> SearchQuery:
    known_keys(value, list(SearchQuery.__dataclass_fields__), "search_jobs")
    for key in ("query", "location", "country"):
        _kind(value, key, str)
    for key in ("remote", "include_unknown_experience"):
        _kind(value, key, bool)
    if value.get("country") is not None:
        _codes([value["country"]], "country")
    _number(value, "offset", 0, 1_000_000)
    _number(value, "limit", 1, 100)
    _number(value, "max_age_days", 0, 365)
    _number(value, "experience_years", 0, 60, whole=False)
    return SearchQuery(**value)


def refresh_reason(policy: str, partitions: DataFrame | None, matches: int, enough: int, stale_days: int, now: datetime) -> str:
    """Why a recommendation would crawl first, by the first rule that holds."""
    if policy in ("never", "always"):
        return f"policy_{policy}"
    if partitions is None:
        return "snapshot_missing"
    if coverage.staleness(partitions, "fetched_at", now, stale_days).first()["stale"]:
        return "snapshot_stale"
    return "insufficient_matches" if matches < enough else "not_needed"


def revision(partitions: DataFrame) -> str:
    """Identity of a snapshot: its sources and when they were fetched (hashed, whatever their number)."""
    row = partitions.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("source_slug", "fetched_at")), F.lit(0)).alias("x")).first()
    return f"{row['n']}-{row['x'] & ((1 << 64) - 1):016x}"


def outcome(intent: Intent, profile: Profile, steps: dict, matches: int) -> dict:
    """Says in data terms why the result is what it is."""
    windows = {k.removeprefix("results_"): v for k, v in steps.items() if k.startswith("results_")}
    said = ", ".join(f"{'all time' if d == '0' else d + ' days'}: {n}" for d, n in windows.items())
    scope = "; ".join(f"{label}: {', '.join(v)}" for label, v in (("roles asked", intent.roles), ("countries", intent.countries), ("resume skills", profile.values("skill")[:8]), ("resume roles", profile.values("role")[:4])) if v)
    if not matches:
        return {"outcome": "no_matches", "explanation": f"No role matched ({said}). {scope}.", "next_moves": ["Broaden the roles", "Add countries or allow remote roles", "Search by keyword", "Check the coverage of the countries"]}
    if steps["widened"]:
        return {"outcome": "widened", "explanation": f"The window widened to {steps['days_used'] or 'all'} days ({said}). {scope}.", "next_moves": ["Tell which window the results are from", "Offer to broaden roles or countries"]}
    return {"outcome": "matches", "explanation": f"{matches} matches in the last {steps['days_used']} days ({said}). {scope}.", "next_moves": []}


def select_sources(catalog: DataFrame, slugs: list[str] | None = None, country: str | None = None, countries: list[str] | None = None) -> DataFrame:
    """Sources of a scope: named ones (an unknown name is an error), else those of a country, else of several, else all."""
    if slugs is not None:
        wanted = list(dict.fromkeys(slugs))
        found = catalog.where(F.col("source_slug").isin(wanted))
        missing = {*wanted} - {r[0] for r in found.select("source_slug").collect()}
        if missing:
            raise InvalidInput(f"Unknown company source(s): {', '.join(s for s in wanted if s in missing)}")
        return found
    codes = [country] if country else countries or []
    return catalog.where(F.arrays_overlap("cohorts", F.array(*[F.lit(c.upper()) for c in codes]))) if codes else catalog


class TableCache:
    """Tables by key for five minutes of an injected clock; what fails to load is not kept."""

    def __init__(self, now: Callable[[], datetime], seconds: int = CACHE_SECONDS):
        self.now, self.seconds, self.held = now, seconds, {}

    def get(self, key: str, load: Callable[[], DataFrame]) -> DataFrame:
        held = self.held.get(key)
        if held and (self.now() - held[0]).total_seconds() < self.seconds:
            return held[1]
        self.drop(key)
        table = load().persist()
        try:
            table.count()
        except Exception:
            table.unpersist()
            raise
        self.held[key] = (self.now(), table)
        return table

    def drop(self, key: str) -> None:
        held = self.held.pop(key, None)
        if held:
            held[1].unpersist()


def _token_of(countries: list[str], attempted: list[str]) -> str:
    return base64.urlsafe_b64encode(json.dumps({"version": 1, "countries": countries, "attempted": sorted(attempted)}).encode()).decode()


def _attempted_in(token: str | None, countries: list[str], catalog: DataFrame) -> list[str]:
    """The sources that earlier calls of one preparation tried; a token of other countries or unknown sources is refused."""
    if token is None:
        return []
    wrong = InvalidInput("continuation must be a valid preparation token for the requested countries")
    if not isinstance(token, str) or len(token) > MAX_TOKEN:
        raise wrong
    try:
        held = json.loads(base64.urlsafe_b64decode(token.encode()))
        version, asked, attempted = held["version"], held["countries"], held["attempted"]
    except (ValueError, KeyError, TypeError):
        raise wrong from None
    if version != 1 or asked != countries or not isinstance(attempted, list) or not all(isinstance(s, str) for s in attempted):
        raise wrong
    known = catalog.where(F.col("source_slug").isin(attempted)).select("source_slug").distinct().count() if attempted else 0
    if known != len({*attempted}):
        raise wrong
    return attempted


class Tools:
    """All tools over a snapshot: ``jobs``, ``partitions``, ``catalog``. What reaches outside is injected: ``now``; ``crawl``, which
    fetches named sources and may return the new ``(jobs, partitions)``; ``details``, descriptions by job; ``watch_path``, where
    watches are kept between sessions (in memory without it).
    """

    def __init__(
        self, jobs: DataFrame, partitions: DataFrame, catalog: DataFrame, now: Callable[[], datetime], scopes: list[str] | None = None, crawl: Callable[[list[str]], object] | None = None,
        details: DataFrame | None = None, watch_path: str | None = None,
    ):
        self.jobs, self.partitions, self.catalog, self.now, self.scopes, self.crawl = jobs, partitions, catalog, now, scopes, crawl
        self.details, self.watch_path = details, watch_path
        kept = sinks.read_watches(jobs.sparkSession, watch_path) if watch_path else {}
        # seen ids in order, the newest first
        self.watches: dict[str, tuple[watches.WatchProfile, list[str]]] = {n: (watches.WatchProfile(**w["profile"]), w["seen"]) for n, w in kept.items()}

    def _keep_watches(self) -> None:
        if self.watch_path:
            sinks.write_watches(self.jobs.sparkSession, {n: {"profile": w.__dict__, "seen": seen} for n, (w, seen) in self.watches.items()}, self.watch_path)

    def _crawled(self, slugs: list[str]) -> bool:
        """Crawl sources; whether a new snapshot came of it."""
        new = self.crawl(slugs)
        if isinstance(new, tuple):
            self.jobs, self.partitions = new
        return isinstance(new, tuple)

    def names(self) -> list[str]:
        return [n for n, s in SCOPES.items() if self.scopes is None or s in self.scopes]

    def call(self, name: str, value: dict) -> dict:
        if name not in SCOPES:
            raise InvalidInput(f"Unknown tool: {name}")
        if name not in self.names():
            raise PermissionError(f"{name} needs the scope {SCOPES[name]}")
        if not isinstance(value, dict):
            raise InvalidInput("input must be an object")
        return getattr(self, name)(value)

    def search_jobs(self, value: dict) -> dict:
        q = search_query_of(value)
        found = [r.asDict(True) for r in search.search(self.jobs, q, self.now(), always=True).collect()]
        page = {"offset": q.offset, "limit": q.limit, "total": found[0]["total"], "next_offset": found[0]["next_offset"]}
        rows = [r for r in found if r["id"] is not None]  # a page past the end is the total alone
        return {"jobs": rows, "pagination": page, "window": {"days_used": rows[0]["days_used"], "widened": rows[0]["widened"]} if rows else None}

    def get_job(self, value: dict) -> dict:
        known_keys(value, ["id", "job_id"], "get_job")
        id_ = value.get("id") or value.get("job_id")
        if not isinstance(id_, str) or not id_:
            raise InvalidInput("get_job requires a non-empty id")
        found = self.jobs.where(F.col("id") == id_) if self.details is None else search.lookup(self.jobs, self.details, id_)
        row = found.first()
        return {"job": row and row.asDict(True)}

    def get_job_coverage(self, value: dict) -> dict:
        known_keys(value, ["countries"], "get_job_coverage")
        countries = value.get("countries")
        if not isinstance(countries, list) or not 1 <= len(countries) <= MAX_COUNTRIES:
            raise InvalidInput(f"countries must be 1 to {MAX_COUNTRIES} country codes")
        _codes(countries, "countries")
        rows = coverage.country_coverage(self.jobs, self.catalog, [c.upper() for c in countries]).orderBy("country")
        return {"coverage": [r.asDict() for r in rows.collect()], "revision": revision(self.partitions)}

    def prepare_job_search(self, value: dict) -> dict:
        """Crawls what is pending and was not tried before in this preparation, some sources a call, until nearly all are fresh."""
        known_keys(value, ["countries", "continuation"], "prepare_job_search")
        wanted = list(dict.fromkeys(str(c).upper() for c in value.get("countries", [])))
        _codes(wanted, "countries")
        attempted = _attempted_in(value.get("continuation"), wanted, self.catalog)
        sources = select_sources(self.catalog, countries=wanted)
        waiting = lambda: self._states(sources).where("state <> 'fresh'")
        untried = waiting().where(~F.col("source_slug").isin(attempted)) if attempted else waiting()
        todo = [r[0] for r in untried.orderBy(F.asc_nulls_first("fetched_at"), "source_slug").limit(PREPARE_AT_ONCE).select("source_slug").collect()]
        if self.crawl and todo:
            self._crawled(todo)
        counts = state.ready(state.pending_counts(self._states(sources)), READY_SHARE).first().asDict()
        tried = [*attempted, *todo]
        left = (waiting().where(~F.col("source_slug").isin(tried)) if tried else waiting()).limit(1).count()
        move = "ready" if counts["ready"] else "call_again" if left else "retry_later"
        return {"status": "ready" if counts["pending"] == 0 else "partial", "next_action": move, "counts": counts, "crawled": todo, "continuation": _token_of(wanted, tried) if move == "call_again" else None}

    def _states(self, sources: DataFrame) -> DataFrame:
        cutoff = F.lit(self.now()).cast("timestamp") - F.expr(f"INTERVAL {FRESH_DAYS} DAYS")
        return state.pending(sources, self.partitions, "source_slug", "fetched_at", cutoff)

    def _resume(self, value: dict) -> Profile:
        resume = value.get("resume")
        if not isinstance(resume, dict):
            raise InvalidInput("resume must be an object")
        known_keys(resume, ["content", "format"], "resume")
        return parse_resume(resume.get("content"), resume.get("format", "text"))

    def _relevant(self, intent: Intent) -> DataFrame:
        """Partitions of sources for the countries: by cohort, or by having an eligible job."""
        if not intent.countries:
            return self.jobs
        codes = [c.upper() for c in intent.countries]
        by_cohort = self.catalog.where(F.arrays_overlap("cohorts", F.array(*map(F.lit, codes)))).select("source_slug")
        open_to = F.lit(False)
        for c in codes:
            open_to = open_to | geo.eligible_for(c)
        by_job = self.jobs.where(open_to).select("source_slug").join(self.catalog.select("source_slug"), "source_slug", "left_semi")
        return self.jobs.join(by_cohort.unionByName(by_job).distinct(), "source_slug", "left_semi")

    def recommend_jobs(self, value: dict) -> dict:
        """Matches of the present snapshot, or of a fresh one if a reason asks for a crawl; at most one. A crawl that fails leaves the old."""
        known_keys(value, ["resume", "intent", "limit", "refresh"], "recommend_jobs")
        _number(value, "limit", 1, 100)
        profile, intent, limit = self._resume(value), intent_of(value.get("intent")), value.get("limit", 20)
        policy = value.get("refresh", "auto")
        if policy not in ("auto", "never", "always"):
            raise InvalidInput("refresh must be auto, never or always")
        found = self._recommend(profile, intent, limit)
        reason = refresh_reason(policy, self.partitions, len(found["matches"]), ENOUGH_MATCHES, FRESH_DAYS, self.now())
        refresh = {"policy": policy, "reason": reason, "attempted": False, "occurred": False}
        if self.crawl and reason not in ("policy_never", "not_needed"):
            refresh["attempted"] = True
            before = (self.jobs, self.partitions)
            scope = select_sources(self.catalog, countries=[c.upper() for c in intent.countries])
            try:
                refresh["occurred"] = self._crawled([r[0] for r in scope.select("source_slug").orderBy("source_slug").collect()])
                found = self._recommend(profile, intent, limit) if refresh["occurred"] else found
            except Exception as e:
                self.jobs, self.partitions = before
                refresh |= {"occurred": False, "error": {"code": "refresh_failed", "message": str(e)}}
        n = len(found["matches"])
        short = {} if n >= ENOUGH_MATCHES else {"shortfall": {"minimum_matches": ENOUGH_MATCHES, "actual_matches": n}}
        return {**found, "refresh": refresh, **short, **outcome(intent, profile, found["window"], n)}

    def _recommend(self, profile: Profile, intent: Intent, limit: int) -> dict:
        """The jobs are scored once, kept for this call, and read for the matches, the window and what was filtered out."""
        timeless = replace(intent, max_age_days=0)
        scored = matching.score_jobs(self._relevant(intent), profile, timeless, self.now()).persist()
        try:
            best, steps = matching.best_of(scored.where(F.size("reasons") == 0), intent, self.now(), limit)
            rows = [r.asDict(True) for r in best.collect()]
            used = steps.first().asDict()
            out = matching.filtered_out(scored, replace(intent, max_age_days=used["days_used"]), self.now()).persist()
            try:
                by_reason = {r["reason"]: r["n"] for r in matching.reason_histogram(out).collect()}
                sample = [r.asDict() for r in out.orderBy("id").limit(20).collect()]
            finally:
                out.unpersist()
        finally:
            scored.unpersist()
        groups = {k: [r["id"] for r in rows if r["category"] == k] for k in ("direct", "hidden", "stretch")}
        return {"matches": rows, "window": used, "filtered_out": {"by_reason": by_reason, "sample": sample}, "exploration": groups}

    def analyze_job_fit(self, value: dict) -> dict:
        known_keys(value, ["job_id", "resume", "intent"], "analyze_job_fit")
        if not isinstance(value.get("job_id"), str) or not value["job_id"].strip():
            raise InvalidInput("job_id must be a non-empty string")
        return {"fit": fit.analyze(self.jobs, self._resume(value), intent_of(value.get("intent")), value["job_id"], self.now())}

    def optimize_resume(self, value: dict) -> dict:
        known_keys(value, ["job_id", "resume", "output"], "optimize_resume")
        profile = self._resume(value)
        found = self.analyze_job_fit({k: v for k, v in value.items() if k != "output"})["fit"]
        return fit.optimize(profile, found, value.get("output", "suggestions"))

    def watch_jobs(self, value: dict) -> dict:
        """Everything live when a watch is made counts as seen."""
        known_keys(value, ["name", "resume", "intent"], "watch_jobs")
        if not isinstance(value.get("name"), str) or not value["name"].strip():
            raise InvalidInput("name must be a non-empty string")
        intent = intent_of(value.get("intent"))
        w = watches.to_watch(self._resume(value), intent.countries, intent.locations, intent.remote, intent.excluded_terms)
        live = [r["id"] for r in watches.match_watch(self.jobs, w, state.SEEN_CAP).select("id").collect()]
        self.watches[value["name"]] = (w, live)
        self._keep_watches()
        return {"name": value["name"], "holds": watches.describe(w), "already_live": len(live)}

    def list_watches(self, value: dict) -> dict:
        return {"watches": [{"name": n, "holds": watches.describe(w), "seen": len(seen)} for n, (w, seen) in self.watches.items()]}

    def check_watch(self, value: dict) -> dict:
        """New matches since last time, 20 at most shown; all that were found count as seen, unless it is a peek."""
        known_keys(value, ["name", "peek"], "check_watch")
        if value.get("name") not in self.watches:
            raise InvalidInput("unknown watch")
        w, seen = self.watches[value["name"]]
        found = [r.asDict(True) for r in watches.match_watch(self.jobs, w, state.SEEN_CAP).select("id", "title", "company", "score").collect()]
        known = {*seen}
        fresh = [r for r in found if r["id"] not in known]
        if not value.get("peek"):
            # new ids first; at the cap the oldest go
            self.watches[value["name"]] = (w, [*(r["id"] for r in fresh), *seen][: state.SEEN_CAP])
            self._keep_watches()
        return {"new": fresh[:20], "total_new": len(fresh)}

    def stop_watch(self, value: dict) -> dict:
        known_keys(value, ["name"], "stop_watch")
        stopped = self.watches.pop(value.get("name"), None) is not None
        if stopped:
            self._keep_watches()
        return {"stopped": stopped}
