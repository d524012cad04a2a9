from datetime import timedelta

import pytest
from vacantia.api import InvalidInput, Tools, intent_of, refresh_reason, search_query_of

from .helpers import NOW, job, jobs
from .test_matching import RESUME
from .test_search import CATALOG


@pytest.fixture(scope="module")
def tools(spark):
    rows = jobs(
        spark,
        [
            job("a", "Backend Engineer", ordinal=0, description="Java is required. Must have Kafka. AWS certification is required. Authorized to work in India is required."), job("b", "Chef", ordinal=1),
            job("c", "Senior Backend Engineer", ordinal=2, description="Java and Python required"), job("d", "Backend Engineer", eligible_countries=["US"], ordinal=3, source_slug="b"),
        ],
    ).cache()
    parts = spark.createDataFrame([("acme", NOW - timedelta(days=1)), ("b", NOW - timedelta(days=30))], "source_slug string, fetched_at timestamp")
    catalog = spark.createDataFrame([("acme", "Acme", "lever", "a", ["IN"], "acme.com", "u", None), ("b", "B", "lever", "b", [], "b.com", "u", None), ("n", "N", "lever", "n", ["IN"], "n.com", "u", None)], CATALOG)
    return Tools(rows, parts, catalog, lambda: NOW)


RES = {"content": RESUME, "format": "markdown"}


@pytest.mark.parametrize("bad", [{"x": 1}, {"limit": 0}, {"limit": 101}, {"limit": True}, {"offset": -1}, {"max_age_days": 366}, {"experience_years": 61}, {"country": "IND"}, {"remote": "yes"}, {"query": 3}])
def test_search_input(bad):
    with pytest.raises(InvalidInput):
        search_query_of(bad)


@pytest.mark.parametrize("bad", [{"x": []}, {"roles": [""]}, {"roles": ["a", "a"]}, {"countries": ["IND"]}, {"remote": 1}, {"max_age_days": 1.5}, {"roles": "a"}])
def test_intent_input(bad):
    with pytest.raises(InvalidInput):
        intent_of(bad)


def test_scopes(tools):
    held = Tools(tools.jobs, tools.partitions, tools.catalog, lambda: NOW, ["jobs.read"])
    assert "recommend_jobs" not in held.names() and "check_watch" in held.names() and len(tools.names()) == 11
    with pytest.raises(PermissionError):
        held.call("recommend_jobs", {})
    with pytest.raises(InvalidInput):
        tools.call("drop", {})


def test_search_get_and_coverage(tools):
    got = tools.call("search_jobs", {"query": "backend", "country": "in", "limit": 1})
    assert [r["id"] for r in got["jobs"]] == ["a"] and got["pagination"] == {"offset": 0, "limit": 1, "total": 2, "next_offset": 1}
    assert tools.call("get_job", {"job_id": "b"})["job"]["title"] == "Chef" and tools.call("get_job", {"id": "zz"})["job"] is None
    assert tools.call("get_job_coverage", {"countries": ["in", "DE"]})["coverage"] == [{"country": "DE", "sources": 0, "jobs": 0, "employers": 0}, {"country": "IN", "sources": 1, "jobs": 3, "employers": 1}]
    with pytest.raises(InvalidInput):
        tools.call("get_job_coverage", {"countries": []})


def test_prepare(tools):
    asked = []
    held = Tools(tools.jobs, tools.partitions, tools.catalog, lambda: NOW, crawl=asked.extend)
    got = held.call("prepare_job_search", {})
    assert got["counts"]["pending"] == 2 and asked == ["n", "b"] and (got["next_action"], got["continuation"]) == ("retry_later", None)  # all were tried
    assert refresh_reason("auto", tools.partitions, 9, 5, 14, NOW) == "snapshot_stale" and refresh_reason("never", None, 0, 5, 14, NOW) == "policy_never" and refresh_reason("auto", None, 0, 5, 14, NOW) == "snapshot_missing"
    fresh = tools.partitions.limit(1)
    assert refresh_reason("auto", fresh, 1, 5, 14, NOW) == "insufficient_matches" and refresh_reason("auto", fresh, 5, 5, 14, NOW) == "not_needed"


def test_recommend(tools):
    got = tools.call("recommend_jobs", {"resume": RES, "intent": {"countries": ["IN"], "roles": ["backend engineer"]}})
    assert got["matches"][0]["id"] == "c" and got["outcome"] == "widened" and got["exploration"]["direct"][:1] == ["c"] and got["refresh"]["reason"] == "snapshot_stale"


def test_fit_and_resume_edits(tools):
    fit = tools.call("analyze_job_fit", {"job_id": "a", "resume": RES})["fit"]
    assert fit.fit == "good" or fit.fit == "stretch"
    assert "Java" in fit.supported and "AWS certification" in fit.supported and "Kafka" in fit.unsupported and any(r.startswith("Work authorization") for r in fit.risks)
    assert fit.reasons[0].quote.lower() == "java" and tools.call("analyze_job_fit", {"job_id": "d", "resume": RES, "intent": {"countries": ["IN"]}})["fit"].fit == "poor"
    with pytest.raises(LookupError):
        tools.call("analyze_job_fit", {"job_id": "nope", "resume": RES})
    md = tools.call("optimize_resume", {"job_id": "a", "resume": RES, "output": "revised_markdown"})
    assert md["content"].startswith("# Targeted Highlights\n\n- Built services in Java\n- Java\n") and md["original_overwritten"] is False
    diff = tools.call("optimize_resume", {"job_id": "a", "resume": RES, "output": "unified_diff"})["content"].split("\n")
    assert diff[0] == "--- resume" and sum(x.startswith(" ") for x in diff) == len(RESUME.split("\n"))


def test_watches(tools):
    made = tools.call("watch_jobs", {"name": "w", "resume": RES, "intent": {"countries": ["US"]}})
    assert made["already_live"] == 1 and "skills including java" in made["holds"]
    assert tools.call("check_watch", {"name": "w"}) == {"new": [], "total_new": 0}
    tools.watches["w"][1].clear()
    assert tools.call("check_watch", {"name": "w", "peek": True})["total_new"] == 1 == tools.call("check_watch", {"name": "w"})["total_new"]
    assert tools.call("check_watch", {"name": "w"})["total_new"] == 0 and tools.call("list_watches", {})["watches"][0]["seen"] == 1
    assert tools.call("stop_watch", {"name": "w"}) == {"stopped": True} and tools.call("stop_watch", {"name": "w"}) == {"stopped": False}
