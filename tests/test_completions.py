"""Readers, sinks, joins and tools that complete the inventory; long chains and repeated rows."""

import json
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from vacantia.api import InvalidInput, TableCache, Tools, select_sources
from vacantia.functions.graph import connected
from vacantia.functions.register import register
from vacantia.operators import coverage, matching, precedence, registry, verification
from vacantia.sources import sinks, snapshots

from .helpers import NOW, job, jobs
from .test_api import RES
from .test_operators import T0, lead
from .test_search import CATALOG


def test_a_chain_of_two_hundred_is_one_group(spark):
    links = list(range(200))
    random.Random(1).shuffle(links)
    rows = spark.createDataFrame([(n, [f"k{k}", f"k{k + 1}"]) for n, k in enumerate(links)] + [(500, []), (501, ["alone"])], "id long, keys array<string>")
    got = {r.id: r.component for r in connected(rows, "id", "keys").collect()}
    assert {got[n] for n in range(200)} == {0} and got[500] == 500 and got[501] == 501


def test_duplicates_along_a_chain(spark):
    rows = [(k, "lever", f"t{k // 2}", f"d{(k + 1) // 2}.com", f"s{k}") for k in range(90)]
    got = precedence.dedupe_verified(spark.createDataFrame(rows, "ordinal long, ats string, token string, company_domain string, slug string")).collect()
    kept, used = set(), set()
    for k, ats, token, domain, slug in rows:
        keys = {("s", ats, token), ("d", domain), ("g", slug)}
        if not keys & used:
            kept.add(k)
            used |= keys
    assert {r.ordinal for r in got if r.rejected is None} == kept


def test_slugs_never_meet(spark):
    rows = [(0, "lever", "x"), (1, "ashby", "lever-x"), (2, "lever", "x"), (3, "lever", "y"), (4, "lever", "y"), (5, "lever", "y"), (6, "ashby", "y")]
    got = {r.ordinal: r.slug for r in precedence.allocate_slugs(spark.createDataFrame(rows, "ordinal long, ats string, base string"), spark.createDataFrame([("x",)], "slug string")).collect()}
    assert got == {0: "lever-x", 1: "ashby-lever-x", 2: None, 3: "y", 4: "lever-y", 5: None, 6: "ashby-y"}


def test_repeated_rows_stay_repeated(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    known = spark.createDataFrame([("a",)], "k string")
    assert precedence.any_key_semi(left, known, F.array("k"), F.array("k")).count() == 2
    assert [r.k for r in precedence.any_key_semi(left, known, F.array("k"), F.array("k"), anti=True).collect()] == ["b"]


def test_batches_without_one_task(spark):
    got = precedence.batches(spark.range(1000).repartition(7), "id", 64).collect()
    assert all(r.batch == r.id // 64 for r in got) and len(got) == 1000


def test_repeated_additions_are_one_lead(spark):
    old = spark.createDataFrame([lead("lever:a", matches=["a.com"])], registry.LEAD)
    new = spark.createDataFrame([lead("lever:b", matches=["b.com"]), lead("lever:b", matches=["c.com"]), lead("lever:a", matches=["d.com"], promoted=T0), lead("lever:a")], registry.LEAD)
    got = {r.source_key: [m.company_domain for m in r.company_matches] for r in registry.merge_leads(old, new).collect()}
    assert got == {"lever:a": ["a.com", "d.com"], "lever:b": ["b.com", "c.com"]}
    a = spark.createDataFrame([("k", ["IN"], "first")], "source_key string, cohorts array<string>, evidence string")
    b = spark.createDataFrame([("n", ["US"], "x"), ("n", ["DE"], "y"), ("k", ["US"], "z")], a.schema)
    assert {r.source_key: (r.cohorts, r.evidence) for r in verification.merge_candidates(a, b).collect()} == {"k": (["IN", "US"], "first"), "n": (["DE", "US"], "x")}


def test_candidates_crawl_and_seed(spark, tmp_path):
    good = {"companyName": "Acme", "companyDomain": "Acme.com", "sourceUrl": "https://jobs.lever.co/ACME", "discoveredFrom": {"channel": "search", "reference": "r"}}
    (tmp_path / "c.json").write_text(json.dumps([good, good | {"companyDomain": "other.com"}]))
    found = snapshots.read_candidates(spark, str(tmp_path / "c.json"))
    catalog = spark.createDataFrame([("acme", "lever", "acme", "acme.com", "https://jobs.lever.co/ACME")], "slug string, ats string, token string, company_domain string, source_url string")
    assert [r.company_domain for r in verification.promoted(found, catalog).collect()] == ["Acme.com"]
    assert [r.standing for r in verification.against_catalog(found.withColumn("slug", F.lit("acme")), catalog).orderBy("company_domain").collect()] == ["known", "conflict"]
    (tmp_path / "bad.json").write_text(json.dumps([{"companyName": "x"}]))
    with pytest.raises(Exception, match="invalid source candidate"):
        snapshots.read_candidates(spark, str(tmp_path / "bad.json")).collect()
    run = {"startedAt": "2026-01-01", "finishedAt": "2026-01-02", "selected": 2, "succeeded": 1, "failed": [{"source": "a", "error": "e"}]}
    for name, crawl in (("ok", run), ("no", run | {"succeeded": 2})):
        (tmp_path / f"{name}.json").write_text(json.dumps({"version": 1, "lastCrawl": crawl, "partitions": {}}))
    assert snapshots.read_crawl(spark, str(tmp_path / "ok.json")).first().failed == 1
    with pytest.raises(Exception, match="more outcomes"):
        snapshots.read_crawl(spark, str(tmp_path / "no.json")).collect()
    assert snapshots.seed_snapshot(spark, str(tmp_path / "none.json")) is None


def test_export_removes_what_is_gone(spark, tmp_path):
    rows = jobs(spark, [job("b", source_slug="one"), job("a", source_slug="one"), job("c", source_slug="two")])
    first = {r.source_slug: (r.jobs, r.sha256) for r in snapshots.export_snapshot(rows, f"{tmp_path}/x").collect()}
    again = {r.source_slug: r.sha256 for r in snapshots.export_manifest(rows.orderBy("id")).collect()}
    assert {s: h for s, (_, h) in first.items()} == again and first["one"][0] == 2
    left = snapshots.export_snapshot(rows.where("source_slug = 'one'"), f"{tmp_path}/x")
    assert [r.source_slug for r in left.collect()] == ["one"] and not (tmp_path / "x/sources/source_slug=two").exists()
    with pytest.raises(ValueError, match="unsafe"):
        snapshots.export_snapshot(rows.withColumn("source_slug", F.lit("../x")), f"{tmp_path}/x")
    assert snapshots.without_descriptions(jobs(spark, [job("a", description="x")])).first().description == ""


def test_catalog_notice_and_watches_files(spark, tmp_path):
    sinks.write_catalog(spark.createDataFrame([("b",), ("a",)], "source_slug string"), f"{tmp_path}/cat")
    assert [r.source_slug for r in spark.read.json(f"{tmp_path}/cat").collect()] == ["a", "b"]
    sinks.write_watches(spark, {"w": {"profile": {"skills": ["java"]}, "seen": ["2", "1"]}}, f"{tmp_path}/watches")
    assert sinks.read_watches(spark, f"{tmp_path}/watches") == {"w": {"profile": {"skills": ["java"]}, "seen": ["2", "1"]}} and sinks.read_watches(spark, f"{tmp_path}/no") == {}
    said = []
    assert sinks.notify_new(jobs(spark, [job("a", "Dev")]), lambda a, b: said.append((a, b))) == 1 and said == [("1 new role", "Dev at Acme")]

    def broken(title, body):
        raise OSError

    assert sinks.notify_new(jobs(spark, [job("a")]), broken) == 1


def test_transferable_and_career_leads(spark):
    needs = spark.createDataFrame([("j", "Kafka"), ("j", "Java")], "id string, requirement string")
    skills = spark.createDataFrame([("RabbitMQ", "f1"), ("java", "f2")], "skill string, fact_id string")
    edges = spark.createDataFrame([("kafka", "rabbitmq", "backend_programming"), ("java", "rabbitmq", "backend_programming")], "target string, source string, via string")
    assert [tuple(r) for r in matching.transferable(needs, skills, edges).collect()] == [("j", "Kafka", "backend_programming", ["f1"])]
    assert matching.transferable(needs, skills, matching.transfer_edges(spark)).count() == 0
    companies = spark.createDataFrame([("Acme Inc", "www.acme.com"), ("Zed", "beta.io"), ("No", "no.org")], "company_name string, company_domain string")
    leads = spark.createDataFrame([("lever:acme", "acme", 2), ("ashby:acme", "ACME", 1), ("w", "x.myworkdayjobs.com/beta/Site", 3), ("l", "no", 4)], "source_key string, token string, ordinal long")
    assert {r.company_domain: r.source_key for r in registry.career_leads(companies, leads).collect()} == {"www.acme.com": "ashby:acme", "beta.io": "w"}


def test_registered_functions(spark):
    assert "job_postings" in register(spark)
    assert spark.sql("SELECT required_terms('Must have Java and Kafka.')").first()[0] == ["Java", "Kafka"]
    assert spark.sql("SELECT stated_years('5+ years of experience'), plain_text('<p>a &amp; b</p>')").first()[:] == (5.0, "a & b")
    assert spark.sql("SELECT min, max FROM experience_readings('Experience: 2-5 years')").first()[:] == (2.0, 5.0)
    page = '<script type="application/ld+json">{"@type":"JobPosting","title":"Dev"}</script>'
    assert spark.sql(f"SELECT title, location FROM job_postings('{page}', 'https://a.b/c')").first()[:] == ("Dev", "Unspecified")


@pytest.fixture
def store(spark):
    rows = jobs(spark, [job(f"j{k}", "Backend Engineer", days=k + 1, ordinal=k, description="Java required") for k in range(6)])
    parts = spark.createDataFrame([("acme", NOW - timedelta(days=1))], "source_slug string, fetched_at timestamp")
    catalog = spark.createDataFrame([(s, s, "lever", s, ["IN"], f"{s}.com", "u", None) for s in ("acme", "b", "c")], CATALOG)
    return rows, parts, catalog


def test_pages_details_and_scopes(spark, store):
    rows, parts, catalog = store
    details = spark.createDataFrame([("j1", "more"), ("j2", "unused")], "job_id string, description string")
    blank = rows.withColumn("description", F.when(F.col("id") != "j1", F.col("description")).otherwise(" "))
    held = Tools(blank, parts, catalog, lambda: NOW, details=details)
    past = held.call("search_jobs", {"query": "backend", "offset": 500})
    assert past["jobs"] == [] and past["pagination"] == {"offset": 500, "limit": 50, "total": 6, "next_offset": None}
    assert held.call("get_job", {"id": "j1"})["job"]["description"] == "more" and held.call("get_job", {"id": "j2"})["job"]["description"] == "Java required"
    assert [r.source_slug for r in select_sources(catalog, slugs=["c", "b"]).orderBy("source_slug").collect()] == ["b", "c"] and select_sources(catalog, country="us").count() == 0
    with pytest.raises(InvalidInput, match="zz"):
        select_sources(catalog, slugs=["b", "zz"])


def test_preparation_goes_on_where_it_stopped(spark, store, monkeypatch):
    rows, parts, catalog = store
    monkeypatch.setattr("vacantia.api.PREPARE_AT_ONCE", 1)
    asked = []
    held = Tools(rows, parts, catalog, lambda: NOW, crawl=lambda slugs: asked.append(slugs))
    one = held.call("prepare_job_search", {"countries": ["IN"]})
    two = held.call("prepare_job_search", {"countries": ["in"], "continuation": one["continuation"]})
    assert asked == [["b"], ["c"]] and (one["next_action"], two["next_action"], two["continuation"]) == ("call_again", "retry_later", None)
    for bad in ("x", one["continuation"][:-8], 5):
        with pytest.raises(InvalidInput, match="continuation"):
            held.call("prepare_job_search", {"countries": ["IN"], "continuation": bad})
    with pytest.raises(InvalidInput, match="continuation"):
        held.call("prepare_job_search", {"countries": ["US"], "continuation": one["continuation"]})

    def crawl(slugs):
        return rows, spark.createDataFrame([(s, NOW) for s in ("acme", "b", "c")], parts.schema)

    done = Tools(rows, parts, catalog, lambda: NOW, crawl=crawl).call("prepare_job_search", {"countries": ["IN"]})
    assert (done["status"], done["next_action"], done["counts"]["fresh"]) == ("ready", "ready", 3)


def test_recommendations_refresh_and_fall_back(spark, store):
    rows, parts, catalog = store
    ask = {"resume": RES, "intent": {"roles": ["backend engineer"]}}
    more = rows.unionByName(jobs(spark, [job("new", "Senior Backend Engineer", days=0.5, ordinal=9, description="Java and Python required")]))
    got = Tools(rows, parts, catalog, lambda: NOW, crawl=lambda slugs: (more, parts)).call("recommend_jobs", ask | {"refresh": "always"})
    assert got["refresh"] == {"policy": "always", "reason": "policy_always", "attempted": True, "occurred": True} and got["matches"][0]["id"] == "new"

    def fails(slugs):
        raise OSError("down")

    held = Tools(rows.limit(2), parts, catalog, lambda: NOW, crawl=fails)
    got = held.call("recommend_jobs", ask)
    assert got["refresh"]["reason"] == "insufficient_matches" and got["refresh"]["error"] == {"code": "refresh_failed", "message": "down"} and len(got["matches"]) == 2
    assert got["shortfall"] == {"minimum_matches": 5, "actual_matches": 2}
    assert not Tools(rows, parts, catalog, lambda: NOW, crawl=fails).call("recommend_jobs", ask | {"refresh": "never"})["refresh"]["attempted"]


def test_watches_are_kept_and_forget_the_oldest(spark, store, tmp_path, monkeypatch):
    rows, parts, catalog = store
    monkeypatch.setattr("vacantia.operators.state.SEEN_CAP", 7)
    held = Tools(rows, parts, catalog, lambda: NOW, watch_path=f"{tmp_path}/w")
    held.call("watch_jobs", {"name": "w", "resume": RES})
    first = held.watches["w"][1]
    held.jobs = jobs(spark, [job(f"n{k}", "Backend Engineer", ordinal=k) for k in range(3)])
    again = Tools(held.jobs, parts, catalog, lambda: NOW, watch_path=f"{tmp_path}/w")
    assert again.watches["w"][1] == first and again.call("check_watch", {"name": "w"})["total_new"] == 3
    assert again.watches["w"][1] == ["n0", "n1", "n2", *first[:4]]
    assert Tools(held.jobs, parts, catalog, lambda: NOW, watch_path=f"{tmp_path}/w").watches["w"][1][0] == "n0"


def test_cache_expires_and_drops_failures(spark):
    clock = [NOW]
    cache, loads = TableCache(lambda: clock[0]), []
    load = lambda: loads.append(1) or spark.range(3)
    assert cache.get("a", load) is cache.get("a", load) and len(loads) == 1
    clock[0] += timedelta(minutes=6)
    assert cache.get("a", load).count() == 3 and len(loads) == 2
    with pytest.raises(Exception, match="boom"):
        cache.get("b", lambda: spark.range(1).select(F.raise_error(F.lit("boom"))))
    assert "b" not in cache.held


def test_fit_tells_risks_by_their_fields(spark, store):
    rows, parts, catalog = store
    extra = [
        job("x", "Principal Backend Engineer", ordinal=20, location="Berlin", work_mode="onsite", eligible_countries=["DE"], description="Minimum 12 years of experience. Java required. Must have Kafka and Kafka Streams."),
    ]
    held = Tools(rows.unionByName(jobs(spark, extra)), parts, catalog, lambda: NOW)
    fit = held.call("analyze_job_fit", {"job_id": "x", "resume": RES, "intent": {"countries": ["IN"], "locations": ["Pune"], "remote": True, "excluded_terms": ["kafka"]}})["fit"]
    assert fit.fit == "poor" and fit.unsupported == ["Kafka"] and fit.partial == ["Minimum 12 years of experience"] or fit.partial
    by_claim = {r.claim: r for r in fit.reasons}
    assert by_claim["Job is not eligible for requested country: IN"].field == "eligibility" and by_claim["Job is not explicitly remote"].quote == "onsite"
    assert by_claim["Job location does not match explicit location intent"].quote == "Berlin" and by_claim["Job contains an excluded term: kafka"].quote == "Kafka"
    assert any(c.startswith("seniority differs") for c in fit.risks) and fit.preparation[-1].startswith("Prepare a truthful response about the unsupported Kafka")
    assert fit.scores["evidence"] == fit.evidence_percent <= 79


def test_report_counts_promotions_and_retries(spark, store):
    rows, parts, catalog = store
    candidates = spark.createDataFrame([("Acme", "acme.com", None, "https://jobs.lever.co/acme", ["IN"], "search", "r")], "company_name string, company_domain string, slug string, source_url string, cohorts array<string>, channel string, reference string")
    leads = spark.createDataFrame([lead("lever:a"), lead("lever:b", matches=["a.com"])], registry.LEAD)
    got = coverage.coverage_report(catalog, candidates, leads, rows, parts, "IN", NOW)
    assert got["promoted_candidates"].first()[0] == 1
    assert {(r.kind, r.name): r.n for r in got["leads"].collect()} == {("state", "unresolved"): 1, ("state", "matched"): 1, ("retry", "fresh"): 2}
