from datetime import datetime, timedelta

from pyspark.sql import functions as F
from vacantia.operators import audit, coverage, search
from vacantia.operators.search import SearchQuery

from .helpers import NOW, job, jobs


def ids(df):
    return [r.id for r in df.collect()]


def test_cascade_and_pages(spark):
    rows = jobs(spark, [job(f"j{k}", "Backend Engineer", days=d) for k, d in enumerate([1, 1, 9, 9, 9, 20, None])])
    got = search.search(rows, SearchQuery(query="backend engineers", limit=2), NOW).collect()
    assert [(r.id, r.days_used, r.widened, r.total, r.next_offset, r.age) for r in got] == [("j0", 14, True, 5, 2, "new"), ("j1", 14, True, 5, 2, "new")]
    assert ids(search.search(rows, SearchQuery(limit=2, offset=4), NOW)) == ["j4"]
    assert search.search(rows, SearchQuery(limit=2, offset=4), NOW).first().next_offset is None
    assert ids(search.search(rows, SearchQuery(max_age_days=7), NOW)) == ["j0", "j1"]
    assert ids(search.search(rows, SearchQuery(max_age_days=0), NOW))[-1] == "j6"
    few = search.search(rows.limit(3), SearchQuery(), NOW)
    assert {r.days_used for r in few.collect()} <= {0} and "description" not in few.columns


def test_predicates(spark):
    rows = jobs(
        spark,
        [
            job("a", "iOS Developer", location="Bangalore"), job("b", "Analyst", company="Axio Biosolutions"), job("c", "Dev", description="React Native, react native!"), job("d", "Dev", skills="", description="kafka kafka"),
            job("e", "Dev", eligible_countries=[], eligible_regions=["APAC"], remote=True, work_mode="remote"), job("f", "Dev", eligible_countries=["US"], excluded_countries=["IN"], eligible_regions=["worldwide"]),
        ],
    )
    found = lambda **q: sorted(ids(search.search(rows, SearchQuery(max_age_days=0, **q), NOW)))
    assert found(query="ios") == ["a"] and found(query="react native") == ["c"] and found(query="kafka") == [] and found(location="Bengaluru") == ["a"]
    assert found(country="IN", query="dev") == ["c", "d", "e"] and found(country="de", query="dev") == ["f"] and found(remote=True) == ["e"] and len(found(query=" ")) == 6


def test_experience_filter(spark):
    rows = jobs(spark, [job("a", description="0-2 years of experience"), job("b", description="10+ years experience"), job("c", description="none"), job("d")])
    found = lambda y, u=False: sorted(ids(search.search(rows, SearchQuery(max_age_days=0, experience_years=y, include_unknown_experience=u), NOW)))
    assert found(0) == ["a"] and found(4) == [] and found(12) == ["b"] and found(4, True) == ["c", "d"]


def test_plan(spark):
    rows = jobs(spark, [job("a")])
    plan = search.search(rows, SearchQuery(query="x", country="IN"), NOW)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_lookup_and_excerpt(spark):
    rows, details = jobs(spark, [job("a"), job("b", description="own")]), spark.createDataFrame([("a", "full"), ("b", "other")], "job_id string, description string")
    assert [search.lookup(rows, details, x).first().description for x in "ab"] == ["full", "own"]
    assert spark.range(1).select(search.excerpt(F.lit("x" * 279 + "  yz"))).first()[0] == "x" * 279 + "…"


CATALOG = "source_slug string, name string, ats string, token string, cohorts array<string>, company_domain string, source_url string, domain_evidence_kind string"


def test_country_report(spark):
    catalog = spark.createDataFrame([("a", "A", "lever", "a", ["IN"], "www.a.com", "u", None), ("b", "B", "ashby", "b", [], "a.com", "u", None), ("c", "C", "ashby", "C", ["IN"], None, "u", "provider_board")], CATALOG)
    rows = jobs(spark, [job("1", source_slug="a"), job("2", source_slug="b"), job("3", source_slug="b", eligible_countries=["US"]), job("4", source_slug="zz")])
    parts = spark.createDataFrame([("a", NOW - timedelta(hours=3)), ("b", NOW - timedelta(days=10)), ("zz", NOW - timedelta(days=40))], "source_slug string, fetched_at timestamp")
    from vacantia.operators.registry import LEAD

    got = coverage.coverage_report(catalog, spark.createDataFrame([("x",)], "company_name string"), spark.createDataFrame([], LEAD), rows, parts, "IN", NOW)
    assert got["country"].first()[:] == ("IN", 2, 2, 1)
    s = got["sources"].first()
    assert (s.verified_sources, s.cohort_sources, s.indexed_sources, s.catalog_coverage_percent) == (3, 2, 2, 66.67)
    assert [r[0] for r in got["never_indexed"].collect()] == ["c"] and [r[0] for r in got["orphaned"].collect()] == ["zz"]
    assert {(r.bucket, r.source_slug) for r in got["freshness_members"].collect()} == {("fresh_24_hours", "a"), ("age_8_to_14_days", "b"), ("older_than_14_days", "zz")}
    assert {r.bucket: r.n for r in got["freshness"].collect()} == {"fresh_24_hours": 1, "age_8_to_14_days": 1, "older_than_14_days": 1}
    assert got["confidence_eligible"].first()[:] == (2, 0, 0)
    assert {r.country: (r.sources, r.jobs) for r in coverage.country_coverage(rows, catalog, ["IN", "DE"]).collect()} == {"IN": (2, 2), "DE": (0, 0)}
    import pytest

    with pytest.raises(ValueError):
        coverage.coverage_report(catalog, parts, parts, rows, parts.select("source_slug", F.lit(NOW + timedelta(days=1)).alias("fetched_at")), "IN", NOW)
    with pytest.raises(ValueError):
        coverage.coverage_report(catalog, parts, parts, rows.withColumn("title", F.lit(None).cast("string")), parts, "IN", NOW)


def test_percent_and_staleness(spark):
    assert [r[0] for r in spark.createDataFrame([(1, 3), (0, 0), (2, 3)], "a int, b int").select(coverage.percent(F.col("a"), F.col("b"))).collect()] == [33.33, 0.0, 66.67]
    none = spark.createDataFrame([], "at timestamp")
    assert coverage.staleness(none, "at", NOW).first()[:] == (0, None, True)


def test_audit_does_not_depend_on_order(spark):
    rows = [
        job("lever:a:1", "Back-end Dev", location="Bangalore", description="x"), job("lever:a:1", "Back-end Dev", location="Bengaluru"), job("ashby:b:2", " Sales & Data", days=40, company="Beta", location="Berlin, Germany"),
        job("x", "Chef", days=-3), job("y", None, days=None, experience=(4.0, None, False), experience_state="stated"), job("z", eligible_countries=["US"]),
    ]
    parts = spark.createDataFrame([("a", NOW), ("b", NOW - timedelta(days=20)), ("c", None)], "source_slug string, fetched_at timestamp")
    reports = []
    for order in (rows, rows[::-1]):
        got = audit.search_audit(jobs(spark, order), parts, "IN", NOW)
        reports.append({k: sorted(map(repr, v.collect())) for k, v in got.items()})
    assert reports[0] == reports[1]
    t = audit.search_audit(jobs(spark, rows), parts, "IN", NOW)
    total = t["totals"].first()
    assert (total.eligible_jobs, total.repeated_ids, total.distinct_company_labels, total.missing_title, total.missing_description, total.older, total.undated, total.future_dated, total.three_to_five) == (5, 1, 2, 1, 4, 1, 1, 1, 1)
    assert {r.bucket: r.jobs for r in t["titles"].collect()} == {"backend": 2, "sales": 1, "data": 1, "other": 2}
    assert t["duplicates"].count() == 1 and [r.id for r in t["location_review"].collect()] == ["ashby:b:2"]
    assert t["partitions"].first()[:] == (3, 1, 1) and {r.city: r.jobs for r in t["cities"].collect()} == {"bengaluru": 2, "pune": 2, "other_or_unspecified": 1}


def test_signals_ngrams_prevalence(spark):
    rows = jobs(spark, [job("a", "GTM  Engineer"), job("b", "RevOps lead", eligible_countries=[]), job("c", "Engineer")])
    assert {r.country: (r.jobs, r.exact_titles) for r in audit.signal_countries(rows).collect()} == {"IN": (1, 1), "(unclassified)": (1, 0)}
    clauses = spark.createDataFrame([(1, "must know the java and sql"), (1, "java sql"), (2, "SQL, sql")], "id int, c string")
    assert [tuple(r) for r in audit.ngrams(clauses, "c", ["the", "and"], 2, 2).collect()] == [("java sql", 2), ("know java", 1)]
    assert [tuple(r) for r in audit.term_prevalence(clauses, "id", "c", ["sql", "java", "go"]).collect()] == [("sql", 4, 2, [1, 2]), ("java", 2, 1, [1])]


def test_times_are_whole_days():
    assert datetime(2026, 9, 1, 12) == NOW
