import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from vacantia.sources import providers, snapshots

from .helpers import NOW, job, jobs

P = "source_slug string, name string, token string, body string"


def adapted(spark, ats, body, token="tok"):
    text = body if isinstance(body, str) else json.dumps(body)
    return providers.adapt(ats, spark.createDataFrame([("s", "Co", token, text)], P), NOW).orderBy("ordinal").collect()


CASES = [
    ("greenhouse", "tok", {"jobs": [{"id": 1, "title": "Dev", "location": {"name": "Pune, India"}, "absolute_url": "https://x/1", "updated_at": "2026-08-30T10:00:00Z", "content": "<p>a &amp;amp; b</p><p>c</p>"}]},
     ("greenhouse:s:1", "Pune, India", "unknown", datetime(2026, 8, 30, 10), "a &amp; b\n\nc", ["IN"])),
    ("lever", "tok", [{"id": "a", "text": "Dev", "categories": {"location": "Remote - US"}, "workplaceType": "remote", "hostedUrl": "u", "createdAt": 1756684800000, "descriptionPlain": " d ", "lists": [{"text": "Req", "content": "<li>Java</li>"}], "additionalPlain": "more"}],
     ("lever:s:a", "Remote - US", "remote", datetime(2025, 9, 1), "d\n\nReq\nJava\n\nmore", ["US"])),
    ("lever", "tok", [{"id": "b", "text": "Dev", "hostedUrl": "u"}], ("lever:s:b", "Unspecified", "unknown", None, "", [])),
    ("ashby", "tok", {"jobs": [{"id": "b", "title": "Dev", "location": "Berlin, Germany", "isRemote": False, "jobUrl": "u", "publishedAt": "2026-08-01T00:00:00.000+00:00"}]}, ("ashby:s:b", "Berlin, Germany", "unknown", datetime(2026, 8, 1), "", ["DE"])),
    ("recruitee", "tok", {"offers": [{"guid": "g", "title": "T", "city": "Paris", "country_code": "fr", "hybrid": True, "careers_url": "u", "published_at": "2026-08-01 10:00:00 UTC", "translations": {"fr": {"title": "F"}, "en": {"title": "Dev", "description": "<p>x</p>"}}}]},
     ("recruitee:s:g", "Paris, FR", "hybrid", datetime(2026, 8, 1, 10), "x", ["FR"])),
    ("smartrecruiters", "tok", {"content": [{"id": "1", "name": "Dev", "releasedDate": "2026-08-01", "location": {"city": "Pune", "country": "in", "remote": True}}]}, ("smartrecruiters:s:1", "Pune, India", "remote", datetime(2026, 8, 1), "", ["IN"])),
    ("workable", "tok", {"jobs": [{"shortcode": "S", "title": "Dev", "city": "Rome", "locations": [{"country": "Italy"}]}]}, ("workable:s:S", "Rome, Italy", "unknown", None, "", ["IT"])),
    ("breezy", "tok", [{"id": "1", "name": "Dev", "location": {"city": "Oslo", "country": {"name": "Norway"}}, "description": "<div>a</div>b"}], ("breezy:s:1", "Oslo, Norway", "unknown", None, "a\nb", ["NO"])),
    ("freshteam", "tok", {"jobs": [{"id": 2, "deleted": True, "title": "X"}, {"id": 1, "title": "Dev", "branch_id": 7, "remote": False}], "branches": [{"id": 7, "city": "Chennai", "country_code": "IN"}]}, ("freshteam:s:1", "Chennai, India", "unknown", None, "", ["IN"])),
    ("oraclecloud", "h.fa.x.oraclecloud.com/CX_1", {"items": [{"requisitionList": [{"Id": "5", "Title": "Dev", "PrimaryLocation": "Austin, TX", "PrimaryLocationCountry": "US", "PostedDate": "2026-08-20", "secondaryLocations": [{"Name": "Pune"}]}]}]},
     ("oraclecloud:s:5", "Austin, TX; Pune, United States", "unknown", datetime(2026, 8, 20), "", ["IN", "US"])),
    ("keka", "t/org", [{"id": 1, "title": "Dev", "jobType": 3, "jobLocations": [{"city": "Delhi", "countryCode": "IN"}], "description": "x"}], ("keka:s:1", "Delhi, India", "remote", None, "x", ["IN"])),
    ("accenture", "in-en", {"data": [{"requisitionId": "1", "title": "Dev", "location": ["Pune"], "postedDateText": "Posted 2 weeks ago", "mustHaveSkills": "Java", "jobDetailUrl": "https://a/{0}/x"}]}, ("accenture:s:1", "Pune, India", "unknown", datetime(2026, 8, 18, 12), "Must have skills: Java", ["IN"])),
    ("infosys", "1", [{"postingId": "1", "postingTitle": "Dev", "location": "PUNE", "createdOn": "2026-08-01T10:00:00", "rolesResponsibilities": "<p>a</p>"}], ("infosys:s:1", "Pune, India", "unknown", datetime(2026, 8, 1, 4, 30), "a", ["IN"])),
    ("capgemini", "in-en", {"data": [{"id": "1", "ref": "r", "source": "S", "title": "Dev", "location": "Pune", "updated_at": "2026-08-01T00:00:00Z", "description": "<p>d</p>"}]}, ("capgemini:s:1", "Pune, India", "unknown", datetime(2026, 8, 1), "d", ["IN"])),
    ("amazon", "USA", {"jobs": [{"id": "1", "title": "Dev", "city": "Seattle", "state": "WA", "country_code": "USA", "posted_date": "August  3, 2026", "job_path": "/p", "basic_qualifications": "q"}]}, ("amazon:s:1", "Seattle, WA, United States", "unknown", datetime(2026, 8, 3), "Basic qualifications:\nq", ["US"])),
    ("zohorecruit", "t.zohorecruit.com", '<rss><channel><title>Co</title><item><title><![CDATA[Dev]]></title><link>https://t.zohorecruit.com/jobs/Careers/12?source=RSS</link><guid></guid><pubDate>Wed, 02 Sep 2026 13:00:00 GMT</pubDate><description><![CDATA[Location: Pune<br>x <span id="spandesc">Body<br>2]]></description></item></channel></rss>',
     ("zohorecruit:s:12", "Pune", "unknown", datetime(2026, 9, 2, 13), "Body\n2", ["IN"])),
]


@pytest.mark.parametrize(("ats", "token", "body", "want"), CASES, ids=[f"{c[0]}{n}" for n, c in enumerate(CASES)])
def test_adapters(spark, ats, token, body, want):
    rows = adapted(spark, ats, body, token)
    assert [(r.id, r.location, r.work_mode, r.updated_at, r.description, r.eligible_countries) for r in rows] == [want]
    assert rows[0].company == "Co" and rows[0].title == ("Dev")


def test_every_provider_has_an_adapter():
    from vacantia import schemas

    assert set(providers.ADAPTERS) | {"jobposting"} == set(schemas.PROVIDERS)


@pytest.mark.parametrize("body", ["", "not json", "{}", "[]", "null"])
def test_broken_payloads_give_no_rows(spark, body):
    for ats in providers.ADAPTERS:
        assert adapted(spark, ats, body, "a/b/c") == []


def test_workday_pages_and_country_pass(spark):
    body = {"jobPostings": [{"title": "Dev", "externalPath": "/job/P/Dev_R-1", "locationsText": "2 Locations", "postedOn": "Posted 3 Days Ago", "bulletFields": ["R-1"]}, {"title": "Dev", "externalPath": "/job/P/Dev_R-1"}, {"title": "none"}]}
    rows = adapted(spark, "workday", body, "h.wd1.myworkdayjobs.com/t/Site")
    assert [(r.id, r.updated_at, r.url) for r in rows] == [("workday:s:R-1", datetime(2026, 8, 29), "https://h.wd1.myworkdayjobs.com/en-US/Site/job/P/Dev_R-1")]
    base = jobs(spark, [job("a", eligible_countries=[], eligibility_confidence="unknown"), job("b", eligible_countries=["US"])])
    facet = jobs(spark, [job("a", eligible_countries=[]), job("new", eligible_countries=[])])
    got = {r.id: (r.eligible_countries, r.eligibility_confidence) for r in providers.workday_country_pass(base, facet, "IN").collect()}
    assert got == {"a": (["IN"], "explicit"), "b": (["US"], "explicit"), "new": (["IN"], "explicit")}
    facets = {"facets": [{"facetParameter": "Location_Country", "values": [{"descriptor": "India", "id": "x", "count": 5}, {"values": [{"descriptor": "USA", "id": "y", "count": 2}]}]}, {"facetParameter": "other", "values": [{"descriptor": "India", "id": "z", "count": 1}]}]}
    assert providers.workday_facets_of(json.dumps(facets)) == {"IN": ("Location_Country", "x", 5), "US": ("Location_Country", "y", 2)} and providers.workday_facets_of("x") == {}


def test_site_postings_and_admission(spark):
    page = lambda t, i: f'<script type="application/ld+json">{json.dumps({"@type": "JobPosting", "title": t, "identifier": i, "description": "d", "datePosted": "2026-08-01", "jobLocation": {"address": {"addressCountry": "India"}}})}</script>'
    pages = spark.createDataFrame([("s", "https://jobs.acme.com/1", page("Old", "7") + page("New", "7")), ("s", "https://evil.com/1", page("Evil", "8"))], "source_slug string, url string, html string").coalesce(1)
    catalog = spark.createDataFrame([("s", "Acme", "acme.com")], "source_slug string, name string, company_domain string")
    assert [(r.id, r.title, r.eligible_countries) for r in providers.site_postings(pages, catalog).collect()] == [("jobposting:s:7", "New", ["IN"])]
    rows = spark.createDataFrame(
        [("https://acme.com/1", "T", "d", "2026-08-01", None, "1", ["IN"]), ("https://x.com/1", "T", "d", "2026-08-01", None, "1", ["IN"]), ("https://acme.com/1", "T", "", "2026-08-01", None, "1", ["IN"]),
         ("https://acme.com/1", "T", "d", "2026-08-01", "2026-08-02", "1", ["IN"]), ("https://acme.com/1", "T", "d", "2026-08-01", None, "1", []), ("https://acme.com/1", "T", "d", "2026-08-01", None, None, ["IN"])],
        "url string, title string, description string, date_posted string, valid_through string, identifier string, eligible_countries array<string>").withColumn("company_domain", F.lit("acme.com"))
    assert [r[0] for r in rows.select(providers.admission(rows, NOW)).collect()] == [None, "domain_conflict", "missing_field", "expired", "missing_country", "missing_identity"]


def test_snapshot_round_trip(spark, tmp_path):
    j = {"id": "a", "company": "C", "title": "T", "location": "L", "remote": False, "workMode": "onsite", "eligibleCountries": ["IN"], "excludedCountries": [], "eligibleRegions": [], "eligibilityConfidence": "explicit", "url": "u", "updatedAt": "2026-08-01", "description": "", "experience": {"min": 2, "max": 5, "maxOpen": True}, "experienceVersion": 2}
    k = {**j, "id": "b", "experience": None}
    m = {x: v for x, v in j.items() if x not in ("experience", "experienceVersion")} | {"id": "c"}
    (tmp_path / "s.json").write_text(json.dumps({"version": 1, "updatedAt": "x", "partitions": {"constructor": {"fetchedAt": "2026-08-02T00:00:00Z", "jobs": [j, k, m]}}}))
    rows, parts = snapshots.read_snapshot(spark, str(tmp_path / "s.json"))
    assert {r.id: (r.ordinal, r.experience_state, r.updated_at) for r in rows.collect()} == {"a": (0, "stated", datetime(2026, 8, 1)), "b": (1, "unstated", datetime(2026, 8, 1)), "c": (2, "unread", datetime(2026, 8, 1))}
    assert [tuple(r) for r in parts.collect()] == [("constructor", datetime(2026, 8, 2))]
    out = str(tmp_path / "jobs")
    snapshots.write_partitions(rows, out)
    snapshots.write_partitions(rows.withColumn("source_slug", F.lit("other")).limit(1), out)
    assert {(r.source_slug, r["count"]) for r in spark.read.parquet(out).groupBy("source_slug").count().collect()} == {("constructor", 3), ("other", 1)}
    one, two = snapshots.export_manifest(rows).collect(), snapshots.export_manifest(rows.orderBy(F.desc("id"))).collect()
    assert one == two and one[0].jobs == 3
    (tmp_path / "bad.json").write_text(json.dumps({"version": 2, "partitions": {}}))
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, str(tmp_path / "bad.json"))


def test_catalog_registry_and_lists(spark, tmp_path):
    good = {"a": {"name": "A", "ats": "lever", "token": "a", "companyDomain": "a.com"}, "b": {"name": "B", "ats": "ashby", "token": "b", "domainEvidence": {"kind": "provider_board", "reference": "r"}}}
    (tmp_path / "c.json").write_text(json.dumps(good))
    assert {r.source_slug for r in snapshots.read_catalog(spark, str(tmp_path / "c.json")).collect()} == {"a", "b"}
    (tmp_path / "d.json").write_text(json.dumps(good | {"x": {"name": "X", "ats": "nope", "token": "x", "companyDomain": "x.com"}}))
    with pytest.raises(Exception, match="invalid catalog entry"):
        snapshots.read_catalog(spark, str(tmp_path / "d.json")).collect()
    assert snapshots.read_registry(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "i.txt").write_text('{"url":"https://jobs.lever.co/acme"}\n{"url":"https://x.com"}\nbroken\n')
    boards, rest = snapshots.read_index_pages(spark, str(tmp_path / "i.txt"))
    assert [tuple(r)[1:] for r in boards.collect()] == [("lever", "acme")] and rest.count() == 2
    (tmp_path / "e.json").write_text('["Lever:Acme"]')
    assert [r.key for r in snapshots.read_exclusions(spark, str(tmp_path / "e.json")).collect()] == ["lever:acme"]
    (tmp_path / "s.md").write_text("- [A](https://a.com/jobs)\n<a class='x' href=\"https://b.io/\">B</a> [T](https://www.linkedin.com/x)")
    assert {(r.name, r.url) for r in snapshots.read_seed_list(spark, str(tmp_path / "s.md"), ["linkedin.com"]).collect()} == {("A", "https://a.com/jobs"), ("B", "https://b.io/")}
    (tmp_path / "k.txt").write_text("acme.keka.com,https://acme.com\nwww.keka.com\nbeta.keka.com\n")
    with_site, without = snapshots.keka_tenants(spark, str(tmp_path / "k.txt"))
    assert [r.host for r in with_site.collect()] == ["acme.keka.com"] and [r.host for r in without.collect()] == ["beta.keka.com"]
