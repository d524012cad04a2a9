"""Dates, experience, geography, HTML, addresses."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from vacantia.functions import dates, experience, geo, html, urls

NOW = datetime(2026, 9, 1, 12)


@pytest.fixture(scope="module")
def names(spark):
    return tuple(geo.country_names(spark))


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("label", "day"),
    [("Posted Today", date(2026, 9, 1)), ("Posted Yesterday", date(2026, 8, 31)), ("Posted 3 Days Ago", date(2026, 8, 29)), ("Posted 30+ Days Ago", date(2026, 8, 1)), ("soon", None), (None, None)],
)
def test_relative_dates(spark, label, day):
    assert one(spark, label, lambda c: dates.relative_date(c, NOW)) == day


@pytest.mark.parametrize(("label", "days"), [("Posted within last 24 hours", 0), ("Posted 2 days ago", 2), ("2 weeks ago", 14), ("Posted more than 1 month ago", 45), ("Posted 1 month ago", 30), ("?", None)])
def test_portal_dates(spark, label, days):
    got = one(spark, label, lambda c: dates.relative_timestamp(c, NOW))
    assert (got is None) if days is None else (NOW - got).days == days


@pytest.mark.parametrize(
    ("text", "at"),
    [("2026-08-01", datetime(2026, 8, 1)), ("2026-08-01T10:00:00.500Z", datetime(2026, 8, 1, 10, 0, 0, 500000)), ("Wed, 02 Oct 2024 13:00:00 GMT", datetime(2024, 10, 2, 13)), ("x", None), ("August 3, 2026", datetime(2026, 8, 3))],
)
def test_lenient_timestamps(spark, text, at):
    assert one(spark, text, dates.lenient_timestamp) == at


def test_ages_and_windows(spark):
    rows = spark.createDataFrame([("a", datetime(2026, 8, 25, 12)), ("b", datetime(2026, 8, 25, 11)), ("c", datetime(2026, 9, 5)), ("d", None), ("e", datetime(2026, 7, 1))], "k string, t timestamp")
    got = {r.k: (r.age, r.days, r.w) for r in rows.select("k", dates.job_age(F.col("t"), NOW).alias("age"), dates.posted_days_ago(F.col("t"), NOW).alias("days"), dates.within_window(F.col("t"), 7, NOW).alias("w")).collect()}
    assert got == {"a": ("new", 7, True), "b": ("new", 7, False), "c": ("new", 0, True), "d": ("undated", None, False), "e": ("stale", 62, False)}
    assert rows.where(dates.within_window(F.col("t"), 0, NOW)).count() == 5


def test_backoff_and_versions(spark):
    assert [one(spark, n, dates.lead_backoff_seconds, "int") for n in (1, 3, 40)] == [60.0, 240.0, 604800.0]
    assert spark.range(1).select(dates.http_backoff_ms(F.lit(2), F.lit(None).cast("double")), dates.http_backoff_ms(F.lit(2), F.lit(90.0))).first()[:] == (2000.0, 30000.0)
    newer = lambda a, b: spark.range(1).select(dates.newer_version(F.lit(a), F.lit(b))).first()[0]
    assert newer("1.10.0", "1.9.9") and not newer("1.0", "1.0.0") and newer("v2", "1.9")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("5+ years of hands-on Java experience", (5, None, False)), ("Experience: 2-5 years", (2, 5, False)), ("minimum 15+ years", (15, None, False)), ("Our company has 30 years of experience", None),
        ("founded with 12 years of experience", None), ("3 to 5+ years of experience", (3, 5, True)), ("Total experience 8-10 years. 3 years experience in Go", (8, 10, False)), ("six to eight years of experience", (6, 8, False)),
        ("25 years of experience", None), ("5-3 years of experience", None), ("2.5 years of experience", (2.5, None, False)), ("<p>4&#43; years experience</p>", (4, None, False)), ("no numbers", None), ("4-4 yrs exp", (4, None, False)),
        ("• 3-6 years\nmore", (3, 6, False)),
    ],
)
def test_experience(spark, text, want):
    r = experience.read_experience_of(text)
    assert (r and (r.low, r.high, r.high_open)) == want
    got = spark.createDataFrame([(text,)], "d string").select(experience.stated(experience.read_experience(F.col("d"))).alias("e")).first().e
    assert (got and (got["min"], got["max"], got["max_open"])) == want


def test_experience_states_labels_and_filter(spark):
    e = "struct<min:double,max:double,max_open:boolean>"
    rows = spark.createDataFrame(
        [("a", "5+ years experience", None, None, None), ("b", "nothing", (1.0, None, False), "stated", 2), ("c", " ", (1.0, 2.0, False), "stated", 2), ("d", "", (1.0, None, False), "stated", 1), ("e", None, None, "unstated", 2)],
        f"k string, description string, experience {e}, experience_state string, experience_version int",
    )
    got = {r.k: (r.experience_state, r.experience and r.experience["min"]) for r in experience.with_experience(rows).collect()}
    assert got == {"a": ("stated", 5.0), "b": ("unstated", None), "c": ("stated", 1.0), "d": ("unread", None), "e": ("unstated", None)}
    known = experience.with_experience(rows)
    assert {r.k for r in known.where(experience.experience_filter(F.col("experience"), 5.0, False)).collect()} == {"a"}
    assert {r.k for r in known.where(experience.experience_filter(F.col("experience"), 1.5, True)).collect()} == {"b", "c", "d", "e"}
    labels = spark.createDataFrame([((2.0, 5.0, True),), ((2.5, None, False),)], f"e {e}").select(experience.experience_label(F.col("e")).alias("x"))
    assert [r.x for r in labels.collect()] == ["2–5+ yrs", "2.5+ yrs"] == [experience.label_of(2, 5, True), experience.label_of(2.5, None, False)]
    assert one(spark, "Graduate Trainee", experience.title_is_entry) and not one(spark, "International Lead", experience.title_is_entry)


@pytest.mark.parametrize(
    ("location", "codes"),
    [
        ("Indianapolis, IN", ["US"]), ("Bangalore, KA, India", ["IN"]), ("Berlin, de", ["DE"]), ("US-IN-FT WAYNE-150A ~ 1010 Production Rd", ["US"]), ("IN - Indianapolis", ["US"]), ("London, UK", ["GB"]),
        ("Hyderabad, TG, India", ["IN"]), ("Atlanta, Georgia", []), ("Tbilisi, Georgia", ["GE"]), ("Pune", ["IN"]), ("Paris, France; Madrid, Spain", ["ES", "FR"]), ("Remote - U.S.", ["US"]), ("Lomé, Togo", ["TG"]), ("", []),
        ("San Francisco, CA, USA", ["US"]), ("Dubai, UAE", ["AE"]), ("Istanbul, Türkiye", ["TR"]),
    ],
)
def test_countries(names, location, codes):
    assert geo.classify_of(location, "", "unknown", names)["eligible_countries"] == codes


def test_classification(spark, names):
    got = geo.classify_of("Remote", "Open to candidates in Germany or India. Not available in France.", "unknown", names)
    assert (got["eligible_countries"], got["excluded_countries"], got["eligibility_confidence"]) == (["DE", "IN"], ["FR"], "explicit")
    assert geo.classify_of("Remote, APAC", "", "unknown", names)["eligibility_confidence"] == "inferred"
    assert geo.classify_of("Hybrid, office", "", "unknown", names)["work_mode"] == "hybrid" and geo.classify_of("Remote", "", "onsite", names)["work_mode"] == "onsite"
    assert geo.classify_of("Remote", "You will work in tandem with our India team", "unknown", names)["eligible_countries"] == []
    assert geo.classify_of("Remote", "hiring across EMEA", "unknown", names)["eligible_regions"] == ["EMEA"]
    rows = spark.createDataFrame([(1, "Remote, Worldwide", "excluding India", "unknown"), (2, None, None, None)], "k int, location string, description string, work_mode string")
    out = {r.k: r for r in geo.classify(rows).collect()}
    assert out[1].excluded_countries == ["IN"] and out[1].remote and out[2].eligibility_confidence == "unknown"
    assert [r.k for r in geo.classify(rows).where(geo.eligible_for("de")).collect()] == [1] and geo.classify(rows).where(geo.eligible_for("IN")).count() == 0
    assert geo.regions_with("IN") == ["APAC", "Asia"] and len(names) == 249
    assert one(spark, " Bangalore / MADRAS ", geo.normalize_location) == "bengaluru / chennai" == geo.normalize_location_of(" Bangalore / MADRAS ")
    assert one(spark, "us", lambda c: geo.country_label(c, list(names))) == "United States" and one(spark, " Oz ", lambda c: geo.country_label(c, list(names))) == "Oz"


def test_older_india_predicate(spark):
    rows = spark.createDataFrame([("Pune", "", False), ("Remote", "open to APAC", True), ("Remote", "not available in India. worldwide", True), ("Berlin", "open to India", False)], "l string, d string, r boolean")
    assert [r[0] for r in rows.select(geo.explicitly_indian(F.col("l"), F.col("d"), F.col("r"))).collect()] == [True, True, False, False]


def test_html():
    assert html.decode_entities_of("&amp;#43; &#43; &nbsp;&hellip; &#x110000; &bogus;") == "&#43; +  … &#x110000; &bogus;"
    assert html.plain_text_of("<ul><li>a</li><li>b &lt;</li></ul> c  <br/>d") == "a\nb <\n c\nd"
    assert html.strip_html_of("<p>a</p><p>b</p><li>c</li>d") == "a\n\nb\n\ncd"
    assert html.structured_text_of("<h2>R</h2>a<p>b</p>&nbsp;&amp;") == " R\na b &"
    assert html.links_of("""<a href="/x#f">1</a><a href='/y?q=1'>2</a><a href="http://a.b/">3</a><a href="https://c.d">4</a><a href="/y?q=1">5</a>""", "https://a.b/p") == ["https://a.b/y?q=1", "https://c.d/"]
    assert html.fnv1a_of("a") == "e40c292c" and html.stable_hash({"b": 1, "a": [2]}) == html.stable_hash({"a": [2], "b": 1})


def test_structured_postings(spark):
    page = """<script type="application/ld+json"><!--{"@graph":[{"@type":["Thing","JobPosting"],"title":" Dev ","identifier":{"value":"7"},"hiringOrganization":{"name":"Acme"},
      "jobLocation":[{"address":{"addressLocality":"Pune","addressCountry":"IN"}}],"description":"<p>a &amp; b</p>","url":"/j/7","datePosted":"2026-08-01"}]}--></script>
      <script type='application/ld+json'>{broken</script><script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"item":{"@type":"JobPosting","name":"Ops","jobLocationType":"TELECOMMUTE","applicantLocationRequirements":{"name":"India"}}},{"item":{"@type":"JobPosting"}}]}</script>"""
    got = spark.createDataFrame([(page, "https://acme.com/jobs")], "h string, u string").select(F.explode(html.extract_postings(F.col("h"), F.col("u"))).alias("p")).select("p.*").collect()
    assert [(r.title, r.company, r.location, r.identifier, r.url, r.remote, r.description) for r in got] == [
        ("Dev", "Acme", "Pune, IN", "7", "https://acme.com/j/7", False, "a & b"), ("Ops", None, "Remote (India)", None, "https://acme.com/jobs", True, "")
    ]


def test_robots_and_sitemaps(spark):
    body = "User-agent: *\nDisallow: /private # x\nUser-agent: other\nDisallow: /"
    assert html.robots_prefix_allows(body, "/jobs", "me") and not html.robots_prefix_allows(body, "/private/x", "me") and html.robots_prefix_allows(None, "/", "me")
    strict = "User-agent: *\nDisallow: /jobs\nAllow: /jobs/open\nDisallow: /*.pdf$"
    allows = html.robots_longest_allows
    assert not allows(strict, "/jobs/a", "me") and allows(strict, "/jobs/open/1", "me") and not allows(strict, "/a/b.pdf", "me") and allows(strict, "/a/b.pdf?x", "me")
    assert one(spark, "<loc> https://a/1 </loc><loc>http://a/2</loc>", html.sitemap_locations) == ["https://a/1"]


@pytest.mark.parametrize(
    ("url", "ats", "token"),
    [
        ("https://boards.greenhouse.io/acme/jobs/1", "greenhouse", "acme"), ("https://boards-api.greenhouse.io/v1/boards/acme/jobs", "greenhouse", "acme"), ("https://jobs.lever.co/acme", "lever", "acme"),
        ("https://jobs.ashbyhq.com/acme/x", "ashby", "acme"), ("https://acme.recruitee.com/o/dev", "recruitee", "acme"), ("https://acme.recruitee.com/x/y/z", None, None),
        ("https://acme.wd1.myworkdayjobs.com/en-US/Site", "workday", "acme.wd1.myworkdayjobs.com/acme/Site"), ("https://acme.wd1.myworkdayjobs.com/wday/cxs/acme/Site/jobs", "workday", "acme.wd1.myworkdayjobs.com/acme/Site"),
        ("https://x.fa.em2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/3", "oraclecloud", "x.fa.em2.oraclecloud.com/CX_1"), ("https://www.breezy.hr", None, None), ("https://acme.breezy.hr/p/1", "breezy", "acme"),
        ("not a url", None, None), ("https://apply.workable.com/j/ABC", None, None), ("https://apply.workable.com/acme/", "workable", "acme"), ("https://acme.workable.com", "workable", "acme"),
        ("https://jobs.smartrecruiters.com/Acme/1", "smartrecruiters", "Acme"), ("https://jobs.smartrecruiters.com/sign-in", None, None), ("https://www.amazon.jobs/en/search?normalized_country_code%5B%5D=IND", "amazon", "IND"),
        ("https://t.zohorecruit.in/jobs/Careers", "zohorecruit", "t.zohorecruit.in"), ("https://acme.keka.com/careers", None, None), (None, None, None),
        ("https://acme.keka.com/careers/api/embedjobs/default/active/0a1b2c3d-0000-1111-2222-333344445555", "keka", "acme/0a1b2c3d-0000-1111-2222-333344445555"),
    ],
)
def test_board_addresses(spark, url, ats, token):
    got = one(spark, url, urls.resolve)
    assert (got and (got.ats, got.token)) == ((ats, token) if ats else None)


def test_keys_domains_slugs(spark):
    key = lambda path, bullet: spark.createDataFrame([(path, bullet)], "p string, b string").select(urls.workday_job_key(F.col("p"), F.col("b"))).first()[0]
    assert key("/job/Pune/Dev_R-12", "R-12") == "R-12" and key("/job/Pune/Dev_R-12-1", "R-12") == "R-12" and key("/job/Pune/Dev_R-9", "Regular") == "R-9" and key("/job/Pune/Dev", "R-12") == "/job/Pune/Dev"
    assert [one(spark, h, urls.registrable_domain) for h in ("www.a.acme.co.in", "jobs.acme.com", "acme.io", "a.b.de")] == ["acme.co.in", "acme.com", "acme.io", "b.de"]
    assert one(spark, "www.Acme-x.com", urls.slug_from_domain) == "acme-x" and one(spark, "acme-widgets_io", urls.name_from_token) == "Acme Widgets Io"
    owned = lambda u, d: spark.createDataFrame([(u, d)], "u string, d string").select(urls.owned_by(F.col("u"), F.col("d"))).first()[0]
    assert owned("https://jobs.acme.com/x", "www.acme.com") and not owned("https://notacme.com", "acme.com") and not owned("bad", "acme.com")
    assert one(spark, "work-with.us", urls.careers_host) and one(spark, "jobs", urls.careers_host) and not one(spark, "www", urls.careers_host)
    assert one(spark, "*.b.acme.com\nA.acme.com acme.com evilacme.com", lambda c: urls.certificate_hosts(c, "acme.com")) == ["a.acme.com", "acme.com", "b.acme.com"]
    assert one(spark, "acme/org", lambda c: urls.canonical_url(F.lit("keka"), c)) == "https://acme.keka.com/careers/api/embedjobs/org"
