"""Provider payloads as postings: one adapter a provider, over recorded responses.

A payload row is ``source_slug, name, token, body`` (the recorded JSON or RSS text). Bodies are read with
declared schemas; network access is not part of this. ``adapt`` registers everything under one call.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, geo, html, urls

Adapter = Callable[[DataFrame, datetime], DataFrame]
ADAPTERS: dict[str, Adapter] = {}

# What the portals keep of a description, in characters.
LIMITS = {"accenture": 2_000, "infosys": 6_000, "capgemini": 6_000, "amazon": 3_000}
ACCENTURE_COUNTRIES = {"in-en": "India", "us-en": "United States"}
AMAZON_COUNTRIES = {"IND": "India", "USA": "United States"}


def _adapter(name: str):
    def keep(function: Adapter) -> Adapter:
        ADAPTERS[name] = function
        return function

    return keep


def _rows(payloads: DataFrame, schema: str, array: str | None) -> DataFrame:
    """Records of the bodies, by position; ``array`` is where the list stands (none: the body itself)."""
    # Spark reads a lone object as a list of one, which is no list of records
    body = F.from_json("body" if array else F.when(F.ltrim("body").startswith("["), F.col("body")), schema)
    return payloads.select("source_slug", "name", "token", F.posexplode(body[array] if array else body).alias("ordinal", "j"))


def _joined(*values: Column, by: str = ", ") -> Column:
    return F.array_join(F.filter(F.array(*[F.coalesce(v, F.lit("")) for v in values]), lambda v: v != ""), by)


def _or(value: Column, other: str = "Unspecified") -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(other)


def _remote(location: Column) -> Column:
    return F.coalesce(location.rlike("(?i)remote"), F.lit(False))


def _jobs(rows: DataFrame, ats: str, id_: Column, title: Column, location: Column, mode: Column, url: Column, updated: Column, description: Column) -> DataFrame:
    return rows.select(
        "source_slug", F.col("ordinal").cast("long").alias("ordinal"), F.concat_ws(":", F.lit(ats), "source_slug", id_).alias("id"), F.col("name").alias("company"), title.alias("title"),
        location.alias("location"), mode.alias("work_mode"), url.alias("url"), updated.cast("timestamp").alias("updated_at"), F.coalesce(description, F.lit("")).alias("description"),
    )


def _mode(remote: Column) -> Column:
    return F.when(F.coalesce(remote, F.lit(False)), "remote").otherwise("unknown")


def _when_text(value: Column) -> Column:
    return dates.lenient_timestamp(value)


def _label(payloads: DataFrame, value: Column) -> Column:
    return geo.country_label(F.coalesce(value, F.lit("")), geo.country_names(payloads.sparkSession))


@_adapter("greenhouse")
def greenhouse(payloads: DataFrame, now: datetime) -> DataFrame:
    rows = _rows(payloads, "jobs array<struct<id:string,title:string,location:struct<name:string>,absolute_url:string,first_published:string,updated_at:string,content:string>>", "jobs")
    place = _or(F.col("j.location.name"))
    return _jobs(rows, "greenhouse", F.col("j.id"), F.col("j.title"), place, F.lit("unknown"), F.col("j.absolute_url"), _when_text(F.coalesce("j.first_published", "j.updated_at")), html.strip_html(F.coalesce("j.content", F.lit(""))))


@_adapter("lever")
def lever(payloads: DataFrame, now: datetime) -> DataFrame:
    rows = _rows(payloads, "array<struct<id:string,text:string,categories:struct<location:string>,workplaceType:string,hostedUrl:string,createdAt:long,descriptionPlain:string,lists:array<struct<text:string,content:string>>,additionalPlain:string>>", None)
    # lists hold HTML; one call strips all of a posting's, parted by a character that HTML text has not
    lists = F.transform(F.coalesce("j.lists", F.array().cast("array<struct<text:string,content:string>>")), lambda s: F.concat(F.coalesce(s["text"], F.lit("")), F.lit("\n"), F.coalesce(s["content"], F.lit(""))))
    stripped = F.transform(F.split(html.strip_html(F.array_join(lists, "\x1f")), "\x1f"), lambda s: F.trim(s))
    sections = F.filter(F.concat(F.array(F.trim(F.coalesce("j.descriptionPlain", F.lit("")))), stripped, F.array(F.trim(F.coalesce("j.additionalPlain", F.lit(""))))), lambda s: s != "")
    kind = F.col("j.workplaceType")
    mode = F.when(kind.isin("remote", "hybrid", "onsite"), kind).otherwise("unknown")
    return _jobs(rows, "lever", F.col("j.id"), F.col("j.text"), _or(F.col("j.categories.location")), mode, F.col("j.hostedUrl"), F.timestamp_millis(F.col("j.createdAt")), F.array_join(sections, "\n\n"))


@_adapter("ashby")
def ashby(payloads: DataFrame, now: datetime) -> DataFrame:
    rows = _rows(payloads, "jobs array<struct<id:string,title:string,location:string,isRemote:boolean,jobUrl:string,publishedAt:string,descriptionPlain:string>>", "jobs")
    return _jobs(rows, "ashby", F.col("j.id"), F.col("j.title"), _or(F.col("j.location")), _mode(F.col("j.isRemote")), F.col("j.jobUrl"), _when_text(F.col("j.publishedAt")), F.col("j.descriptionPlain"))


@_adapter("recruitee")
def recruitee(payloads: DataFrame, now: datetime) -> DataFrame:
    said = "struct<title:string,description:string,requirements:string>"
    rows = _rows(payloads, f"offers array<struct<guid:string,title:string,description:string,requirements:string,city:string,state_name:string,country_code:string,remote:boolean,hybrid:boolean,on_site:boolean,careers_url:string,published_at:string,updated_at:string,translations:map<string,{said}>>>", "offers")
    t = F.coalesce(F.try_element_at("j.translations", F.lit("en")), F.get(F.map_values("j.translations"), F.lit(0)))
    rows = rows.withColumn("t", t)
    place = _or(_joined(F.col("j.city"), F.col("j.state_name"), F.upper("j.country_code")))
    mode = F.when(F.col("j.remote"), "remote").when(F.col("j.hybrid"), "hybrid").when(F.col("j.on_site"), "onsite").otherwise("unknown")
    body = _joined(html.strip_html(F.coalesce("t.description", "j.description")), html.strip_html(F.coalesce("t.requirements", "j.requirements")), by="\n\n")
    return _jobs(rows, "recruitee", F.col("j.guid"), F.coalesce("t.title", "j.title"), place, mode, F.col("j.careers_url"), _when_text(F.regexp_replace(F.coalesce("j.published_at", "j.updated_at"), " UTC$", "Z")), body)


WORKDAY = "jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>>>, total int"


@_adapter("workday")
def workday(payloads: DataFrame, now: datetime) -> DataFrame:
    """Pages of listings: rows without a path are dropped, a posting on two pages is one."""
    rows = _rows(payloads, WORKDAY, "jobPostings").where("j.externalPath IS NOT NULL")
    key = urls.workday_job_key(F.col("j.externalPath"), F.get("j.bulletFields", F.lit(0)))
    host, site = F.split("token", "/")[0], F.get(F.split("token", "/"), F.lit(2))
    place = _or(F.col("j.locationsText"))
    jobs = _jobs(rows, "workday", key, F.col("j.title"), place, _mode(_remote(place)), F.concat(F.lit("https://"), host, F.lit("/en-US/"), site, F.col("j.externalPath")), dates.relative_date(F.col("j.postedOn"), now), F.lit(""))
    names = [c for c in jobs.columns if c != "id"]
    return jobs.groupBy("id").agg(F.min_by(F.struct(*names), "ordinal").alias("r")).select(*[F.col("id") if c == "id" else F.col("r")[c].alias(c) for c in jobs.columns])


WORKDAY_MOST, WORKDAY_CAP = 100_000, 2_000


def workday_complete(payloads: DataFrame) -> DataFrame:
    """Per source: what its pages list against the total they state.

    ``complete``: the total is in range and all of it was listed (a short page is not complete); ``expected``: postings, that is
    the total less rows without a path; ``facets_needed``: the listing may be cut at the provider's cap, or lacks places.
    """
    pages = payloads.select("source_slug", F.from_json("body", WORKDAY).alias("b")).where("b.total IS NOT NULL")
    rows = F.coalesce("b.jobPostings", F.array().cast("array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>>>"))
    without = F.size(F.filter(rows, lambda r: r["externalPath"].isNull()))
    unplaced = F.size(F.filter(rows, lambda r: F.coalesce(r["locationsText"], F.lit("")) == ""))
    held = pages.groupBy("source_slug").agg(F.max("b.total").alias("total"), F.sum(F.size(rows)).alias("listed"), F.sum(without).alias("dropped"), F.sum(unplaced).alias("unplaced"))
    return held.select("source_slug", "total", "listed", (F.col("total").between(0, WORKDAY_MOST) & (F.col("listed") == F.col("total"))).alias("complete"), (F.col("total") - F.col("dropped")).alias("expected"), ((F.col("total") >= WORKDAY_CAP) | (F.col("unplaced") > 0)).alias("facets_needed"))


def workday_country_pass(jobs: DataFrame, facet: DataFrame, code: str) -> DataFrame:
    """Add a country to the jobs that its own listing names, and the jobs only that listing has; these are explicit."""
    named = facet.select("id", F.lit(True).alias("_named"))
    marked = jobs.join(named.distinct(), "id", "left")
    more = F.when(F.col("_named") & ~F.array_contains("eligible_countries", code), F.array_sort(F.array_append("eligible_countries", code))).otherwise(F.col("eligible_countries"))
    known = marked.withColumns({"eligible_countries": more, "eligibility_confidence": F.when(F.col("_named"), "explicit").otherwise(F.col("eligibility_confidence"))}).select(*jobs.columns)
    unseen = facet.join(jobs.select("id"), "id", "left_anti").withColumns({"eligible_countries": F.array_sort(F.array_union("eligible_countries", F.array(F.lit(code)))), "eligibility_confidence": F.lit("explicit")})
    return known.unionByName(unseen.select(*jobs.columns))


# Names by which tenants call countries in their facets.
FACET_COUNTRIES = {"IN": ["india"], "US": ["united states of america", "united states", "usa"]}


def workday_facets_of(body: str) -> dict[str, tuple[str, str, int]]:
    """(parameter, id, count) of each known country in a listing's own facets; the parameter name is inherited."""
    import json

    found: dict[str, tuple[str, str, int]] = {}

    def walk(node, parameter: str | None) -> None:
        if isinstance(node, list):
            for x in node:
                walk(x, parameter)
        elif isinstance(node, dict):
            own = node["facetParameter"] if isinstance(node.get("facetParameter"), str) else parameter
            name, id_, n = node.get("descriptor"), node.get("id"), node.get("count")
            if own and "country" in own.lower() and isinstance(name, str) and isinstance(id_, str) and isinstance(n, int):
                for code, names in FACET_COUNTRIES.items():
                    if name.strip().lower() in names:
                        found.setdefault(code, (own, id_, n))
            for x in node.values():
                walk(x, own)

    try:
        walk(json.loads(body).get("facets"), None)
    except (ValueError, AttributeError):
        return {}
    return found


@_adapter("smartrecruiters")
def smartrecruiters(payloads: DataFrame, now: datetime) -> DataFrame:
    rows = _rows(payloads, "content array<struct<id:string,name:string,releasedDate:string,location:struct<city:string,region:string,country:string,fullLocation:string,remote:boolean,hybrid:boolean>>>", "content")
    loc = F.col("j.location")
    place = _or(F.coalesce(F.nullif(loc["fullLocation"], F.lit("")), _joined(loc["city"], loc["region"], _label(payloads, loc["country"]))))
    mode = F.when(loc["remote"], "remote").when(loc["hybrid"], "hybrid").otherwise("unknown")
    return _jobs(rows, "smartrecruiters", F.col("j.id"), F.col("j.name"), place, mode, F.concat(F.lit("https://jobs.smartrecruiters.com/"), "token", F.lit("/"), F.col("j.id")), _when_text(F.col("j.releasedDate")), F.lit(""))


@_adapter("workable")
def workable(payloads: DataFrame, now: datetime) -> DataFrame:
    rows = _rows(payloads, "jobs array<struct<shortcode:string,title:string,city:string,state:string,country:string,telecommuting:boolean,url:string,published_on:string,locations:array<struct<country:string>>>>", "jobs")
    country = F.coalesce(F.nullif("j.country", F.lit("")), F.get("j.locations", F.lit(0))["country"])
    link = F.coalesce(F.nullif("j.url", F.lit("")), F.concat(F.lit("https://apply.workable.com/j/"), "j.shortcode"))
    return _jobs(rows, "workable", F.col("j.shortcode"), F.col("j.title"), _or(_joined(F.col("j.city"), F.col("j.state"), country)), _mode(F.col("j.telecommuting")), link, _when_text(F.col("j.published_on")), F.lit(""))


@_adapter("breezy")
def breezy(payloads: DataFrame, now: datetime) -> DataFrame:
    rows = _rows(payloads, "array<struct<id:string,friendly_id:string,name:string,url:string,published_date:string,description:string,location:struct<name:string,city:string,state:struct<name:string>,country:struct<name:string>,is_remote:boolean>>>", None)
    loc = F.col("j.location")
    place = _or(F.coalesce(F.nullif(loc["name"], F.lit("")), _joined(loc["city"], loc["state"]["name"], loc["country"]["name"])))
    link = F.coalesce(F.nullif("j.url", F.lit("")), F.concat(F.lit("https://"), "token", F.lit(".breezy.hr/p/"), F.coalesce(F.nullif("j.friendly_id", F.lit("")), "j.id")))
    return _jobs(rows, "breezy", F.col("j.id"), F.col("j.name"), place, _mode(loc["is_remote"]), link, _when_text(F.col("j.published_date")), html.plain_text(F.col("j.description")))


@_adapter("freshteam")
def freshteam(payloads: DataFrame, now: datetime) -> DataFrame:
    """Jobs with their branch looked up; deleted ones are dropped."""
    schema = "jobs array<struct<id:string,unique_id:string,title:string,remote:boolean,deleted:boolean,branch_id:string,created_at:string,description:string>>, branches array<struct<id:string,city:string,state:string,country_code:string>>"
    rows = _rows(payloads, schema, "jobs").where(~F.coalesce("j.deleted", F.lit(False)))
    branches = payloads.select("source_slug", F.explode(F.from_json("body", schema)["branches"]).alias("b")).select(F.col("source_slug").alias("_slug"), F.col("b.id").alias("_branch"), "b")
    rows = rows.join(branches, (F.col("source_slug") == F.col("_slug")) & (F.col("j.branch_id") == F.col("_branch")), "left")
    place = _or(F.coalesce(F.nullif(_joined(F.col("b.city"), F.col("b.state"), _label(payloads, F.col("b.country_code"))), F.lit("")), F.when(F.col("j.remote"), F.lit("Remote"))))
    key = F.coalesce(F.nullif("j.unique_id", F.lit("")), "j.id")
    return _jobs(rows, "freshteam", key, F.col("j.title"), place, _mode(F.col("j.remote")), F.concat(F.lit("https://"), "token", F.lit(".freshteam.com/jobs/"), key), _when_text(F.col("j.created_at")), html.plain_text(F.col("j.description")))


@_adapter("oraclecloud")
def oraclecloud(payloads: DataFrame, now: datetime) -> DataFrame:
    job = "struct<Id:string,Title:string,PrimaryLocation:string,PrimaryLocationCountry:string,WorkplaceType:string,WorkplaceTypeCode:string,PostedDate:string,secondaryLocations:array<struct<Name:string>>>"
    rows = _rows(payloads.withColumn("body", F.to_json(F.struct(F.flatten(F.from_json("body", f"items array<struct<requisitionList:array<{job}>>>")["items"]["requisitionList"]).alias("all")))), f"all array<{job}>", "all")
    country = _label(payloads, F.col("j.PrimaryLocationCountry"))
    others = F.filter(F.coalesce("j.secondaryLocations", F.array().cast("array<struct<Name:string>>"))["Name"], lambda n: F.coalesce(n, F.lit("")) != "")
    named = F.array_join(F.concat(F.filter(F.array(F.coalesce("j.PrimaryLocation", F.lit(""))), lambda p: p != ""), others), "; ")
    shown = F.contains(F.lower(F.coalesce("j.PrimaryLocation", F.lit(""))), F.lower(country))
    place = _or(F.concat(named, F.when((country != "") & ~shown, F.concat(F.lit(", "), country)).otherwise("")))
    remote = F.concat_ws(" ", F.coalesce(F.nullif("j.WorkplaceType", F.lit("")), "j.WorkplaceTypeCode"), place).rlike("(?i)remote|work from home")
    host, site = F.split("token", "/")[0], F.coalesce(F.get(F.split("token", "/"), F.lit(1)), F.lit("CX_1"))
    return _jobs(rows, "oraclecloud", F.col("j.Id"), F.col("j.Title"), place, _mode(remote), F.concat(F.lit("https://"), host, F.lit("/hcmUI/CandidateExperience/en/sites/"), site, F.lit("/job/"), F.col("j.Id")), _when_text(F.col("j.PostedDate")), F.lit(""))


@_adapter("keka")
def keka(payloads: DataFrame, now: datetime) -> DataFrame:
    rows = _rows(payloads, "array<struct<id:string,title:string,jobType:int,publishedOn:string,description:string,jobLocations:array<struct<city:string,name:string,state:string,countryCode:string,countryName:string>>>>", None)
    names = geo.country_names(payloads.sparkSession)
    one = lambda p: _joined(F.coalesce(F.nullif(p["city"], F.lit("")), p["name"]), p["state"], F.coalesce(F.nullif(geo.country_label(F.coalesce(p["countryCode"], F.lit("")), names), F.lit("")), p["countryName"]))
    place = _or(F.array_join(F.filter(F.transform("j.jobLocations", one), lambda p: p != ""), "; "))
    remote = _remote(place) | F.coalesce(F.col("j.jobType") == 3, F.lit(False))
    return _jobs(rows, "keka", F.col("j.id"), F.col("j.title"), place, _mode(remote), F.concat(F.lit("https://"), F.split("token", "/")[0], F.lit(".keka.com/careers/jobdetails/"), F.col("j.id")), _when_text(F.col("j.publishedOn")), html.plain_text(F.col("j.description")))


@_adapter("zohorecruit")
def zohorecruit(payloads: DataFrame, now: datetime) -> DataFrame:
    """Items of an RSS feed; the place stands in the description's HTML."""
    items = F.when(F.col("body").rlike("(?i)<rss"), F.regexp_extract_all("body", F.lit(r"(?is)<item>(.*?)</item>"), F.lit(1)))
    rows = payloads.select("source_slug", "name", "token", F.posexplode(items).alias("ordinal", "item"))
    tag = lambda n: F.trim(F.regexp_extract("item", rf"(?is)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1))
    bare = lambda c: F.trim(F.regexp_replace(c, r"(?s)^<!\[CDATA\[(.*?)\]\]>\z", "$1"))
    rows = rows.withColumns({"title": bare(tag("title")), "link": tag("link"), "guid": bare(tag("guid")), "html": bare(tag("description")), "published": tag("pubDate")})
    place = html.plain_text(F.regexp_extract("html", r"(?is)Location:\s*(.*?)(?:<br|<span|\z)", 1))
    key = F.coalesce(F.nullif("guid", F.lit("")), F.nullif(F.regexp_extract("link", r"(?i)/jobs/Careers/([0-9]+)", 1), F.lit("")), "link")
    remote = _remote(F.col("title")) | _remote(place)
    return _jobs(rows, "zohorecruit", key, F.col("title"), _or(place), _mode(remote), F.regexp_replace("link", r"(?i)\?source=RSS$", ""), _when_text(F.col("published")), html.plain_text(F.regexp_replace("html", r'(?is)^.*?<span id="spandesc">', "")))


@_adapter("accenture")
def accenture(payloads: DataFrame, now: datetime) -> DataFrame:
    rows = _rows(payloads, "data array<struct<requisitionId:string,title:string,location:array<string>,feedCity:string,country:string,jobDetailUrl:string,postedDateText:string,staticExtractiveSummary:string,mustHaveSkills:string,goodToHaveSkills:string,yearsOfExperience:string,qualificationShort:string,remoteType:string>>", "data")
    country = F.coalesce(F.nullif("j.country", F.lit("")), F.create_map(*[F.lit(x) for p in ACCENTURE_COUNTRIES.items() for x in p])[F.col("token")], F.lit("India"))
    places = F.filter(F.coalesce("j.location", F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")) != "")
    places = F.when(F.size(places) > 0, places).otherwise(F.filter(F.array(F.coalesce("j.feedCity", F.lit(""))), lambda p: p != ""))
    place = F.coalesce(F.nullif(F.array_join(F.transform(places, lambda p: F.concat(p, F.lit(", "), country)), "; "), F.lit("")), country)
    said = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), F.col(c) if isinstance(c, str) else c))
    skills = _joined(said("Must have skills: ", F.col("j.mustHaveSkills")), said("Good to have skills: ", F.col("j.goodToHaveSkills")), by="\n")
    body = _joined(html.plain_text(F.col("j.staticExtractiveSummary")), skills, F.col("j.yearsOfExperience"), said("Educational qualification: ", F.col("j.qualificationShort")), by="\n\n")
    link = F.regexp_replace("j.jobDetailUrl", F.lit(r"\{0\}"), F.col("token"))
    return _jobs(rows, "accenture", F.col("j.requisitionId"), F.col("j.title"), place, _mode(_remote(F.col("j.remoteType"))), link, dates.relative_timestamp(F.col("j.postedDateText"), now), F.substring(body, 1, LIMITS["accenture"]))


@_adapter("infosys")
def infosys(payloads: DataFrame, now: datetime) -> DataFrame:
    """Times come without a zone and mean India's."""
    parts = ["rolesResponsibilities", "technicalRequirement", "additionalResponsibility", "preferredSkills", "educationalRequirement"]
    rows = _rows(payloads, f"array<struct<postingId:string,postingTitle:string,location:string,country:string,referenceCode:string,sourceId:string,createdOn:string,{','.join(p + ':string' for p in parts)}>>", None)
    body = html.plain_text(F.concat_ws("<br><br>", *[F.nullif(F.col(f"j.{p}"), F.lit("")) for p in parts]))
    place = F.concat(F.initcap(F.trim(F.regexp_replace(F.coalesce("j.location", F.lit("")), r"\s+", " "))), F.lit(", "), F.coalesce(F.nullif("j.country", F.lit("")), F.lit("India")))
    link = F.concat(F.lit("https://career.infosys.com/jobdesc?jobReferenceCode="), "j.referenceCode", F.lit("&sourceId="), "j.sourceId")
    return _jobs(rows, "infosys", F.col("j.postingId"), F.col("j.postingTitle"), place, F.lit("unknown"), link, F.try_to_timestamp(F.concat("j.createdOn", F.lit("+05:30"))), F.substring(body, 1, LIMITS["infosys"]))


@_adapter("capgemini")
def capgemini(payloads: DataFrame, now: datetime) -> DataFrame:
    rows = _rows(payloads, "data array<struct<id:string,ref:string,source:string,title:string,location:string,country_name:string,updated_at:string,description:string,description_stripped:string>>", "data")
    place = F.concat(F.coalesce("j.location", F.lit("")), F.lit(", "), F.coalesce(F.nullif("j.country_name", F.lit("")), F.lit("India")))
    link = F.concat(F.lit("https://www.capgemini.com/"), "token", F.lit("/jobs/"), "j.ref", F.lit("+"), F.lower("j.source"))
    body = html.plain_text(F.coalesce(F.nullif("j.description_stripped", F.lit("")), "j.description"))
    return _jobs(rows, "capgemini", F.col("j.id"), F.col("j.title"), place, F.lit("unknown"), link, _when_text(F.col("j.updated_at")), F.substring(body, 1, LIMITS["capgemini"]))


@_adapter("amazon")
def amazon(payloads: DataFrame, now: datetime) -> DataFrame:
    rows = _rows(payloads, "jobs array<struct<id:string,id_icims:string,title:string,city:string,state:string,country_code:string,posted_date:string,job_path:string,description_short:string,basic_qualifications:string,preferred_qualifications:string>>", "jobs")
    country = F.coalesce(F.create_map(*[F.lit(x) for p in AMAZON_COUNTRIES.items() for x in p])[F.col("j.country_code")], F.col("j.country_code"))
    under = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}:\n"), html.plain_text(F.col(c))))
    body = _joined(html.plain_text(F.col("j.description_short")), under("Basic qualifications", "j.basic_qualifications"), under("Preferred qualifications", "j.preferred_qualifications"), by="\n\n")
    key = F.coalesce(F.nullif("j.id_icims", F.lit("")), "j.id")
    return _jobs(rows, "amazon", key, F.col("j.title"), _or(_joined(F.col("j.city"), F.col("j.state"), country)), F.lit("unknown"), F.concat(F.lit("https://www.amazon.jobs"), "j.job_path"), _when_text(F.regexp_replace("j.posted_date", r"\s+", " ")), F.substring(body, 1, LIMITS["amazon"]))


def adapt(ats: str, payloads: DataFrame, now: datetime) -> DataFrame:
    """Postings of a provider's recorded payloads, classified by place."""
    return geo.classify(ADAPTERS[ats](payloads, now).withColumn("skills", F.lit(None).cast("string")))


def stop_at_age(jobs: DataFrame, days: int, now: datetime) -> DataFrame:
    """Listings that are newest first stop at an age; here that is a filter, the undated stay."""
    return jobs.where(F.col("updated_at").isNull() | dates.within_window(F.col("updated_at"), days, now))


SITEMAPS = 3


def site_candidates(pages: DataFrame, sitemaps: DataFrame, catalog: DataFrame, cap: int) -> DataFrame:
    """Addresses to read of company sites: links of their pages, then those of the first sitemaps; own domain, each once, ``cap`` a source.

    ``pages``: source_slug, url, html; ``sitemaps``: source_slug, ordinal, xml.
    """
    turn = F.row_number().over(Window.partitionBy("source_slug").orderBy("ordinal"))
    few = sitemaps.withColumn("_turn", turn).where(F.col("_turn") <= SITEMAPS)
    linked = pages.select("source_slug", F.lit(0).alias("kind"), F.explode(html.extract_links(F.col("html"), F.col("url"))).alias("link"))
    mapped = few.select("source_slug", F.lit(1).alias("kind"), F.explode(html.sitemap_locations(F.col("xml"))).alias("link"))
    own = linked.unionByName(mapped).join(catalog.select("source_slug", "company_domain"), "source_slug").where(urls.owned_by(F.col("link"), F.col("company_domain")))
    once = own.groupBy("source_slug", "link").agg(F.min("kind").alias("kind"))
    place = F.row_number().over(Window.partitionBy("source_slug").orderBy("kind", "link"))
    return once.withColumn("place", place).where(F.col("place") <= cap).select("source_slug", "place", "link")


def site_postings(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Structured postings of company pages ``source_slug, url, html``: own domain only, the last of an identifier wins."""
    found = pages.join(catalog.select("source_slug", "name", "company_domain"), "source_slug").where(urls.owned_by(F.col("url"), F.col("company_domain")))
    rows = found.select("source_slug", "name", F.monotonically_increasing_id().alias("_page"), F.posexplode(html.extract_postings(F.col("html"), F.col("url"))).alias("_at", "p"))
    key = F.coalesce("p.identifier", "p.url")
    last = rows.groupBy("source_slug", "name", key.alias("key")).agg(F.max_by("p", F.struct("_page", "_at")).alias("j")).withColumn("ordinal", F.xxhash64("key")).withColumn("token", F.lit(""))
    return geo.classify(_jobs(last, "jobposting", F.col("key"), F.col("j.title"), F.col("j.location"), _mode(F.col("j.remote")), F.col("j.url"), _when_text(F.col("j.date_posted")), F.col("j.description")))


def admission(postings: DataFrame, now: datetime) -> Column:
    """The first reason against a structured posting under the strict rules, null if it is admitted."""
    gone = dates.lenient_timestamp(F.col("valid_through")) < F.lit(now).cast("timestamp")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(~urls.owned_by(F.col("url"), F.col("company_domain")), "domain_conflict").when(blank("title") | blank("description") | blank("date_posted"), "missing_field")
        .when(F.coalesce(gone, F.lit(False)), "expired").when(F.size("eligible_countries") == 0, "missing_country").when(blank("identifier"), "missing_identity")
    )
