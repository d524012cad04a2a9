"""Board addresses: provider, token, canonical address, endpoint; job keys, domains, slugs. Built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path words that are no tokens, hosts that are no tenants.
RESERVED = ["my-applications", "sign-in", "signin", "login", "register", "privacy", "cookie-policy", "job-alerts", "search"]
WORKABLE_PATHS = ["j", "api", "jobs", "embed", "assets"]
NO_TENANT = {
    "workable": ["www", "apply", "help", "resources", "jobs", "careers", "api", "app", "assets", "cdn", "status", "developers", "blog", "partners"],
    "breezy": ["www", "app", "api", "help", "blog"],
    "freshteam": ["www", "app", "api", "support", "help", "blog"],
    "keka": ["www", "app", "academy", "developers", "help", "cdn", "api"],
    "zohorecruit": ["www", "help", "static", "img", "js", "css", "accounts"],
}
SITES = ["in-en", "us-en"]


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.get(parts(url), F.lit(k)), F.lit(""))


def query_value(url: Column, key: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(key))


def _token(value: Column) -> Column:
    """A path part that may be a token, else null."""
    return F.when(value.rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~F.lower(value).isin(RESERVED), value)


def _tenant(h: Column, provider: str, suffix: str) -> Column:
    name = F.regexp_extract(h, rf"^([a-z0-9-]+)\.{suffix}$", 1)
    return F.when((name != "") & ~name.isin(NO_TENANT[provider]), name)


def resolve(url: Column) -> Column:
    """(ats, token) of a board address, null if no provider claims it."""
    h, p = host(url), path(url)
    first, second, third = _part(url, 0), _part(url, 1), _part(url, 2)
    smart = F.when(h.isin("jobs.smartrecruiters.com", "careers.smartrecruiters.com"), _token(first)).when((h == "api.smartrecruiters.com") & (first == "v1") & (second == "companies"), _token(third))
    workable = F.when(h == "apply.workable.com", F.when(~first.isin(WORKABLE_PATHS), _token(first))).otherwise(_tenant(h, "workable", r"workable\.com"))
    org = F.lower(F.regexp_extract(p, r"(?i)/(?:careers/api/embedjobs(?:/default/active)?|ats/documents)/([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1))
    keka = F.when(org != "", F.concat_ws("/", _tenant(h, "keka", r"keka\.com"), org))
    keka = F.when(_tenant(h, "keka", r"keka\.com").isNotNull(), keka)
    zoho = F.when(h.rlike(r"^[a-z0-9-]+\.zohorecruit\.(?:com|in|eu)$") & ~F.split(h, r"\.")[0].isin(NO_TENANT["zohorecruit"]) & F.lower(p).startswith("/jobs/careers"), h)
    site = F.coalesce(F.nullif(F.regexp_extract(p, "/sites/([A-Za-z0-9_]{2,32})", 1), F.lit("")), query_value(url, "siteNumber"))
    oracle = F.when(h.rlike(r"^[a-z0-9-]+\.fa(?:\.[a-z0-9-]+)*\.oraclecloud\.com$") & site.rlike("^[A-Za-z0-9_]{2,32}$"), F.concat_ws("/", h, site))
    lead = F.lower(F.regexp_extract(p, "(?i)^/(in-en|us-en)/", 1))
    accenture = F.when(h.rlike(r"(^|\.)accenture\.com$") & (lead != "") & F.lower(p).rlike("^/(in-en|us-en)/careers"), lead)
    infosys = F.when(h.rlike(r"intapgateway\.infosysapps\.com$"), query_value(url, "sourceId"))
    capgemini = F.when(h.rlike(r"(^|\.)capgemini\.com$") & (lead != ""), lead)
    amazon = F.when(h.rlike(r"(^|\.)amazon\.jobs$"), F.nullif(F.regexp_extract(url, r"normalized_country_code(?:\[\]|%5[Bb]%5[Dd])=([^&#]+)", 1), F.lit("")))
    greenhouse = F.when(h.isin("job-boards.greenhouse.io", "boards.greenhouse.io"), first).when((h == "boards-api.greenhouse.io") & (first == "v1") & (second == "boards"), third)
    n = F.size(parts(url))
    own_path = (n == 0) | ((n == 2) & (first == "o")) | (F.array_join(parts(url), "/") == "api/offers")
    recruitee = F.when(h.rlike(r"^[a-z0-9-]+\.recruitee\.com$") & own_path, F.regexp_replace(h, r"\.recruitee\.com$", ""))
    cxs = (n == 5) & (first == "wday") & (second == "cxs") & (_part(url, 4) == "jobs")
    board = first.rlike("(?i)^[a-z]{2}-[a-z]{2}$") & (second != "") & ~F.contains(second, F.lit(".")) & ((n == 2) | ((n == 5) & (third == "job")))
    workday = F.when(h.rlike(r"\.myworkdayjobs\.com$"), F.when(cxs, F.concat_ws("/", h, third, _part(url, 3))).when(board, F.concat_ws("/", h, F.split(h, r"\.")[0], second)))
    tried = [("smartrecruiters", smart), ("workable", workable), ("breezy", _tenant(h, "breezy", r"breezy\.hr")), ("freshteam", _tenant(h, "freshteam", r"freshteam\.com")), ("keka", keka), ("zohorecruit", zoho),
             ("oraclecloud", oracle), ("accenture", accenture), ("infosys", infosys), ("capgemini", capgemini), ("amazon", amazon), ("greenhouse", greenhouse),
             ("lever", F.when(h == "jobs.lever.co", first)), ("ashby", F.when(h == "jobs.ashbyhq.com", first)), ("recruitee", recruitee), ("workday", workday)]
    return F.coalesce(*[F.when(F.coalesce(t, F.lit("")) != "", F.struct(F.lit(name).alias("ats"), t.alias("token"))) for name, t in tried])


def source_key(ats: Column, token: Column) -> Column:
    return F.concat_ws(":", ats, F.lower(token))


def canonical_url(ats: Column, token: Column) -> Column:
    """The address of a board that people open."""
    a, b = F.split(token, "/")[0], F.coalesce(F.get(F.split(token, "/"), F.lit(1)), F.lit(""))
    say = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    return (
        F.when(ats == "greenhouse", say("https://job-boards.greenhouse.io/", token)).when(ats == "lever", say("https://jobs.lever.co/", token)).when(ats == "ashby", say("https://jobs.ashbyhq.com/", token))
        .when(ats == "recruitee", say("https://", token, ".recruitee.com")).when(ats == "workday", say("https://", a, "/en-US/", F.get(F.split(token, "/"), F.lit(2))))
        .when(ats == "smartrecruiters", say("https://jobs.smartrecruiters.com/", token)).when(ats == "workable", say("https://apply.workable.com/", token, "/"))
        .when(ats == "breezy", say("https://", token, ".breezy.hr")).when(ats == "freshteam", say("https://", token, ".freshteam.com/jobs"))
        .when(ats == "keka", say("https://", a, ".keka.com/careers/api/embedjobs/", b)).when(ats == "zohorecruit", say("https://", token, "/jobs/Careers"))
        .when(ats == "oraclecloud", say("https://", a, "/hcmUI/CandidateExperience/en/sites/", b, "/requisitions"))
    )


def workday_job_key(external_path: Column, bullet: Column) -> Column:
    """The requisition bullet if the address corroborates it, else the address's suffix with a digit, else the path."""
    tail = F.element_at(F.split(external_path, "/"), -1)
    suffix = F.when(F.contains(tail, F.lit("_")), F.substring_index(tail, "_", -1)).otherwise("")
    own = F.trim(F.coalesce(bullet, F.lit("")))
    rest = F.substring(suffix, F.length(own) + 2, F.length(suffix))
    backed = (suffix == own) | (F.startswith(suffix, F.concat(own, F.lit("-"))) & rest.rlike("^[0-9]+$"))
    return F.when((own != "") & own.rlike("[0-9]") & backed, own).when(suffix.rlike("(?i)^[a-z0-9.-]+$") & suffix.rlike("[0-9]"), suffix).otherwise(external_path)


def bare_host(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"^www\.", "")


def owned_by(url: Column, domain: Column) -> Column:
    """The host is the domain or stands under it."""
    h, d = bare_host(host(url)), bare_host(domain)
    return F.coalesce((h == d) | F.endswith(h, F.concat(F.lit("."), d)), F.lit(False))


# Second-level labels under two-letter countries.
SECOND_LEVEL = ["co", "com", "org", "net", "ac", "gov", "edu"]


def registrable_domain(h: Column) -> Column:
    """Two labels, or three where the second belongs to a two-letter country."""
    labels = F.split(bare_host(h), r"\.")
    n = F.size(labels)
    deep = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin(SECOND_LEVEL)
    return F.array_join(F.slice(labels, F.when(deep, F.lit(-3)).otherwise(F.greatest(F.lit(-2), -n)), F.lit(3)), ".")


def slug_from_domain(domain: Column) -> Column:
    return F.regexp_replace(F.split(bare_host(domain), r"\.")[0], "[^a-z0-9-]", "-")


def name_from_token(token: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(token, "[-_.]+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


# Words of careers hosts, and the hosts that are tried anyway.
CAREER_WORDS = [
    "careers", "career", "jobs", "job", "apply", "hiring", "talent", "talents", "recruit", "recruiting", "recruitment", "join", "joinus", "workwithus",
    "opportunities", "vacancies", "openings",
]
CONVENTIONAL = ["careers", "jobs", "apply", "hiring", "talent", "recruit", "join"]


def careers_host(subdomain: Column) -> Column:
    """A word of careers hosts in what stands before the company's domain, or both "work" and "us"."""
    words = F.split(F.lower(subdomain), "[.-]+")
    return F.arrays_overlap(words, F.array(*map(F.lit, CAREER_WORDS))) | (F.array_contains(words, "work") & F.array_contains(words, "us"))


def certificate_hosts(names: Column, domain: str) -> Column:
    """Distinct hosts under a domain out of multi-line certificate names, wildcards off, in order."""
    every = F.transform(F.split(F.lower(names), r"\s+"), lambda n: F.regexp_replace(n, r"^\*\.", ""))
    return F.array_sort(F.array_distinct(F.filter(every, lambda n: (n == domain) | F.endswith(n, F.lit("." + domain)))))
