"""Queries that run the job operators whole, over postings made of the driver's tables, and the same results in DuckDB SQL.

A posting's title, place and description follow from its order's key by fixed lists, so that SQL can work out on its own
what the operators must find in them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, experience, geo, html, text, urls
from ..operators import audit, coverage, matching, precedence, registry, requirements, search, state, verification, watches
from ..operators.matching import Intent
from ..operators.profile import parse_resume
from ..sources import snapshots
from .relational import _latest, _t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = datetime(2001, 6, 1)

TITLES = ["Senior Backend Engineer", "Data Analyst", "Software Engineer", "QA Engineer", "Frontend Developer", "Platform Engineer Intern", "Chef", "Principal Data Engineer"]
PLACES = ["Pune, India", "Berlin, Germany", "Remote", "Austin, TX", "Paris, France", "Remote - APAC"]
TEXTS = ["Must have Java and Kafka.", "Minimum 5 years of experience. Java required.", "We like Docker.", "Python is required but Go is optional", "Must know Java, Spring Boot and Go", "Minimum 15 years of experience", ""]
MODES = ["onsite", "onsite", "remote", "onsite", "hybrid", "remote"]
COUNTRIES = [["IN"], ["DE"], [], ["US"], ["FR"], []]
RESUME = "# Jo\n## Skills\nJava, Python\n## Experience\nSoftware Engineer at Beta 2012 to 2019\n## Education\nB.Tech Computer Science"


def _query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


def _sql_list(values: list) -> str:
    return "[" + ", ".join(_sql_list(v) if isinstance(v, list) else "'" + v.replace("'", "''") + "'" for v in values) + "]" + ("::VARCHAR[]" if not values else "")


def _pick(values: list, index: Column) -> Column:
    lit = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)
    return F.element_at(F.array(*map(lit, values)), (index + 1).cast("int"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings in the library's schema."""
    orders, customer = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k, place = F.col("o_orderkey"), F.col("o_custkey") % len(PLACES)
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.concat(F.lit("s"), (F.col("o_custkey") % 40).cast("string")).alias("source_slug"), k.alias("ordinal"), F.concat_ws(":", F.lit("lever"), F.col("o_custkey"), k).alias("id"),
        F.col("c_name").alias("company"), _pick(TITLES, k % len(TITLES)).alias("title"), _pick(PLACES, place).alias("location"), _pick(MODES, place).isin("remote").alias("remote"),
        _pick(MODES, place).alias("work_mode"), _pick(COUNTRIES, place).alias("eligible_countries"), F.when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit("IN"))).otherwise(F.array().cast("array<string>")).alias("excluded_countries"),
        F.when(place == 5, F.array(F.lit("APAC"))).otherwise(F.array().cast("array<string>")).alias("eligible_regions"), F.when(F.size(_pick(COUNTRIES, place)) > 0, "explicit").when(place == 5, "inferred").otherwise("unknown").alias("eligibility_confidence"),
        F.lit("https://x").alias("url"), F.when(k % 11 != 0, F.col("o_orderdate").cast("timestamp")).alias("updated_at"), _pick(TEXTS, k % len(TEXTS)).alias("description"), F.lit(None).cast("string").alias("skills"),
        F.lit(None).cast("struct<min:double,max:double,max_open:boolean>").alias("experience"), F.lit("unread").alias("experience_state"), F.lit(None).cast("int").alias("experience_version"),
    )


#: The same postings as a common table expression; ``ti``, ``pl`` and ``tx`` are the places in the lists.
POSTINGS = f"""
j AS (SELECT o_orderkey AS ordinal, 's' || (o_custkey % 40) AS source_slug, 'lever:' || o_custkey || ':' || o_orderkey AS id, c_name AS company, o_orderkey % 8 AS ti, o_custkey % 6 AS pl, o_orderkey % 7 AS tx,
  {_sql_list(TITLES)}[o_orderkey % 8 + 1] AS title, {_sql_list(PLACES)}[o_custkey % 6 + 1] AS location, {_sql_list(MODES)}[o_custkey % 6 + 1] AS work_mode, {_sql_list(COUNTRIES)}[o_custkey % 6 + 1] AS countries,
  CASE WHEN o_orderpriority = '5-LOW' THEN ['IN'] ELSE []::VARCHAR[] END AS excluded, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS posted, {_sql_list(TEXTS)}[o_orderkey % 7 + 1] AS description
  FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT *, CASE WHEN posted IS NULL THEN NULL ELSE epoch_ms(TIMESTAMP '2001-06-01') - epoch_ms(posted) END AS ms,
  NOT list_contains(excluded, 'IN') AND (list_contains(countries, 'IN') OR pl = 5) AS in_open,
  CASE tx WHEN 1 THEN 5 WHEN 5 THEN 15 END AS low FROM j)
"""


@_query(f"""
WITH {POSTINGS},
f AS (SELECT * FROM n WHERE in_open AND ti IN (0, 2, 3, 5, 7) AND (low IS NULL OR 7 >= low)),
k AS (SELECT count(*) FILTER (ms <= 7 * 86400000::BIGINT) AS a, count(*) FILTER (ms <= 14 * 86400000::BIGINT) AS b, count(*) FILTER (ms <= 30 * 86400000::BIGINT) AS c FROM f),
w AS (SELECT CASE WHEN a >= 5 THEN 7 WHEN b >= 5 THEN 14 WHEN c >= 5 THEN 30 ELSE 0 END AS days_used FROM k),
r AS (SELECT f.*, days_used FROM f, w WHERE days_used = 0 OR ms <= days_used * 86400000::BIGINT)
SELECT id, title, days_used, (SELECT count(*) FROM r) AS total, CASE WHEN ms IS NULL THEN 'undated' WHEN ms <= 8 * 86400000::BIGINT - 1 THEN 'new' WHEN ms <= 31 * 86400000::BIGINT - 1 THEN 'older' ELSE 'stale' END AS age,
       CASE WHEN (SELECT count(*) FROM r) > 25 THEN 25::BIGINT END AS next_offset
FROM r ORDER BY posted DESC NULLS LAST, id LIMIT 20 OFFSET 5
""")
def q40_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: terms over title, country, stated experience, windows, a page with total and age."""
    q = search.SearchQuery(query="engineers", country="in", experience_years=7, include_unknown_experience=True, offset=5, limit=20)
    return search.search(postings(spark, sf_dir), q, NOW).select("id", "title", "days_used", "total", "age", "next_offset")


@_query("""
SELECT CAST(NULL AS BIGINT) AS o_orderkey, count(*) AS total, CAST(NULL AS BIGINT) AS next_offset FROM orders WHERE o_orderstatus = 'P'
""")
def q37_page_past_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page past the last one still tells the total."""
    return search.page(_t(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "o_orderdate", "o_orderkey", 10_000_000, 10, always=True).select("o_orderkey", "total", "next_offset")


@_query(f"""
WITH {POSTINGS},
r AS (SELECT id, list_filter([
  CASE WHEN NOT (in_open OR (list_contains(countries, 'DE'))) THEN 'country_not_eligible:IN' END, CASE WHEN NOT (in_open OR (list_contains(countries, 'DE'))) THEN 'country_not_eligible:DE' END,
  CASE WHEN list_contains(countries, 'US') THEN 'country_excluded:US' END, CASE WHEN location NOT LIKE '%Pune%' AND location NOT LIKE '%Berlin%' THEN 'location_mismatch' END,
  CASE WHEN location LIKE '%TX%' THEN 'location_excluded:tx' END, CASE WHEN ti = 3 THEN 'role_excluded:qa engineer' END,
  CASE WHEN coalesce(ms > 30 * 86400000::BIGINT, true) THEN 'posted_too_old:30d' END, CASE WHEN work_mode = 'remote' THEN 'non_remote_required' END,
  CASE WHEN regexp_matches(description, '(?i)(^|[^a-z0-9+#])docker($|[^a-z0-9+#])') THEN 'excluded_term:docker' END], lambda x: x IS NOT NULL) AS reasons FROM n)
SELECT reason, count(*) AS n, min(id) AS first FROM (SELECT id, unnest(reasons) AS reason FROM r) GROUP BY 1
UNION ALL SELECT '(none)', count(*), min(id) FROM r WHERE len(reasons) = 0
""")
def q41_hard_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons of all hard filters against every posting."""
    intent = Intent(countries=["IN", "DE"], excluded_countries=["US"], locations=["pune", "Berlin"], excluded_locations=["tx"], excluded_roles=["qa engineer"], max_age_days=30, remote=False, excluded_terms=["docker"])
    rows = postings(spark, sf_dir).withColumn("reasons", matching.hard_filter(intent, NOW))
    every = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("(none)")))
    return rows.select("id", F.explode(every).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


# What the lists hold, by hand: points of each title for the role "backend engineer", of its level against seven years; of each
# text the supported terms, the gaps (an unmet screening is one), screened, met and partly met requirements, whether a range is stated.
_SCORED = f"""
WITH {POSTINGS},
ro(ti, role, direct, level) AS (VALUES (0, 6, true, 2), (1, -6, false, 0), (2, 3, false, 0), (3, -6, false, 0), (4, -6, false, 0), (5, 3, false, -2), (6, -6, false, 0), (7, -6, false, -2)),
te(tx, sup, gap, scr, met, part, stated) AS (VALUES (0, 1, 1, 0, 0, 0, 0), (1, 1, 0, 1, 1, 0, 3), (2, 0, 0, 0, 0, 0, 0), (3, 1, 0, 0, 0, 0, 0), (4, 1, 2, 0, 0, 0, 0), (5, 0, 1, 1, 0, 1, -3), (6, 0, 0, 0, 0, 0, 0)),
s AS (SELECT n.*, role, direct, CASE WHEN stated <> 0 THEN stated ELSE level END AS sen, sup, gap, scr, met, part FROM n JOIN ro ON n.ti = ro.ti JOIN te ON n.tx = te.tx),
g AS (SELECT *, role + 2 * sup + sen - 2 * gap - 6 * (scr - met) AS score,
  CASE WHEN role >= 4 THEN 30.0 WHEN role >= 3 THEN 22.5 ELSE 0.0 END + CASE WHEN sup + gap > 0 THEN 50.0 * sup / (sup + gap) ELSE 0.0 END
  + CASE WHEN scr > 0 THEN 20.0 * (met + 0.5 * part) / scr WHEN sen > 0 THEN 20.0 WHEN sen < 0 THEN 0.0 ELSE 10.0 END AS points FROM s),
h AS (SELECT *, CASE WHEN scr > met THEN 'stretch' WHEN score >= 8 AND gap = 0 THEN 'strong' WHEN score >= 4 THEN 'good' ELSE 'stretch' END AS fit,
  CAST(least(floor(points + 0.5), CASE WHEN scr > met THEN 79 ELSE 100 END) AS INTEGER) AS evidence FROM g)
"""


@_query(_SCORED + """
SELECT title, description, count(*) AS n, any_value(CAST(score AS INTEGER)) AS score, any_value(fit) AS fit, any_value(evidence) AS evidence,
       any_value(CASE WHEN fit = 'stretch' THEN 'stretch' WHEN direct THEN 'direct' WHEN ti IN (2, 5) THEN 'hidden' ELSE 'stretch' END) AS category, min(CAST(score AS INTEGER)) = max(CAST(score AS INTEGER)) AS one_score
FROM h GROUP BY 1, 2
""")
def q42_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting scored against a resume: role, requirements, screening, seniority, class, evidence, category."""
    profile = parse_resume(RESUME, "markdown")
    scored = matching.score_jobs(postings(spark, sf_dir), profile, Intent(roles=["backend engineer"], max_age_days=0), NOW).withColumn("points", F.col("score").cast("int"))
    return scored.groupBy("title", "description").agg(
        F.count(F.lit(1)).alias("n"), F.first("points").alias("score"), F.first("fit").alias("fit"), F.first("evidence_percent").alias("evidence"), F.first("category").alias("category"),
        (F.min("points") == F.max("points")).alias("one_score"),
    )


@_query(_SCORED + """
SELECT id, CAST(score AS INTEGER) AS score, fit, evidence FROM h WHERE in_open AND coalesce(ms <= 60 * 86400000::BIGINT, false)
ORDER BY evidence DESC, CASE fit WHEN 'strong' THEN 3 WHEN 'good' THEN 2 ELSE 1 END DESC, score DESC, posted DESC NULLS LAST, ordinal LIMIT 40
""")
def q43_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 40 matches of a country and 60 days, in order."""
    best, _ = matching.match_jobs(postings(spark, sf_dir), parse_resume(RESUME, "markdown"), Intent(roles=["backend engineer"], countries=["IN"], max_age_days=60), NOW, 40)
    return best.select("id", F.col("score").cast("int").alias("score"), "fit", F.col("evidence_percent").alias("evidence"))


@_query(f"""
WITH {POSTINGS},
h AS (SELECT id, ordinal, 2 * (CAST(title LIKE '%Engineer%' AS INTEGER) + CAST(title LIKE '%Software%' AS INTEGER)) AS score, title, location, countries, work_mode FROM n)
SELECT id, score FROM h WHERE score > 0 AND title NOT LIKE '%Intern%' AND list_contains(countries, 'IN') AND (work_mode = 'remote' OR location LIKE '%Pune%') ORDER BY score DESC, ordinal LIMIT 30
""")
def q44_watch_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stored search tells of: title words, exclusions, countries, places."""
    w = watches.to_watch(parse_resume(RESUME, "markdown"), ["IN"], ["Pune"], None, ["intern"])
    return watches.match_watch(postings(spark, sf_dir), w, 30).select("id", "score")


_YEARS_TEXT = "[k || '+ years of hands-on experience', 'Experience: ' || k || '-' || (k + 4) || ' years', 'no numbers', 'Our company has ' || k || ' years of experience', 'minimum six to eight years', k || ' to ' || (k + 1) || '+ years of experience'][p_partkey % 6 + 1]"


@_query(f"""
WITH p AS (SELECT p_partkey, p_size AS k, p_partkey % 6 AS v FROM part),
e AS (SELECT *, CASE WHEN v IN (0, 1, 5) AND k <= 20 THEN k WHEN v = 4 THEN 6 END AS low, CASE WHEN v = 1 AND k <= 20 THEN k + 4 WHEN v = 5 AND k <= 20 THEN k + 1 WHEN v = 4 THEN 8 END AS high FROM p)
SELECT p_partkey, CAST(low AS DOUBLE) AS min_years, CAST(high AS DOUBLE) AS max_years, CASE WHEN low IS NULL THEN 'unstated' ELSE 'stated' END AS state,
       CASE WHEN low IS NULL THEN NULL WHEN high IS NULL THEN low || '+ yrs' ELSE low || '–' || high || CASE WHEN v = 5 THEN '+' ELSE '' END || ' yrs' END AS label,
       coalesce(7 >= low AND (high IS NULL OR v = 5 OR 7 <= high), false) AS fits
FROM e
""")
def q45_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated experience read out of texts: ranges, number words, employer history, open ends; states, labels, filter."""
    k, n = F.col("p_size"), lambda x: x.cast("string")
    said = [
        F.concat(n(k), F.lit("+ years of hands-on experience")), F.concat(F.lit("Experience: "), n(k), F.lit("-"), n(k + 4), F.lit(" years")), F.lit("no numbers"),
        F.concat(F.lit("Our company has "), n(k), F.lit(" years of experience")), F.lit("minimum six to eight years"), F.concat(n(k), F.lit(" to "), n(k + 1), F.lit("+ years of experience")),
    ]
    jobs = _t(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*said), (F.col("p_partkey") % 6 + 1).cast("int")).alias("description"), F.lit(None).cast("struct<min:double,max:double,max_open:boolean>").alias("experience"), F.lit("unread").alias("experience_state"), F.lit(None).cast("int").alias("experience_version"))
    e = F.col("experience")
    out = experience.with_experience(jobs)
    return out.select("p_partkey", e["min"].alias("min_years"), e["max"].alias("max_years"), F.col("experience_state").alias("state"), F.when(e.isNotNull(), experience.experience_label(e)).alias("label"), experience.experience_filter(e, 7.0, False).alias("fits"))


_GEO_PLACES = ["Berlin, DE", "Paris, France; Madrid, Spain", "Austin, TX", "Indianapolis, IN", "Pune, MH, India", "Remote", "Remote, APAC", "London, UK", "Tokyo, Japan", "Hybrid - Toronto, Canada", "US-IN-FT WAYNE-150A", "Bangalore"]
_GEO_TEXTS = ["", "Open to candidates in Germany or India.", "Not available in France.", "You will work in tandem with our India team", "hiring across EMEA", "excluding Spain. Work from Japan"]
_GEO = """
c(code, words, letters) AS (VALUES ('CA', 'Canada', 'CA'), ('DE', 'Germany', 'DE'), ('ES', 'Spain', 'ES'), ('FR', 'France', 'FR'), ('GB', 'United Kingdom|UK', 'GB|UK'), ('IN', 'India', 'IN'), ('JP', 'Japan', 'JP'), ('US', 'United States|USA', 'US'),
  ('MH', 'Marshall Islands', 'MH')),
named AS (SELECT d.k, code FROM d JOIN c ON regexp_matches(location, '(?i)\\b(' || words || ')\\b')),
lettered AS (SELECT d.k, code FROM d JOIN c ON regexp_matches(location, '(?i)(^|[,(/-]\\s*)(' || letters || ')\\s*($|[,)/-])') ANTI JOIN named USING (k, code)),
home AS (SELECT k, EXISTS (SELECT 1 FROM named WHERE named.k = d.k AND code = 'US') AS us, regexp_matches(location, '(?i)\\b(india|pune|bangalore)\\b') AS india,
  regexp_matches(location, ',\\s*(TX|IN|CA|DE)\\s*($|,)') OR regexp_matches(location, '^US-IN-') AS state, NOT EXISTS (SELECT 1 FROM named WHERE named.k = d.k) AS bare FROM d),
located AS (
  SELECT k, code FROM named UNION SELECT k, 'US' FROM home WHERE state AND bare AND NOT india
  UNION SELECT l.k, code FROM lettered l JOIN home h ON h.k = l.k WHERE NOT ((h.us OR (h.state AND h.bare AND NOT h.india)) AND code IN ('CA', 'DE', 'IN')) AND NOT (h.india AND code IN ('MH', 'IN'))
  UNION SELECT k, 'IN' FROM home WHERE india),
remote AS (SELECT * FROM d WHERE regexp_matches(location, '(?i)\\bremote\\b')),
opened AS (
  SELECT r.k, code FROM remote r JOIN c ON regexp_matches(description, '(?i)\\b(open to|hiring|candidates?|applicants?|eligible|remote (in|from)|based in|available (in|to))\\b.{0,80}\\b(' || words || ')\\b|\\bwork (in|from)\\s+(anywhere\\s+in\\s+)?(' || words || ')\\b')),
barred AS (SELECT d.k, code FROM d JOIN c ON regexp_matches(location || chr(10) || description, '(?i)\\b(not available|unavailable|excluding|except)\\b.{0,80}\\b(' || words || ')\\b')),
final AS (SELECT * FROM (SELECT * FROM located UNION SELECT * FROM opened) ANTI JOIN barred USING (k, code)),
regions AS (SELECT k, [CASE WHEN regexp_matches(location, '(?i)\\bAPAC\\b') THEN 'APAC' END, CASE WHEN regexp_matches(description, '(?i)hiring across EMEA') THEN 'EMEA' END] AS r FROM remote)
SELECT d.k, CASE WHEN remote.k IS NOT NULL THEN 'remote' WHEN lower(d.location) LIKE '%hybrid%' THEN 'hybrid' ELSE 'unknown' END AS work_mode,
       coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM final WHERE final.k = d.k), '') AS countries, coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM barred WHERE barred.k = d.k), '') AS excluded,
       coalesce(array_to_string(list_filter(regions.r, lambda x: x IS NOT NULL), ','), '') AS regions,
       CASE WHEN EXISTS (SELECT 1 FROM final WHERE final.k = d.k) THEN 'explicit' WHEN len(list_filter(regions.r, lambda x: x IS NOT NULL)) > 0 THEN 'inferred' ELSE 'unknown' END AS confidence
FROM d LEFT JOIN remote ON remote.k = d.k LEFT JOIN regions ON regions.k = d.k
"""


@_query(f"WITH d AS (SELECT p_partkey AS k, {_sql_list(_GEO_PLACES)}[p_partkey % 12 + 1] AS location, {_sql_list(_GEO_TEXTS)}[p_partkey // 12 % 6 + 1] AS description FROM part)," + _GEO)
def q46_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries, exclusions, regions, work mode and confidence of places and texts."""
    k = F.col("p_partkey")
    jobs = _t(spark, sf_dir, "part").select(k.alias("k"), _pick(_GEO_PLACES, k % 12).alias("location"), _pick(_GEO_TEXTS, F.floor(k / 12) % 6).alias("description"), F.lit("unknown").alias("work_mode"))
    joined = lambda c: F.array_join(c, ",")
    return geo.classify(jobs).select("k", "work_mode", joined("eligible_countries").alias("countries"), joined("excluded_countries").alias("excluded"), joined("eligible_regions").alias("regions"), F.col("eligibility_confidence").alias("confidence"))


_BOARDS = "['https://jobs.lever.co/Acme' || k || '/x', 'https://boards.greenhouse.io/acme' || k || '/jobs/1', 'https://acme' || k || '.recruitee.com/o/dev', 'https://acme' || k || '.wd1.myworkdayjobs.com/en-US/Site', 'https://apply.workable.com/acme' || k || '/', 'https://www.example.com/acme' || k, 'https://acme' || k || '.breezy.hr/p/1', 'https://jobs.smartrecruiters.com/Acme' || k || '/1']"


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    forms = [("https://jobs.lever.co/Acme", "/x"), ("https://boards.greenhouse.io/acme", "/jobs/1"), ("https://acme", ".recruitee.com/o/dev"), ("https://acme", ".wd1.myworkdayjobs.com/en-US/Site"), ("https://apply.workable.com/acme", "/"), ("https://www.example.com/acme", ""), ("https://acme", ".breezy.hr/p/1"), ("https://jobs.smartrecruiters.com/Acme", "/1")]
    said = F.array(*[F.concat(F.lit(a), k, F.lit(b)) for a, b in forms])
    return _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.element_at(said, (F.col("s_suppkey") % 8 + 1).cast("int")).alias("url"))


@_query(f"""
WITH s AS (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS k, s_suppkey % 8 AS v FROM supplier), u AS (SELECT *, {_BOARDS}[v + 1] AS url FROM s),
b AS (SELECT *, ['lever', 'greenhouse', 'recruitee', 'workday', 'workable', NULL, 'breezy', 'smartrecruiters'][v + 1] AS ats,
  ['Acme' || k, 'acme' || k, 'acme' || k, 'acme' || k || '.wd1.myworkdayjobs.com/acme' || k || '/Site', 'acme' || k, NULL, 'acme' || k, 'Acme' || k][v + 1] AS token FROM u)
SELECT s_suppkey, ats, token, ats || ':' || lower(token) AS source_key,
  ['https://jobs.lever.co/' || token, 'https://job-boards.greenhouse.io/' || token, 'https://' || token || '.recruitee.com', 'https://acme' || k || '.wd1.myworkdayjobs.com/en-US/Site', 'https://apply.workable.com/' || token || '/', NULL,
   'https://' || token || '.breezy.hr', 'https://jobs.smartrecruiters.com/' || token][v + 1] AS canonical, v = 5 AS owned,
  CASE v WHEN 0 THEN 'lever.co' WHEN 1 THEN 'greenhouse.io' WHEN 2 THEN 'recruitee.com' WHEN 3 THEN 'myworkdayjobs.com' WHEN 4 THEN 'workable.com' WHEN 5 THEN 'example.com' WHEN 6 THEN 'breezy.hr' ELSE 'smartrecruiters.com' END AS domain
FROM b
""")
def q47_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board addresses resolved to provider and token, keys, canonical addresses, domains."""
    u = F.col("url")
    b = _boards(spark, sf_dir).withColumn("board", urls.resolve(u))
    ats, token = F.col("board.ats"), F.col("board.token")
    key = F.when(ats.isNotNull(), urls.source_key(ats, token))
    return b.select("s_suppkey", ats.alias("ats"), token.alias("token"), key.alias("source_key"), urls.canonical_url(ats, token).alias("canonical"), urls.owned_by(u, F.lit("www.example.com")).alias("owned"), urls.registrable_domain(urls.host(u)).alias("domain"))


@_query("""
WITH RECURSIVE r AS (SELECT s_suppkey, ['lever', 'ashby'][s_suppkey % 2 + 1] AS ats, CASE WHEN s_suppkey % 5 = 4 THEN 'lever-b' || s_nationkey % 4 ELSE 'b' || s_nationkey % 4 END AS base, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier),
f(k, used, s_suppkey, slug) AS (
  SELECT 0::BIGINT, ['b1', 'ashby-b2'], NULL::BIGINT, NULL::VARCHAR
  UNION ALL SELECT x.k, CASE WHEN x.s IS NULL THEN x.used ELSE list_append(x.used, x.s) END, x.s_suppkey, x.s FROM (
    SELECT r.k, f.used, r.s_suppkey, CASE WHEN NOT list_contains(f.used, r.base) THEN r.base WHEN NOT list_contains(f.used, r.ats || '-' || r.base) THEN r.ats || '-' || r.base END AS s FROM f JOIN r ON r.k = f.k + 1) x)
SELECT s_suppkey, slug FROM f WHERE k > 0
""")
def q35_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs allocated one after the other; a base may be another row's second choice, and some are taken."""
    s = _t(spark, sf_dir, "supplier")
    group = F.concat(F.lit("b"), (F.col("s_nationkey") % 4).cast("string"))
    rows = s.select("s_suppkey", F.col("s_suppkey").alias("ordinal"), F.when(F.col("s_suppkey") % 2 == 0, "lever").otherwise("ashby").alias("ats"), F.when(F.col("s_suppkey") % 5 == 4, F.concat(F.lit("lever-"), group)).otherwise(group).alias("base"))
    return precedence.allocate_slugs(rows, spark.sql("SELECT explode(array('b1', 'ashby-b2')) AS slug")).select("s_suppkey", "slug")


@_query("""
WITH RECURSIVE r AS (SELECT s_suppkey, ['source|lever|t' || s_suppkey % 37, 'domain|d' || s_suppkey % 29, 'slug|s' || s_suppkey % 31] AS keys, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier),
f(k, used, s_suppkey, rejected) AS (
  SELECT 0::BIGINT, []::VARCHAR[], NULL::BIGINT, NULL::VARCHAR
  UNION ALL SELECT x.k, CASE WHEN x.hit IS NULL THEN list_concat(x.used, x.keys) ELSE x.used END, x.s_suppkey, 'duplicate_' || split_part(x.hit, '|', 1) FROM (
    SELECT r.k, f.used, r.keys, r.s_suppkey, list_filter(r.keys, lambda q: list_contains(f.used, q))[1] AS hit FROM f JOIN r ON r.k = f.k + 1) x)
SELECT s_suppkey, rejected FROM f WHERE k > 0
""")
def q36_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources kept unless an earlier kept one has their source, domain or slug; long chains of shared keys."""
    k = F.col("s_suppkey")
    part = lambda lead, n: F.concat(F.lit(lead), (k % n).cast("string"))
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", k.alias("ordinal"), F.lit("lever").alias("ats"), part("t", 37).alias("token"), part("d", 29).alias("company_domain"), part("s", 31).alias("slug"))
    return precedence.dedupe_verified(rows).select("s_suppkey", "rejected")


@_query("""
SELECT event_type, user_id % 7 AS u, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE user_id % 7 NOT IN (SELECT s_suppkey % 3 + 2 FROM supplier) AND CAST(json_extract(props, '$.k') AS BIGINT) NOT IN (SELECT s_suppkey % 3 + 2 FROM supplier)
""")
def q38_any_key_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows none of whose keys is known; equal rows stay as often as they are."""
    rows = _t(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("u"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    known = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 3 + 2).alias("key"))
    return precedence.any_key_semi(rows, known, F.array("u", "k"), F.array("key"), anti=True)


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leads: their matches, evidence and attempts follow from the key."""
    k = F.col("c_custkey")
    day = lambda n: F.timestamp_add("DAY", n, F.lit(datetime(2001, 1, 1)).cast("timestamp"))
    none = lambda t: F.array().cast(t)
    kinds = ["authoritative_dataset", "company_registry", "company_redirect", "provider_structured_domain"]
    kind = _pick(kinds, k % 4)
    match = F.struct(F.lit("A").alias("company_name"), F.lit("www.a.com").alias("company_domain"), F.lit("m").alias("method"), F.lit("r").alias("reference"))
    proof = F.struct(F.lit("A").alias("company_name"), F.when(k % 5 == 0, "b.com").otherwise("a.com").alias("company_domain"), kind.alias("kind"), F.lit("r").alias("reference"), day(F.lit(40)).alias("observed_at"))
    other = F.struct(F.lit("A").alias("company_name"), F.lit("c.com").alias("company_domain"), F.lit("company_page_link").alias("kind"), F.lit("r").alias("reference"), day(F.lit(40)).alias("observed_at"))
    outcome = F.when(k % 6 == 0, "permanent_failure").when(k % 6 == 1, "success").otherwise("transient_failure")
    one = lambda n, rank: F.struct(day(n).alias("attempted_at"), outcome.alias("outcome"), F.lit("identity_mismatch").alias("category"), F.lit("d").alias("detail"), F.when(k % 6 > 1, day(n + 200)).alias("next_eligible_at"), rank.cast("int").alias("evidence_rank"))
    tries = F.transform(F.sequence(F.lit(1), (k % 5).cast("int")), lambda n: one(n, F.lit(2)))
    return _t(spark, sf_dir, "customer").select(
        F.concat(F.lit("x:"), k.cast("string")).alias("source_key"), F.lit("u").alias("source_url"), F.when(k % 3 == 0, "lever").otherwise("greenhouse").alias("ats"), k.cast("string").alias("token"),
        none("array<struct<channel:string,reference:string>>").alias("discovered_from"), F.when(k % 7 == 0, none("array<struct<company_name:string,company_domain:string,method:string,reference:string>>")).otherwise(F.array(match)).alias("company_matches"),
        F.when(k % 8 == 0, none(registry.EVIDENCE)).when(k % 9 == 0, F.array(proof, other)).otherwise(F.array(proof)).alias("identity_evidence"),
        F.when(k % 5 == 0, none(registry.ATTEMPTS)).otherwise(tries).alias("attempts"), F.when(k % 2 == 0, F.lit(datetime(2001, 1, 1)).cast("timestamp")).alias("promoted_at"),
    )


_LEADS = """
l AS (SELECT c_custkey AS k, c_custkey % 3 = 0 AS strict, c_custkey % 7 <> 0 AS matched, [1, 2, 3, 4][c_custkey % 4 + 1] AS rank, CASE WHEN c_custkey % 5 = 0 THEN 'b.com' ELSE 'a.com' END AS domain, c_custkey % 8 <> 0 AS has, c_custkey % 8 <> 0 AND c_custkey % 9 = 0 AS two,
  c_custkey % 5 AS tries, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 6 = 0 THEN 'permanent_failure' WHEN c_custkey % 6 = 1 THEN 'success' ELSE 'transient_failure' END AS outcome, c_custkey % 2 = 0 AS promoted FROM customer),
e AS (SELECT *, CASE WHEN has AND (NOT strict OR rank >= 3) THEN rank ELSE 0 END AS q1, CASE WHEN two THEN 3 ELSE 0 END AS q2 FROM l),
w AS (SELECT *, greatest(q1, q2) AS top, list_distinct(list_filter([CASE WHEN q1 > 0 AND q1 = greatest(q1, q2) THEN domain END, CASE WHEN q2 > 0 AND q2 = greatest(q1, q2) THEN 'c.com' END], lambda x: x IS NOT NULL)) AS domains, promoted AND outcome = 'success' AS done,
  outcome = 'permanent_failure' AND NOT ((has AND rank > 2) OR two) AS dead FROM e),
s AS (SELECT *, CASE WHEN dead THEN 'rejected' WHEN NOT matched THEN CASE WHEN done THEN 'verified' ELSE 'unresolved' END WHEN top = 0 THEN CASE WHEN done THEN 'verified' ELSE 'matched' END
  WHEN len(domains) <> 1 OR domains[1] <> 'a.com' THEN 'rejected' WHEN done THEN 'verified' ELSE 'evidence_ready' END AS state,
  CASE WHEN tries = 0 THEN 'fresh' WHEN outcome <> 'transient_failure' THEN 'retryable' WHEN TIMESTAMP '2001-01-01' + to_days(CAST(tries + 200 AS INTEGER)) > TIMESTAMP '2001-07-22' THEN 'cooling_down' WHEN tries >= 3 THEN 'repeatedly_failing' ELSE 'retryable' END AS retry FROM w)
"""


@_query(f"WITH {_LEADS} SELECT 'state' AS kind, state AS name, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'retry', retry, count(*) FROM s GROUP BY 2")
def q48_lead_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived states and retry dispositions of leads."""
    return registry.state_histograms(_leads(spark, sf_dir), datetime(2001, 7, 22))


@_query(f"""WITH {_LEADS},
o AS (SELECT *, CASE k % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'transient_failure' WHEN 2 THEN 'permanent_failure' END AS new, CASE WHEN outcome = 'transient_failure' THEN tries ELSE 0 END AS failed FROM s)
SELECT 'x:' || k AS source_key, CAST(CASE WHEN new IS NULL THEN tries ELSE tries + 1 END AS INTEGER) AS attempts, CASE WHEN new = 'transient_failure' THEN CAST(least(604800, 60 * power(2, failed)) AS BIGINT) END AS wait_s,
       CASE WHEN new = 'permanent_failure' THEN CAST(greatest(CASE WHEN has THEN rank ELSE 0 END, CASE WHEN two THEN 3 ELSE 0 END) AS INTEGER) WHEN new IS NULL AND tries > 0 THEN 2 END AS evidence_rank,
       strftime(CASE WHEN new = 'success' THEN TIMESTAMP '2001-07-22' WHEN promoted THEN TIMESTAMP '2001-01-01' END, '%Y-%m-%d') AS promoted FROM o""")
def q49_record_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts appended to leads: promotion, back-off by the run of failures, the rank that was judged."""
    leads, now = _leads(spark, sf_dir), datetime(2001, 7, 22)
    k = F.col("token").cast("long")
    outcomes = leads.select("source_key", F.when(k % 4 == 0, "success").when(k % 4 == 1, "transient_failure").when(k % 4 == 2, "permanent_failure").alias("outcome"), F.lit("c").alias("category"), F.lit("d").alias("detail")).where("outcome IS NOT NULL")
    out = registry.record_outcomes(leads, outcomes, now)
    last = registry.latest_attempt()
    decided = F.coalesce(last["attempted_at"] == F.lit(now).cast("timestamp"), F.lit(False))
    wait = F.when(decided & (last["outcome"] == "transient_failure"), F.unix_seconds(last["next_eligible_at"]) - F.unix_seconds(F.lit(now).cast("timestamp")))
    return out.select("source_key", F.size("attempts").alias("attempts"), wait.alias("wait_s"), last["evidence_rank"].alias("evidence_rank"), F.date_format("promoted_at", "yyyy-MM-dd").alias("promoted"))


@_query("""
WITH a AS (SELECT 'k' || c_custkey % 50 AS key, 'n' || c_nationkey AS m, CAST(c_custkey AS VARCHAR) AS u FROM customer WHERE c_custkey < 900),
b AS (SELECT 'k' || s_suppkey % 70 AS key, 'n' || s_nationkey AS m, 'z' || s_suppkey AS u FROM supplier),
x AS (SELECT key, m FROM a UNION SELECT key, m FROM b)
SELECT key AS source_key, array_to_string(list_sort(list(DISTINCT x.m)), ',') AS matches, coalesce((SELECT min(u) FROM a WHERE a.key = x.key), (SELECT min(u) FROM b WHERE b.key = x.key)) AS url FROM x GROUP BY key
""")
def q50_merge_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry upsert with keys that stand many times in the additions: one lead a key, facts united, the first address kept."""
    customer, supplier = _t(spark, sf_dir, "customer").where("c_custkey < 900"), _t(spark, sf_dir, "supplier")
    cast = lambda c: F.col(c).cast("string")

    def leads(rows: DataFrame, key: Column, nation: str, url: Column) -> DataFrame:
        match = F.struct(F.concat(F.lit("n"), cast(nation)).alias("company_name"), F.lit("d").alias("company_domain"), F.lit("m").alias("method"), F.lit("r").alias("reference"))
        none = lambda t: F.array().cast(t)
        return rows.select(key.alias("source_key"), url.alias("source_url"), F.lit("lever").alias("ats"), F.lit("t").alias("token"), none("array<struct<channel:string,reference:string>>").alias("discovered_from"), F.array(match).alias("company_matches"), none(registry.EVIDENCE).alias("identity_evidence"), none(registry.ATTEMPTS).alias("attempts"), F.lit(None).cast("timestamp").alias("promoted_at"))

    old = registry.united_additions(leads(customer, F.concat(F.lit("k"), (F.col("c_custkey") % 50).cast("string")), "c_nationkey", cast("c_custkey")))
    new = leads(supplier, F.concat(F.lit("k"), (F.col("s_suppkey") % 70).cast("string")), "s_nationkey", F.concat(F.lit("z"), cast("s_suppkey")))
    return registry.merge_leads(old, new).select("source_key", F.array_join(F.array_sort(F.transform("company_matches", lambda m: m["company_name"])), ",").alias("matches"), F.col("source_url").alias("url"))


@_query("""
WITH c AS (SELECT s_suppkey AS k, ['Acme', '', 'Beta Inc', 'Gamma'][s_suppkey % 4 + 1] AS name, ['acme.com', 'x.com', 'beta.io', 'other.org'][s_suppkey % 4 + 1] AS domain, CASE WHEN s_suppkey % 8 = 5 THEN 'https://www.example.com' ELSE 'https://jobs.lever.co/' || ['acme', 'x', 'betalabs', 'delta'][s_suppkey % 4 + 1] || s_suppkey END AS url,
  s_suppkey % 3 <> 0 AS up, s_nationkey % 2 = 0 AS open FROM supplier),
r AS (SELECT k, CASE WHEN trim(name) = '' THEN 'invalid_candidate' WHEN url LIKE '%example%' THEN 'unsupported_source' WHEN NOT up THEN 'probe_failed' WHEN name = 'Gamma' THEN 'identity_mismatch' WHEN NOT open THEN 'no_country_jobs' ELSE 'verified' END AS reason FROM c)
SELECT reason, count(*) AS n FROM r GROUP BY 1
""")
def q51_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates through validation, resolution, probe, identity and country gate; the funnel in numbers."""
    s, k = _t(spark, sf_dir, "supplier"), F.col("s_suppkey")
    pick = lambda values: _pick(values, k % 4)
    url = F.when(k % 8 == 5, "https://www.example.com").otherwise(F.concat(F.lit("https://jobs.lever.co/"), pick(["acme", "x", "betalabs", "delta"]), k.cast("string")))
    candidates = s.select("s_nationkey", k.alias("ordinal"), pick(["Acme", "", "Beta Inc", "Gamma"]).alias("company_name"), pick(["acme.com", "x.com", "beta.io", "other.org"]).alias("company_domain"), F.lit(None).cast("string").alias("slug"), url.alias("source_url"), F.lit("community").alias("channel"), F.lit("r").alias("reference"))
    keyed = candidates.withColumn("board", urls.resolve(F.col("source_url"))).where("board IS NOT NULL").withColumn("source_key", urls.source_key(F.col("board.ats"), F.col("board.token")))
    probes = keyed.select("source_key", F.when(F.col("ordinal") % 3 != 0, 200).otherwise(404).alias("status"), F.lit("").alias("observed_name"))
    none = F.array().cast("array<string>")
    jobs = keyed.select("source_key", F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("IN"))).otherwise(none).alias("eligible_countries"), none.alias("excluded_countries"), none.alias("eligible_regions"))
    return verification.report(verification.verify(candidates.drop("s_nationkey"), probes, jobs, "IN"))


@_query("""
WITH c AS (SELECT s_suppkey AS k, 'lever:acme' || s_suppkey AS key, s_suppkey % 3 = 0 AS accepted FROM supplier), cat AS (SELECT 'lever' AS ats, 'Acme' || c_custkey AS token, 'd' || c_custkey % 5 AS domain FROM customer WHERE c_custkey % 2 = 0)
SELECT 'promoted' AS kind, count(*) AS n, min(k) AS first FROM c JOIN cat ON lower(token) = 'acme' || k AND 'd' || k % 5 = domain
UNION ALL SELECT 'deduped', count(*), sum(first)::BIGINT FROM (SELECT k % 10 AS g, arg_min(k, (NOT accepted, k)) AS first FROM c GROUP BY 1)
UNION ALL SELECT 'ordered', 10, (SELECT sum(k * p)::BIGINT FROM (SELECT k, row_number() OVER (ORDER BY CASE WHEN k % 4 = 0 THEN NULL ELSE k % 4 END NULLS FIRST, k % 2, CASE WHEN k % 2 = 1 THEN k % 3 END NULLS FIRST, k) AS p FROM c) WHERE p <= 10)
""")
def q52_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are promoted, one row a source, the order of verification."""
    s, k = _t(spark, sf_dir, "supplier"), F.col("s_suppkey")
    n = lambda c: c.cast("string")
    cand = s.select(k.alias("ordinal"), F.concat(F.lit("lever:acme"), n(k)).alias("source_key"), F.concat(F.lit("https://jobs.lever.co/acme"), n(k)).alias("source_url"), F.concat(F.lit("D"), n(k % 5)).alias("company_domain"), (k % 3 == 0).alias("accepted"))
    c = F.col("c_custkey")
    catalog = _t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.lit("lever").alias("ats"), F.concat(F.lit("Acme"), n(c)).alias("token"), F.concat(F.lit("d"), n(c % 5)).alias("company_domain"))
    total = lambda kind, df, first: df.agg(F.count(F.lit(1)).alias("n"), first.cast("long").alias("first")).select(F.lit(kind).alias("kind"), "n", "first")
    once = verification.dedupe_discovered(cand.withColumn("source_key", n(F.col("ordinal") % 10)))
    attempts = cand.where("ordinal % 4 <> 0").select("source_key", F.timestamp_seconds(F.col("ordinal") % 4).alias("attempted_at"))
    known = cand.where("ordinal % 2 = 1").select("source_key", F.timestamp_seconds(F.col("ordinal") % 3).alias("checked_at"))
    first = verification.verification_order(cand, attempts, known, 10)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_first("attempted_at"), "known", F.asc_nulls_first("checked_at"), "ordinal"))
    ordered = first.withColumn("p", place)
    return coverage.union_all([total("promoted", verification.promoted(cand, catalog), F.min("ordinal")), total("deduped", once, F.sum("ordinal")), total("ordered", ordered, F.sum(F.col("ordinal") * F.col("p")))])


@_query(f"""
WITH {POSTINGS}, cat AS (SELECT 's' || k AS slug, k, 'd' || k % 7 AS domain FROM range(0, 45) AS t(k)), held AS (SELECT DISTINCT source_slug FROM j),
x(country, ok) AS (VALUES ('IN', 1), ('DE', 2), ('JP', 3), ('FR', 4)),
o AS (SELECT x.country, n.source_slug, id FROM n JOIN x ON CASE ok WHEN 1 THEN in_open WHEN 2 THEN list_contains(countries, 'DE') WHEN 3 THEN pl = 5 ELSE list_contains(countries, 'FR') END)
SELECT 'country:' || x.country AS section, count(DISTINCT source_slug)::BIGINT AS a, count(id) AS b, count(DISTINCT domain)::BIGINT AS c FROM x LEFT JOIN (o JOIN cat ON slug = source_slug) ON x.country = o.country GROUP BY 1
UNION ALL SELECT 'never_indexed', count(*), 0, 0 FROM cat WHERE slug NOT IN (SELECT source_slug FROM held)
UNION ALL SELECT 'confidence:' || CASE WHEN len(countries) > 0 THEN 'explicit' WHEN pl = 5 THEN 'inferred' ELSE 'unknown' END, count(*), 0, 0 FROM j GROUP BY 1
UNION ALL SELECT 'delta', 0, (SELECT count(*) FROM j WHERE ordinal % 3 = 0), (SELECT count(*) FROM n WHERE in_open AND ordinal % 3 = 0)
""")
def q53_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of countries (none of them dropped), sources never indexed, confidence, and what a run adds."""
    jobs = postings(spark, sf_dir)
    catalog = spark.range(45).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source_slug"), F.concat(F.lit("www.d"), (F.col("id") % 7).cast("string")).alias("company_domain"), F.lit("lever").alias("ats"), F.lit("t").alias("token"), F.lit(None).cast("string").alias("domain_evidence_kind"))
    zero = F.lit(0).cast("long")
    by_country = coverage.country_coverage(jobs, catalog, ["IN", "DE", "JP", "FR"]).select(F.concat(F.lit("country:"), F.col("country")).alias("section"), F.col("sources").alias("a"), F.col("jobs").alias("b"), F.col("employers").alias("c"))
    never, _ = coverage.covered_keys(catalog, jobs.select("source_slug"), "source_slug")
    held = jobs.groupBy("eligibility_confidence").agg(F.count(F.lit(1)).alias("a"))
    delta = coverage.metrics_delta(coverage.corpus_metrics(catalog, jobs.where("ordinal % 3 <> 0"), "IN"), coverage.corpus_metrics(catalog, jobs, "IN"))
    return coverage.union_all([
        by_country, never.agg(F.count(F.lit(1)).alias("a")).select(F.lit("never_indexed").alias("section"), "a", zero.alias("b"), zero.alias("c")),
        held.select(F.concat(F.lit("confidence:"), F.col("eligibility_confidence")).alias("section"), "a", zero.alias("b"), zero.alias("c")), delta.select(F.lit("delta").alias("section"), F.col("companies").alias("a"), F.col("jobs").alias("b"), F.col("country_jobs").alias("c")),
    ])


@_query(f"""
WITH {POSTINGS}
SELECT 'city' AS kind, CASE WHEN pl = 0 THEN 'pune' ELSE 'other_or_unspecified' END AS name, count(*) AS n FROM j GROUP BY 2
UNION ALL SELECT 'title', unnest(list_filter([CASE WHEN ti = 0 THEN 'backend' END, CASE WHEN ti = 4 THEN 'frontend' END, CASE WHEN ti IN (1, 7) THEN 'data' END, CASE WHEN ti IN (2, 3, 5, 6) THEN 'other' END], lambda x: x IS NOT NULL)), count(*) FROM j GROUP BY 2
UNION ALL SELECT 'signal', CASE WHEN len(countries) > 0 THEN countries[1] ELSE '(unclassified)' END, count(*) FROM j WHERE ti = 6 GROUP BY 2
UNION ALL SELECT 'exact', CASE WHEN len(countries) > 0 THEN countries[1] ELSE '(unclassified)' END, count(*) FROM j WHERE ti = 6 GROUP BY 2
""")
def q54_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City and title buckets of an audit, and a title signal by country."""
    jobs = postings(spark, sf_dir)
    count = lambda df, kind, name: df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    signal = audit.signal_countries(jobs.withColumn("title", F.when(F.col("title") == "Chef", "  GTM   engineer ").otherwise(F.col("title"))))
    return coverage.union_all([
        count(jobs, "city", audit.city_bucket(F.col("location"))), count(jobs.select(F.explode(audit.title_buckets(F.col("title"))).alias("b")), "title", F.col("b")),
        signal.select(F.lit("signal").alias("kind"), F.col("country").alias("name"), F.col("jobs").alias("n")), signal.select(F.lit("exact").alias("kind"), F.col("country").alias("name"), F.col("exact_titles").alias("n")),
    ])


@_query("""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9+#.]+') AS w FROM documents)
SELECT doc_id, round((CAST(list_contains(w, 'the') AS INTEGER) + CAST(list_contains(w, 'und') AS INTEGER) + CAST(list_contains(w, 'les') AS INTEGER)) / 3.0, 6) AS overlap,
       CAST(len(regexp_extract_all(replace(lower(coalesce(text, '')), 'the', 'the the'), '(^|[^a-z0-9+#])zzzq($|[^a-z0-9+#])')) AS BIGINT) AS none FROM documents JOIN t USING (doc_id) WHERE doc_id IS NOT NULL
""")
def q55_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a title's tokens in whole texts; generic words do not count."""
    docs = _t(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    body = F.coalesce("text", F.lit(""))
    folded = F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select("doc_id", F.round(text.token_overlap("The und engineer les", folded), 6).alias("overlap"), text.count_phrase(body, "zzzq").cast("long").alias("none"))


_AGO = ["Posted Today", "Posted Yesterday", "Posted 3 Days Ago", "Posted 30+ Days Ago", "soon"]
_PORTAL = ["Posted within last 24 hours", "Posted 2 days ago", "2 weeks ago", "Posted more than 1 month ago", "Posted 1 month ago", "?"]
_WRITTEN = ["2026-08-01", "2026-08-01T10:00:00.500Z", "Wed, 02 Oct 2024 13:00:00 GMT", "x", "August 3, 2026"]


@_query(f"""
SELECT p_partkey, strftime([DATE '2001-06-01', DATE '2001-05-31', DATE '2001-05-29', DATE '2001-05-01', NULL][p_partkey % 5 + 1], '%Y-%m-%d') AS listed, strftime(TIMESTAMP '2001-06-01' - to_days([0, 2, 14, 45, 30, NULL][p_partkey % 6 + 1]), '%Y-%m-%d') AS portal,
       CAST([epoch_ms(TIMESTAMP '2026-08-01'), epoch_ms(TIMESTAMP '2026-08-01 10:00:00.5'), epoch_ms(TIMESTAMP '2024-10-02 13:00:00'), NULL, epoch_ms(TIMESTAMP '2026-08-03')][p_partkey % 5 + 1] AS BIGINT) AS written,
       CAST(least(604800, 60 * power(2, p_size - 1)) AS BIGINT) AS wait_s, p_size IN (429, 502, 503, 504, 520) AS transient, p_size > 9 AS newer FROM part
""")
def q56_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative labels, lenient timestamps, back-off, versions."""
    k = F.col("p_partkey")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    version = F.concat(F.lit("v1."), F.col("p_size").cast("string"))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", day(dates.relative_date(_pick(_AGO, k % 5), NOW)).alias("listed"), day(dates.relative_timestamp(_pick(_PORTAL, k % 6), NOW)).alias("portal"), F.unix_millis(dates.lenient_timestamp(_pick(_WRITTEN, k % 5))).alias("written"),
        dates.lead_backoff_seconds(F.col("p_size")).cast("long").alias("wait_s"), dates.is_transient(F.col("p_size")).alias("transient"), dates.newer_version(version, F.lit("1.9.0")).alias("newer"),
    )


@_query(f"""
WITH {POSTINGS},
k AS (SELECT source_slug, max(posted) AS fetched FROM j GROUP BY 1), x AS (SELECT max(posted) - INTERVAL 10 DAY AS cut FROM j)
SELECT 'due' AS kind, count(*) AS n, coalesce(count(DISTINCT source_slug), 0) AS m FROM k, x WHERE fetched IS NULL OR fetched <= cut
UNION ALL SELECT 'budget', count(*), count(DISTINCT source_slug) FROM (SELECT source_slug, row_number() OVER (PARTITION BY source_slug ORDER BY CASE WHEN list_contains(countries, 'DE') THEN 1 WHEN list_contains(countries, 'FR') THEN 2 ELSE 3 END, ordinal) AS t FROM n WHERE tx = 6 AND coalesce(ms <= 30 * 86400000::BIGINT, false)) WHERE t <= 2
UNION ALL SELECT 'carried', count(*), count(*) FILTER (tx <> 6) FROM j WHERE tx <> 6 OR ordinal % 2 = 0
UNION ALL SELECT 'run', count(*), count(DISTINCT user_id) FROM events WHERE event_type = 'error'
UNION ALL SELECT 'batch', max(b) + 1, count(*) FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 700 AS b FROM orders)
""")
def q57_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl does next and keeps: due sources, the description budget, carried experience, a run's totals, batches."""
    jobs = postings(spark, sf_dir)
    count = lambda kind, df, m: df.agg(F.count(F.lit(1)).alias("n"), m.cast("long").alias("m")).select(F.lit(kind).alias("kind"), "n", "m")
    parts = jobs.groupBy("source_slug").agg(F.max("updated_at").alias("fetched_at"))
    due = parts.where(state.crawl_due(parts, "fetched_at", _latest(jobs, "updated_at", 10)))
    budget = state.describe_budget(jobs, ["DE", "FR"], NOW, 2)
    read = experience.with_experience(jobs)
    before = jobs.where("ordinal % 2 = 0").withColumns({"experience": F.struct(F.lit(1.0).alias("min"), F.lit(None).cast("double").alias("max"), F.lit(False).alias("max_open")), "experience_state": F.lit("stated"), "experience_version": F.lit(2)})
    carried = state.carry_experience(read, before).where("experience_state <> 'unread'")
    attempts = _t(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"), F.lit(200).alias("status"), F.lit(0).alias("backoff_ms")).where("outcome = 'failure'")
    run = state.crawl_report(attempts, 10, 5).select(F.lit("run").alias("kind"), F.col("attempts").alias("n"), F.col("selected").alias("m"))
    dealt = precedence.batches(_t(spark, sf_dir, "orders"), "o_orderkey", 700).agg((F.max("batch") + 1).alias("n"), F.count(F.lit(1)).alias("m")).select(F.lit("batch").alias("kind"), "n", "m")
    return coverage.union_all([count("due", due, F.count_distinct("source_slug")), count("budget", budget, F.count_distinct("source_slug")), count("carried", carried, F.count_if(F.trim("description") != "")), run, dealt])


_TERMS = [("Must have Java and Kafka.", "Java,Kafka"), ("Required: go-to-market", ""), ("JavaScript is required but Python is optional", "JavaScript"), ("<h3>Requirements</h3><ul><li>Kafka</li></ul><h3>Nice to have</h3><li>must know Redis</li>", "Kafka"), ("Must have CI/CD, large language models", "CI/CD,LLM"), ("Required Spring 2026 internship", ""), ("Must know Java, Spring Boot and Go", "Java,Go,Spring Boot")]


@_query(f"WITH t(v, terms) AS (VALUES {', '.join(f'({n}, {chr(39)}{want}{chr(39)})' for n, (_, want) in enumerate(_TERMS))}) SELECT terms, count(*) AS n, min(p_partkey) AS first FROM part JOIN t ON v = p_partkey % {len(_TERMS)} GROUP BY 1")
def q58_requirement_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in clauses that require: headings, polarity, masked idioms, the longest first."""
    said = _t(spark, sf_dir, "part").select("p_partkey", F.array_join(requirements.requirements_udf(_pick([t for t, _ in _TERMS], F.col("p_partkey") % len(_TERMS))), ",").alias("terms"))
    return said.groupBy("terms").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@_query(f"""
WITH {POSTINGS}
SELECT 'p' || ordinal AS identifier, title, company, 'City ' || pl || ', IN' AS location, ordinal % 4 = 0 AS remote, 'https://acme.com/j/' || ordinal AS url, 'a & b ' || ordinal AS description FROM j WHERE ordinal % 5 <> 0
""")
def q59_structured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job postings out of pages with structured data: graphs, broken blocks, entities, addresses, relative links."""
    jobs, k = postings(spark, sf_dir), F.col("ordinal").cast("string")
    place = (F.substring_index(F.substring_index("id", ":", 2), ":", -1).cast("long") % len(PLACES)).cast("string")
    node = F.to_json(F.struct(
        F.when(F.col("ordinal") % 5 == 0, "Thing").otherwise("JobPosting").alias("@type"), F.concat(F.lit(" "), F.col("title")).alias("title"), F.struct(F.concat(F.lit("p"), k).alias("value")).alias("identifier"),
        F.struct(F.col("company").alias("name")).alias("hiringOrganization"), F.array(F.struct(F.struct(F.concat(F.lit("City "), place).alias("addressLocality"), F.lit("IN").alias("addressCountry")).alias("address"))).alias("jobLocation"),
        F.when(F.col("ordinal") % 4 == 0, "TELECOMMUTE").alias("jobLocationType"), F.concat(F.lit("<p>a &amp; b "), k, F.lit("</p>")).alias("description"), F.concat(F.lit("/j/"), k).alias("url"),
    ))
    page = F.concat(F.lit('<html><script type="application/ld+json">{"@graph":['), node, F.lit("]}</script><script type='application/ld+json'>{broken</script></html>"))
    found = jobs.select(F.explode(html.extract_postings(page, F.lit("https://acme.com/jobs"))).alias("p"))
    return found.select("p.identifier", "p.title", "p.company", "p.location", "p.remote", "p.url", "p.description")


@_query("""
SELECT p_partkey, ['a' || chr(10) || 'b <' || chr(10) || ' c', 'A & B – C', '&#43; +  …', 'x' || chr(10) || chr(10) || 'y'][p_partkey % 4 + 1] AS plain FROM part
""")
def q61_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends of blocks, tags out, entities decoded once."""
    said = ["<ul><li>a</li><li>b &lt;</li></ul> c", "<b>A &amp; B</b> &ndash; C ", "&amp;#43; &#43; &nbsp;&hellip;", "<p>x</p><br/><br><div>\n\ny</div>"]
    return _t(spark, sf_dir, "part").select("p_partkey", html.plain_text(_pick(said, F.col("p_partkey") % 4)).alias("plain"))


@_query("""
WITH m AS (SELECT s_suppkey AS k, 't' || s_suppkey % 30 AS token, 'd' || s_nationkey % 6 AS domain FROM supplier)
SELECT token, CASE WHEN count(DISTINCT domain) = 1 THEN min(domain) END AS domain, CASE WHEN count(DISTINCT domain) > 1 THEN 'quarantined' WHEN min(domain) IN ('d0', 'd1') THEN 'excluded' ELSE 'matched' END AS state FROM m GROUP BY 1
""")
def q62_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with one domain, several, or a known one."""
    s = _t(spark, sf_dir, "supplier")
    rows = s.select(F.concat(F.lit("t"), (F.col("s_suppkey") % 30).cast("string")).alias("token"), F.concat(F.lit("www.D"), (F.col("s_nationkey") % 6).cast("string")).alias("domain"))
    return registry.identities_per_token(rows, spark.sql("SELECT explode(array('d0', 'www.d1')) AS domain"))


@_query("""
WITH b AS (SELECT c_custkey AS k, ['lever', 'other', 'ashby'][c_custkey % 3 + 1] AS ats, CASE WHEN c_custkey % 7 = 0 THEN 'demo' || (10000 + c_custkey) WHEN c_custkey % 7 = 1 THEN 'xkcdqwrt' || chr(112 + CAST(c_custkey % 20 // 4 AS INTEGER)) ELSE 'Acme' || c_custkey % 100 END AS token FROM customer),
f AS (SELECT CASE WHEN ats = 'other' THEN 'unsupported' WHEN ats || ':' || lower(token) IN (SELECT 'lever:acme' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0) THEN 'excluded' WHEN ats || ':' || lower(token) IN (SELECT 'ashby:acme' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 0) THEN 'in_catalog'
  WHEN k % 7 IN (0, 1) THEN 'test_board' WHEN k % 11 = 0 THEN 'cooling_down' ELSE '(probed)' END AS skip FROM b)
SELECT skip, count(*) AS n FROM f GROUP BY 1
""")
def q63_board_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why boards are skipped, by the first rule that holds."""
    k, n = F.col("c_custkey"), lambda c: c.cast("string")
    token = F.when(k % 7 == 0, F.concat(F.lit("demo"), n(10000 + k))).when(k % 7 == 1, F.concat(F.lit("xkcdqwrt"), F.char(112 + F.floor(k % 20 / 4)))).otherwise(F.concat(F.lit("Acme"), n(k % 100)))
    at = F.lit(datetime(2001, 5, 31, 12)).cast("timestamp")
    attempt = F.struct(at.alias("attempted_at"), F.lit("transient_failure").alias("outcome"), F.lit("c").alias("category"), F.lit("d").alias("detail"), F.lit(None).cast("timestamp").alias("next_eligible_at"), F.lit(0).alias("evidence_rank"))
    boards = _t(spark, sf_dir, "customer").select(_pick(["lever", "other", "ashby"], k % 3).alias("ats"), token.alias("token"), F.when(k % 11 == 0, F.array(attempt)).otherwise(F.array().cast(registry.ATTEMPTS)).alias("attempts"))
    s = _t(spark, sf_dir, "supplier")
    excluded = s.where("s_suppkey % 4 = 0").select(F.concat(F.lit("Lever:Acme"), n(F.col("s_suppkey"))).alias("key"))
    catalog = s.where("s_suppkey % 5 = 0").select(F.lit("ashby").alias("ats"), F.concat(F.lit("ACME"), n(F.col("s_suppkey"))).alias("token"))
    out = registry.board_funnel(boards, ["lever", "ashby"], excluded, catalog, NOW)
    return out.groupBy(F.coalesce("skip", F.lit("(probed)")).alias("skip")).agg(F.count(F.lit(1)).alias("n"))


@_query("""
WITH o AS (SELECT 'b' || user_id AS key, event_type AS q FROM events), b AS (SELECT DISTINCT 'b' || user_id AS key FROM events)
SELECT 'pairs' AS kind, count(*) AS a, count(DISTINCT key) AS b, 0 AS c FROM (SELECT DISTINCT key, 'i' || (length(q) % 3) AS i FROM o WHERE q <> 'view')
UNION ALL SELECT 'campaign', count(*), count(*) FILTER (key IN (SELECT 'b' || s_suppkey FROM supplier)), count(*) FILTER (key NOT IN (SELECT 'b' || s_suppkey FROM supplier)) FROM b
UNION ALL SELECT 'sites', count(*), count(*) FILTER (s_suppkey % 4 > 0), sum(s_suppkey % 4)::BIGINT FROM supplier
UNION ALL SELECT 'manifest', count(*), sum(n)::BIGINT, 0 FROM (SELECT o_custkey % 40, count(*) AS n FROM orders GROUP BY 1)
""")
def q64_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards by index and query, campaign totals, site yield, the manifest of an export."""
    e, s = _t(spark, sf_dir, "events"), _t(spark, sf_dir, "supplier")
    key = lambda c: F.concat(F.lit("b"), F.col(c).cast("string"))
    boards = e.select(key("user_id").alias("key")).distinct()
    origins = e.select(key("user_id").alias("board_key"), F.col("event_type").alias("query_id"))
    queries = e.select(F.col("event_type").alias("id")).distinct().where("id <> 'view'").withColumn("index_id", F.concat(F.lit("i"), (F.length("id") % 3).cast("string")))
    pairs = verification.board_origins(boards, origins, queries)
    campaign = verification.campaign_totals(boards, s.select(key("s_suppkey").alias("key")), 1, 0)
    n = (F.col("s_suppkey") % 4).alias("postings")
    sites, _ = verification.site_yield(s.select(key("s_suppkey").alias("domain"), F.lit("u").alias("career_url"), F.lit(False).alias("robots_blocked"), F.lit(1).alias("pages_fetched"), n, F.lit(0).alias("with_date"), F.lit(0).alias("with_identifier"), F.lit(0).alias("country_postings")))
    manifest = snapshots.export_manifest(postings(spark, sf_dir))
    zero = F.lit(0)
    return coverage.union_all([
        pairs.agg(F.count(F.lit(1)).alias("a"), F.count_distinct("key").alias("b")).select(F.lit("pairs").alias("kind"), "a", "b", zero.cast("long").alias("c")),
        campaign.select(F.lit("campaign").alias("kind"), F.col("boards").alias("a"), F.col("known_boards").alias("b"), F.col("new_board_leads").alias("c")),
        sites.select(F.lit("sites").alias("kind"), F.col("checked").alias("a"), F.col("with_postings").alias("b"), F.col("postings").alias("c")),
        manifest.agg(F.count(F.lit(1)).alias("a"), F.sum("jobs").alias("b")).select(F.lit("manifest").alias("kind"), "a", "b", zero.cast("long").alias("c")),
    ])


# One posting a provider, ``{k}`` the supplier's key: token, recorded body, and the row that it must become.
_PAYLOADS = [
    ("greenhouse", "tok", '{"jobs":[{"id":{k},"title":"Dev {k}","location":{"name":"Pune, India"},"absolute_url":"https://x/1","updated_at":"2026-08-30T10:00:00Z","content":"<p>a &amp;amp; b</p><p>c</p>"}]}', "{k}", "Pune, India", "unknown", "2026-08-30", "IN", "a &amp; b\n\nc"),
    ("lever", "tok", '[{"id":"a{k}","text":"Dev {k}","categories":{"location":"Remote - US"},"workplaceType":"remote","hostedUrl":"u","createdAt":1756684800000,"descriptionPlain":" d ","lists":[{"text":"Req","content":"<li>Java</li>"}],"additionalPlain":"more"}]', "a{k}", "Remote - US", "remote", "2025-09-01", "US", "d\n\nReq\nJava\n\nmore"),
    ("ashby", "tok", '{"jobs":[{"id":"b{k}","title":"Dev {k}","location":"Berlin, Germany","isRemote":false,"jobUrl":"u","publishedAt":"2026-08-01T00:00:00.000+00:00"}]}', "b{k}", "Berlin, Germany", "unknown", "2026-08-01", "DE", ""),
    ("recruitee", "tok", '{"offers":[{"guid":"g{k}","title":"T","city":"Paris","country_code":"fr","hybrid":true,"careers_url":"u","published_at":"2026-08-01 10:00:00 UTC","translations":{"fr":{"title":"F"},"en":{"title":"Dev {k}","description":"<p>x</p>"}}}]}', "g{k}", "Paris, FR", "hybrid", "2026-08-01", "FR", "x"),
    ("workday", "h.wd1.myworkdayjobs.com/t/Site", '{"jobPostings":[{"title":"Dev {k}","externalPath":"/job/P/Dev_R-{k}","locationsText":"Pune, India","postedOn":"Posted 3 Days Ago","bulletFields":["R-{k}"]},{"title":"Dev","externalPath":"/job/P/Dev_R-{k}"},{"title":"none"}]}', "R-{k}", "Pune, India", "unknown", "2001-05-29", "IN", ""),
    ("smartrecruiters", "tok", '{"content":[{"id":"{k}","name":"Dev {k}","releasedDate":"2026-08-01","location":{"city":"Pune","country":"in","remote":true}}]}', "{k}", "Pune, India", "remote", "2026-08-01", "IN", ""),
    ("workable", "tok", '{"jobs":[{"shortcode":"S{k}","title":"Dev {k}","city":"Rome","locations":[{"country":"Italy"}]}]}', "S{k}", "Rome, Italy", "unknown", None, "IT", ""),
    ("breezy", "tok", '[{"id":"{k}","name":"Dev {k}","location":{"city":"Oslo","country":{"name":"Norway"}},"description":"<div>a</div>b"}]', "{k}", "Oslo, Norway", "unknown", None, "NO", "a\nb"),
    ("freshteam", "tok", '{"jobs":[{"id":2,"deleted":true,"title":"X"},{"id":"{k}","title":"Dev {k}","branch_id":7,"remote":false}],"branches":[{"id":7,"city":"Chennai","country_code":"IN"}]}', "{k}", "Chennai, India", "unknown", None, "IN", ""),
    ("oraclecloud", "h.fa.x.oraclecloud.com/CX_1", '{"items":[{"requisitionList":[{"Id":"{k}","Title":"Dev {k}","PrimaryLocation":"Austin, TX","PrimaryLocationCountry":"US","PostedDate":"2026-08-20","secondaryLocations":[{"Name":"Pune"}]}]}]}', "{k}", "Austin, TX; Pune, United States", "unknown", "2026-08-20", "IN,US", ""),
    ("keka", "t/org", '[{"id":"{k}","title":"Dev {k}","jobType":3,"jobLocations":[{"city":"Delhi","countryCode":"IN"}],"description":"x"}]', "{k}", "Delhi, India", "remote", None, "IN", "x"),
    ("accenture", "in-en", '{"data":[{"requisitionId":"{k}","title":"Dev {k}","location":["Pune"],"postedDateText":"Posted 2 weeks ago","mustHaveSkills":"Java","jobDetailUrl":"https://a/{0}/x"}]}', "{k}", "Pune, India", "unknown", "2001-05-18", "IN", "Must have skills: Java"),
    ("infosys", "1", '[{"postingId":"{k}","postingTitle":"Dev {k}","location":"PUNE","createdOn":"2026-08-01T01:00:00","rolesResponsibilities":"<p>a</p>"}]', "{k}", "Pune, India", "unknown", "2026-07-31", "IN", "a"),
    ("capgemini", "in-en", '{"data":[{"id":"{k}","ref":"r","source":"S","title":"Dev {k}","location":"Pune","updated_at":"2026-08-01T00:00:00Z","description":"<p>d</p>"}]}', "{k}", "Pune, India", "unknown", "2026-08-01", "IN", "d"),
    ("amazon", "USA", '{"jobs":[{"id":"{k}","title":"Dev {k}","city":"Seattle","state":"WA","country_code":"USA","posted_date":"August  3, 2026","job_path":"/p","basic_qualifications":"q"}]}', "{k}", "Seattle, WA, United States", "unknown", "2026-08-03", "US", "Basic qualifications:\nq"),
    ("zohorecruit", "t.zohorecruit.com", '<rss><channel><title>Co</title><item><title><![CDATA[Dev {k}]]></title><link>https://t.zohorecruit.com/jobs/Careers/12{k}?source=RSS</link><guid></guid><pubDate>Wed, 02 Sep 2026 13:00:00 GMT</pubDate><description><![CDATA[Location: Pune<br>x <span id="spandesc">Body<br>2]]></description></item></channel></rss>', "12{k}", "Pune", "unknown", "2026-09-02", "IN", "Body\n2"),
]


def _sql_text(value: str | None) -> str:
    return "NULL::VARCHAR" if value is None else "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@_query(f"""
WITH w(ats, key, location, work_mode, posted, countries, description) AS (VALUES {", ".join("(" + ", ".join(map(_sql_text, (a, *rest))) + ")" for a, _, _, *rest in _PAYLOADS)})
SELECT ats || ':s' || s_suppkey || ':' || replace(key, '{{k}}', CAST(s_suppkey AS VARCHAR)) AS id, 'Dev ' || s_suppkey AS title, s_name AS company, location, work_mode, posted, countries, description FROM supplier, w
""")
def q65_provider_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded payloads of every provider as classified postings."""
    from ..sources import providers

    k = F.col("s_suppkey").cast("string")
    parts = []
    for ats, token, body, *_ in _PAYLOADS:
        rows = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k).alias("source_slug"), F.col("s_name").alias("name"), F.lit(token).alias("token"), F.replace(F.lit(body), F.lit("{k}"), k).alias("body"))
        parts.append(providers.ADAPTERS[ats](rows, NOW))
    found = geo.classify(coverage.union_all(parts))
    return found.select("id", "title", "company", "location", "work_mode", F.date_format("updated_at", "yyyy-MM-dd").alias("posted"), F.array_join("eligible_countries", ",").alias("countries"), "description")


@_query("""
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)
SELECT 'boards' AS kind, count(*) FILTER (k % 4 <> 0) AS n, sum(k) FILTER (k % 4 <> 0)::BIGINT AS total FROM s UNION ALL SELECT 'no boards', count(*) FILTER (k % 4 = 0), sum(k) FILTER (k % 4 = 0)::BIGINT FROM s
UNION ALL SELECT 'tenants', count(*) FILTER (k % 3 = 0), sum(k) FILTER (k % 3 = 0)::BIGINT FROM s UNION ALL SELECT 'tenant leads', count(*) FILTER (k % 3 <> 0), sum(k) FILTER (k % 3 <> 0)::BIGINT FROM s
UNION ALL SELECT 'excluded', count(DISTINCT n), sum(DISTINCT n)::BIGINT FROM s UNION ALL SELECT 'catalog', count(*), sum(k)::BIGINT FROM s UNION ALL SELECT 'candidates', count(*), sum(k)::BIGINT FROM s
UNION ALL SELECT 'snapshot jobs', count(*), sum(k * n)::BIGINT FROM s UNION ALL SELECT 'snapshot partitions', count(DISTINCT n), count(DISTINCT n) FROM s UNION ALL SELECT 'leads', count(*) FILTER (k % 5 <> 0), sum(k) FILTER (k % 5 <> 0)::BIGINT FROM s
UNION ALL SELECT 'seeds', count(*), sum(k)::BIGINT FROM s UNION ALL SELECT 'partitions kept', count(*), sum(CASE WHEN n = 3 THEN 2 * k ELSE k END)::BIGINT FROM s
""")
def q66_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every kind written to the shared folder and read by the library: pages, tenants, lists, catalogs, snapshots, leads; partitions replaced."""
    import uuid

    from ..functions.shared import shared_dir

    at = f"{shared_dir(spark)}/readers-{uuid.uuid4().hex}"
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    k, n = F.col("k").cast("string"), F.col("n").cast("string")

    def lines(name: str, text: Column) -> str:
        s.select(text.alias("value")).write.text(f"{at}/{name}")
        return f"{at}/{name}"

    def one(name: str, text: Column, rows: DataFrame = s) -> str:
        rows.agg(text.alias("value")).coalesce(1).write.text(f"{at}/{name}")
        return f"{at}/{name}"

    number = lambda c: F.regexp_extract(c, "([0-9]+)", 1).cast("long")
    total = lambda kind, df, value: df.agg(F.count(F.lit(1)).alias("n"), F.sum(value).cast("long").alias("total")).select(F.lit(kind).alias("kind"), "n", "total")
    url = F.concat(F.when(F.col("k") % 4 == 0, "https://www.example.com/acme").otherwise("https://jobs.lever.co/acme"), k)
    boards, rest = snapshots.read_index_pages(spark, lines("pages", F.to_json(F.struct(url.alias("url")))))
    with_site, without = snapshots.keka_tenants(spark, lines("tenants", F.concat(F.lit("acme"), k, F.lit(".keka.com"), F.when(F.col("k") % 3 == 0, ",https://acme.com").otherwise(""))))
    excluded = snapshots.read_exclusions(spark, one("excluded", F.to_json(F.collect_list(F.concat(F.lit("Lever:"), n)))))
    entry = F.struct(F.lit("A").alias("name"), F.lit("lever").alias("ats"), k.alias("token"), F.lit("a.com").alias("companyDomain"))
    catalog = snapshots.read_catalog(spark, one("catalog", F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("s"), k), entry))))))
    wanted = F.struct(F.lit("A").alias("companyName"), F.lit("a.com").alias("companyDomain"), F.concat(F.lit("https://jobs.lever.co/"), k).alias("sourceUrl"), F.struct(F.lit("search").alias("channel"), F.lit("r").alias("reference")).alias("discoveredFrom"))
    candidates = snapshots.read_candidates(spark, one("candidates", F.to_json(F.collect_list(wanted))))
    job = F.struct(k.alias("id"), F.lit("T").alias("title"), n.alias("location"), F.lit("2026-08-01").alias("updatedAt"))
    parts = s.groupBy("n").agg(F.collect_list(job).alias("jobs")).select(F.concat(F.lit("s"), n).alias("slug"), F.struct(F.lit("2026-08-02").alias("fetchedAt"), "jobs").alias("p"))
    path = one("snapshot", F.to_json(F.struct(F.lit(1).alias("version"), F.map_from_entries(F.collect_list(F.struct("slug", "p"))).alias("partitions"))), parts)
    jobs, held = snapshots.read_snapshot(spark, path)
    key = F.concat(F.when(F.col("k") % 5 == 0, "ashby:").otherwise("lever:"), F.lit("t"), k)
    leads = snapshots.read_registry(spark, lines("leads", F.to_json(F.struct(key.alias("source_key"), F.lit("lever").alias("ats"), F.concat(F.lit("T"), k).alias("token")))))
    seeds = snapshots.read_seed_list(spark, lines("seeds", F.concat(F.lit("- [A"), k, F.lit("](https://a"), k, F.lit(".com/jobs) [x](https://www.linkedin.com/x)"))), ["linkedin.com"])
    rows = s.select(F.concat(F.lit("s"), n).alias("source_slug"), "k")
    snapshots.write_partitions(rows, f"{at}/jobs")
    snapshots.write_partitions(rows.where("source_slug = 's3'").withColumn("k", 2 * F.col("k")), f"{at}/jobs")
    return coverage.union_all([
        total("boards", boards, number("token")), total("no boards", rest, number("url")), total("tenants", with_site, number("host")), total("tenant leads", without, number("host")), total("excluded", excluded, number("key")),
        total("catalog", catalog, number("token")), total("candidates", candidates, number("source_url")), total("snapshot jobs", jobs, F.col("id").cast("long") * F.col("location").cast("long")), total("snapshot partitions", held, F.lit(1)),
        total("leads", leads, number("token")), total("seeds", seeds, number("name")), total("partitions kept", spark.read.parquet(f"{at}/jobs"), F.col("k")),
    ])


@_query("""
WITH e AS (SELECT user_id, count(*) AS n, arg_max(event_type, event_id) AS last FROM events GROUP BY 1),
w AS (SELECT s_suppkey AS k, s_suppkey % 4 AS v FROM supplier)
SELECT 'wave' AS kind, count(*) AS n, coalesce(sum(user_id), 0)::BIGINT AS total FROM e WHERE last <> 'view' AND n < 67
UNION ALL SELECT 'phase ' || p, count(*), sum(k)::BIGINT FROM (SELECT s_suppkey AS k, CAST(ceil(row_number() OVER (ORDER BY s_acctbal, s_suppkey) / 10) AS INTEGER) AS p FROM supplier) WHERE p <= 2 GROUP BY p
UNION ALL SELECT 'complete', count(*), sum(k)::BIGINT FROM w WHERE v <> 3
UNION ALL SELECT 'expected', count(*), sum(CASE WHEN v = 3 THEN 4 ELSE 2 END)::BIGINT FROM w
UNION ALL SELECT 'facets', count(*), sum(k)::BIGINT FROM w WHERE v = 1
UNION ALL SELECT 'candidates', 3 * count(*), 6 * count(*) FROM w
""")
def q67_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second waves of a crawl, phases of a probe, whole listings, addresses of company sites with their sitemaps."""
    from ..sources import providers

    e, s = _t(spark, sf_dir, "events"), _t(spark, sf_dir, "supplier")
    total = lambda kind, df, value: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("total")).select(F.lit(kind).alias("kind"), "n", "total")
    wave = state.next_wave(e.select(F.col("user_id").alias("source"), F.when(F.col("event_type") == "view", "success").otherwise("failure").alias("outcome"), F.col("event_id").alias("ordinal")), 67)
    ranked = s.withColumn("by", F.concat(F.lpad(F.format_string("%.2f", F.col("s_acctbal") + 100000.0), 12, "0"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")))
    phases = verification.probe_phases(ranked, "by").groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("total")).select(F.concat(F.lit("phase "), F.col("phase").cast("string")).alias("kind"), "n", "total")
    k, v = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 4
    row = '{"title":"T","externalPath":"/a","locationsText":"%s"}'
    body = F.concat(F.lit('{"jobPostings":[' + row % "Pune" + ","), F.when(v == 1, row % "").otherwise(row % "Pune"), F.lit(',{"title":"none","locationsText":"Pune"}],"total":'), F.when(v == 3, "5").otherwise("3"), F.lit("}"))
    listed = providers.workday_complete(s.select(k.alias("source_slug"), body.alias("body")))
    slug = F.col("source_slug").cast("long")
    site = F.concat(F.lit("https://acme"), k, F.lit(".com"))
    pages = s.select(k.alias("source_slug"), F.concat(site, F.lit("/jobs")).alias("url"), F.lit('<a href="/b">b</a><a href="/a">a</a><a href="https://evil.com/x">x</a><a href="/a">again</a>').alias("html"))
    maps = s.select(k.alias("source_slug"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("ordinal"), site.alias("site")).select("source_slug", "ordinal", F.concat(F.lit("<loc>"), F.col("site"), F.lit("/m"), F.col("ordinal").cast("string"), F.lit("</loc>")).alias("xml"))
    found = providers.site_candidates(pages, maps, s.select(k.alias("source_slug"), F.concat(F.lit("acme"), k, F.lit(".com")).alias("company_domain")), 3)
    return coverage.union_all([
        total("wave", wave, F.col("source")), phases, total("complete", listed.where("complete"), slug), total("expected", listed, F.col("expected")), total("facets", listed.where("facets_needed"), slug), total("candidates", found, F.col("place")),
    ])
