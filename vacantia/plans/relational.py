"""Queries over the driver's tables that run the library's operators, and the same results in DuckDB SQL.

The tables hold no postings, so each query names what stands for what: orders for dated postings,
customers for sources, nations for countries, events for market postings, parts for titles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, html, text
from ..operators import audit, coverage, market, precedence, search, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _latest(df: DataFrame, column: str, days_before: int = 0) -> Column:
    """A fixed now: the latest time of a column (one scalar), some days back."""
    return F.lit(df.agg(F.max(F.col(column).cast("timestamp"))).first()[0]) - F.expr(f"INTERVAL {days_before} DAYS")


@_query("""
WITH p AS (
  SELECT o.o_orderkey, o.o_orderdate, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE o.o_orderstatus = 'O' AND n.n_name IN ('NATION_1', 'NATION_2')),
x AS (SELECT max(o_orderdate) AS now FROM orders),
k AS (SELECT count(*) FILTER (o_orderdate >= now - INTERVAL 7 DAY) AS a, count(*) FILTER (o_orderdate >= now - INTERVAL 14 DAY) AS b,
             count(*) FILTER (o_orderdate >= now - INTERVAL 30 DAY) AS c FROM p, x),
w AS (SELECT CASE WHEN a >= 5 THEN 7 WHEN b >= 5 THEN 14 WHEN c >= 5 THEN 30 ELSE 0 END AS days_used FROM k),
f AS (SELECT p.*, days_used FROM p, x, w WHERE days_used = 0 OR o_orderdate >= now - days_used * INTERVAL 1 DAY)
SELECT o_orderkey, n_name, strftime(o_orderdate, '%Y-%m-%d') AS posted, days_used, (SELECT count(*) FROM f) AS total,
       CASE WHEN (SELECT count(*) FROM f) > 4 THEN 4::BIGINT END AS next_offset
FROM f ORDER BY o_orderdate DESC, o_orderkey LIMIT 2 OFFSET 2
""")
def q01_search_cascade_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders of two nations: the cascade picks an age window; the second page of two, newest first."""
    orders, customer, nation = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    places = nation.where(F.col("n_name").isin("NATION_1", "NATION_2"))
    posts = orders.where("o_orderstatus = 'O'").join(customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    found = search.in_cascade(posts.select("o_orderkey", "o_orderdate", "n_name"), "o_orderdate", _latest(orders, "o_orderdate"))
    shown = search.page(found, "o_orderdate", "o_orderkey", 2, 2)
    return shown.select("o_orderkey", "n_name", F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted"), "days_used", "total", "next_offset")


_STEM = "CASE WHEN length(t) >= 7 AND ends_with(t, 'ing') THEN t[:-4] WHEN length(t) >= 5 AND ends_with(t, 's') AND NOT ends_with(t, 'ss') THEN t[:-2] ELSE t END"


@_query(f"""
WITH s AS (
  SELECT p_partkey, unnest(string_split(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9.+#]+', ' ', 'g')), ' ')) AS t FROM part),
a AS (SELECT p_partkey, trim(t, '.') AS t FROM s),
b AS (SELECT p_partkey, {_STEM} AS t FROM a), c AS (SELECT p_partkey, {_STEM} AS t FROM b), d AS (SELECT p_partkey, {_STEM} AS t FROM c)
SELECT p.p_partkey, p.p_name, p.p_type FROM part p
WHERE p.p_partkey IN (SELECT p_partkey FROM d WHERE t = 'large') AND p.p_partkey IN (SELECT p_partkey FROM d WHERE t = 'widget')
""")
def q02_token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose title holds all terms of the query "Large widgets" as whole stemmed tokens."""
    part = _t(spark, sf_dir, "part")
    indexed = text.haystack(F.concat_ws(" ", "p_name", "p_type"))
    return part.where(text.matches_terms(indexed, text.search_terms_of("Large, widgets"))).select("p_partkey", "p_name", "p_type")


@_query("""
SELECT doc_id, regexp_matches(text, '(?i)(^|[^a-z0-9+#])the thing($|[^a-z0-9+#])') AS has_phrase,
       regexp_matches(text, '(?i)(^|[^a-z0-9+#.])the($|[^a-z0-9+#.])') AS has_dotted,
       CAST(len(regexp_extract_all(regexp_replace(text, '(?i)the', 'the the', 'g'), '(?i)(^|[^a-z0-9+#])zzz')) AS BIGINT) AS n_none
FROM documents WHERE regexp_matches(text, '(?i)(^|[^a-z0-9+#])idiot($|[^a-z0-9+#])') OR regexp_matches(text, '(?i)(^|[^a-z0-9+#])the and($|[^a-z0-9+#])')
""")
def q03_phrase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a phrase as whole words, and the dotted variant of the test."""
    docs = _t(spark, sf_dir, "documents")
    body = F.col("text")
    found = docs.where(text.includes_phrase(body, "idiot") | text.includes_phrase(body, "the and"))
    return found.select("doc_id", text.includes_phrase(body, "the thing").alias("has_phrase"), text.includes_phrase_dotted(body, "the").alias("has_dotted"), text.count_phrase(body, "zzz").cast("long").alias("n_none"))


@_query("""
WITH x AS (SELECT max(o_orderdate) - INTERVAL 200 DAY AS now FROM orders)
SELECT CASE WHEN d <= 7 THEN 'new' WHEN d <= 30 THEN 'older' ELSE 'stale' END AS age, count(*) AS n, min(d) AS least_days, max(d) AS most_days
FROM (SELECT greatest(0, CAST(floor((epoch_ms(now) - epoch_ms(o_orderdate)) / 86400000) AS BIGINT)) AS d FROM orders, x) GROUP BY 1
""")
def q04_job_age_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by age class; the future counts as new."""
    orders = _t(spark, sf_dir, "orders")
    now = _latest(orders, "o_orderdate", 200)
    aged = orders.select(dates.job_age(F.col("o_orderdate"), now).alias("age"), dates.posted_days_ago(F.col("o_orderdate"), now).alias("d"))
    return aged.groupBy("age").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("least_days"), F.max("d").alias("most_days"))


@_query("""
SELECT n.n_name AS country, count(DISTINCT c.c_custkey) AS sources, count(o.o_orderkey) AS jobs, count(DISTINCT CASE WHEN o.o_orderkey IS NOT NULL THEN c.c_mktsegment END) AS employers
FROM nation n LEFT JOIN (customer c JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' AND o.o_totalprice > 450000) ON c.c_nationkey = n.n_nationkey GROUP BY 1
""")
def q05_coverage_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation: customers with a large pending order, such orders, distinct segments; nations without any stay."""
    nation, customer, orders = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    held = orders.where("o_orderstatus = 'P' AND o_totalprice > 450000").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    counted = held.groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("sources"), F.count(F.lit(1)).alias("jobs"), F.count_distinct("c_mktsegment").alias("employers"))
    return nation.join(counted, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("country"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sources", "jobs", "employers")])


@_query("""
SELECT o_orderpriority AS provider, count(*) AS n, CAST(round(count(*) FILTER (o_orderstatus = 'F') / count(*) * 100, 2) AS DOUBLE) AS done_percent,
       count(*) FILTER (o_orderstatus = 'O') AS explicit, count(*) FILTER (o_orderstatus = 'P') AS inferred, count(*) FILTER (o_orderstatus = 'X') AS unknown
FROM orders GROUP BY 1
""")
def q06_provider_counts_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by provider with a fixed, zero-filled pivot and a percentage."""
    orders = _t(spark, sf_dir, "orders")
    hit = lambda s: F.count_if(F.col("o_orderstatus") == s)
    counted = orders.groupBy(F.col("o_orderpriority").alias("provider")).agg(F.count(F.lit(1)).alias("n"), hit("F").alias("done"), hit("O").alias("explicit"), hit("P").alias("inferred"), hit("X").alias("unknown"))
    return counted.select("provider", "n", coverage.percent(F.col("done"), F.col("n")).alias("done_percent"), "explicit", "inferred", "unknown")


@_query("""
WITH x AS (SELECT max(o_orderdate) - INTERVAL 20 DAY AS now FROM orders), p AS (SELECT o_custkey, max(o_orderdate) AS fetched FROM orders GROUP BY 1)
SELECT CASE WHEN epoch_ms(now) - epoch_ms(fetched) < 0 THEN 'future' WHEN epoch_ms(now) - epoch_ms(fetched) <= 86400000 THEN 'fresh_24_hours' WHEN epoch_ms(now) - epoch_ms(fetched) <= 7 * 86400000 THEN 'age_1_to_7_days'
            WHEN epoch_ms(now) - epoch_ms(fetched) <= 14 * 86400000 THEN 'age_8_to_14_days' ELSE 'older_than_14_days' END AS bucket,
       count(*) AS n, strftime(min(fetched), '%Y-%m-%d') AS oldest, strftime(max(fetched), '%Y-%m-%d') AS newest
FROM p, x GROUP BY 1
""")
def q07_freshness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as partitions, their latest order as the time of fetching: freshness buckets."""
    orders = _t(spark, sf_dir, "orders")
    parts = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    found = coverage.freshness(parts, "at", _latest(orders, "o_orderdate", 20))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return found.select("bucket", "n", day("oldest"), day("newest"))


@_query("""
WITH x AS (SELECT max(o_orderdate) - INTERVAL 20 DAY AS now FROM orders), p AS (SELECT o_custkey, max(o_orderdate) AS fetched FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN epoch_ms(now) - epoch_ms(fetched) < 0 THEN 'future' WHEN epoch_ms(now) - epoch_ms(fetched) <= 86400000 THEN 'fresh_24_hours' WHEN epoch_ms(now) - epoch_ms(fetched) <= 7 * 86400000 THEN 'age_1_to_7_days'
            WHEN epoch_ms(now) - epoch_ms(fetched) <= 14 * 86400000 THEN 'age_8_to_14_days' ELSE 'older_than_14_days' END AS bucket FROM p, x
""")
def q07c_freshness_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customer lies in which bucket, a row each."""
    orders = _t(spark, sf_dir, "orders")
    parts = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    return coverage.freshness_members(parts, "o_custkey", "at", _latest(orders, "o_orderdate", 20))


@_query("""
WITH x AS (SELECT max(o_orderdate) AS now FROM orders), p AS (SELECT o_custkey, max(o_orderdate) AS fetched FROM orders GROUP BY 1)
SELECT count(*) AS partitions, CAST(floor((epoch_ms(now) - epoch_ms(min(fetched))) / 86400000) AS BIGINT) AS oldest_age_days, epoch_ms(now) - epoch_ms(min(fetched)) > 14 * 86400000 AS stale FROM p, x GROUP BY now
""")
def q07b_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest partition decides whether the snapshot is stale."""
    orders = _t(spark, sf_dir, "orders")
    parts = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    return coverage.staleness(parts, "at", _latest(orders, "o_orderdate"))


@_query("""
SELECT 'never_indexed' AS kind, p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
UNION ALL SELECT DISTINCT 'orphaned', l_suppkey + 1 FROM lineitem WHERE l_suppkey + 1 NOT IN (SELECT s_suppkey FROM supplier)
""")
def q08_never_indexed_orphaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-joins in both directions: parts without large lines, line keys without a supplier."""
    part, line, supplier = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "supplier")
    never, _ = coverage.covered_keys(part.select(F.col("p_partkey").alias("key")), line.where("l_quantity > 45").select(F.col("l_partkey").alias("key")), "key")
    _, orphaned = coverage.covered_keys(supplier.select(F.col("s_suppkey").alias("key")), line.select((F.col("l_suppkey") + 1).alias("key")), "key")
    return coverage.union_all([never.select(F.lit("never_indexed").alias("kind"), "key"), orphaned.select(F.lit("orphaned").alias("kind"), "key")])


@_query("""
WITH a AS (SELECT DISTINCT p_partkey, key FROM (SELECT p_partkey, replace(p_name, ' ', '') AS key FROM part UNION ALL SELECT p_partkey, lower(p_type) FROM part)),
b AS (SELECT DISTINCT c_nationkey AS domain, key FROM (SELECT c_nationkey, lower(c_mktsegment) || c_nationkey AS key FROM customer UNION ALL SELECT c_nationkey, split_part(c_name, '#', 1) || CASE WHEN c_nationkey = 3 THEN 'x' ELSE '' END FROM customer
      UNION ALL SELECT c_nationkey, lower(['small', 'red', 'blue', 'green', 'hot'][c_nationkey % 5 + 1]) || 'ring' FROM customer WHERE c_nationkey < 4 UNION ALL SELECT n_nationkey, lower('ECONOMY') FROM nation WHERE n_nationkey = 2))
SELECT p_partkey, min(domain) AS domain FROM a JOIN b USING (key) WHERE length(key) >= 3 GROUP BY 1 HAVING count(DISTINCT domain) = 1
""")
def q09_unique_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose derived keys meet exactly one distinct nation: a theta join as an equi-join on exploded keys."""
    part, customer = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "customer")
    n = F.col("c_nationkey")
    colour = F.element_at(F.array(*map(F.lit, ["small", "red", "blue", "green", "hot"])), (n % 5 + 1).cast("int"))
    known = customer.select(
        n.alias("domain"),
        F.array_compact(F.array(
            F.concat(F.lower("c_mktsegment"), n.cast("string")), F.concat(F.split("c_name", "#")[0], F.when(n == 3, "x").otherwise("")), F.when(n < 4, F.concat(colour, F.lit("ring"))), F.when(n == 2, F.lit("economy")),
        )).alias("keys"),
    )
    return precedence.unique_match(part, known, F.array(F.regexp_replace("p_name", " ", ""), F.lower("p_type")), F.col("keys"), "p_partkey", "domain")


@_query(r"""
WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)
SELECT page_id, host FROM h WHERE NOT (host = 'example.org' OR ends_with(host, '.example.org')) AND NOT (host = 'www.thbleth.example.com' OR ends_with(host, '.example.net'))
""")
def q10_multi_key_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under no known domain: suffix matches as an equi anti-join on exploded host suffixes."""
    pages = _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    known = spark.createDataFrame([("example.org",), ("example.net",), ("www.thbleth.example.com",)], "domain string")
    return precedence.any_key_semi(pages, known, precedence.host_suffixes(F.col("host")), F.array("domain"), anti=True)


@_query("""
SELECT md5(lower(trim(text))) AS key1, source AS key2, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1
""")
def q11_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal text and source with more than one member."""
    return audit.duplicate_groups(_t(spark, sf_dir, "documents"), F.md5(F.lower(F.trim("text"))), F.col("source"))


@_query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2)
SELECT user_id, arg_max(event_type, (n, -first)) AS event_type, max(n) AS n FROM c GROUP BY 1
""")
def q12_majority_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's most frequent event type; of equally frequent ones the first seen."""
    return precedence.majority(_t(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@_query("""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9+#.-]*'), lambda x: length(x) > 1 AND x NOT IN ('the', 'and', 'of', 'de', 'der', 'la')) AS w FROM documents),
g AS (SELECT unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS gram FROM t)
SELECT gram, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, gram LIMIT 200
""")
def q13_bigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 most frequent neighbouring words, stop words gone before."""
    return audit.ngrams(_t(spark, sf_dir, "documents"), "text", ["the", "and", "of", "de", "der", "la"], 2, 200)


@_query("""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9+#.-]*'), lambda x: length(x) > 1 AND x NOT IN ('the', 'and')) AS w FROM documents)
SELECT gram, count(*) AS n FROM (SELECT unnest(w) AS gram FROM t) GROUP BY 1 ORDER BY n DESC, gram LIMIT 250
""")
def q13b_unigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 250 most frequent words."""
    return audit.ngrams(_t(spark, sf_dir, "documents"), "text", ["the", "and"], 1, 250)


@_query(r"""
WITH m AS (
  SELECT term, doc_id, len(regexp_extract_all(regexp_replace(text, '(?i)([^a-z0-9+#])', '\1\1', 'g'), '(?i)(^|[^a-z0-9+#])' || term || '($|[^a-z0-9+#])')) AS n
  FROM documents, (VALUES ('idiot'), ('license'), ('than'), ('with')) AS v(term))
SELECT term, CAST(sum(n) AS BIGINT) AS mentions, count(*) AS documents, array_to_string(list(doc_id ORDER BY doc_id)[1:3], ',') AS examples FROM m WHERE n > 0 GROUP BY 1
""")
def q14_term_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of terms as whole words, documents that hold them, the first three of these."""
    found = audit.term_prevalence(_t(spark, sf_dir, "documents"), "doc_id", "text", ["idiot", "license", "than", "with"])
    return found.withColumn("examples", F.array_join(F.transform("examples", lambda d: d.cast("string")), ","))


@_query("""
WITH r AS (SELECT event_type, 'User ' || user_id AS name, ts, event_id, CAST(CAST(floor(value) AS BIGINT) % 7 AS VARCHAR) AS place FROM events),
p AS (SELECT lower(name) AS employer, place, min(event_id) AS f FROM r GROUP BY 1, 2)
SELECT lower(name) AS employer, min_by(name, event_id) AS name, count(*) AS postings, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest,
       array_to_string(list_sort(list(DISTINCT event_type)), ',') AS categories,
       any_value(places) AS places
FROM r JOIN (SELECT employer AS e, array_to_string(list(place ORDER BY f)[1:5], ',') AS places FROM p GROUP BY 1) ON e = lower(name) GROUP BY 1
""")
def q15_employer_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as employers: postings, latest, categories, first five places, first spelling."""
    events = _t(spark, sf_dir, "events")
    posts = events.select("event_id", "ts", "event_type", F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("spelling"), (F.floor("value").cast("long") % 7).cast("string").alias("place"))
    found = market.employer_signals(posts, "spelling", "ts", "event_type", "place", "event_id")
    return found.select("employer", "name", "postings", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"), F.array_join("categories", ",").alias("categories"), F.array_join("places", ",").alias("places"))


@_query("""
WITH x AS (SELECT max(ts) - INTERVAL 10 DAY AS now FROM events),
o AS (SELECT event_id // 2 AS id, min((ts, user_id)) AS p FROM events, x WHERE ts >= now - INTERVAL 7 DAY GROUP BY 1)
SELECT p[2] AS user_id, count(*) AS postings, strftime(min(p[1]), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(p[1]), '%Y-%m-%d %H:%M:%S') AS last_seen FROM (SELECT [p] AS q, p FROM o) GROUP BY 1
""".replace("p[2]", "struct_extract(p, 2)").replace("p[1]", "struct_extract(p, 1)"))
def q16_rolling_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of a rolling week per user, each id once."""
    events = _t(spark, sf_dir, "events").withColumn("id", F.floor(F.col("event_id") / 2))
    found = market.rolling_market(events, "id", "user_id", "ts", _latest(events, "ts", 10), 7)
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("user_id", "postings", at("first_seen"), at("last_seen"))


@_query("""
WITH e AS (SELECT user_id, count(*) AS postings FROM events GROUP BY 1), k AS (SELECT DISTINCT c_custkey AS key FROM customer WHERE c_nationkey < 5 UNION SELECT c_custkey + 1 FROM customer WHERE c_acctbal > 9000),
m AS (SELECT *, user_id IN (SELECT key FROM k) OR user_id * 3 IN (SELECT key FROM k) AS covered FROM e)
SELECT count(*) AS employers, CAST(sum(postings) AS BIGINT) AS postings, count(*) FILTER (covered) AS covered_employers, CAST(coalesce(sum(postings) FILTER (covered), 0) AS BIGINT) AS covered_postings FROM m
""")
def q17_market_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a market the catalog covers, by any of several keys on both sides."""
    return market.coverage_totals(_market(spark, sf_dir))


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, customer = _t(spark, sf_dir, "events"), _t(spark, sf_dir, "customer")
    employers = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("postings")).withColumn("employer", F.col("user_id"))
    known = F.array_compact(F.array(F.when(F.col("c_nationkey") < 5, F.col("c_custkey")), F.when(F.col("c_acctbal") > 9000, F.col("c_custkey") + 1)))
    return market.covered(employers, customer, F.array(F.col("user_id"), F.col("user_id") * 3), known)


@_query("""
WITH e AS (SELECT user_id, count(*) AS postings FROM events GROUP BY 1), k AS (SELECT DISTINCT c_custkey AS key FROM customer WHERE c_nationkey < 5 UNION SELECT c_custkey + 1 FROM customer WHERE c_acctbal > 9000)
SELECT user_id, postings FROM e WHERE NOT (user_id IN (SELECT key FROM k) OR user_id * 3 IN (SELECT key FROM k)) ORDER BY postings DESC, user_id LIMIT 50
""")
def q17b_market_uncovered_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 largest employers that the catalog misses."""
    return market.uncovered_top(_market(spark, sf_dir)).select("user_id", "postings")


@_query("""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS turn, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS group_first FROM supplier)
SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY turn, group_first) AS place FROM t
""")
def q18_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers interleaved by nation."""
    from pyspark.sql import Window

    turned = precedence.round_robin(_t(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey")
    # the place among all: rows of earlier turns, then groups in order of first sight
    per_turn = turned.groupBy("turn").agg(F.count(F.lit(1)).alias("n"))
    before = per_turn.select("turn", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("turn").orderBy("group_first"))
    return turned.withColumn("inside", inside).join(before, "turn").select("s_suppkey", "s_nationkey", (F.col("before") + F.col("inside")).alias("place"))


@_query("""
WITH l AS (SELECT c_custkey, max(o_orderdate) AS fetched FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey, strftime(fetched, '%Y-%m-%d') AS fetched FROM l ORDER BY fetched ASC NULLS FIRST, c_custkey LIMIT 25
""")
def q19_crawl_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to crawl next: never fetched first, then the oldest."""
    customer, orders = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    held = orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    found = state.crawl_order(customer.join(held, F.col("c_custkey") == F.col("o_custkey"), "left"), "at", "c_custkey", 25)
    return found.select("c_custkey", F.date_format("at", "yyyy-MM-dd").alias("fetched"))


@_query("""
WITH r AS (SELECT o_orderkey, o_custkey, coalesce(list_position(['1-URGENT', '3-MEDIUM'], o_orderpriority), 3) AS rank FROM orders)
SELECT o_custkey, o_orderkey, rank AS country_rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rank, o_orderkey) AS k FROM r) WHERE k <= 2
""")
def q19b_describe_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orders of each customer, those of wanted priorities first: a budget by rank within a source."""
    from pyspark.sql import Window

    orders = _t(spark, sf_dir, "orders").withColumn("p", F.array("o_orderpriority"))
    ranked = orders.withColumn("country_rank", precedence.country_rank("p", ["1-URGENT", "3-MEDIUM"]).cast("int"))
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("country_rank", "o_orderkey"))
    return ranked.withColumn("k", turn).where("k <= 2").select("o_custkey", "o_orderkey", "country_rank")


@_query("""
WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
f AS (SELECT user_id, min(k) AS first_ok FROM r WHERE event_type NOT IN ('error', 'view') GROUP BY 1)
SELECT u.user_id, CAST(coalesce(first_ok - 1, u.n) AS INTEGER) AS failures, CASE WHEN coalesce(first_ok - 1, u.n) >= 3 THEN 'repeatedly_failing' ELSE 'retryable' END AS disposition
FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) u LEFT JOIN f USING (user_id)
""")
def q20_trailing_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts: the run of failures at the end of each user's history."""
    from ..operators import registry

    events = _t(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type").isin("error", "view"), "transient_failure").otherwise("success")
    n = F.col("failures")
    found = registry.trailing_failures_of(events, "user_id", ["ts", "event_id"], outcome)
    return found.select("user_id", n.cast("int").alias("failures"), F.when(n >= registry.REPEATED, "repeatedly_failing").otherwise("retryable").alias("disposition"))


@_query("""
WITH i AS (SELECT l_suppkey, CAST(epoch(l_shipdate) // 86400 AS BIGINT) AS a, CAST(epoch(l_shipdate) // 86400 AS BIGINT) + l_linenumber AS z FROM lineitem),
m AS (SELECT *, max(z) OVER (PARTITION BY l_suppkey ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY l_suppkey ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM m),
s AS (SELECT l_suppkey, island, max(z) - min(a) AS n FROM g GROUP BY 1, 2)
SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS length, count(*) AS islands FROM s GROUP BY 1
""")
def q21_interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that a supplier ships on, overlapping intervals merged."""
    line = _t(spark, sf_dir, "lineitem")
    start = F.unix_date(F.to_date("l_shipdate")).cast("long")
    return precedence.merged_length(line.select("l_suppkey", start.alias("a"), (start + F.col("l_linenumber")).alias("z")), "l_suppkey", "a", "z", suppress=False)


@_query("""
WITH x AS (SELECT max(ts) - INTERVAL 5 DAY AS cut FROM events)
SELECT DISTINCT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS job FROM events, x WHERE ts >= cut
EXCEPT SELECT DISTINCT user_id, CAST(json_extract(props, '$.k') AS BIGINT) FROM events, x WHERE ts < cut
""")
def q22_new_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each watch sees after a cut and did not see before it."""
    events = _t(spark, sf_dir, "events")
    cut = _latest(events, "ts", 5)
    seen = events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("job"), (F.col("ts").cast("timestamp") >= cut).alias("after"))
    return state.new_since(seen.where("after").select("user_id", "job").distinct(), seen.where("NOT after").select("user_id", "job").distinct(), ["user_id", "job"])


@_query("""
WITH n AS (SELECT o_custkey, o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 3 = 0)
SELECT o_custkey, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DECIMAL(18, 2))::VARCHAR AS total FROM (
  SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM n) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)
  UNION ALL SELECT * FROM n) GROUP BY 1
""")
def q23_partition_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that fetched some customers: their partitions are replaced, others stay, unknown ones are pruned."""
    orders, customer = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"), _t(spark, sf_dir, "customer")
    new = orders.where("o_orderstatus = 'P' AND o_custkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    known = customer.where("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"))
    out = state.replace_partitions(orders, new, "o_custkey", known)
    return out.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).cast("decimal(18,2)").cast("string").alias("total"))


@_query("""
WITH r AS (SELECT o_orderkey, list_filter([CASE WHEN o_orderstatus <> 'O' THEN 'status_mismatch:' || o_orderstatus END, CASE WHEN o_totalprice < 100000 THEN 'too_small:100000' END,
                  CASE WHEN o_orderpriority = '5-LOW' THEN 'priority_excluded:5-LOW' END], lambda x: x IS NOT NULL) AS reasons FROM orders)
SELECT split_part(reason, ':', 1) AS reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY 1
UNION ALL SELECT '(kept)', count(*) FROM r WHERE len(reasons) = 0
""")
def q24_reasons_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons against each order, not the first alone, counted by kind; and how many have none."""
    from ..operators import matching

    orders = _t(spark, sf_dir, "orders")
    reasons = matching.reasons(
        (F.col("o_orderstatus") != "O", F.concat(F.lit("status_mismatch:"), F.col("o_orderstatus"))),
        (F.col("o_totalprice") < 100000, F.lit("too_small:100000")),
        (F.col("o_orderpriority") == "5-LOW", F.lit("priority_excluded:5-LOW")),
    )
    return matching.reason_histogram(orders.withColumn("reasons", reasons))


@_query("""
WITH s AS (SELECT p_partkey, CASE WHEN p_name LIKE '%widget%' THEN 6 WHEN p_name LIKE '%ring%' THEN 3 ELSE 0 END + 2 * CAST(p_type = 'LARGE' AS INTEGER) - 2 * CAST(p_size > 40 AS INTEGER) AS score,
                  p_retailprice, p_size > 40 AS gap FROM part),
f AS (SELECT *, CASE WHEN score >= 8 AND NOT gap THEN 'strong' WHEN score >= 4 THEN 'good' ELSE 'stretch' END AS fit FROM s)
SELECT p_partkey, score, fit FROM f ORDER BY CASE fit WHEN 'strong' THEN 3 WHEN 'good' THEN 2 ELSE 1 END DESC, score DESC, p_retailprice DESC, p_partkey LIMIT 20
""")
def q25_score_and_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts scored against a preference, classed and ranked: a top-k over several keys."""
    from ..operators import matching

    part = _t(spark, sf_dir, "part")
    name = F.col("p_name")
    scored = part.withColumns({
        "gaps": (F.col("p_size") > 40).cast("int"),
        "role": F.when(text.includes_phrase(name, "widget"), 6).when(text.includes_phrase(name, "ring"), 3).otherwise(0),
    }).withColumn("score", F.col("role") + 2 * (F.col("p_type") == "LARGE").cast("int") - 2 * F.col("gaps"))
    fit = matching.fit_class(F.col("score"), F.col("gaps"), F.lit(0))
    return scored.withColumn("fit", fit).orderBy(matching.fit_rank(F.col("fit")).desc(), F.desc("score"), F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "score", "fit")


@_query(r"""
SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#\s]+)["'']', 1)) AS INTEGER) AS n_links,
       md5(array_to_string(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#\s]+)["'']', 1), ' ')) AS links_md5,
       CAST(len(regexp_extract_all(html, '(?is)<script[^>]*type\s*=\s*["'']application/ld\+json["''][^>]*>(.*?)</script>', 1)) AS INTEGER) AS n_ld
FROM pages
""")
def q26_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets of every page, and its structured-data blocks."""
    pages = _t(spark, sf_dir, "pages")
    found = html.hrefs(F.col("html"))
    return pages.select("page_id", F.size(found).alias("n_links"), F.md5(F.array_join(found, " ")).alias("links_md5"), F.size(html.ld_json_blocks(F.col("html"))).alias("n_ld"))


@_query(r"""
WITH a AS (SELECT page_id, url, html, regexp_replace(regexp_replace(html, '(?i)<br\s*/?\s*>|</(p|li|div|h[1-6])>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM pages),
b AS (SELECT *, replace(replace(replace(replace(replace(t, '&quot;', '"'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS d FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(d, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS p FROM b),
l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#\s]+)["'']', 1)) AS link FROM pages),
n AS (SELECT page_id, count(DISTINCT CASE WHEN link LIKE 'https://%' THEN link WHEN link LIKE 'http://%' THEN NULL WHEN url LIKE 'https://%' THEN link END) AS n FROM l GROUP BY 1)
SELECT c.page_id, trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) AS text, CAST(coalesce(n.n, 0) AS INTEGER) AS n_links FROM c LEFT JOIN n ON n.page_id = c.page_id
""")
def q26b_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of every page, with absolute https links."""
    pages = _t(spark, sf_dir, "pages")
    return pages.select("page_id", html.plain_text(F.col("html")).alias("text"), F.size(html.extract_links(F.col("html"), F.col("url"))).alias("n_links"))


@_query()
def q28_classify_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geography and stated experience of documents read as remote postings."""
    from ..functions import experience, geo

    docs = _t(spark, sf_dir, "documents")
    jobs = docs.select("doc_id", F.concat(F.lit("Remote, "), F.upper("lang")).alias("location"), F.col("text").alias("description"), F.lit("unknown").alias("work_mode"))
    out = geo.classify(jobs).withColumn("experience", experience.stated(experience.read_experience(F.col("description"))))
    return out.select("doc_id", "work_mode", F.array_join("eligible_countries", ",").alias("countries"), F.array_join("eligible_regions", ",").alias("regions"), "eligibility_confidence", F.col("experience.min").alias("min_years"))


@_query("""
SELECT event_type AS tool, CAST(json_extract(props, '$.k') AS BIGINT) // 25 AS bucket, count(*) AS events, count(DISTINCT user_id) AS users, CAST(round(sum(value), 2) AS DECIMAL(18, 2))::VARCHAR AS value
FROM events GROUP BY 1, 2
""")
def q29_usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events by tool and a field of their JSON."""
    events = _t(spark, sf_dir, "events").withColumn("bucket", F.floor(F.get_json_object("props", "$.k").cast("long") / 25))
    return events.groupBy(F.col("event_type").alias("tool"), "bucket").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).cast("decimal(18,2)").cast("string").alias("value"))


@_query("""
WITH x AS (SELECT max(o_orderdate) - INTERVAL 100 DAY AS now FROM orders), o AS (SELECT *, epoch_ms(now) - epoch_ms(o_orderdate) AS ms FROM orders, x)
SELECT count(*) AS eligible_jobs, count(DISTINCT o_custkey) AS distinct_company_labels, count(*) - count(DISTINCT o_totalprice) AS repeated_ids,
       count(*) FILTER (ms >= 0 AND ms <= 7 * 86400000) AS within_7_days, count(*) FILTER (ms >= 0 AND ms <= 30 * 86400000::BIGINT) AS within_30_days, count(*) FILTER (ms > 30 * 86400000::BIGINT) AS older,
       count(*) FILTER (o_orderdate IS NULL) AS undated, count(*) FILTER (ms < 0) AS future_dated,
       count(*) FILTER (o_totalprice <= 2e4) AS zero_to_two, count(*) FILTER (o_totalprice > 2e4 AND o_totalprice <= 5e4) AS three_to_five,
       count(*) FILTER (o_totalprice > 5e4 AND o_totalprice <= 1e5) AS six_to_ten, count(*) FILTER (o_totalprice > 1e5) AS above_ten
FROM o
""")
def q30_audit_single_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dozen audit metrics of the orders in one pass."""
    orders = _t(spark, sf_dir, "orders")
    return orders.agg(
        F.count(F.lit(1)).alias("eligible_jobs"),
        F.count_distinct("o_custkey").alias("distinct_company_labels"),
        (F.count(F.lit(1)) - F.count_distinct("o_totalprice")).alias("repeated_ids"),
        *audit.age_counts("o_orderdate", _latest(orders, "o_orderdate", 100)),
        *audit.band_counts(F.col("o_totalprice"), [("zero_to_two", 2e4), ("three_to_five", 5e4), ("six_to_ten", 1e5)], "above_ten"),
    )


@_query("""
WITH x AS (SELECT max(o_orderdate) - INTERVAL 30 DAY AS cut FROM orders), h AS (SELECT o_custkey, max(o_orderdate) AS fetched FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
s AS (SELECT CASE WHEN fetched IS NULL THEN 'missing' WHEN fetched < cut THEN 'stale' ELSE 'fresh' END AS state FROM customer LEFT JOIN h ON o_custkey = c_custkey, x)
SELECT count(*) AS sources, count(*) FILTER (state = 'fresh') AS fresh, count(*) FILTER (state = 'stale') AS stale, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state <> 'fresh') AS pending,
       count(*) FILTER (state = 'fresh') / count(*) >= 0.95 AS ready FROM s
""")
def q31_pending_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by state, and whether preparation is done."""
    customer, orders = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    held = orders.where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("at"))
    return state.ready(state.pending_counts(state.pending(customer, held, "c_custkey", "at", _latest(orders, "o_orderdate", 30))))


@_query("""
SELECT unnest([CASE WHEN o_orderstatus = 'O' THEN 'IN' END, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'US' END, CASE WHEN o_totalprice > 200000 THEN 'DE' END]) AS country, count(*) AS jobs
FROM orders GROUP BY 1 HAVING country IS NOT NULL
""")
def q32_jobs_per_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job counts once for each of its countries."""
    countries = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "O", F.lit("IN")), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("US")), F.when(F.col("o_totalprice") > 200000, F.lit("DE"))))
    return coverage.jobs_per_country(_t(spark, sf_dir, "orders").withColumn("eligible_countries", countries))


@_query("""
WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY seen, CASE WHEN seen THEN event_id ELSE -event_id END) AS ordinal
           FROM (SELECT user_id, event_id, event_type = 'view' AS seen FROM events WHERE event_type IN ('view', 'click')))
SELECT * FROM f WHERE ordinal <= 10
""")
def q33_seen_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen sets with a cap: new ids first, then the old ones."""
    events = _t(spark, sf_dir, "events")
    seen = events.where("event_type = 'view'").select("user_id", "event_id", F.col("event_id").alias("ordinal"))
    found = events.where("event_type = 'click'").select("user_id", "event_id", (-F.col("event_id")).alias("ordinal"))
    return state.update_seen(found, seen, "user_id", "event_id", 10)


@_query(r"""
SELECT DISTINCT p_name, split_part(p_name, ' ', 1) || split_part(p_name, ' ', 2) || ',' || split_part(p_name, ' ', 1) || '-' || split_part(p_name, ' ', 2) || ',' || split_part(p_name, ' ', 1) AS guesses FROM part
""")
def q34_token_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board tokens guessed from two-word names."""
    part = _t(spark, sf_dir, "part").select("p_name").distinct()
    return part.select("p_name", F.array_join(text.token_guesses(F.col("p_name")), ",").alias("guesses"))
