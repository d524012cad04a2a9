import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from vacantia.operators import market, precedence, registry, state, verification

from .helpers import NOW, job, jobs

T0 = datetime(2026, 1, 1)


def lead(key="lever:a", ats="lever", matches=(), evidence=(), attempts=(), promoted=None):
    return (key, "https://jobs.lever.co/a", ats, "a", [], [("A", d, "normalized_name", "r") for d in matches], [("A", d, k, "r", at) for d, k, at in evidence],
            [(T0 + timedelta(days=n), o, c, "", nxt, rank) for n, (o, c, nxt, rank) in enumerate(attempts)], promoted)


def ok(o="success", c=None, nxt=None, rank=None):
    return (o, c, nxt, rank)


@pytest.mark.parametrize(
    ("row", "state_"),
    [
        (lead(), "unresolved"), (lead(matches=["a.com"]), "matched"), (lead(attempts=[ok()], promoted=T0), "verified"), (lead(attempts=[ok("permanent_failure")]), "rejected"),
        (lead(matches=["a.com"], evidence=[("a.com", "company_registry", T0)]), "matched"), (lead(ats="greenhouse", matches=["WWW.a.com"], evidence=[("a.com", "company_registry", T0)]), "evidence_ready"),
        (lead(matches=["a.com"], evidence=[("a.com", "company_page_link", T0), ("b.com", "company_redirect", T0)]), "rejected"),
        (lead(matches=["a.com"], evidence=[("a.com", "provider_structured_domain", T0), ("b.com", "company_redirect", T0)]), "evidence_ready"),
        (lead(matches=["c.com"], evidence=[("a.com", "company_redirect", T0)]), "rejected"),
        (lead(matches=["a.com"], evidence=[("a.com", "company_redirect", T0 + timedelta(days=9))], attempts=[ok("permanent_failure", "identity_mismatch", None, 2)]), "evidence_ready"),
        (lead(matches=["a.com"], evidence=[("a.com", "company_redirect", T0 + timedelta(days=9))], attempts=[ok("permanent_failure", "other", None, 2)]), "rejected"),
        (lead(matches=["a.com"], evidence=[("a.com", "company_redirect", T0)], attempts=[ok()], promoted=T0), "verified"),
    ],
)
def test_lead_states(spark, row, state_):
    assert spark.createDataFrame([row], registry.LEAD).select(registry.lead_state()).first()[0] == state_


@pytest.mark.parametrize(
    ("attempts", "what"),
    [
        ([], "fresh"), ([ok()], "retryable"), ([ok("transient_failure", nxt=NOW + timedelta(hours=1))], "cooling_down"), ([ok("transient_failure", nxt=T0)] * 2, "retryable"),
        ([ok("transient_failure")] * 3, "repeatedly_failing"), ([ok("transient_failure"), ok(), ok("transient_failure")], "retryable"),
    ],
)
def test_retries(spark, attempts, what):
    assert spark.createDataFrame([lead(attempts=attempts)], registry.LEAD).select(registry.retry_disposition(NOW)).first()[0] == what


def test_registry_upsert(spark):
    old = spark.createDataFrame([lead("lever:a", matches=["a.com"])], registry.LEAD)
    new = spark.createDataFrame([lead("lever:a", matches=["a.com", "b.com"], promoted=T0), lead("lever:b")], registry.LEAD)
    got = {r.source_key: r for r in registry.merge_leads(old, new).collect()}
    assert [m.company_domain for m in got["lever:a"].company_matches] == ["a.com", "b.com"] and got["lever:a"].promoted_at == T0 and set(got) == {"lever:a", "lever:b"}
    twice = registry.merge_leads(registry.merge_leads(old, new), new)
    assert sorted(map(repr, twice.collect())) == sorted(map(repr, got.values()))


def test_board_funnel(spark):
    rows = spark.createDataFrame([lead(f"lever:{t}", ats)[:3] + (t,) + lead()[4:] for ats, t in [("lever", "Acme"), ("other", "x"), ("lever", "out"), ("lever", "held"), ("lever", "demo12345"), ("lever", "xkcdqwrt")]], registry.LEAD)
    excluded, catalog = spark.createDataFrame([("LEVER:out",)], "key string"), spark.createDataFrame([("lever", "Held")], "ats string, token string")
    got = {r.token: r.skip for r in registry.board_funnel(rows, ["lever"], excluded, catalog, NOW).collect()}
    assert got == {"Acme": None, "x": "unsupported", "out": "excluded", "held": "in_catalog", "demo12345": "test_board", "xkcdqwrt": "test_board"}


def test_identities_and_matches(spark):
    rows = spark.createDataFrame([("a", "x.com"), ("a", "www.x.com"), ("b", "y.com"), ("b", "z.com"), ("c", "known.com")], "token string, domain string")
    known = spark.createDataFrame([("www.known.com",)], "domain string")
    assert {r.token: r.state for r in registry.identities_per_token(rows, known).collect()} == {"a": "matched", "b": "quarantined", "c": "excluded"}
    leads = spark.createDataFrame([("k1", "acme"), ("k2", "dup"), ("k3", "zz")], "source_key string, token string")
    companies = spark.createDataFrame([("Acme", "www.acme.io"), ("ACME", "acme.io"), ("Dup", "d1.com"), ("dup", "d2.com"), ("Zz", "zz.com")], "company_name string, company_domain string")
    assert [tuple(r) for r in registry.lead_company_matches(leads, companies).collect()] == [("k1", "acme.io")]


def test_majority_ties_and_round_robin(spark):
    rows = spark.createDataFrame([(1, "g", "b"), (2, "g", "a"), (3, "g", "a"), (4, "g", "b"), (5, "g", ""), (6, "g", None), (7, "h", "c")], "n int, g string, v string")
    assert {r.g: (r.v, r.n) for r in precedence.majority(rows, "g", "v", "n").collect()} == {"g": ("b", 2), "h": ("c", 1)}
    turned = [r.n for r in precedence.round_robin(rows, "g", "n").collect()]
    assert turned == [1, 7, 2, 3, 4, 5, 6]


def test_interval_merge_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(g, a, a + rnd.randint(0, 6)) for g in range(20) for a in [rnd.randint(0, 40) for _ in range(rnd.randint(1, 9))]] + [(99, 1, 3), (99, 5, None)]
    got = {r.g: r.length for r in precedence.merged_length(spark.createDataFrame(rows, "g int, a int, z int"), "g", "a", "z").collect()}
    for g in range(20):
        assert got[g] == len({x for h, a, z in rows if h == g for x in range(a, z)})
    assert got[99] is None


def test_interval_merge_of_nulls_against_sql(spark, tmp_path):
    """q21 with nulls; no two equal intervals, which the two sorts of its SQL may order apart."""
    import duckdb
    from vacantia.plans import relational

    rnd = random.Random(5)
    days = [None, *(datetime(1995, 3, 1) + timedelta(days=2 * k) for k in range(40))]
    rows = [(rnd.choice([None, *range(30)]), rnd.choice([None, 1, 2, 3, 7]), rnd.choice(days)) for _ in range(600)]
    rows = [*dict.fromkeys(rows), (100, None, days[1]), (101, 2, None), (102, 2, days[1]), (102, None, days[2]), (102, 1, days[2])]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        want = con.execute(relational.ORACLE_SQL["q21_interval_merge"]).fetchall()
    got = [tuple(r) for r in relational.q21_interval_merge(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_folds(spark):
    rows = spark.createDataFrame(
        [(0, "lever", "A", "a.com", "a"), (1, "lever", "a", "b.com", "b"), (2, "ashby", "x", "b.com", "c"), (3, "ashby", "y", "c.com", "c"), (4, "ashby", "z", "z.com", "z")],
        "ordinal long, ats string, token string, company_domain string, slug string",
    )
    spark.sparkContext.setCheckpointDir("/tmp/vacantia-test-checkpoints")
    # row 1 repeats row 0's source, so its domain is free for row 2, which then holds slug c against row 3
    assert {r.ordinal: r.rejected for r in precedence.dedupe_verified(rows).collect()} == {0: None, 1: "duplicate_source", 2: None, 3: "duplicate_slug", 4: None}
    slugs = spark.createDataFrame([(0, "lever", "acme"), (1, "ashby", "acme"), (2, "ashby", "acme"), (3, "lever", "held")], "ordinal long, ats string, base string")
    taken = spark.createDataFrame([("held",)], "slug string")
    assert {r.ordinal: r.slug for r in precedence.allocate_slugs(slugs, taken).collect()} == {0: "acme", 1: "ashby-acme", 2: None, 3: "lever-held"}


def test_samples_and_keys(spark):
    assert precedence.spaced_pages(100, 4) == [1, 34, 67, 100] and precedence.spaced_pages(3, 9) == [1, 2, 3] and precedence.spaced_pages(9, 1) == [1]
    rows = spark.createDataFrame([(k % 7, f"a.b{k % 7}.com") for k in range(30)], "k int, h string")
    assert precedence.seeded_sample(rows, "k", 5, 1).count() == 5
    found, short = precedence.sample_by_key(rows, "k", 9)
    assert [r.k for r in found.collect()] == list(range(7)) and short.first()[0] == 2
    known = spark.createDataFrame([("b1.com",), ("a.b2.com",)], "d string")
    kept = precedence.any_key_semi(rows, known, precedence.host_suffixes(F.col("h")), F.array("d"))
    assert {r.k for r in kept.collect()} == {1, 2}
    assert {r.k for r in precedence.any_key_semi(rows, known, precedence.host_suffixes(F.col("h")), F.array("d"), anti=True).collect()} == {0, 3, 4, 5, 6}
    assert [r.batch for r in precedence.batches(spark.range(5).toDF("n"), "n", 2).orderBy("n").collect()] == [0, 0, 1, 1, 2]


def test_market(spark):
    posts = spark.createDataFrame(
        [(1, "p1", "Acme Ltd", NOW, "it", "Pune"), (2, "p2", "ACME LTD", NOW - timedelta(days=2), "ops", "Delhi"), (2, "p2", "ACME LTD", NOW, "ops", "Delhi"), (3, "p3", "B", NOW, "x", "y"), (4, "p4", "PricewaterhouseCoopers", NOW - timedelta(days=60), "x", "y")],
        "n int, id string, name string, at timestamp, cat string, place string",
    )
    got = {r.employer: r for r in market.employer_signals(posts.dropDuplicates(["id"]), "name", "at", "cat", "place", "n").collect()}
    assert got["acme ltd"].name == "Acme Ltd" and got["acme ltd"].postings == 2 and got["acme ltd"].categories == ["it", "ops"] and got["acme ltd"].places == ["Pune", "Delhi"] and set(got) == {"acme ltd", "pricewaterhousecoopers"}
    live = {r.name: r.postings for r in market.rolling_market(posts, "id", "name", "at", NOW).collect()}
    assert live == {"Acme Ltd": 1, "ACME LTD": 1, "B": 1}
    employers = spark.createDataFrame([("pwc", "PricewaterhouseCoopers", 5), ("acme", "The Acme Group", 3), ("zed", "Zed Works", 9)], "employer string, name string, postings long")
    catalog = spark.createDataFrame([("pwc", "P", "x", None), ("s", "n", "acme.wd1.com/t", None)], "slug string, name string, token string, company_domain string")
    marked = market.covered(employers, catalog)
    assert market.coverage_totals(marked).first()[:] == (3, 17, 2, 8) and [r.employer for r in market.uncovered_top(marked).collect()] == ["zed"]


def test_partition_replacement(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("gone", 3)], "source_slug string, n int")
    new = spark.createDataFrame([("a", 9)], "source_slug string, n int")
    known = spark.createDataFrame([("a",), ("b",)], "source_slug string")
    assert sorted(map(tuple, state.replace_partitions(old, new, "source_slug").collect())) == [("a", 9), ("b", 2), ("gone", 3)]
    assert sorted(map(tuple, state.replace_partitions(old, new, "source_slug", known).collect())) == [("a", 9), ("b", 2)]


def test_crawl_state(spark):
    sources = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "source_slug string, ordinal long")
    parts = spark.createDataFrame([("a", NOW), ("b", NOW - timedelta(days=9)), ("c", NOW - timedelta(days=3))], "source_slug string, fetched_at timestamp")
    held = sources.join(parts, "source_slug", "left")
    assert [r.source_slug for r in state.crawl_order(held, "fetched_at", "ordinal", 3).collect()] == ["d", "b", "c"]
    states = state.pending(sources, parts, "source_slug", "fetched_at", NOW - timedelta(days=3))
    assert {r.source_slug: r.state for r in states.collect()} == {"a": "fresh", "b": "stale", "c": "fresh", "d": "missing"}
    assert state.ready(state.pending_counts(states)).first()[:] == (4, 2, 1, 1, 2, False)
    assert {r.source_slug for r in held.where(state.crawl_due(held, "fetched_at", NOW - timedelta(days=3))).collect()} == {"b", "c", "d"}
    attempts = spark.createDataFrame([("a", "success", 200, 0), ("b", "failure", 429, 500), ("b", "success", 200, 0)], "source string, outcome string, status int, backoff_ms long")
    assert state.crawl_report(attempts, 10, 6).first()[:] == (2, 3, 1, 500, 2, 4, 4)
    seen = spark.createDataFrame([("w", "1", 0), ("w", "2", 1)], "watch_id string, id string, ordinal long")
    found = spark.createDataFrame([("w", "2", 0), ("w", "3", 1)], "watch_id string, id string, ordinal long")
    assert [(r.id, r.ordinal) for r in state.update_seen(found, seen, "watch_id", "id", 2).orderBy("ordinal").collect()] == [("3", 1), ("1", 2)]


def test_experience_is_carried_and_described(spark):
    before = jobs(spark, [job("a", experience=(3.0, None, False), experience_state="stated", experience_version=2), job("b", experience=(1.0, None, False), experience_state="stated", experience_version=1)])
    now = jobs(spark, [job("a"), job("b"), job("c")])
    got = {r.id: (r.experience_state, r.experience and r.experience["min"]) for r in state.carry_experience(now, before).collect()}
    assert got == {"a": ("stated", 3.0), "b": ("unread", None), "c": ("unread", None)}
    rows = jobs(spark, [job("a", ordinal=0, eligible_countries=["US"]), job("b", ordinal=1), job("c", days=45, ordinal=2), job("d", ordinal=3, description="x")])
    assert [r.id for r in state.describe_budget(rows, ["IN", "US"], NOW, 1).collect()] == ["b"]


def test_catalog_after_verification(spark):
    s = "slug string, company_domain string, source_key string"
    catalog = spark.createDataFrame([("a", "a.com", "k1"), ("b", "b.com", "k2"), ("c", "c.com", "k3"), ("d", "d.com", "k4")], s)
    verified = spark.createDataFrame([("a", "a.com", "k1"), ("n", "d.com", "k9")], s)
    rejected = spark.createDataFrame([("k2", "probe_failed"), ("k3", "identity_mismatch"), ("k4", "probe_failed")], "source_key string, reason string")
    assert sorted(r.slug for r in state.preserved_catalog(catalog, verified, rejected, ["probe_failed"]).collect()) == ["a", "b", "n"]


def test_verification_funnel(spark):
    c = "company_name string, company_domain string, slug string, source_url string, channel string, reference string, ordinal long"
    rows = spark.createDataFrame(
        [("Acme", "acme.com", None, "https://jobs.lever.co/acme", "search", "r", 0), ("Acme", "acme.com", None, "https://nowhere.io/x", "search", "r", 1), ("Zed", "zed.io", None, "https://jobs.lever.co/other", "search", "r", 2),
         ("", "x.com", None, "https://jobs.lever.co/x", "search", "r", 3), ("Beta", "beta.com", None, "https://jobs.lever.co/beta", "search", "r", 4), ("Gone", "gone.com", None, "https://jobs.lever.co/gone", "search", "r", 5)], c)
    probes = spark.createDataFrame([("lever:acme", 200, "Acme Inc"), ("lever:other", 200, "Other"), ("lever:beta", 200, ""), ("lever:gone", 404, "")], "source_key string, status int, observed_name string")
    open_ = jobs(spark, [job("1")]).withColumn("source_key", F.lit("lever:acme"))
    got = {r.ordinal: r.reason for r in verification.verify(rows, probes, open_, "IN").collect()}
    assert got == {0: None, 1: "unsupported_source", 2: "identity_mismatch", 3: "invalid_candidate", 4: "no_country_jobs", 5: "probe_failed"}
    found = spark.createDataFrame([("k", False, 0), ("k", True, 1), ("m", False, 2)], "source_key string, accepted boolean, ordinal long")
    assert sorted(r.ordinal for r in verification.dedupe_discovered(found).collect()) == [1, 2]
    boards = spark.createDataFrame([("lever", "acmewidgets", 1), ("ashby", "acme", 0)], "ats string, token string, rank int")
    names = spark.createDataFrame([("Acme Widgets Ltd",), ("Nobody",)], "name string")
    assert [tuple(r) for r in verification.resolve_employers(names, boards).collect()] == [("Acme Widgets Ltd", "lever", "acmewidgets")]
    entries = spark.createDataFrame([(0, "A", "https://www.a.com", "Pune, India"), (1, "A2", "https://a.com/x", "India"), (2, "B", "https://b.com", "Indianapolis")], "ordinal int, name string, website string, locations string")
    assert [tuple(r) for r in verification.directory_companies(entries, "India").collect()] == [("a.com", "A", 0)]


def test_candidate_upsert_and_order(spark):
    old = spark.createDataFrame([("k1", "A", ["IN"])], "source_key string, name string, cohorts array<string>")
    new = spark.createDataFrame([("k1", "B", ["US", "IN"]), ("k2", "C", None)], "source_key string, name string, cohorts array<string>")
    assert sorted(map(tuple, verification.merge_candidates(old, new).collect())) == [("k1", "A", ["IN", "US"]), ("k2", "C", [])]
    rows = spark.createDataFrame([("k1", 0), ("k2", 1), ("k3", 2)], "source_key string, ordinal long")
    tries = spark.createDataFrame([("k1", T0), ("k2", T0 - timedelta(days=1))], "source_key string, attempted_at timestamp")
    known = spark.createDataFrame([("k3", T0)], "source_key string, checked_at timestamp")
    assert [r.source_key for r in verification.verification_order(rows, tries, known, 9).collect()] == ["k3", "k2", "k1"]


def test_connected_follows_a_chain_to_its_end(spark, monkeypatch, tmp_path):
    from vacantia.functions import graph

    monkeypatch.setattr(graph, "ROUNDS", 2, raising=False)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = spark.createDataFrame([(k, [f"k{k}", f"k{k + 1}"]) for k in range(6)], "ordinal int, _keys array<string>")
    assert {r.component for r in graph.connected(rows, "ordinal", "_keys").collect()} == {0}
