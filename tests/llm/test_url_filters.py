import random
import re

from pyspark.sql import functions as F
from vacantia.llm import url_filters

from .conftest import rows_of


def brute(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), verdict, rule))
    return (host, path, *((max(fits)[2], max(fits)[1]) if fits else (None, "allow")))


ODD = [None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://a..b.com/", "http://xcom/", "http://example.com?/en/", "http://é.net/fr/", "http://a.b/c://net/es/", "http://com./x"]


def test_against_brute_force(spark):
    rnd = random.Random(6)
    labels = ["com", "net", "org", "example", "www", "m", "a", "b", "comx"]
    urls = ODD + [f"http://{'.'.join(rnd.choice(labels) for _ in range(rnd.randint(1, 4)))}{rnd.choice(['', '/', '/en/', '/es/x', '/fr', '/en/a/b'])}{rnd.choice(['', '?q=/en/', '#t'])}" for _ in range(500)]
    urls += [urls[20]] * 300
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    more = [(f"{'.'.join(rnd.choice(labels) for _ in range(rnd.randint(1, 3)))}{rnd.choice(['/', '/en/', '/e'])}", rnd.choice(["allow", "block"])) for _ in range(60)]
    for rules in (url_filters.RULES, [*url_filters.RULES, *more]):
        got = url_filters.judge(pages, url_filters.rule_table(spark, rules)).collect()
        assert sorted(tuple(r) for r in [(r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got]) == sorted((k, *(x or "" if n == 2 else x for n, x in enumerate(brute(u, rules)))) for k, u in enumerate(urls))


def test_no_rules_empty_and_clashing(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, None)], "page_id long, url string")
    rules = url_filters.rule_table(spark)
    assert url_filters.judge(pages.limit(0), rules).count() == 0
    assert {(r.rule, r.verdict) for r in url_filters.judge(pages, rules.limit(0)).collect()} == {(None, "allow")}
    assert rows_of(url_filters.judge(pages.withColumns({n: F.lit("q") for n in ("host", "path", "key", "rule", "active", "stack")}), rules)) == rows_of(url_filters.judge(pages, rules))


def test_stack_is_carried_over_ranges(spark, monkeypatch):
    """Deep rules whose intervals span many ranges, and rules that end inside one."""
    rnd = random.Random(2)
    name = lambda n: ".".join(rnd.choice("abc") for _ in range(n))
    rules = [("a/", "block"), ("b.a/", "allow"), ("c.b.a/x", "block"), ("a.c.b.a/", "allow"), ("b/", "block"), ("c/x", "block"), ("c.c/", "allow")]
    rules += [(f"{name(rnd.randint(2, 5))}/{rnd.choice(['', 'x'])}", rnd.choice(["allow", "block"])) for _ in range(40)]
    urls = [f"http://{name(rnd.randint(1, 6))}/{rnd.choice(['', 'x', 'y'])}" for _ in range(900)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    monkeypatch.setattr(url_filters, "HOSTS", 3)
    got = url_filters.judge(pages, url_filters.rule_table(spark, rules)).collect()
    assert {(r.page_id, r.rule, r.verdict) for r in got} == {(k, *brute(u, rules)[2:]) for k, u in enumerate(urls)}
