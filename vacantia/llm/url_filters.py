"""URL filters as a sort-merge range join; DataFrame functions alone.

A host's canonical key is its labels in reverse, each ended by a dot (``www.example.com`` is
``com.example.www.``), so a rule's host and all its subdomains are the one interval of keys that
begin with the rule's. These intervals are nested or apart. Distinct hosts and rules are sorted
together in key ranges, and one sweep runs along each range. It keeps a stack with a level for every
number of labels: a rule's key, when its interval begins, is pushed on the level of its length, over
what lay there (an interval that has ended, since two intervals of one length never overlap). At a
host, the levels whose interval has ended, that is, whose key the host's does not begin with, are
popped; what is left are the active rules, outermost first. Every range starts with the levels that
are open at its lower end. Of the active rules, those fit whose path the URL's path begins with; the
longest wins.

URLs of one host meet the sweep as one host, so a host of a third of all rows costs one row there;
the join back is an equi-join that AQE can split. Range bounds come from a sample of hosts, one range
for every ``HOSTS`` of them, at least ``RANGES``. Rules are a stated set: those of one host key lie
on the stack together, as one array.

Defined results: null URLs, and those without ``://``, have empty host and path, no rule and the
default verdict; a URL without a path has an empty path, which fits no rule; of equally long rules
block wins; repeated rows are judged row by row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, literal_rows, lower_ascii

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
DEFAULT = "allow"
RANGES = 64
HOSTS = 200_000
#: Sampled hosts for every range.
SAMPLE = 64


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    return literal_rows(spark, [{"rule": r, "verdict": v} for r, v in rules], "rule:string,verdict:string")


def _opened(rules: DataFrame) -> DataFrame:
    """``key, level, held``: each rule host's key, its number of labels, its rules."""
    slash = F.instr("rule", "/")
    host = F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule"))
    path = F.when(slash > 0, F.substring("rule", slash, F.length("rule"))).otherwise(F.lit("/"))
    known = rules.where("rule is not null").select(host_key(lower_ascii(host)).alias("key"), F.length("rule").alias("length"), "verdict", path.alias("path"), "rule").distinct()
    held = known.groupBy("key").agg(F.collect_list(F.struct("length", "verdict", "path", "rule")).alias("held"))
    return held.select("key", (F.size(F.split("key", r"\.")) - 1).alias("level"), "held")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of pages."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = cut(urls.select("host").distinct().select("host", host_key(F.col("host")).alias("key")))
    ranges = max(RANGES, -(-hosts.count() // HOSTS))
    sample = sorted(r[0] for r in hosts.orderBy(F.xxhash64("key"), "key").limit(SAMPLE * ranges).select("key").distinct().collect())
    bounds = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []
    range_of = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("key"))) if bounds else F.lit(0)

    opened = cut(_opened(rules).withColumn("range", range_of))
    levels = [r[0] for r in opened.select("level").distinct().orderBy("level").collect()]
    # the last key of each level is still on the stack where later ranges begin, up to the next of its level
    last = opened.groupBy("level", "range").agg(F.max_by(F.struct("key", "held"), "key").alias("rule"))
    until = F.coalesce(F.lead("range").over(Window.partitionBy("level").orderBy("range")), F.lit(len(bounds)))
    carried = last.withColumn("until", until).where("range < until").select(F.explode(F.sequence(F.col("range") + 1, F.col("until"))).alias("range"), F.lit("").alias("key"), "level", "rule")
    pushed = opened.select("range", "key", "level", F.struct("key", "held").alias("rule")).unionByName(carried)
    nothing = F.lit(None)
    events = pushed.select("range", "key", F.lit(0).alias("kind"), "level", "rule", nothing.cast("string").alias("host")).unionByName(
        hosts.select(range_of.alias("range"), "key", F.lit(1).alias("kind"), nothing.cast("int").alias("level"), nothing.cast(pushed.schema["rule"].dataType).alias("rule"), "host")
    )
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = [F.last(F.when(F.col("level") == n, F.col("rule")), ignorenulls=True).over(sweep) for n in levels]
    swept = events.withColumn("stack", F.array(*stack) if stack else F.array().cast(f"array<{pushed.schema['rule'].dataType.simpleString()}>")).where("kind = 1")
    active = F.filter("stack", lambda r: r.isNotNull() & F.col("key").startswith(r["key"]))
    found = swept.select(F.col("host").alias("swept_host"), F.flatten(F.transform(active, lambda r: r["held"])).alias("active")).where(F.size("active") > 0)

    joined = urls.join(found, urls["host"] == found["swept_host"], "left")
    best = F.array_max(F.transform(F.filter("active", lambda r: F.col("path").startswith(r["path"])), lambda r: F.struct(r["length"], r["verdict"], r["rule"])))
    return joined.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
