"""Employers of a hiring market: signals, a rolling map, what the catalog covers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text

ROLLING_DAYS = 30
PLACES = 5
# Stop words of market names, and employers known by names of another kind.
STOP_WORDS = [
    "the", "inc", "llc", "ltd", "limited", "pvt", "private", "corp", "corporation", "company", "co", "group", "india", "technologies", "technology", "solutions", "services", "global",
    "international", "plc", "llp", "and", "of", "com",
]
NAME_ALIASES = {
    "pricewaterhousecoopers": ["pwc"], "deutschebank": ["db"], "standardchartered": ["standard"], "spglobal": ["spgi"], "jonesianglasalle": ["jll"],
    "merck": ["msd"], "johnsonandjohnson": ["jj"], "wellsfargo": ["wf"], "northropgrumman": ["ngc"],
}


def employer_signals(posts: DataFrame, name: str, posted: str, category: str, place: str, ordinal: str, id_: str | None = None) -> DataFrame:
    """Per employer (its name in lower case): postings, latest date, categories, first five places, first spelling."""
    rows = posts.dropDuplicates([id_]) if id_ else posts
    keyed = rows.where(F.length(F.trim(name)) >= 2).withColumn("employer", F.lower(F.trim(name)))
    places = keyed.groupBy("employer", place).agg(F.min(ordinal).alias("_first")).where(F.coalesce(place, F.lit("")) != "")
    turn = F.row_number().over(Window.partitionBy("employer").orderBy("_first", place))
    few = places.withColumn("_turn", turn).where(F.col("_turn") <= PLACES)  # ranked before they are gathered
    first_places = few.groupBy("employer").agg(F.array_sort(F.collect_list(F.struct("_first", place))).alias("_places"))
    found = keyed.groupBy("employer").agg(
        F.min_by(F.trim(name), ordinal).alias("name"), F.count(F.lit(1)).alias("postings"), F.max(posted).alias("latest"), F.array_sort(F.collect_set(category)).alias("categories")
    )
    return found.join(first_places, "employer", "left").withColumn("places", F.transform("_places", lambda p: p[place])).drop("_places")


def rolling_market(posts: DataFrame, id_: str, employer: str, created: str, now: datetime | Column, days: int = ROLLING_DAYS) -> DataFrame:
    """Postings of the last days per employer, each id once. Recomputed from the deduplicated log, so it needs no state."""
    live = posts.where(F.unix_millis(F.col(created).cast("timestamp")) >= F.unix_millis(dates.instant(now)) - days * dates.DAY_MS)
    once = live.groupBy(id_).agg(F.min(F.struct(created, employer)).alias("p")).select(F.col("p")[employer].alias(employer), F.col("p")[created].alias(created))
    return once.groupBy(employer).agg(F.count(F.lit(1)).alias("postings"), F.min(created).alias("first_seen"), F.max(created).alias("last_seen"))


def name_keys(name: Column) -> Column:
    """Keys a market name may be known by: joined, with and without stop words, alias, a first word of four letters."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "&", " and "), "[^a-z0-9 ]+", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    core = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    base = F.when(F.size(core) > 0, core).otherwise(words)
    full = F.array_join(base, "")
    table = F.create_map(*[x for k, v in NAME_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    first = F.get(base, F.lit(0))
    lone = F.when(F.length(first) >= 4, F.array(first)).otherwise(none)
    keys = F.concat(F.array(full, F.array_join(words, "")), F.coalesce(F.try_element_at(table, full), none), lone)
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) >= 2))


def catalog_keys() -> Column:
    """Squashed slug, name, token host label, domain label; of three letters and more."""
    label = lambda c: F.split(F.split(F.coalesce(c, F.lit("")), "/")[0], r"\.")[0]
    keys = F.array(text.squash(F.col("slug")), text.squash(F.col("name")), text.squash(label(F.col("token"))), text.squash(label(F.col("company_domain"))))
    return F.filter(keys, lambda k: F.length(k) >= 3)


def covered(employers: DataFrame, catalog: DataFrame, keys: Column | None = None, known: Column | None = None) -> DataFrame:
    """Adds ``covered``: any key of the employer is known. Keys are exploded, the join is on equality."""
    names = employers.columns
    held = catalog.select(F.explode(catalog_keys() if known is None else known).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    asked = employers.select(F.struct(*names).alias("_all"), F.explode_outer(name_keys(F.col("name")) if keys is None else keys).alias("_key"))
    return asked.join(held, "_key", "left").groupBy("_all").agg(F.coalesce(F.max("_hit"), F.lit(False)).alias("covered")).select("_all.*", "covered")


def coverage_totals(marked: DataFrame) -> DataFrame:
    n, hit = F.lit(1), F.col("covered")
    return marked.agg(
        F.count(n).alias("employers"), F.coalesce(F.sum("postings"), F.lit(0)).alias("postings"), F.count_if(hit).alias("covered_employers"),
        F.coalesce(F.sum(F.when(hit, F.col("postings"))), F.lit(0)).alias("covered_postings"),
    )


def uncovered_top(marked: DataFrame, limit: int = 50) -> DataFrame:
    return marked.where(~F.col("covered")).orderBy(F.desc("postings"), "employer").limit(limit)
