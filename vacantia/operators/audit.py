"""Audits of a corpus of postings: one-pass reports, duplicate groups, n-grams, term prevalence."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, geo, text

# Cities of the coarse city buckets, in order of trial.
CITIES = ["bengaluru", "hyderabad", "pune", "mumbai", "chennai", "gurugram", "noida", "delhi"]
# Fixed patterns: overlapping title buckets.
TITLE_BUCKETS = {
    "backend": r"back[- ]?end", "frontend": r"front[- ]?end", "fullstack": r"full[- ]?stack", "data": r"(?:data|analytics|machine learning)", "infrastructure": r"(?:devops|sre|infrastructure|cloud)",
    "sales": r"(?:sales|account executive|business development)", "finance": r"(?:finance|accounting|accountant)",
}
# Fixed pattern and titles: the go-to-market title signal.
SIGNAL = r"(?i)(?<![A-Za-z0-9_])(?:gtm|revops|rev ops|growth engineer|growth automation|marketing engineer)(?![A-Za-z0-9_])"
SIGNAL_TITLES = ["gtm engineer", "revops engineer"]


def _whole(pattern: str) -> str:
    return rf"(?i)(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])"


def duplicate_groups(rows: DataFrame, *keys: Column) -> DataFrame:
    """Keys that more than one row has, with their counts."""
    named = rows.select(*[k.alias(f"key{n}") for n, k in enumerate(keys, 1)])
    return named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def age_counts(posted: str, now: datetime | Column) -> list[Column]:
    """Ages of an audit: the 7-day count lies in the 30-day one; the future counts apart."""
    ms = F.unix_millis(dates.instant(now)) - F.unix_millis(F.col(posted).cast("timestamp"))
    day = dates.DAY_MS
    return [
        F.count_if((ms >= 0) & (ms <= 7 * day)).alias("within_7_days"),
        F.count_if((ms >= 0) & (ms <= 30 * day)).alias("within_30_days"),
        F.count_if(ms > 30 * day).alias("older"),
        F.count_if(F.col(posted).isNull()).alias("undated"),
        F.count_if(ms < 0).alias("future_dated"),
    ]


def band_counts(value: Column, bands: list[tuple[str, float]], above: str) -> list[Column]:
    """Counts of a value by upper bounds, in order, each row in one band; nulls in none."""
    out, low = [], None
    for name, high in bands:
        inside = value <= high if low is None else (value > low) & (value <= high)
        out.append(F.count_if(inside).alias(name))
        low = high
    return [*out, F.count_if(value > low).alias(above)]


def city_bucket(location: Column) -> Column:
    place = geo.normalize_location(location)
    out = F.lit("other_or_unspecified")
    for city in reversed(CITIES):
        out = F.when(place.rlike(rf"(?<![A-Za-z0-9_]){city}(?![A-Za-z0-9_])"), city).otherwise(out)
    return out


def title_buckets(title: Column) -> Column:
    """All buckets a title falls in, or ``other``."""
    hit = F.array_compact(F.array(*[F.when(F.coalesce(title, F.lit("")).rlike(_whole(p)), F.lit(n)) for n, p in TITLE_BUCKETS.items()]))
    return F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit("other")))


def search_audit(jobs: DataFrame, partitions: DataFrame, country: str, as_of: datetime) -> dict[str, DataFrame]:
    """The coverage audit: one row of totals from one pass, and small histograms. Order of rows never matters."""
    own = jobs.where(geo.eligible_for(country)).withColumns(
        {"provider": F.coalesce(F.nullif(F.split("id", ":")[0], F.lit("")), F.lit("unknown")), "no_text": F.trim(F.coalesce("description", F.lit(""))) == "", "company_label": F.lower(F.trim("company"))}
    )
    low = F.col("experience.min")
    totals = own.agg(
        F.count(F.lit(1)).alias("eligible_jobs"),
        F.count_distinct("company_label").alias("distinct_company_labels"),
        (F.count(F.lit(1)) - F.count_distinct("id")).alias("repeated_ids"),
        F.count_if(F.trim(F.coalesce("title", F.lit(""))) == "").alias("missing_title"),
        F.count_if("no_text").alias("missing_description"),
        *age_counts("updated_at", as_of),
        *band_counts(low, [("zero_to_two", 2), ("three_to_five", 5), ("six_to_ten", 10)], "above_ten"),
        F.count_if(F.col("experience_state") == "unstated").alias("unstated"),
        F.count_if(F.col("experience_state") == "unread").alias("unread"),
    )
    ms = F.unix_millis(F.lit(as_of).cast("timestamp")) - F.unix_millis("fetched_at")
    alone = geo.classify(own.select("id", "location").withColumns({"description": F.lit(""), "work_mode": F.lit("unknown")}))
    review = alone.where((F.size("eligible_countries") > 0) & ~geo.eligible_for(country))
    return {
        "totals": totals,
        "partitions": partitions.agg(F.count(F.lit(1)).alias("partitions"), F.count_if(ms > 14 * dates.DAY_MS).alias("stale_partitions"), F.count_if(F.col("fetched_at").isNull()).alias("undated_partitions")),
        "providers": own.groupBy("provider").agg(F.count(F.lit(1)).alias("jobs"), F.count_if("no_text").alias("missing_descriptions")),
        "cities": own.groupBy(city_bucket(F.col("location")).alias("city")).agg(F.count(F.lit(1)).alias("jobs")),
        "titles": own.select(F.explode(title_buckets(F.col("title"))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("jobs")),
        "duplicates": duplicate_groups(own, F.col("company_label"), F.lower(F.trim("title")), geo.normalize_location(F.col("location"))),
        "location_review": review.select("id", "location", "eligible_countries").orderBy("id"),
    }


def _joined_neighbours(tokens: Column, n: int) -> Column:
    """Every n tokens in a row, joined by spaces; one pass over the array for each further token."""
    out = tokens
    for k in range(1, n):
        later = F.slice(tokens, F.lit(k + 1), F.size(tokens))
        out = F.zip_with(out, later, lambda a, b: F.concat(a, F.lit(" "), b))  # null where the tokens end
    return F.filter(out, lambda g: g.isNotNull())


def ngrams(clauses: DataFrame, clause: str, stop_words: list[str], n: int, top: int, token: str = "[a-z][a-z0-9+#.-]*") -> DataFrame:
    """The most frequent n-grams of clauses; stop words go before neighbours are taken; ties by the alphabet."""
    kept = F.filter(F.regexp_extract_all(F.lower(clause), F.lit(token), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(stop_words))
    grams = text.let(kept, lambda t: _joined_neighbours(t, n))
    counted = clauses.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "gram").limit(top)


def term_prevalence(clauses: DataFrame, id_: str, clause: str, terms: list[str], examples: int = 3) -> DataFrame:
    """Per term: mentions, distinct documents, the first documents by id as examples; by documents, mentions, term."""
    counts = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), text.count_phrase(F.col(clause), t).alias("mentions")) for t in terms]))
    hits = clauses.select(id_, counts.alias("c")).select(id_, "c.term", "c.mentions").where("mentions > 0")
    per_doc = hits.groupBy("term", id_).agg(F.sum("mentions").alias("mentions"))
    found = per_doc.groupBy("term").agg(F.sum("mentions").alias("mentions"), F.count(F.lit(1)).alias("documents"))
    turn = F.row_number().over(Window.partitionBy("term").orderBy(id_))
    first = per_doc.withColumn("_turn", turn).where(F.col("_turn") <= examples).groupBy("term").agg(F.array_sort(F.collect_list(id_)).alias("examples"))
    return found.join(first, "term", "left").orderBy(F.desc("documents"), F.desc("mentions"), "term")


def title_signal(title: Column) -> tuple[Column, Column]:
    """Whether a title carries the signal, and whether it is exactly one of its titles."""
    return F.coalesce(title, F.lit("")).rlike(SIGNAL), text.normalize_title(F.coalesce(title, F.lit(""))).isin(SIGNAL_TITLES)


def signal_countries(jobs: DataFrame) -> DataFrame:
    """Signal titles by country; jobs without a country count as unclassified."""
    hit, exact = title_signal(F.col("title"))
    places = F.when(F.size("eligible_countries") > 0, F.col("eligible_countries")).otherwise(F.array(F.lit("(unclassified)")))
    return jobs.where(hit).select(F.explode(places).alias("country"), exact.alias("exact")).groupBy("country").agg(F.count(F.lit(1)).alias("jobs"), F.count_if("exact").alias("exact_titles"))
