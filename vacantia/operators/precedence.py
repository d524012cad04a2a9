"""Operators in which order or precedence decides."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(rows: DataFrame, group: str, value: str, ordinal: str) -> DataFrame:
    """The most frequent non-empty value of each group; of equally frequent ones the first seen."""
    counted = rows.where(F.coalesce(value, F.lit("")) != "").groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"))
    return counted.groupBy(group).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias(value), F.max("n").alias("n"))


def round_robin(rows: DataFrame, group: str, ordinal: str) -> DataFrame:
    """Interleave groups: first rows of all groups, then second ones; groups in order of first sight. Adds ``turn``, ``group_first``."""
    own = Window.partitionBy(group).orderBy(ordinal)
    first = rows.groupBy(group).agg(F.min(ordinal).alias("group_first"))
    return rows.withColumn("turn", F.row_number().over(own)).join(first, group).orderBy("turn", "group_first")


def unique_match(left: DataFrame, right: DataFrame, left_keys: Column, right_keys: Column, id_: str, value: str) -> DataFrame:
    """Rows whose keys (arrays) meet exactly one distinct value on the right.

    Keys are exploded on both sides, so the theta join is an equi-join.
    """
    a = left.select(id_, F.explode(F.array_distinct(left_keys)).alias("key")).where(F.length("key") >= 3)
    b = right.select(value, F.explode(F.array_distinct(right_keys)).alias("key")).where(F.length("key") >= 3).distinct()
    met = a.join(b, "key").groupBy(id_).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value))
    return met.where("n = 1").drop("n")


def any_key_semi(left: DataFrame, right: DataFrame, left_keys: Column, right_keys: Column, anti: bool = False) -> DataFrame:
    """Rows of the left that share (or, ``anti``, do not share) any derived key with the right; repeated rows stay repeated.

    Only keys and row numbers meet the right side; whole rows are joined with the numbers that were met.
    """
    known = right.select(F.explode(right_keys).alias("_key")).distinct()
    rows = left.withColumn("_row", F.monotonically_increasing_id())
    met = rows.select("_row", F.explode(F.array_distinct(left_keys)).alias("_key")).join(known, "_key", "left_semi").select("_row").distinct()
    return rows.join(met, "_row", "left_anti" if anti else "left_semi").drop("_row")


def host_suffixes(host: Column) -> Column:
    """A host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def merged_length(rows: DataFrame, group: str, start: str, end: str, suppress: bool = True) -> DataFrame:
    """Total length of each group's intervals, overlaps counted once; suppressed (null) if an interval is open.

    Gaps and islands: an interval begins an island where no earlier one reaches it, and adds what lies beyond
    their reach. One window gives both, so equal intervals count alike in whatever order they come. Without
    ``suppress``, an open interval adds nothing and reaches nothing; it is an island where it lies in none.
    """
    closed = F.coalesce(end, start) if suppress else F.col(end)
    before = Window.partitionBy(group).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end)).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("_reach", F.max(closed).over(before)).withColumn("_new", F.when(F.col(start) <= F.col("_reach"), 0).otherwise(1))
    added = F.sum(F.when(F.col("_new") == 1, closed - F.col(start)).otherwise(F.greatest(closed - F.col("_reach"), F.lit(0))))
    length = F.when(~F.max(F.col(end).isNull()), added) if suppress else added
    return marked.groupBy(group).agg(length.alias("length"), F.sum("_new").alias("islands"))


def pick_priority(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows by an order (nulls as the order says); the rest are deferred. A top-k, no full sort."""
    return rows.orderBy(*order).limit(limit)


def country_rank(countries: str, wanted: list[str]) -> Column:
    """Best position among wanted countries over a job's countries; beyond the list if none."""
    at = F.transform(F.col(countries), lambda c: F.array_position(F.array(*map(F.lit, wanted)), c))
    return F.coalesce(F.array_min(F.filter(at, lambda k: k > 0)), F.lit(len(wanted) + 1))


def spaced_pages(pages: int, n: int) -> list[int]:
    """n page numbers from 1 to ``pages``, evenly spaced."""
    if n >= pages:
        return list(range(1, pages + 1))
    return list(dict.fromkeys(1 + int((k * (pages - 1)) / (n - 1) + 0.5) if n > 1 else 1 for k in range(n)))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows with the smallest seeded hashes of their key."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def sample_by_key(rows: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """First n distinct keys in order, and how many are missing to n."""
    found = rows.dropDuplicates([key]).orderBy(key).limit(n)
    return found, found.agg((F.lit(n) - F.count(F.lit(1))).alias("shortfall"))


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Chunks of a size in order; adds ``batch``. Rows are numbered within ranges of the order, then the ranges one after the other."""
    from ..functions.shared import cut

    ranged = cut(rows.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()))
    along = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranged.withColumn("_row", inside).join(F.broadcast(firsts), "_range").withColumn("batch", F.floor((F.col("_first") + F.col("_row")) / size)).select(*rows.columns, "batch")


def ordered_fold(rows: DataFrame, partition: str, order: str, schema: str, fold: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """A decision that depends on earlier decisions, one small group at a time."""
    return rows.groupBy(partition).applyInPandas(lambda pdf: fold(pdf.sort_values(order, kind="stable")), schema)


def dedupe_verified(rows: DataFrame) -> DataFrame:
    """Keep a verified source unless an earlier kept one has its source, its company domain or its slug.

    A row dropped earlier does not hold its keys, so this is a fold, not three windows. Rows that
    share no key cannot touch each other: the fold runs per connected group, found first.
    """
    from ..functions.graph import connected

    keyed = rows.withColumn("_keys", F.array(F.concat_ws("|", F.lit("source"), "ats", F.lower("token")), F.concat_ws("|", F.lit("domain"), F.lower("company_domain")), F.concat_ws("|", F.lit("slug"), "slug")))
    grouped = connected(keyed, "ordinal", "_keys")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: dict[str, str] = {}
        out = []
        for keys in pdf["_keys"]:
            hit = next((k for k in keys if k in seen), None)
            out.append(None if hit is None else "duplicate_" + hit.split("|")[0])
            if hit is None:
                seen.update(dict.fromkeys(keys, ""))
        return pdf.drop(columns=["_keys", "component"]).assign(rejected=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ordered_fold(grouped, "component", "ordinal", f"{fields}, rejected string", fold)


def allocate_slugs(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Slug of each row in order: its base, else ``ats-base``, else rejected; earlier rows and the catalog hold theirs.

    A base may be another row's ``ats-base``, so rows are folded per group that shares candidates. Of one provider's rows
    of one base only the first two can get a slug (after them both candidates are taken), so groups stay small.
    """
    from ..functions.graph import connected

    second = F.concat_ws("-", "ats", "base")
    turn = F.row_number().over(Window.partitionBy("ats", "base").orderBy("ordinal"))
    turned = rows.withColumn("_turn", turn)
    late = turned.where("_turn > 2").drop("_turn").withColumn("slug", F.lit(None).cast("string"))
    held = taken.select(F.col("slug").alias("_slug")).distinct()
    options = turned.where("_turn <= 2").drop("_turn").withColumn("_options", F.array("base", second))
    asked = options.select("ordinal", F.posexplode("_options").alias("_at", "_slug"))
    free = asked.join(held, "_slug", "left_anti").groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("_at", "_slug"))).alias("_free"))
    known = connected(options, "ordinal", "_options").join(free, "ordinal", "left")
    names = [*rows.columns, "slug"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        for candidates in pdf["_free"]:
            slug = next((c["_slug"] for c in (candidates if candidates is not None else []) if c["_slug"] not in used), None)
            out.append(slug)
            used.add(slug)
        return pdf.assign(slug=out)[names]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ordered_fold(known, "component", "ordinal", f"{fields}, slug string", fold).unionByName(late)
