"""Snapshots, catalogs and registries: JSON files in, tables out, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import dates, urls


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``jobs`` and ``partitions`` of a snapshot file of version 1. Import once, then work on Parquet."""
    raw = spark.read.schema(schemas.SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    head = raw.select("version").first()
    if head is None or head["version"] != 1:
        raise ValueError("unsupported snapshot version")
    parts = raw.select(F.explode("partitions").alias("source_slug", "p"))
    rows = parts.select("source_slug", F.posexplode("p.jobs").alias("ordinal", "j"))
    state = F.when(F.col("j.experience").isNotNull(), "stated").when(F.col("j.experienceVersion").isNotNull(), "unstated").otherwise("unread")
    jobs = rows.select(
        "source_slug", F.col("ordinal").cast("long").alias("ordinal"), "j.id", "j.company", "j.title", "j.location", "j.remote", F.col("j.workMode").alias("work_mode"),
        F.col("j.eligibleCountries").alias("eligible_countries"), F.col("j.excludedCountries").alias("excluded_countries"), F.col("j.eligibleRegions").alias("eligible_regions"),
        F.col("j.eligibilityConfidence").alias("eligibility_confidence"), "j.url", dates.lenient_timestamp(F.col("j.updatedAt")).alias("updated_at"), "j.description", "j.skills",
        F.when(F.col("j.experience").isNotNull(), F.struct(F.col("j.experience.min").alias("min"), F.col("j.experience.max").alias("max"), F.col("j.experience.maxOpen").alias("max_open"))).alias("experience"),
        state.alias("experience_state"), F.col("j.experienceVersion").alias("experience_version"),
    )
    return jobs, parts.select("source_slug", dates.lenient_timestamp(F.col("p.fetchedAt")).alias("fetched_at"))


def write_partitions(jobs: DataFrame, path: str) -> None:
    """Replace the partitions that the rows belong to, all at once; others stay."""
    jobs.repartition("source_slug").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_slug").parquet(path)


def export_manifest(jobs: DataFrame) -> DataFrame:
    """Per source: jobs and a content hash of its rows in any order (number, sum and exclusive-or of row hashes, so no source is gathered)."""
    rows = jobs.withColumn("_h", F.xxhash64(F.to_json(F.struct(*sorted(jobs.columns)))))
    hashed = rows.groupBy("source_slug").agg(F.count(F.lit(1)).alias("jobs"), F.sum(F.col("_h").cast("decimal(20,0)")).alias("_sum"), F.bit_xor("_h").alias("_xor"))
    return hashed.select("source_slug", "jobs", F.sha2(F.concat_ws(":", F.col("jobs"), F.col("_sum").cast("string"), F.col("_xor")), 256).alias("sha256"))


SAFE_SLUG = "^[a-z0-9]+(?:-[a-z0-9]+)*$"


def export_snapshot(jobs: DataFrame, path: str) -> DataFrame:
    """One folder of JSON lines a source (rows by id), folders of sources that are gone removed, then the manifest; returns it.

    An unsafe slug fails the export before anything is written.
    """
    if not jobs.where(~F.col("source_slug").rlike(SAFE_SLUG)).isEmpty():
        raise ValueError("the snapshot holds an unsafe source slug")
    spark = jobs.sparkSession
    out = f"{path}/sources"
    jobs.repartition("source_slug").sortWithinPartitions("source_slug", "id").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("source_slug").json(out)
    manifest = export_manifest(jobs).withColumn("path", F.concat(F.lit("sources/source_slug="), F.col("source_slug")))
    manifest.orderBy("source_slug").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of candidates; one of another shape fails it all."""
    entry = "struct<companyName:string,companyDomain:string,slug:string,sourceUrl:string,cohorts:array<string>,discoveredFrom:struct<channel:string,reference:string>>"
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"array<{entry}>", {"mode": "FAILFAST"})).alias("c"))
    out = rows.select(
        F.col("c.companyName").alias("company_name"), F.col("c.companyDomain").alias("company_domain"), "c.slug", F.col("c.sourceUrl").alias("source_url"), "c.cohorts",
        F.col("c.discoveredFrom.channel").alias("channel"), F.col("c.discoveredFrom.reference").alias("reference"),
    )
    bad = F.col("company_name").isNull() | F.col("company_domain").isNull() | F.col("source_url").isNull() | F.col("channel").isNull()
    checked = out.withColumn("_ok", F.assert_true(~bad, F.lit("invalid source candidate")))
    return checked.where(F.col("_ok").isNull()).drop("_ok")


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """The last crawl of a snapshot file; more outcomes than sources selected fail it."""
    from ..operators.coverage import valid_snapshot

    shape = "lastCrawl struct<startedAt:string,finishedAt:string,selected:long,succeeded:long,failed:array<struct<source:string,error:string>>>"
    raw = spark.read.schema(shape).option("multiLine", True).option("mode", "FAILFAST").json(path).where("lastCrawl IS NOT NULL").select("lastCrawl.*")
    crawl = raw.select(dates.lenient_timestamp(F.col("startedAt")).alias("started_at"), dates.lenient_timestamp(F.col("finishedAt")).alias("finished_at"), "selected", "succeeded", F.size("failed").alias("failed"))
    checked = crawl.withColumn("_ok", F.assert_true(valid_snapshot(crawl), F.lit("a crawl has more outcomes than sources")))
    return checked.where(F.col("_ok").isNull()).drop("_ok")


def seed_snapshot(spark: SparkSession, path: str, country: str | None = None) -> tuple[DataFrame, DataFrame] | None:
    """A snapshot to begin with, jobs of a country alone if asked; none if it cannot be read."""
    from ..functions import geo

    try:
        jobs, parts = read_snapshot(spark, path)
    except Exception:  # a seed is a convenience: whatever is wrong with it, the crawl goes on without
        return None
    return (jobs.where(geo.eligible_for(country)) if country else jobs), parts


def without_descriptions(jobs: DataFrame) -> DataFrame:
    """Rows with blank descriptions; what was read from these stays."""
    return jobs.withColumn("description", F.lit(""))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog object keyed by slug, as rows; one bad row fails it all."""
    entry = "struct<name:string,ats:string,token:string,cohorts:array<string>,companyDomain:string,sourceUrl:string,domainEvidence:struct<kind:string,reference:string>>"
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"map<string,{entry}>", {"mode": "FAILFAST"})).alias("source_slug", "c"))
    out = rows.select("source_slug", "c.name", "c.ats", "c.token", "c.cohorts", F.col("c.companyDomain").alias("company_domain"), F.col("c.sourceUrl").alias("source_url"), F.col("c.domainEvidence.kind").alias("domain_evidence_kind"))
    bad = ~F.col("ats").isin(schemas.PROVIDERS) | F.col("name").isNull() | F.col("token").isNull() | (F.col("company_domain").isNull() & (F.coalesce("domain_evidence_kind", F.lit("")) != "provider_board"))
    checked = out.withColumn("_ok", F.assert_true(~bad, F.concat(F.lit("invalid catalog entry: "), F.col("source_slug"))))
    return checked.where(F.col("_ok").isNull()).drop("_ok")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Leads whose key agrees with their provider and token; a missing file is an empty registry."""
    from ..operators.registry import LEAD

    try:
        rows = spark.read.schema(LEAD).option("mode", "FAILFAST").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEAD)
    return rows.where(F.col("source_key") == urls.source_key(F.col("ats"), F.col("token")))


def read_index_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Crawl-index lines ``{"url": ...}`` as boards, and the lines that are none."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.withColumn("url", F.get_json_object("value", "$.url")).withColumn("board", urls.resolve(F.col("url")))
    return parsed.where("board IS NOT NULL").select("url", "board.ats", "board.token"), parsed.where("board IS NULL").select("value", "url")


def read_seed_list(spark: SparkSession, path: str, third_party: list[str]) -> DataFrame:
    """Employers of a Markdown or HTML list of links; hosts of third parties are left out; the last of a pair wins."""
    text = spark.read.text(path, wholetext=True)
    marks = F.regexp_extract_all("value", F.lit(r"\[([^\]]+)\]\((https?://[^)\s]+)\)"), F.lit(0))
    anchors = F.regexp_extract_all("value", F.lit(r"""(?i)<a\s[^>]*href\s*=\s*["']https?://[^"']+["'][^>]*>[^<]+</a>"""), F.lit(0))
    rows = text.select(F.posexplode(F.concat(marks, anchors)).alias("ordinal", "m"))
    name = F.coalesce(F.nullif(F.regexp_extract("m", r"^\[([^\]]+)\]", 1), F.lit("")), F.regexp_extract("m", r">([^<]+)</a>", 1))
    link = F.coalesce(F.nullif(F.regexp_extract("m", r"\]\(([^)\s]+)\)", 1), F.lit("")), F.regexp_extract("m", r"""(?i)href\s*=\s*["']([^"']+)["']""", 1))
    out = rows.select("ordinal", F.trim(name).alias("name"), link.alias("url")).where(~urls.registrable_domain(urls.host(F.col("url"))).isin(third_party))
    return out.groupBy("name", "url").agg(F.max("ordinal").alias("ordinal"))


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Excluded boards ``ats:token`` of a JSON list, in lower case."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<string>")).alias("key")).select(F.lower("key").alias("key")).distinct()


def keka_tenants(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid tenant hosts with a website (candidates) and without one (leads), from lines ``host,website``."""
    rows = spark.read.text(path).select(F.lower(F.trim(F.split("value", ",")[0])).alias("host"), F.nullif(F.trim(F.coalesce(F.get(F.split("value", ","), F.lit(1)), F.lit(""))), F.lit("")).alias("website"))
    valid = rows.where(F.col("host").rlike(r"^[a-z0-9-]+\.keka\.com$") & ~F.split("host", r"\.")[0].isin(urls.NO_TENANT["keka"])).distinct()
    return valid.where("website IS NOT NULL"), valid.where("website IS NULL").select("host")
