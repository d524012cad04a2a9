"""Sinks: stamped reports, content-addressed generations, guarded exports, posts."""

from __future__ import annotations

import gzip
import hashlib
import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Versions that reports are stamped with.
PIPELINE_VERSION, SCHEMA_VERSION = "1", 1
TRIES = 3


def stamped(report: dict, now: datetime) -> dict:
    return {"pipelineVersion": PIPELINE_VERSION, "schemaVersion": SCHEMA_VERSION, "generatedAt": now.isoformat() + "Z", **report}


def check_stamp(report: dict) -> dict:
    """A report of another schema version is not read."""
    if report.get("schemaVersion") != SCHEMA_VERSION:
        raise ValueError(f"unsupported report schema: {report.get('schemaVersion')}")
    return report


def write_report(spark, report: dict, path: str, now: datetime) -> None:
    """One JSON file, replaced as a whole by the file system's committer."""
    text = json.dumps(stamped(report, now), ensure_ascii=False, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_generation(rows: DataFrame, path: str) -> str:
    """Write rows under a name made of their content (rows hash alone, order does not matter); the same content is one folder."""
    hashed = rows.select(F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x")).first()
    name = hashlib.sha256(f"{hashed['n']}:{hashed['x']}:{','.join(sorted(rows.columns))}".encode()).hexdigest()[:16]
    rows.write.mode("overwrite").json(f"{path}/{name}")
    return name


def export_new(rows: DataFrame, path: str) -> None:
    """Refuses to overwrite."""
    rows.write.mode("errorifexists").json(path)


def post_partitions(jobs: DataFrame, send: Callable[[str, bytes], int]) -> DataFrame:
    """Post each source's rows, gzipped; statuses under 500 are final, others get three tries. Returns what happened.

    Posts run on the executors, one source at a time; ``send`` must be picklable.
    """

    def run(pdf):
        import pandas as pd

        slug = pdf["source_slug"].iloc[0]
        body = gzip.compress(pdf.sort_values("id").to_json(orient="records", date_format="iso").encode())
        status, tries = 0, 0
        while tries < TRIES and (status == 0 or status >= 500):
            tries += 1
            try:
                status = send(slug, body)
            except OSError:
                status = 599
        return pd.DataFrame([(slug, status, tries, len(body))], columns=["source_slug", "status", "tries", "bytes"])

    return jobs.groupBy("source_slug").applyInPandas(run, "source_slug string, status int, tries int, bytes long")


def usage_event(tool: str, given: dict, result: dict, now: datetime) -> dict:
    """A tool call in short: lists of at most 20 names, texts of at most 120 characters; no resume text."""
    short = lambda v: str(v)[:120]
    return {
        "ts": now, "tool": tool, "fields": sorted(given)[:20], "query": short(given["query"]) if isinstance(given.get("query"), str) else None,
        "countries": [short(c) for c in (given.get("countries") or (given.get("intent") or {}).get("countries") or [])][:20],
        "results": len(result.get("jobs") or result.get("matches") or []), "outcome": result.get("outcome"),
    }


def write_catalog(catalog: DataFrame, path: str) -> None:
    """The catalog by slug, one file, replaced as a whole."""
    catalog.orderBy("source_slug").coalesce(1).write.mode("overwrite").json(path)


def write_watches(spark, watches: dict[str, dict], path: str) -> None:
    """Stored searches ``name: {"profile": ..., "seen": [...]}``, a row each, replaced as a whole."""
    rows = [(name, json.dumps(w["profile"], ensure_ascii=False, sort_keys=True), list(w["seen"])) for name, w in sorted(watches.items())]
    spark.createDataFrame(rows, "name string, profile string, seen array<string>").coalesce(1).write.mode("overwrite").parquet(path)


def read_watches(spark, path: str) -> dict[str, dict]:
    """What ``write_watches`` stored; a missing or broken file is no watches."""
    try:
        rows = spark.read.schema("name string, profile string, seen array<string>").parquet(path).collect()
        return {r["name"]: {"profile": json.loads(r["profile"]), "seen": list(r["seen"])} for r in rows}
    except Exception:  # by definition: an unreadable file holds nothing
        return {}


def notify_new(rows: DataFrame, send: Callable[[str, str], None], shown: int = 3) -> int:
    """Tell of new matches through a callback, best effort: a title and the first few; returns how many there are."""
    n = rows.count()
    if n:
        names = [f"{r['title']} at {r['company']}" for r in rows.limit(shown).collect()]
        try:
            send(f"{n} new {'role' if n == 1 else 'roles'}", ", ".join(names))
        except OSError:
            pass
    return n
