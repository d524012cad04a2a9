"""Thin command line over the tools: ``python -m vacantia COMMAND --data FOLDER [--input JSON]``.

FOLDER holds ``jobs``, ``partitions`` and ``catalog`` as Parquet, and ``watches``; ``import`` makes them from a snapshot and a
catalog file, ``export`` writes a folder a source with a manifest, ``sources`` tells how fresh each source is.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession

from .api import FRESH_DAYS, SCOPES, Tools, select_sources
from .operators import audit, state
from .sources import snapshots

COMMANDS = {
    "search": "search_jobs", "get": "get_job", "coverage": "get_job_coverage", "recommend": "recommend_jobs", "fit": "analyze_job_fit", "optimize": "optimize_resume", "prepare": "prepare_job_search",
    "watch": "watch_jobs", "watches": "list_watches", "check": "check_watch", "stop": "stop_watch",
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vacantia")
    parser.add_argument("command", choices=["import", "export", "audit", "sources", *COMMANDS])
    parser.add_argument("--data", required=True)
    parser.add_argument("--input", default="{}", help="JSON of the tool's input")
    parser.add_argument("--now", help="ISO time, UTC; the clock if left out")
    parser.add_argument("--snapshot")
    parser.add_argument("--catalog")
    args = parser.parse_args(argv)
    now = datetime.fromisoformat(args.now) if args.now else datetime.now(timezone.utc).replace(tzinfo=None)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "import":
        jobs, partitions = snapshots.read_snapshot(spark, args.snapshot)
        jobs.write.mode("overwrite").partitionBy("source_slug").parquet(f"{args.data}/jobs")
        partitions.write.mode("overwrite").parquet(f"{args.data}/partitions")
        snapshots.read_catalog(spark, args.catalog).write.mode("overwrite").parquet(f"{args.data}/catalog")
        return 0
    jobs, partitions, catalog = (spark.read.parquet(f"{args.data}/{name}") for name in ("jobs", "partitions", "catalog"))
    given = json.loads(args.input)
    if args.command == "audit":
        report = audit.search_audit(jobs, partitions, given.get("country", "IN"), now)
        result = {name: [r.asDict(True) for r in rows.collect()] for name, rows in report.items()}
    elif args.command == "export":
        result = [r.asDict() for r in snapshots.export_snapshot(jobs, given["path"]).collect()]
    elif args.command == "sources":
        states = state.pending(select_sources(catalog, given.get("slugs"), given.get("country"), given.get("countries")), partitions, "source_slug", "fetched_at", now - timedelta(days=FRESH_DAYS))
        result = [r.asDict() for r in states.select("source_slug", "state", "fetched_at").orderBy("source_slug").collect()]
    else:
        assert COMMANDS[args.command] in SCOPES
        result = Tools(jobs, partitions, catalog, lambda: now, watch_path=f"{args.data}/watches").call(COMMANDS[args.command], given)
    json.dump(result, sys.stdout, default=lambda x: dataclasses.asdict(x) if dataclasses.is_dataclass(x) else str(x), ensure_ascii=False)
    print()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
