import json

import pytest
from vacantia.sources import sinks

from .helpers import NOW, job, jobs


def test_reports_and_generations(spark, tmp_path):
    sinks.write_report(spark, {"a": 1}, f"{tmp_path}/r", NOW)
    sinks.write_report(spark, {"a": 2}, f"{tmp_path}/r", NOW)
    got = json.loads(spark.read.text(f"{tmp_path}/r").first().value)
    assert sinks.check_stamp(got)["a"] == 2
    with pytest.raises(ValueError):
        sinks.check_stamp({"schemaVersion": 9})
    rows = jobs(spark, [job("a"), job("b")])
    one, two, other = sinks.write_generation(rows, f"{tmp_path}/g"), sinks.write_generation(rows.orderBy("title", "id"), f"{tmp_path}/g"), sinks.write_generation(rows.limit(1), f"{tmp_path}/g")
    assert one == two != other
    sinks.export_new(rows, f"{tmp_path}/x")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.export_new(rows, f"{tmp_path}/x")


def test_posts(spark):
    rows = jobs(spark, [job("a"), job("b", source_slug="bad"), job("c", source_slug="down")])

    def send(slug, body):
        if slug == "down":
            raise OSError
        return 404 if slug == "bad" else 200

    assert {(r.source_slug, r.status, r.tries) for r in sinks.post_partitions(rows, send).collect()} == {("acme", 200, 1), ("bad", 404, 1), ("down", 599, 3)}


def test_usage_events():
    e = sinks.usage_event("search_jobs", {"query": "x" * 500, "resume": {"content": "secret"}}, {"jobs": [1, 2]}, NOW)
    assert len(e["query"]) == 120 and e["results"] == 2 and "secret" not in str(e)
