"""The library's functions under SQL names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import experience, html


def _pandas(function, kind: str):
    return F.pandas_udf(lambda text: pd.Series([function(t) for t in text]), kind)


def register(spark: SparkSession) -> list[str]:
    """Register the functions that built-ins cannot express, as SQL functions and one table function; returns their names."""
    from ..operators import requirements

    scalar = {
        "plain_text": _pandas(lambda t: None if t is None else html.plain_text_of(t), "string"),
        "decode_entities": _pandas(lambda t: None if t is None else html.decode_entities_of(t), "string"),
        "requirement_terms": _pandas(lambda t: requirements.detect_terms(t or ""), "array<string>"),
        "required_terms": _pandas(requirements.detected_requirements, "array<string>"),
        "stated_years": _pandas(requirements.stated_years, "double"),
    }
    for name, function in scalar.items():
        spark.udf.register(name, function)

    @F.udtf(returnType=html.POSTING)
    class JobPostings:
        def eval(self, page: str, url: str):
            for node in html.postings_of(page):
                row = html.posting_row(node, url)
                if row:
                    yield tuple(row.values())

    @F.udtf(returnType="min double, max double, max_open boolean, quote string")
    class StatedExperience:
        def eval(self, description: str):
            for r in experience.readings_of(html.plain_text_of(description)):
                yield float(r.low), None if r.high is None else float(r.high), r.high_open, r.quote

    spark.udtf.register("job_postings", JobPostings)
    spark.udtf.register("experience_readings", StatedExperience)
    return [*scalar, "job_postings", "experience_readings"]
