"""Rows of postings for tests."""

from datetime import datetime, timedelta

from vacantia import schemas

NOW = datetime(2026, 9, 1, 12)


def job(id_, title="Engineer", days=1.0, **more):
    base = {
        "source_slug": "acme", "ordinal": 0, "id": id_, "company": "Acme", "title": title, "location": "Pune, India", "remote": False, "work_mode": "onsite", "eligible_countries": ["IN"],
        "excluded_countries": [], "eligible_regions": [], "eligibility_confidence": "explicit", "url": f"https://x/{id_}", "updated_at": None if days is None else NOW - timedelta(days=days),
        "description": "", "skills": None, "experience": None, "experience_state": "unread", "experience_version": None,
    }
    return base | more


def jobs(spark, rows):
    names = [c.strip().split(" ")[0] for c in schemas.JOBS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schemas.JOBS)
