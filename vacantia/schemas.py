"""Declared schemas of the tables; nothing is inferred."""

from __future__ import annotations

# Closed sets of names.
PROVIDERS = [
    "greenhouse", "lever", "ashby", "recruitee", "workday", "smartrecruiters", "workable", "breezy", "freshteam", "keka", "zohorecruit", "oraclecloud",
    "accenture", "infosys", "capgemini", "amazon", "jobposting",
]
WORK_MODES = ["remote", "hybrid", "onsite", "unknown"]
CONFIDENCE = ["explicit", "inferred", "unknown"]
AGES = ["new", "older", "stale", "undated"]

JOBS = (
    "source_slug string, ordinal long, id string, company string, title string, location string, remote boolean, work_mode string, eligible_countries array<string>, "
    "excluded_countries array<string>, eligible_regions array<string>, eligibility_confidence string, url string, updated_at timestamp, description string, skills string, "
    "experience struct<min:double,max:double,max_open:boolean>, experience_state string, experience_version int"
)
PARTITIONS = "source_slug string, fetched_at timestamp"
CATALOG = "source_slug string, name string, ats string, token string, cohorts array<string>, company_domain string, source_url string, domain_evidence_kind string"
CANDIDATES = "company_name string, company_domain string, slug string, source_url string, cohorts array<string>, channel string, reference string"

#: A snapshot file: one JSON object with the rows of each source under its slug.
SNAPSHOT_JOB = (
    "id string, company string, title string, location string, remote boolean, workMode string, eligibleCountries array<string>, excludedCountries array<string>, eligibleRegions array<string>, "
    "eligibilityConfidence string, url string, updatedAt string, description string, skills string, experience struct<min:double,max:double,maxOpen:boolean>, experienceVersion int"
)
SNAPSHOT = f"version int, updatedAt string, partitions map<string,struct<fetchedAt:string,jobs:array<struct<{SNAPSHOT_JOB.replace(', ', ',').replace(' ', ':')}>>>>"
