"""Years of experience that a posting asks for, read from its text."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import plain_text_of
from .vectorized import vectorized

VERSION = 2
EXPERIENCE = "struct<min:double,max:double,max_open:boolean>"

# Number words.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12, "fifteen": 15}
# Fixed patterns: a range of years, and where one counts. White space is JavaScript's, word edges are ASCII.
_S = r"[\s ﻿]"
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_NUMBER = rf"([0-9]{{1,2}}(?:\.[0-9])?|{'|'.join(NUMBER_WORDS)})"
_RANGE = rf"(?<![0-9.]){_NUMBER}{_S}*\+?{_S}*(?:(?:-|–|—|to){_S}*{_NUMBER}{_S}*)?\+?{_S}*(?:years?|yrs?)\+?(?:['’]s?)?"
_EXPERIENCE = rf"{_B}(?:experiences?|exp){_E}"
_LEAST = rf"{_B}(?:minimum|min\.?|at least|atleast){_S}*(?:of{_S}*)?"
YEARS_FIRST = re.compile(rf"{_RANGE}(?:{_S}+of)?(?:{_S}+[A-Za-z0-9_/&,'’()-]+){{0,10}}?{_S}+(?:experiences?|exp){_E}", re.I)
WORD_FIRST = re.compile(rf"{_EXPERIENCE}[^.\n0-9]{{0,30}}?{_RANGE}", re.I)
LEAST_FIRST = re.compile(rf"{_LEAST}{_RANGE}", re.I)
ALONE = re.compile(rf"^[ \t]*(?:[•·-][ \t]*)?{_RANGE}[ \t]*[.!]?[ \t]*$", re.I | re.M)
_EMPLOYER = re.compile(
    rf"{_B}(?:our (?:company|firm|group|organi[sz]ation|brands?|history|legacy)|(?:company|firm|group) (?:has|with)|founded|established|history|legacy|heritage){_E}[^.\n?!:;•·-]*\Z", re.I
)
_LEAST_BEFORE = re.compile(rf"{_LEAST}\Z", re.I)
_OVERALL = re.compile(rf"{_B}(?:overall|total){_E}", re.I)
_OPEN = re.compile(rf"\+{_S}*(?:years?|yrs?)|(?:years?|yrs?){_S}*\+", re.I)


class Reading(NamedTuple):
    index: int
    quote: str
    priority: int
    low: float
    high: float | None
    high_open: bool


def _number(text: str | None) -> float | None:
    return None if not text else float(NUMBER_WORDS.get(text.lower(), 0) or text)


def readings_of(text: str) -> list[Reading]:
    """All ranges that count, best first: overall or total, then lines of their own, then the larger minimum."""
    low = text.lower()
    if "year" not in low and "yr" not in low:
        return []
    out = []
    for pattern in (YEARS_FIRST, WORD_FIRST, LEAST_FIRST, ALONE):
        for m in pattern.finditer(text):
            least, high = _number(m[1]), _number(m[2])
            if least is None or least > 20 or (high is not None and not least <= high <= 40):
                continue
            before = text[max(0, m.start() - 60) : m.start()]
            if pattern is not LEAST_FIRST and _EMPLOYER.search(before) and not _LEAST_BEFORE.search(before):
                continue
            # the clause begins after the last line feed or full stop before the match
            clause = max(text.rfind("\n", 0, m.start()), text.rfind(".", 0, m.start())) + 1
            priority = 3 if _OVERALL.search(text[clause : m.end()]) else 2 if pattern is ALONE else 1
            two_sided = high is not None and high != least
            out.append(Reading(m.start(), m[0], priority, least, high if two_sided else None, two_sided and _OPEN.search(m[0]) is not None))
    return sorted(out, key=lambda r: (-r.priority, -r.low, r.index))


def read_experience_of(description: str | None) -> Reading | None:
    found = readings_of(plain_text_of(description))
    return found[0] if found else None


@vectorized(EXPERIENCE)
def read_experience(description: pd.Series) -> pd.DataFrame:
    """The stated range of each description; null fields where none is."""
    found = [read_experience_of(d) for d in description]
    return pd.DataFrame({"min": [r and r.low for r in found], "max": [r and r.high for r in found], "max_open": [bool(r.high_open) if r else None for r in found]}).astype({"min": "float64", "max": "float64"})


def stated(experience: Column) -> Column:
    """The struct, or null where it holds no range."""
    return F.when(experience["min"].isNotNull() & ~F.isnan(experience["min"]), experience)


def title_is_entry(title: Column) -> Column:
    """Titles that say 0 to 1 year."""
    return title.rlike(r"(?i)(?<![A-Za-z0-9_])(?:intern|internship|trainee|freshers?|graduate|apprentice(?:ship)?|entry[- ]level)(?![A-Za-z0-9_])")


def _years(value: Column) -> Column:
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def experience_label(e: Column) -> Column:
    """"2–5 yrs", "5+ yrs"."""
    return F.when(e["max"].isNull(), F.concat(_years(e["min"]), F.lit("+ yrs"))).otherwise(F.concat(_years(e["min"]), F.lit("–"), _years(e["max"]), F.when(e["max_open"], "+").otherwise(""), F.lit(" yrs")))


def label_of(low: float, high: float | None, high_open: bool) -> str:
    say = lambda x: str(int(x)) if x == int(x) else str(x)
    return f"{say(low)}+ yrs" if high is None else f"{say(low)}–{say(high)}{'+' if high_open else ''} yrs"


def experience_matches(e: Column, years: float) -> Column:
    return (F.lit(years) >= e["min"]) & (e["max"].isNull() | F.coalesce(e["max_open"], F.lit(False)) | (F.lit(years) <= e["max"]))


def experience_filter(e: Column, years: float | None, include_unknown: bool) -> Column:
    """Without years everything; postings without a range only if asked for."""
    return F.lit(True) if years is None else F.coalesce(experience_matches(e, years), F.lit(include_unknown))


def with_experience(jobs):
    """Experience and its state from the description; a cached value counts only in the present version; else unread."""
    read = F.trim(F.coalesce("description", F.lit(""))) != ""
    fresh = jobs.withColumn("_read", F.when(read, stated(read_experience("description"))))
    kept = ~read & (F.col("experience_version") == VERSION)
    return fresh.select(
        *[c for c in jobs.columns if c not in ("experience", "experience_state", "experience_version")],
        F.when(read, F.col("_read")).when(kept, F.col("experience")).alias("experience"),
        F.when(read, F.when(F.col("_read").isNull(), "unstated").otherwise("stated")).when(kept, F.col("experience_state")).otherwise("unread").alias("experience_state"),
        F.when(read | kept, VERSION).alias("experience_version"),
    )
