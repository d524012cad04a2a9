"""Text out of HTML, links, structured postings. Column expressions where built-ins can, Arrow-batched Python else."""

from __future__ import annotations

import hashlib
import json
import re
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectorized import vectorized

# Named entities that are decoded.
ENTITIES = {"nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "hellip": "…"}
_ENTITY = re.compile(r"&(#[0-9]{1,7}|#x[0-9a-f]{1,6}|[a-z]{2,8});", re.I)
#: What JavaScript's trim and \s take as white space.
WHITE = "\t\n\v\f\r    -     　﻿"


def trim(text: str) -> str:
    return re.sub(f"^[{WHITE}]+|[{WHITE}]+\\Z", "", text)


def _entity(m: re.Match) -> str:
    code = m[1]
    if not code.startswith("#"):
        return ENTITIES.get(code.lower(), m[0])
    point = int(code[2:], 16) if code[1] in "xX" else int(code[1:])
    return chr(point) if 0 < point <= 0x10FFFF and not 0xD800 <= point <= 0xDFFF else m[0]


def decode_entities_of(text: str) -> str:
    """One pass: an escaped ampersand never begins another entity."""
    return _ENTITY.sub(_entity, text)


def plain_text_of(text: str | None) -> str:
    """Line feeds at breaks and block ends, other tags out, entities decoded, blank space thinned."""
    out = re.sub(r"<br\s*/?\s*>|</(?:p|li|div|h[1-6])>", "\n", text or "", flags=re.I)
    out = decode_entities_of(re.sub("<[^>]+>", "", out))
    return trim(re.sub("\n{3,}", "\n\n", re.sub("[ \t]+\n", "\n", out)))


def strip_html_of(text: str | None) -> str:
    """The catalog's variant: paragraphs end in a blank line, list items do not end a line."""
    out = re.sub(r"<br\s*/?\s*>", "\n", text or "", flags=re.I)
    out = re.sub("<[^>]+>", "", re.sub("</p>", "\n\n", out, flags=re.I))
    return trim(re.sub("\n{3,}", "\n\n", decode_entities_of(out)))


def structured_text_of(text: str | None) -> str:
    """The screening variant: breaks and headings end lines, tags become spaces, runs of blanks one."""
    out = re.sub(r"<br\s*/?>|</h[1-6]>", "\n", text or "", flags=re.I)
    out = re.sub("&nbsp;|&#160;| ", " ", re.sub("<[^>]+>", " ", out), flags=re.I)
    return re.sub("[ \t]+", " ", re.sub("&amp;", "&", out, flags=re.I))


@vectorized("string")
def decode_entities(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else decode_entities_of(t))


@vectorized("string")
def plain_text(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else plain_text_of(t))


@vectorized("string")
def strip_html(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else strip_html_of(t))


def hrefs(html: Column) -> Column:
    """Values of href attributes without fragments or blanks, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"'#\s]+)["']"""), F.lit(1))


def links_of(html: str, base: str) -> list[str]:
    """Absolute https links of a page, distinct, in order."""
    out: dict[str, None] = {}
    for value in re.findall(r"""href\s*=\s*["']([^"'#\s]+)["']""", html or "", flags=re.I):
        try:
            url = urljoin(base, value)
            parts = urlsplit(url)
            if parts.scheme == "https" and parts.hostname:
                out[url if parts.path else url + "/"] = None
        except ValueError:
            continue
    return list(out)


@vectorized("array<string>")
def extract_links(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([links_of(h, b) for h, b in zip(html, base, strict=True)])


def ld_json_blocks(html: Column) -> Column:
    """Bodies of ld+json scripts."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))


_LD = re.compile(r"""<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>([\s\S]*?)</script>""", re.I)
DEPTH = 6
DESCRIPTION_LIMIT = 20_000


# Keys under which further nodes stand.
NESTING = ("@graph", "itemListElement", "item", "mainEntity", "hasPart")


def _job_nodes(root) -> list[dict]:
    """Nodes typed as job postings, in the order of reading, down to a depth."""
    out, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        inner = []
        if isinstance(node, list):
            inner = node
        elif isinstance(node, dict):
            kinds = node.get("@type")
            if "jobposting" in {str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])}:
                out.append(node)
            inner = [node[k] for k in NESTING if k in node]
        if depth < DEPTH:
            todo += [(x, depth + 1) for x in reversed(inner)]
    return out


def postings_of(html: str | None) -> list[dict]:
    """Raw job postings of a page's ld+json blocks, through graphs and lists; malformed blocks are skipped."""
    out: list[dict] = []
    for block in _LD.findall(html or ""):
        try:
            out += _job_nodes(json.loads(re.sub("^<!--|-->\\Z", "", trim(block))))
        except ValueError:
            continue
    return out


def _text(value) -> str:
    return trim(value) if isinstance(value, str) else ""


def _place(value: dict, country_label) -> str:
    """City, region and country of a place's address, else its name."""
    address = value["address"] if isinstance(value.get("address"), dict) else value
    country = _text(address.get("addressCountry"))
    parts = [_text(address.get("addressLocality")), _text(address.get("addressRegion")), country_label(country) if country else ""]
    held = value.get("address")
    return ", ".join(filter(None, parts)) or _text(value.get("name")) or (held if isinstance(held, str) else "")


def _dicts(value) -> list[dict]:
    return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]


def site_text_of(text: str) -> str:
    """The company-site variant: tags to spaces, entities decoded, white space to one space."""
    return trim(re.sub(f"[{WHITE}]+", " ", decode_entities_of(re.sub("<[^>]+>", " ", text))))


def fnv1a_of(text: str) -> str:
    """FNV-1a of 32 bits over UTF-16 units, in hex."""
    h = 0x811C9DC5
    raw = text.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(raw), 2):
        h = ((h ^ (raw[k] | raw[k + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


def posting_row(node: dict, page: str, country_label=lambda c: c) -> dict | None:
    """A posting as columns; without a title there is none."""
    title = _text(node.get("title")) or _text(node.get("name"))
    if not title:
        return None
    employer, identifier, about = node.get("hiringOrganization"), node.get("identifier"), node.get("mainEntityOfPage")
    where = "; ".join(filter(None, (_place(p, country_label) for p in _dicts(node.get("jobLocation")))))
    remote = "TELECOMMUTE" in str(node.get("jobLocationType") or "").upper()
    allowed = "; ".join(filter(None, (_text(a.get("name")) for a in _dicts(node.get("applicantLocationRequirements")))))
    url = _text(node.get("url")) or (_text(about.get("@id")) if isinstance(about, dict) else _text(about)) or page
    try:
        url = urljoin(page, url)
    except ValueError:
        url = page
    return {
        "identifier": (_text(identifier.get("value")) or _text(identifier.get("name")) if isinstance(identifier, dict) else _text(identifier)) or None,
        "title": title,
        "company": (_text(employer.get("name")) if isinstance(employer, dict) else _text(employer)) or None,
        "location": where or ((f"Remote ({allowed})" if allowed else "Remote") if remote else "Unspecified"),
        "remote": remote,
        "date_posted": _text(node.get("datePosted")) or None,
        "valid_through": _text(node.get("validThrough")) or None,
        "url": url,
        "description": site_text_of(_text(node.get("description")))[:DESCRIPTION_LIMIT],
        "signature": stable_hash(node),
    }


def stable_hash(value) -> str:
    """Hash of a JSON value whose keys are sorted at every level."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


POSTING = "identifier string, title string, company string, location string, remote boolean, date_posted string, valid_through string, url string, description string, signature string"


@vectorized(f"array<struct<{POSTING.replace(' ', ':').replace(',:', ',')}>>")
def extract_postings(html: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([[r for n in postings_of(h) if (r := posting_row(n, u))] for h, u in zip(html, url, strict=True)])


def sitemap_locations(xml: Column) -> Column:
    """https addresses of a sitemap."""
    found = F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return F.filter(found, lambda u: u.startswith("https://"))


def robots_prefix_allows(body: str | None, path: str, agent: str) -> bool:
    """The plain reading: a disallowed prefix for everyone or for this agent."""
    applies, barred = False, []
    for raw in re.split("\r?\n", body or ""):
        line = trim(re.sub("#.*", "", raw))
        if m := re.match(r"user-agent:\s*(.+)\Z", line, re.I):
            name = trim(m[1]).lower()
            applies = name == "*" or agent in name
        elif (m := re.match(r"disallow:\s*(.*)\Z", line, re.I)) and applies and trim(m[1]):
            barred.append(trim(m[1]))
    return not any(path.startswith(p) for p in barred)


def robots_longest_allows(body: str | None, path: str, agent: str) -> bool:
    """The strict reading: of the rules that match (* and $ count), the longest decides; allow wins a tie."""
    groups: list[tuple[list[str], list[tuple[bool, str]]]] = []
    open_names = False
    for raw in re.split("\r?\n", body or ""):
        line = trim(re.sub("#.*", "", raw))
        m = re.match(r"(user-agent|allow|disallow)\s*:\s*(.*)\Z", line, re.I)
        if not m:
            continue
        if m[1].lower() == "user-agent":
            if not open_names:
                groups.append(([], []))
            groups[-1][0].append(m[2].lower())
            open_names = True
        else:
            open_names = False
            if groups and m[2]:
                groups[-1][1].append((m[1].lower() == "allow", m[2]))
    own = [r for names, r in groups if any(n != "*" and n and n in agent for n in names)] or [r for names, r in groups if "*" in names]
    best = (-1, True)
    for allow, rule in (x for r in own for x in r):
        pattern = "".join(".*" if c == "*" else re.escape(c) for c in rule.removesuffix("$")) + (r"\Z" if rule.endswith("$") else "")
        if re.match(pattern, path, re.S):
            best = max(best, (len(rule), allow))
    return best[1]


@vectorized("boolean")
def robots_allows(body: pd.Series, path: pd.Series, agent: pd.Series) -> pd.Series:
    return pd.Series([robots_prefix_allows(b, p, a) for b, p, a in zip(body, path, agent, strict=True)])


@vectorized("string")
def fnv1a(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else fnv1a_of(t))
