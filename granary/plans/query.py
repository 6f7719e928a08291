"""The query language: filters, tags, phrases, synonyms.

Queries are parsed on the driver into small tables that operators join with.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from datetime import UTC, datetime

from granary.functions.text import PLAIN, ACCENTED, SYNONYMS

_DAY = 86_400
_UNITS = {**dict.fromkeys(("", "d", "day", "days"), _DAY), **dict.fromkeys(("h", "hour", "hours"), 3600), **dict.fromkeys(("w", "week", "weeks"), 7 * _DAY), **dict.fromkeys(("m", "month", "months"), 30 * _DAY), **dict.fromkeys(("y", "year", "years"), 365 * _DAY)}

#: Words for kinds.
_KIND_WORDS = {
    "pdf": "pdf pdfs",
    "note": "note notes",
    "image": "image images img picture pictures screenshot screenshots",
    "text": "text txt texts",
    "file": "file files",
    "docx": "docx word",
    "xlsx": "xlsx excel sheet sheets spreadsheet spreadsheets",
    "pptx": "pptx powerpoint slide slides deck decks presentation presentations",
    "web": "web page pages url urls link links html site sites",
}
KINDS = {w: (k,) for k, text in _KIND_WORDS.items() for w in text.split()}
KINDS |= {"office": ("docx", "xlsx", "pptx")}
KINDS |= dict.fromkeys(("doc", "docs", "document", "documents"), ("pdf", "file", "docx", "xlsx", "pptx"))


@dataclass
class Filters:
    """What a query keeps: kinds (any if none), code files, items since a time, a part of source or title."""

    kinds: list[str] = field(default_factory=list)
    code: bool = False
    since: int | None = None
    source: str | None = None
    labels: list[str] = field(default_factory=list)

    def is_empty(self) -> bool:
        return not (self.kinds or self.code or self.since is not None or self.source is not None)

    def describe(self) -> str:
        return " · ".join(self.labels)


def civil_seconds(text: str) -> int | None:
    """Midnight UTC of year-month-day; a day past the month's end rolls over."""
    m = re.fullmatch(r"\+?(\d+)-\+?(\d+)-\+?(\d+)", text)
    if not m:
        return None
    y, month, day = map(int, m.groups())
    if not (1970 <= y <= 3000 and 1 <= month <= 12 and 1 <= day <= 31):
        return None
    return int(datetime(y, month, 1, tzinfo=UTC).timestamp()) + (day - 1) * _DAY


def parse_since(value: str, now: int, offset: int = 0) -> int | None:
    """A time from a word, a span or a date; ``offset`` is the local clock's distance from UTC in seconds."""
    local = datetime.fromtimestamp(now + offset, UTC)
    today = now - (local.hour * 3600 + local.minute * 60 + local.second)
    named = {"today": today, "yesterday": today - _DAY, "week": today - local.weekday() * _DAY, "month": today - (local.day - 1) * _DAY}
    named |= {"thisweek": named["week"], "thismonth": named["month"]}
    if value in named:
        return named[value]
    if "-" in value:
        return civil_seconds(value)
    m = re.fullmatch(r"([0-9]+)(.*)", value, re.S)
    return now - int(m[1]) * _UNITS[m[2]] if m and m[2] in _UNITS else None


def parse_filters(query: str, now: int, offset: int = 0) -> tuple[Filters, str]:
    """Filters of a query and the words that are none. Unknown keys and values stay words."""
    f, rest = Filters(), []
    for word in query.split():
        key, colon, value = word.lower().partition(":")
        taken = False
        if colon and value:
            if key in ("kind", "type", "is") and (value in KINDS or value == "code"):
                f.kinds += KINDS.get(value, ())
                f.code |= value == "code"
                key, taken = "kind", True
            elif key in ("since", "after") and (at := parse_since(value, now, offset)) is not None:
                f.since = at if f.since is None else max(f.since, at)
                key, taken = "since", True
            elif key in ("source", "from", "in"):
                f.source = value
                key, taken = "source", True
        if taken:
            f.labels.append(f"{key}:{value}")
        else:
            rest.append(word)
    return f, " ".join(rest)


def split_tags(query: str) -> tuple[list[str], str]:
    tags = [w[1:].lower() for w in query.split() if w.startswith("#") and len(w) > 1]
    return tags, " ".join(w for w in query.split() if not (w.startswith("#") and len(w) > 1))


def strip_question(query: str) -> tuple[bool, str]:
    """Whether a leading question mark asks for an answer, and the rest."""
    q = query.lstrip()
    return (True, q[1:].strip()) if q.startswith("?") else (False, query)


def match_tokens(query: str) -> list[str]:
    """Words of a query without double quotes, as typed."""
    return [t for t in (w.replace('"', "") for w in query.split()) if t]


def match_text(query: str) -> str | None:
    """The match expression: quoted words, any of which may match, the last as a prefix."""
    t = match_tokens(query)
    return " OR ".join([f'"{w}"' for w in t[:-1]] + [f'"{t[-1]}"*']) if t else None


_FOLD = str.maketrans(ACCENTED, PLAIN)


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def terms_of(word: str) -> list[str]:
    """Tokens of a word, as the index has them."""
    out, cur = [], ""
    for c in fold(word):
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            cur += c
        elif cur:
            out, cur = [*out, cur], ""
    return [*out, cur] if cur else out


def phrases(queries: dict[int, str]) -> list[tuple[int, int, int, int, str, bool]]:
    """Rows (query_id, pos, n, j, term, is_prefix): each query word is a phrase of n terms, the last word's last term a prefix."""
    rows = []
    for qid, text in queries.items():
        parts = match_tokens(text)
        for pos, word in enumerate(parts):
            terms = terms_of(word)
            for j, t in enumerate(terms):
                rows.append((qid, pos, len(terms), j, t, pos == len(parts) - 1 and j == len(terms) - 1))
    return rows


def expand(words: list[str], known: set[str] | None = None, table: dict[str, str] | None = None, terms: int = 3, most: int = 12) -> list[str]:
    """Synonyms of query words in order, none of the query's own, none twice; only known ones where ``known`` is given.

    Queries of fewer than ``terms`` words have none.
    """
    if len(words) < terms:
        return []
    found = [s for w in words for s in (table or SYNONYMS).get(w, "").split()]
    kept = [s for s in dict.fromkeys(found) if s not in words and (known is None or s in known)]
    return kept[:most]


def dense_query(query: str, synonyms: list[str]) -> str:
    return " ".join([query, *synonyms])


def clean_rewrites(text: str, question: str, most: int = 3) -> list[str]:
    """Search lines out of a model's answer: bullets and quotes off, preambles, echoes, long and equal lines out."""
    out: list[str] = []
    for line in text.splitlines():
        t = re.sub(r"^[0-9\-*•.) ]+", "", line.strip()).strip("\"`'").strip()
        low = t.lower()
        if t and not t.endswith(":") and "search quer" not in low and len(t.split()) <= 10 and low != question.lower() and t not in out:
            out.append(t)
    return out[:most]
