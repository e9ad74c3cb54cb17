"""The search language: a total parser from a string to a frozen query.

Whatever is typed is a query. Operators that are unknown or whose value makes no sense are
plain words, and words never become SQL: they stay values until they are compared with
tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..functions.text import CON_WORDS, PRO_WORDS

SORTS = ("relevance", "reads", "recent", "length")
# Names of events in the published dialect.
EVENTS = {"policy": "cx", "cx": "cx", "ld": "ld", "lincoln-douglas": "ld", "pf": "pf", "public-forum": "pf", "publicforum": "pf"}
_TOKEN = re.compile(r'(?P<neg>-(?=\S))?(?:(?P<field>[A-Za-z_]+):)?(?:"(?P<quoted>[^"]*)(?:"|$)|(?P<bare>\S*))')


@dataclass(frozen=True)
class Term:
    """A word or phrase to match, in one column if ``column`` is given."""

    text: str
    column: str | None = None


@dataclass(frozen=True)
class Query:
    positives: tuple[Term, ...] = ()
    negatives: tuple[Term, ...] = ()
    filters: dict = field(default_factory=dict)
    sort: str = "relevance"


def _side(v: str) -> str | None:
    return "P" if v.strip().upper() in PRO_WORDS else "C" if v.strip().upper() in CON_WORDS else None


def _number(v: str) -> int | None:
    return int(v) if re.fullmatch(r"\d{1,9}", v) else None


def _year(v: str) -> str | None:
    return v[-2:] if re.fullmatch(r"\d{2}|\d{4}", v) else None


def _loose_year(v: str) -> str | None:
    return _year(re.sub("[^0-9]", "", v))


def _matching(pattern: str) -> Callable[[str], str | None]:
    return lambda v: v if re.fullmatch(pattern, v) else None


def _analytic(*words: str) -> Callable[[str], bool | None]:
    return lambda v: True if v.lower() in words else None


_TEXT: Callable[[str], str | None] = lambda v: v
#: Per dialect: operator -> (name of the filter, reader of the value).
ENGINE = {
    "topic": ("topic", _TEXT),
    "season": ("season", lambda v: _number(v) if len(v) == 4 else None),
    "side": ("side", _side),
    "school": ("school", _TEXT),
    "team": ("team", _TEXT),
    "cite": ("cite", _TEXT),
    "author": ("cite", _TEXT),
    "year": ("year", _year),
    "before": ("before", _matching(r"\d{4}(-\d{2}(-\d{2})?)?")),
    "after": ("after", _matching(r"\d{4}(-\d{2}(-\d{2})?)?")),
    "is": ("is_analytic", _analytic("analytic", "analytics")),
    "min_reads": ("min_reads", _number),
    "status": ("status", str.lower),
}
SITE = {
    "topic": ("topic", _TEXT),
    "season": ("season", _number),
    "cite": ("cite", _TEXT),
    "author": ("cite", _TEXT),
    "year": ("year", _loose_year),
    "block": ("block", _TEXT),
    "event": ("event", lambda v: EVENTS.get(v.lower())),
    "before": ("before", _matching(r"\d{4}-\d{2}-\d{2}")),
    "after": ("after", _matching(r"\d{4}-\d{2}-\d{2}")),
    "is": ("is_analytic", _analytic("analytic")),
    "min_reads": ("min_reads", _number),
}
#: Filters of the published dialect that collect all their values.
_MANY = {"site": {"topic", "cite"}, "engine": set()}


def parse(text: object, dialect: str = "engine") -> Query:
    """The query that a string means; any string means one."""
    operators, many = (SITE if dialect == "site" else ENGINE), _MANY[dialect]
    positives: list[Term] = []
    negatives: list[Term] = []
    filters: dict = {}
    sort = "relevance"
    for m in _TOKEN.finditer(str(text if text is not None else "")):
        raw = m.group(0)
        if not raw.strip():
            continue
        negated, name = bool(m["neg"]), (m["field"] or "").lower()
        value = (m["quoted"] if m["quoted"] is not None else m["bare"] or "").strip()
        if name and not negated and value:
            if name == "sort" and value.lower() in SORTS:
                sort = value.lower()
                continue
            if name == "block" and dialect == "engine":
                positives.append(Term(value, "block"))
                continue
            if name in operators:
                key, read = operators[name]
                if (found := read(value)) is not None:
                    if key in many:
                        filters.setdefault(key, []).append(found)
                    else:
                        filters[key] = found
                    continue
        plain = raw[1:] if negated and name else raw if name else value
        if any(ch.isalnum() for ch in plain):
            (negatives if negated else positives).append(Term(plain))
    query = Query(tuple(positives), tuple(negatives), filters, sort)
    if not positives and negatives:
        # without anything to subtract from: a filter here, dropped in the published dialect
        query = replace(query, negatives=(), filters=filters | ({"exclude": tuple(negatives)} if dialect == "engine" else {}))
    return query
