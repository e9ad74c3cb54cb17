"""What the document readers know of citations, on plain strings."""

from __future__ import annotations

import re

from ..functions.dateparse import MONTHS
from ..functions.text import FULLCITE_WORDS, SHORT_CITES

# Limits of the readers, in words, characters and points.
CITE_WORDS, LEAD_WORDS, EVIDENCE_WORDS, TAG_WORDS, LOOSE_WORDS = FULLCITE_WORDS, 60, 40, 40, 120
DATE_ZONE = 200
TAG_BOLD_SHARE, TAG_POINTS, SMALL_POINTS = 0.8, 12.5, 9.0

# Shapes of addresses, years, dates and marks of access.
_SHORT = [re.compile(p.replace("(?U)", "")) for p in SHORT_CITES]
_URL = re.compile(r"https?://[^\s<>\"'\)\]]+", re.IGNORECASE)
_YEAR = re.compile(r"\b(?:19|20)\d{2}\b")
_ACCESS = re.compile(r"\b(?:(?i:accessed|access date|date of access|retrieved)|DOA)\b")
_NUMERIC = re.compile(r"\b(\d{1,2})[-/](\d{1,2})[-/](\d{4})\b")
_NAMED = re.compile(r"\b(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "september" else "sep(?:t(?:ember)?)?" for m in MONTHS) + r")\.?\s+(\d{1,2})(?:st|nd|rd|th)?\s*,?\s+(\d{4})\b", re.IGNORECASE)


def squash(text: str | None) -> str:
    return " ".join((text or "").split())


def count_words(text: str | None) -> int:
    return len((text or "").split())


def short_cite(text: str) -> tuple[str, str] | None:
    """(short citation, what follows it) of a paragraph that begins with one."""
    for pattern in _SHORT:
        if m := pattern.match(text):
            return squash(m.group()).rstrip(","), squash(text[m.end() :].lstrip(" \t\n,;:-–—"))
    return None


def address(text: str | None) -> str | None:
    m = _URL.search(text or "")
    return (m.group().rstrip(".,;:!?") or None) if m else None


def publication_date(text: str | None) -> str | None:
    """The first date near the front, as ISO: whatever shape comes first, of two at one
    place the fuller one. Days are checked by range only."""
    zone = (text or "")[:DATE_ZONE]
    found: list[tuple[int, int, str]] = [(m.start(), 1, m.group()) for m in _YEAR.finditer(zone)]
    for m in _NUMERIC.finditer(zone):
        found.append((m.start(), 0, "-".join((m[3], m[1].zfill(2), m[2].zfill(2)))))
    for m in _NAMED.finditer(zone):
        month = next(k for k, name in enumerate(MONTHS, 1) if name.startswith(m[1].lower()[:3]))
        found.append((m.start(), 0, f"{m[3]}-{month:02d}-{int(m[2]):02d}"))
    sound = [f for f in found if f[1] or (f[2][:2] in ("19", "20") and "01" <= f[2][5:7] <= "12" and "01" <= f[2][8:] <= "31")]
    return min(sound)[2] if sound else None


def strong_fullcite(text: str | None) -> bool:
    """A paragraph short enough for a citation, with an address, a year or a mark of access."""
    return bool(text) and count_words(text) <= CITE_WORDS and bool(_URL.search(text) or _YEAR.search(text) or _ACCESS.search(text))


def cite_line(text: str) -> bool:
    """A line of plain text that opens or continues a citation: a year alone is not enough."""
    return strong_fullcite(text) and bool(_URL.search(text) or _ACCESS.search(text) or text.count(",") >= 2)


def resembles_fullcite(text: str | None) -> bool:
    return bool(text) and bool(_URL.search(text) or publication_date(text) or (text.count(",") >= 2 and count_words(text) <= LOOSE_WORDS))


def divide(paragraphs: list[tuple[str, bool]]) -> tuple[str | None, str | None, int]:
    """(cite, full cite, number of paragraphs they take) at the start of a card, from
    (text, whether from a table) of its paragraphs; zero paragraphs if there is none.

    A short citation at the start of the first paragraph, or of the second after a short
    lead, goes before a paragraph that only has the signs of a full citation.
    """
    usable = [not table for _, table in paragraphs[:2]]
    texts = [t for t, _ in paragraphs[:2]] + [""] * (2 - len(paragraphs[:2]))
    one, two = bool(usable) and usable[0], len(usable) == 2 and usable[1]
    brief_lead = count_words(texts[0]) < LEAD_WORDS
    if one and (hit := short_cite(texts[0])):
        cite, rest = hit
        if len(rest) < 15 and two and not short_cite(texts[1]) and resembles_fullcite(texts[1]):
            return cite, squash(f"{rest} {texts[1]}") or None, 2
        return cite, rest or None, 1
    if two and brief_lead and (hit := short_cite(texts[1])):
        return hit[0], squash(f"{texts[0]} {hit[1]}") or None, 2
    if one and strong_fullcite(texts[0]):
        return None, squash(texts[0]) or None, 1
    if one and two and brief_lead and strong_fullcite(texts[1]):
        return None, squash(f"{texts[0]} {texts[1]}") or None, 2
    return None, None, 0
