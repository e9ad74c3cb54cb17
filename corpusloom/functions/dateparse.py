"""Exhaustive parsing of one written date or time. Plain Python, used on distinct strings only."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# English month names, and what the zone abbreviations of the press stand for.
MONTHS = ("january february march april may june july august september october november december").split()
FIXED_ZONES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
REGION_ZONES = {"ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles"}

_MON = {name[:n]: k + 1 for k, name in enumerate(MONTHS) for n in range(3, len(name) + 1)} | {"sept": 9}
_MONTH = r"(?P<mon>[A-Za-z]{3,9})\.?"
_DAY = r"(?P<d>\d{1,2})(?:st|nd|rd|th)?"
_DATES = [
    r"(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})",
    r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})",
    r"(?P<a>\d{1,2})(?P<s>[-/.])(?P<b>\d{1,2})(?P=s)(?P<y>\d{4}|\d{2})",
    rf"{_DAY}[ -](?:of )?{_MONTH}[ -],?\s*(?P<y>\d{{4}})",
    rf"{_MONTH}[ -]{_DAY}(?:,\s*|[ -])(?P<y>\d{{4}})",
]
_COARSE = [
    r"(?P<y>\d{4})[-/.](?P<m>\d{1,2})",
    r"(?P<m>\d{1,2})[-/.](?P<y>\d{4})",
    rf"{_MONTH}(?:,\s*|\s+|-)(?P<y>\d{{4}})",
    r"(?P<y>\d{4})",
]
_TIME = (
    r"(?P<hh>\d{1,2}):(?P<mi>\d{2})(?::(?P<ss>\d{2})(?:[.,]\d+)?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
    r"(?:\s*(?P<off>[+-]\d{2}(?::?\d{2})?)|\s*\(?(?P<zone>[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)*)\)?)?"
)
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_FULL = [re.compile(rf"{_WEEKDAY}{d}(?:(?:\s*[T,]\s*|\s+(?:at\s+)?){_TIME})?", re.IGNORECASE) for d in _DATES]
_PART = [re.compile(p, re.IGNORECASE) for p in _COARSE]
_EPOCH = re.compile(r"\d{10}|\d{13}")


@lru_cache(maxsize=1024)
def _region(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def _zone(name: str) -> timezone | ZoneInfo | None:
    upper = name.upper()
    if upper in FIXED_ZONES:
        return timezone(timedelta(minutes=FIXED_ZONES[upper]))
    return _region(REGION_ZONES.get(upper, name))


def _stamp(t: datetime) -> str:
    return f"{t.year:04d}-{t.month:02d}-{t.day:02d}T{t.hour:02d}:{t.minute:02d}:{t.second:02d}Z"


def parse_written(raw: str | None, local_zone: str | None, day_first: bool | None) -> tuple[str, str] | None:
    """``(UTC text, grain)`` of a whole string that is a date or time, else None.

    grain is time, day, month or year. A time without a zone is local to ``local_zone``
    (UTC if None or unknown); a doubled local time means the first, a skipped one is read
    with the offset before the change. Numeric dates put the month first unless
    ``day_first``. Dates that do not exist, bare two-digit years and years before 1000
    are no dates.
    """
    text = " ".join((raw or "").split())
    if not text:
        return None
    if _EPOCH.fullmatch(text):
        seconds = int(text) if len(text) == 10 else int(text) // 1000
        return _stamp(datetime(1970, 1, 1) + timedelta(seconds=seconds)), "time"
    for pattern in _FULL:
        if m := pattern.fullmatch(text):
            return _full(m.groupdict(), local_zone, day_first)
    for pattern in _PART:
        if m := pattern.fullmatch(text):
            return _coarse(m.groupdict())
    return None


def _month(g: dict) -> int | None:
    return _MON.get(g["mon"].lower()) if g.get("mon") else None


def _coarse(g: dict) -> tuple[str, str] | None:
    year = int(g["y"])
    if year < 1000:
        return None
    if not g.get("mon") and not g.get("m"):
        return _stamp(datetime(year, 1, 1)), "year"
    month = int(g["m"]) if g.get("m") else _month(g)
    return (_stamp(datetime(year, month, 1)), "month") if month and 1 <= month <= 12 else None


def _full(g: dict, local_zone: str | None, day_first: bool | None) -> tuple[str, str] | None:
    year = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
    if g.get("a"):
        month, day = (int(g["b"]), int(g["a"])) if day_first else (int(g["a"]), int(g["b"]))
    else:
        month, day = (int(g["m"]) if g.get("m") else _month(g)), int(g["d"])
    try:
        if year < 1000 or not month:
            return None
        at = datetime(year, month, day)
        if not g["hh"]:
            return _stamp(at), "day"
        hour = int(g["hh"])
        if g["ap"]:
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if g["ap"] in "pP" else 0)
        at = at.replace(hour=hour, minute=int(g["mi"]), second=int(g["ss"] or 0))
    except ValueError:
        return None
    if g["off"]:
        digits = g["off"][1:].replace(":", "").ljust(4, "0")
        minutes = (int(digits[:2]) * 60 + int(digits[2:])) * (-1 if g["off"][0] == "-" else 1)
        zone = timezone(timedelta(minutes=minutes)) if abs(minutes) < 1440 else None
    elif g["zone"]:
        zone = _zone(g["zone"])
    else:
        zone = (_region(local_zone) if local_zone else None) or timezone.utc
    if zone is None:
        return None
    try:
        # fold=0: of a doubled time the first, of a skipped one the offset before the change
        return _stamp(at.replace(tzinfo=zone).astimezone(timezone.utc)), "time"
    except OverflowError:
        return None
