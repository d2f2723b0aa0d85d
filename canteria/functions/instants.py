"""Reading one written timestamp: notation, zone and calendar rules.

Plain Python, called once per distinct (text, zone, date order) by
:mod:`canteria.operators.instants`.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

#: Names what :func:`to_utc_us` gives; changes with it, so a kept dictionary of another reading is not used.
PARSER_VERSION = "r2"

# Month names and abbreviations, English and Spanish.
MONTHS = {
    "jan": 1, "january": 1, "ene": 1, "enero": 1,
    "feb": 2, "february": 2, "febrero": 2,
    "mar": 3, "march": 3, "marzo": 3,
    "apr": 4, "april": 4, "abr": 4, "abril": 4,
    "may": 5, "mayo": 5,
    "jun": 6, "june": 6, "junio": 6,
    "jul": 7, "july": 7, "julio": 7,
    "aug": 8, "august": 8, "ago": 8, "agosto": 8,
    "sep": 9, "sept": 9, "september": 9, "septiembre": 9, "setiembre": 9,
    "oct": 10, "october": 10, "octubre": 10,
    "nov": 11, "november": 11, "noviembre": 11,
    "dec": 12, "december": 12, "dic": 12, "diciembre": 12,
}

# Weekdays before a date, English and Spanish. ``mar`` may be March, so a short one has a comma, or a date with a named month, after it.
_WEEKDAY = re.compile(
    r"(?:(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bado|domingo),?"
    r"|(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun|lun|mar|mi[eé]|jue|vie|s[aá]b|dom)\.?(?:,|(?=\s+(?:\d{1,2}(?:\s+de)?[\s-]+[a-z]|[a-z]{3,10}\.?\s+\d))))\s*(?=[\da-z])"
)
#: Month, day, time and perhaps a zone before the year, as the C library writes them.
_YEAR_LAST = re.compile(r"([a-z]{3,9}\s+\d{1,2})\s+(\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)\s+(?:([a-z]{1,5}|[+-]\d{4})\s+)?(\d{4})")

EPOCH = datetime(1970, 1, 1)
_MICRO = timedelta(microseconds=1)
_UNITS = {9: 10**6, 10: 10**6, 11: 10**6, 13: 10**3, 16: 1, 19: -1000}

_DATES = [
    ("ymd", re.compile(r"(\d{4})-(\d{2})-(\d{2})")),
    ("week", re.compile(r"(\d{4})-?w(\d{2})-?(\d)")),
    ("ordinal", re.compile(r"(\d{4})-(\d{3})(?!\d)")),
    ("ymd", re.compile(r"(\d{4})(\d{2})(\d{2})(?=t|\s|$)")),
    ("ymd", re.compile(r"(\d{4})[/.](\d{1,2})[/.](\d{1,2})")),
    ("numeric", re.compile(r"(\d{1,2})([/.\-])(\d{1,2})\2(\d{4})")),
    ("named", re.compile(r"(\d{1,2})(?:\s+de\s+|[\s\-/.]+)([a-z]{3,10})\.?(?:\s+(?:de|del)\s+|[\s\-/.,]+)(\d{4})")),
    ("english", re.compile(r"([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})")),
]
_TIME = re.compile(r"(?:t|,?\s+|,)(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?|(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)(?:\s*([ap])\.?\s?m(?![a-z])\.?)?(?![\d:])")
_OFFSET = re.compile(r"(?:(?:utc|gmt)\s*)?([+-])(\d{1,2})(?::?(\d{2})(?::?(\d{2}))?)?")
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})?")


@lru_cache(maxsize=None)
def _zone_names() -> dict[str, str]:
    return {name.lower(): name for name in available_timezones()}


@lru_cache(maxsize=None)
def _zone(name: str) -> ZoneInfo | None:
    known = _zone_names().get(name.lower())
    return ZoneInfo(known) if known else None


@lru_cache(maxsize=None)
def _abbreviations(zona: str) -> dict[str, int]:
    """Offset in seconds of every abbreviation the zone has used since 1970; the latest use counts."""
    zone, out = _zone(zona), {}
    if zone is not None:
        t = datetime(1970, 1, 1, tzinfo=timezone.utc)
        while t.year < 2038:
            local = t.astimezone(zone)
            out[local.tzname().lower()] = int(local.utcoffset().total_seconds())
            t += timedelta(days=7)
    return out


def _civil(kind: str, g: tuple, orden: str | None) -> date | None:
    if kind == "week":
        return date.fromisocalendar(int(g[0]), int(g[1]), int(g[2]))
    if kind == "ordinal":
        day = date(int(g[0]), 1, 1) + timedelta(days=int(g[1]) - 1)
        return day if int(g[1]) >= 1 and day.year == int(g[0]) else None
    if kind == "ymd":
        return date(int(g[0]), int(g[1]), int(g[2]))
    if kind == "numeric":
        day, month = {"dmy": (g[0], g[2]), "mdy": (g[2], g[0])}.get(orden or "", (None, None))
        return date(int(g[3]), int(month), int(day)) if day else None
    name, day = (g[1], g[0]) if kind == "named" else (g[0], g[1])
    month = MONTHS.get(name)
    return date(int(g[2]), month, int(day)) if month else None


def _offset_seconds(rest: str, wall: datetime, zona: str | None) -> int | None:
    """Offset from UTC that what stands after the time gives to a wall time."""
    if rest.endswith(")"):  # a comment; it names the zone if nothing else does
        opened = rest.find("(", rest.rfind(")", 0, -1) + 1)
        if opened >= 0:
            rest, comment = rest[:opened].rstrip(), rest[opened + 1 : -1].strip()
            named = _offset_seconds(comment, wall, zona) if not rest and comment and "(" not in comment else None
            if named is not None:
                return named
    if rest == "":
        return _zone_offset(wall, zona)
    if rest in ("z", "utc", "gmt", "zulu"):
        return 0
    before, opened, bracket = rest.partition("[")
    if opened and bracket.find("]") == len(bracket) - 1 > 0:  # a zone in brackets
        rest, bracket = before.rstrip(), bracket[:-1]
        if not rest:
            return _zone_offset(wall, bracket)
        if rest == "z":
            return 0
    m = _OFFSET.fullmatch(rest)
    if m:
        hours, minutes, seconds = (int(x or 0) for x in m.groups()[1:])
        if hours > 18 or minutes > 59 or seconds > 59:
            return None
        return (1 if m[1] == "+" else -1) * (hours * 3600 + minutes * 60 + seconds)
    if "/" in rest:
        return _zone_offset(wall, rest)
    return _abbreviations(zona).get(rest) if zona else None


def _zone_offset(wall: datetime, zona: str | None) -> int | None:
    """Of a time that occurs twice the earlier instant; a skipped one has the offset before the change: fold 0 is both."""
    zone = _zone(zona) if zona else None
    return None if zone is None else int(wall.replace(tzinfo=zone, fold=0).utcoffset().total_seconds())


def _epoch(text: str) -> int | None:
    m = re.fullmatch(r"(\d+)(?:[.,](\d+))?", text)
    if not m:
        return None
    unit = _UNITS.get(len(m[1]))
    if unit is None or (m[2] and unit != 10**6):
        return None
    if unit < 0:
        return int(m[1]) // 1000
    return int(m[1]) * unit + (int((m[2] + "000000")[:6]) if m[2] else 0)


def to_utc_us(raw: str | None, zona: str | None = None, orden: str | None = None) -> int | None:
    """Microseconds since 1970-01-01 UTC that ``raw`` denotes, or None.

    ``zona`` is the IANA zone of the writing machine, ``orden`` its order of
    an all-numeric date; both None where the machine is unknown.
    """
    if raw is None:
        return None
    text = unicodedata.normalize("NFKC", raw).replace("−", "-").strip().lower()
    if not text:
        return None
    us = _epoch(text)
    if us is not None:
        return us
    try:
        return _calendar(text, zona, orden)
    except (ValueError, OverflowError):
        return None


def _calendar(text: str, zona: str | None, orden: str | None) -> int | None:
    compact = _COMPACT.fullmatch(text)
    if compact:
        text = f"{text[:8]}t{text[8:]}"
    else:
        weekday = _WEEKDAY.match(text)
        text = text[weekday.end() :] if weekday else text
        last = _YEAR_LAST.fullmatch(text)
        text = f"{last[1]} {last[4]} {last[2]} {last[3] or ''}" if last else text
    for kind, pattern in _DATES:
        m = pattern.match(text)
        if m:
            break
    else:
        return None
    day = _civil(kind, m.groups(), orden)
    if day is None:
        return None
    rest, hour, minute, second, fraction = text[m.end():], 0, 0, 0, ""
    t = _TIME.match(rest)
    if t:
        h, mi, s, f = (t[1], t[2], t[3], t[4]) if t[1] else (t[5], t[6], t[7], t[8])
        hour, minute, second, fraction = int(h), int(mi), int(s or 0), f or ""
        if t[9]:
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if t[9] == "p" else 0)
        rest = rest[t.end():]
    wall = datetime(day.year, day.month, day.day, hour, minute, second)
    offset = _offset_seconds(rest.strip(), wall, zona)
    if offset is None:
        return None
    return (wall - EPOCH) // _MICRO - offset * 10**6 + int((fraction + "000000")[:6])
