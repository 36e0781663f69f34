"""Dates, times and durations in Azerbaijani text, resolved against a reference moment."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame

from ..functions.numbers import HUNDRED, MAGNITUDES, ONES, TENS
from .morphology import lower
from .rows import map_rows

MOST_BYTES, MOST_RESULTS, MERGE_GAP, MOST_QUANTITY = 1 << 20, 10_000, 20, 1_000_000
RESULTS = (
    "array<struct<text:string,start:int,end:int,type:string,time:timestamp_ntz,duration_s:bigint,explicit:int>>"
)
YEAR, MONTH, DAY, HOUR, MINUTE, SECOND = 1, 2, 4, 8, 16, 32
#: Names of months and days, and words that shift a date.
MONTHS = "yanvar fevral mart aprel may iyun iyul avqust sentyabr oktyabr noyabr dekabr".split()
WEEKDAYS = {
    "çərşənbə axşamı": 1, "bazar ertəsi": 0, "cümə axşamı": 3, "çərşənbə": 2, "şənbə": 5, "cümə": 4, "bazar": 6,
}
DAY_WORDS = {"bu gün": 0, "bugün": 0, "sabah": 1, "birigün": 2, "dünən": -1, "srağagün": -2}
PERIODS, PERIOD_UNITS = {"keçən": -1, "bu": 0, "gələn": 1}, ("həftə", "ay", "il")
DIRECTIONS = {"əvvəl": -1, "öncə": -1, "sonra": 1}
UNITS = {"gün": 86400, "həftə": 604800, "ay": None, "il": None, "saat": 3600, "dəqiqə": 60, "saniyə": 1}
LONG_UNITS = {"ay": 30 * 86400, "il": 365 * 86400}
DAY_PARTS = {"səhər": 0, "gündüz": 0, "axşam": 12, "gecə": 12}
CLOCK, BRIDGE = "saat", "ayının"
#: Shapes of numeric dates and times and of ordinals.
EDGE, END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
ISO = re.compile(rf"{EDGE}([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}}){END}")
DOTTED = re.compile(rf"{EDGE}([0-9]{{1,2}})\.([0-9]{{1,2}})\.([0-9]{{4}}){END}")
SLASHED = re.compile(rf"{EDGE}([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}){END}")
TIMES = re.compile(rf"{EDGE}([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?{END}")
ORDINAL = re.compile("^([0-9]{1,2})[-.]?(?:[iıuü]?nc[iıuü]|c[iıuü]|[iıuü])$")
WORDS = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")


def _month_forms() -> tuple[dict[str, int], set[str]]:
    """Every case form of the month names by harmony, and the genitive ones."""
    forms, genitives = {}, set()
    for number, name in enumerate(MONTHS, 1):
        vowel = [c for c in name if c in "aeiouüıəö"][-1]
        wide, narrow = ("ə" if vowel in "eəiöü" else "a"), {"a": "ı", "ı": "ı", "e": "i", "i": "i", "u": "u"}[vowel]
        for ending in ("", f"d{wide}", f"d{wide}n", f"{narrow}n", narrow, wide):
            forms[name + ending] = number
        genitives.add(f"{name}{narrow}n")
    return forms, genitives


MONTH_FORMS, GENITIVES = _month_forms()
NUMBERS = {w: i for i, w in enumerate(ONES)} | {w: 10 * i for i, w in enumerate(TENS) if w}
NUMBERS |= {HUNDRED: 100} | {w: 1000**i for i, w in enumerate(MAGNITUDES) if w}


class Words:
    """The words of a text with a mark for those that belong to a result."""

    def __init__(self, text: str):
        self.spans = [m.span() for m in WORDS.finditer(text)]
        self.low = [lower(text[a:b]) for a, b in self.spans]
        self.used = [False] * len(self.low)

    def free(self, first: int, last: int) -> bool:
        return 0 <= first and last < len(self.low) and not any(self.used[first : last + 1])

    def take(self, first: int, last: int) -> tuple[int, int]:
        self.used[first : last + 1] = [True] * (last - first + 1)
        return self.spans[first][0], self.spans[last][1]


def _calendar(year: int, month: int, day: int) -> datetime | None:
    """A date whose surplus days or months run on."""
    year, month = year + (month - 1) // 12, (month - 1) % 12 + 1
    try:
        return datetime(year, month, 1) + timedelta(days=day - 1)
    except (ValueError, OverflowError):
        return None


def _small(word: str) -> int | None:
    return int(word) if re.fullmatch("[0-9]{1,2}", word) else None


def _ordinal(word: str) -> int | None:
    match = ORDINAL.match(word)
    return int(match[1]) if match and 1 <= int(match[1]) <= 31 else None


def _quantity(words: Words, at: int) -> tuple[int, int] | None:
    """(value, words taken) of a short number or number words."""
    if at >= len(words.low):
        return None
    if (n := _small(words.low[at])) is not None:
        return n, 1
    for size in range(min(5, len(words.low) - at), 0, -1):
        total, group, ok = 0, 0, True
        for word in words.low[at : at + size]:
            value = NUMBERS.get(word, 0)
            ok = ok and value > 0
            if value >= 1000:
                total, group = total + max(group, 1) * value, 0
            elif value == 100:
                group = max(group, 1) * 100
            else:
                group += value
        if ok and total + group > 0:
            return min(total + group, MOST_QUANTITY), size
    return None


def _numeric(text: str, ref: datetime) -> list[tuple]:
    out = []
    for pattern, order in ((ISO, (1, 2, 3)), (DOTTED, (3, 2, 1)), (SLASHED, (3, 2, 1))):
        for m in pattern.finditer(text):
            try:
                out.append((*m.span(), "Date", datetime(*(int(m[i]) for i in order)), None, YEAR | MONTH | DAY))
            except ValueError:
                continue
    for m in TIMES.finditer(text):
        h, minute, second = int(m[1]), int(m[2]), int(m[3] or 0)
        if h <= 23 and minute <= 59 and second <= 59:
            moment = datetime(ref.year, ref.month, ref.day, h, minute, second)
            out.append((*m.span(), "Time", moment, None, HOUR | MINUTE | (SECOND if m[3] else 0)))
    return out


def _written(words: Words, ref: datetime) -> list[tuple]:
    """Month names with what stands around them."""
    out = []
    for i, word in enumerate(words.low):
        if words.used[i] or word not in MONTH_FORMS:
            continue
        first = last = i
        day = None
        if words.free(i, i + 2) and words.low[i + 1] == BRIDGE and (day := _ordinal(words.low[i + 2])):
            last = i + 2
        elif word in GENITIVES and words.free(i, i + 1) and (day := _ordinal(words.low[i + 1])):
            last = i + 1
        elif words.free(i - 1, i):
            day = _ordinal(words.low[i - 1]) or _small(words.low[i - 1])
            day = day if day and 1 <= day <= 31 else None
            first = i - 1 if day else i
        year = None
        if words.free(last + 1, last + 1) and re.fullmatch("[0-9]{4}", words.low[last + 1]) and int(words.low[last + 1]):
            last, year = last + 1, int(words.low[last + 1])
        moment = _calendar(year or ref.year, MONTH_FORMS[word], day or 1)
        span = words.take(first, last)
        if moment:
            out.append((*span, "Date", moment, None, MONTH | (DAY if day else 0) | (YEAR if year else 0)))
    return out


def _weekday_at(words: Words, at: int) -> tuple[int, int] | None:
    """(weekday, last word) of a day name that begins at a word, the longest first."""
    for name, day in WEEKDAYS.items():
        parts = name.split()
        if words.low[at : at + len(parts)] == parts and words.free(at, at + len(parts) - 1):
            return day, at + len(parts) - 1
    return None


def _days(words: Words, ref: datetime) -> list[tuple]:
    """Day names, with or without a word that shifts the week."""
    out, today = [], datetime(ref.year, ref.month, ref.day)
    for i in range(len(words.low)):
        shift = PERIODS.get(words.low[i], 0)
        if shift and words.free(i, i) and i + 1 < len(words.low) and (hit := _weekday_at(words, i + 1)):
            ahead = (hit[0] - today.weekday() - 1) % 7 + 1
            moment = today + timedelta(days=ahead if shift > 0 else -((today.weekday() - hit[0] - 1) % 7 + 1))
            out.append((*words.take(i, hit[1]), "Date", moment, None, YEAR | MONTH | DAY))
        elif hit := _weekday_at(words, i):
            moment = today + timedelta(days=(hit[0] - today.weekday()) % 7)
            out.append((*words.take(i, hit[1]), "Date", moment, None, YEAR | MONTH | DAY))
    return out


def _clock(words: Words, ref: datetime) -> list[tuple]:
    out = []
    for i, word in enumerate(words.low):
        if word != CLOCK or not words.free(i, i + 1):
            continue
        if words.free(i - 1, i - 1) and _small(words.low[i - 1]) is not None:
            continue
        digits = re.match("^([0-9]{1,2})(?:-.*)?$", words.low[i + 1])
        hour = int(digits[1]) if digits else _ordinal(words.low[i + 1])
        if hour is None or hour > 23:
            continue
        first = i
        if words.free(i - 1, i - 1) and words.low[i - 1] in DAY_PARTS:
            first = i - 1
            hour += DAY_PARTS[words.low[first]] if 0 < hour < 12 else 0
        span = words.take(first, i + 1)
        out.append((*span, "Time", datetime(ref.year, ref.month, ref.day, hour), None, HOUR))
    return out


def _moved(ref: datetime, unit: str, amount: int) -> datetime | None:
    try:
        if UNITS[unit]:
            return ref + timedelta(seconds=UNITS[unit] * amount)
        day = _calendar(ref.year + (amount if unit == "il" else 0), ref.month + (amount if unit == "ay" else 0), ref.day)
        return day and day + (ref - datetime(ref.year, ref.month, ref.day))
    except OverflowError:
        return None


def _relative(words: Words, ref: datetime) -> list[tuple]:
    out, today = [], datetime(ref.year, ref.month, ref.day)
    whole = YEAR | MONTH | DAY
    for i in range(len(words.low)):
        if words.used[i] or not (quantity := _quantity(words, i)):
            continue
        value, size = quantity
        end = i + size + 1
        if words.free(i, end) and words.low[i + size] in UNITS and words.low[end] in DIRECTIONS:
            unit = words.low[i + size]
            moment = _moved(ref, unit, value * DIRECTIONS[words.low[end]])
            clock = unit in ("saat", "dəqiqə", "saniyə")
            span = words.take(i, end)
            if moment:
                out.append((*span, "DateTime" if clock else "Date", moment, None, 63 if clock else whole))
    for i in range(len(words.low) - 1):
        if words.free(i, i + 1) and words.low[i] in PERIODS and words.low[i + 1] in PERIOD_UNITS:
            shift, unit = PERIODS[words.low[i]], words.low[i + 1]
            if unit == "həftə":
                moment = today + timedelta(days=7 * shift - today.weekday())
            else:
                moment = _calendar(ref.year + shift, 1, 1) if unit == "il" else _calendar(ref.year, ref.month + shift, 1)
            if moment:
                out.append((*words.take(i, i + 1), "Date", moment, None, whole))
    for i in range(len(words.low)):
        for size in (2, 1):
            name = " ".join(words.low[i : i + size])
            if words.free(i, i + size - 1) and name in DAY_WORDS and (size == 1) == (" " not in name):
                out.append((*words.take(i, i + size - 1), "Date", today + timedelta(days=DAY_WORDS[name]), None, whole))
                break
    return out


def _durations(words: Words, ref: datetime) -> list[tuple]:
    """Amounts of time that no direction word places, neighbours summed."""
    out, i = [], 0
    while i < len(words.low):
        total, at = 0, i
        while (quantity := _quantity(words, at)) and words.free(at, at + quantity[1]) and words.low[at + quantity[1]] in UNITS:
            unit = words.low[at + quantity[1]]
            total += quantity[0] * (UNITS[unit] or LONG_UNITS[unit])
            at += quantity[1] + 1
        if at > i:
            out.append((*words.take(i, at - 1), "Duration", ref, total, 0))
        i = max(at, i + 1)
    return out


def _resolved(found: list[tuple]) -> list[tuple]:
    """The earliest results, of equal starts the longest, that do not overlap."""
    out: list[tuple] = []
    for result in sorted(found, key=lambda r: (r[0], -r[1])):
        if not out or result[0] >= out[-1][1]:
            out.append(result)
    return out[:MOST_RESULTS]


def _joined(found: list[tuple], text: str) -> list[tuple]:
    """A date and a time close together are one moment."""
    out, i = [], 0
    while i < len(found):
        a = found[i]
        b = found[i + 1] if i + 1 < len(found) else None
        if b and {a[2], b[2]} == {"Date", "Time"} and len(text[a[1] : b[0]].encode("utf-8")) <= MERGE_GAP:
            day, clock = (a[3], b[3]) if a[2] == "Date" else (b[3], a[3])
            out.append((a[0], b[1], "DateTime", datetime.combine(day.date(), clock.time()), None, a[5] | b[5]))
            i += 2
        else:
            out.append(a)
            i += 1
    return out


def extract(text: str | None, ref: datetime | date | None) -> list[dict] | None:
    """All moments and durations of a text; null for null or empty text, texts beyond the limit or no reference."""
    if not text or ref is None or len(text.encode("utf-8")) > MOST_BYTES:
        return None
    if not isinstance(ref, datetime):
        ref = datetime(ref.year, ref.month, ref.day)
    words = Words(text)
    found = _numeric(text, ref)
    for part in (_written, _relative, _days, _clock, _durations):
        found += part(words, ref)
    results = _joined(_resolved(found), text)
    return [
        {
            "text": text[a:b],
            "start": len(text[:a].encode("utf-8")),
            "end": len(text[:b].encode("utf-8")),
            "type": kind,
            "time": moment,
            "duration_s": seconds,
            "explicit": mask,
        }
        for a, b, kind, moment, seconds, mask in results
    ]


def with_datetimes(frame: DataFrame, text: str, ref: str, name: str = "datetimes") -> DataFrame:
    """The table with the moments of a text column, resolved against a timestamp column."""
    return map_rows(frame, [text, ref], f"{name} {RESULTS}", extract)


def parsed(text: str | None, ref: datetime | date | None) -> tuple[dict | None, str | None]:
    """The first result of a text, or why there is none."""
    if not text:
        return None, "empty input"
    if len(text.encode("utf-8")) > MOST_BYTES:
        return None, f"input exceeds {MOST_BYTES} bytes"
    results = extract(text, ref)
    return (results[0], None) if results else (None, "unrecognized input")


def with_moment(frame: DataFrame, text: str, ref: str, name: str = "moment", error: str = "moment_error") -> DataFrame:
    """The table with the one moment or duration that a text column gives, or the reason why it gives none."""
    kind = RESULTS.removeprefix("array<").removesuffix(">")
    return map_rows(frame, [text, ref], f"{name} {kind}, {error} string", parsed)
