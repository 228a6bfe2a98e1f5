"""Capture times. Readings stay strings with their own offset, as RFC 3339: a cast to
timestamp would move them to another day."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from datetime import UTC, date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:\.(\d+))?(?:[Zz]|([+-])(\d\d):?(\d\d))\Z", re.A)
_LOCAL = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})[T ]\s*(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d+))?\Z", re.A)
_DAY = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})\Z", re.A)
_OFFSET = re.compile(r"([+-])(\d\d):?(\d\d)", re.A)
#: Epoch milliseconds whose year has four digits.
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999


def rfc_3339(t: datetime) -> str:
    """The fraction is left out where it is 0, and has three digits where those suffice."""
    base = t.strftime("%Y-%m-%dT%H:%M:%S").rjust(19, "0")
    frac = f".{t.microsecond // 1000:03d}" if t.microsecond % 1000 == 0 else f".{t.microsecond:06d}"
    seconds = int((t.utcoffset() or timedelta()).total_seconds())
    sign, minutes = "-" if seconds < 0 else "+", abs(seconds) // 60
    return f"{base}{frac if t.microsecond else ''}{sign}{minutes // 60:02d}:{minutes % 60:02d}"


def _micros(digits: str | None) -> int:
    return int((digits or "0")[:6].ljust(6, "0"))


def parse_exif_date(raw: str | None) -> datetime | None:
    """An instant with an offset; a local reading or a bare day, taken as UTC; else None."""
    raw = (raw or "").strip()
    try:
        if m := _RFC.match(raw):
            away = timedelta(hours=int(m[9]), minutes=int(m[10])) * (-1 if m[8] == "-" else 1) if m[8] else timedelta()
            return datetime(*map(int, m.groups()[:6]), _micros(m[7]), timezone(away))
        if re.match(r"\d{4}:\d\d:\d\d", raw, re.A):
            raw = f"{raw[:4]}-{raw[5:7]}-{raw[8:]}"
        if m := _LOCAL.match(raw):
            return datetime(*map(int, m.groups()[:6]), _micros(m[7]), UTC)
        if m := _DAY.match(raw):
            return datetime(*map(int, m.groups()), tzinfo=UTC)
    except ValueError:
        return None
    return None


def sub_second_millis(raw: str | None) -> int | None:
    """Digits after the decimal point, as milliseconds; finer ones are dropped."""
    digits = (raw or "").strip().strip("\0").strip(" \0")
    return int(digits[:3].ljust(3, "0")) if digits.isascii() and digits.isdigit() else None


#: Offsets of EXIF dates; a date without its own takes the first of the others.
OFFSETS = ("OffsetTimeOriginal", "OffsetTimeDigitized", "OffsetTime")


def _dated(tags: Mapping[str, str], day: str, fraction: str, offset: str) -> datetime | None:
    """A date with its fraction and, where the reading itself has none, its offset: the clock is not moved."""
    t, ms = parse_exif_date(tags.get(day)), sub_second_millis(tags.get(fraction))
    if t is not None and not _RFC.match(tags[day].strip()):
        known = (parse_offset(tags.get(name) or "") for name in (offset, *OFFSETS))
        t = t.replace(tzinfo=next((z for z in known if z), t.tzinfo))
    return t if t is None or ms is None else t.replace(microsecond=ms * 1000)


def capture_reading(tags: Mapping[str, str]) -> str | None:
    """The camera's clock at the shutter, never moved to another zone."""
    t = _dated(tags, "DateTimeOriginal", "SubSecTimeOriginal", "OffsetTimeOriginal") or _dated(tags, "CreateDate", "SubSecTimeDigitized", "OffsetTimeDigitized")
    return rfc_3339(t) if t else None


def gps_reading(tags: Mapping[str, str], zone: timezone) -> str | None:
    """Day and time of the receiver, in the output zone; a day alone stays where it is."""
    day = tags.get("GPSDateStamp")
    if day is None:
        return None
    clock = (tags.get("GPSTimeStamp") or "").strip()
    full = parse_exif_date(f"{day.strip()} {clock}") if clock else None
    if full:
        return rfc_3339(full.astimezone(zone))
    t = parse_exif_date(day)
    return rfc_3339(t) if t else None


def fallback_reading(tags: Mapping[str, str], zone: timezone) -> str | None:
    t = _dated(tags, "ModifyDate", "SubSecTime", "OffsetTime")
    return rfc_3339(t) if t else gps_reading(tags, zone)


def gps_time(hours: float, minutes: float, seconds: float) -> str | None:
    """hh:mm:ss with milliseconds where there are any; a leap second is allowed."""
    if not (0 <= hours < 24 and 0 <= minutes < 60 and 0 <= seconds < 61):
        return None
    ms = min(999, int((seconds - int(seconds)) * 1000 + 0.5))
    return f"{int(hours):02d}:{int(minutes):02d}:{int(seconds):02d}" + (f".{ms:03d}" if ms else "")


def track_reading(raw: str | None, zone: timezone) -> str | None:
    t = parse_exif_date(raw)
    try:
        return rfc_3339(t.astimezone(zone)) if t else None
    except OverflowError:
        return None


def parse_offset(raw: str) -> timezone | None:
    """The UTC offset at the front of a string; what follows is ignored."""
    m = _OFFSET.match(raw.strip())
    if not m or int(m[2]) > 23 or int(m[3]) > 59:
        return None
    away = timedelta(hours=int(m[2]), minutes=int(m[3]))
    return timezone(-away if m[1] == "-" else away)


def output_zone(option: str | None = None, env: str | None = None) -> timezone:
    """The zone of a run: the option (an error where it is no offset), then TZ if that is one, then the machine's."""
    if option and option.strip():
        zone = parse_offset(option)
        if zone is None:
            raise ValueError(f"{option!r} is not a UTC offset such as +12:00")
        return zone
    zone = parse_offset(env if env is not None else os.environ.get("TZ", ""))
    return zone or timezone(datetime.now().astimezone().utcoffset() or timedelta())


def offset_text(zone: timezone) -> str:
    return rfc_3339(datetime(2000, 1, 1, tzinfo=zone))[19:]


def render_millis(millis: Column, zone: timezone) -> Column:
    """Epoch milliseconds as RFC 3339 in a zone; null outside years 1 to 9999."""
    shift = int((zone.utcoffset(None) or timedelta()).total_seconds()) * 1000
    local = (millis + shift).cast("long")
    safe = F.when(local.between(FIRST_MS, LAST_MS), local)
    seconds = F.floor(safe / 1000).cast("long")
    rest = safe - seconds * 1000
    # The session's zone must not matter: days are added to a date, and the clock is arithmetic.
    days = F.floor(seconds / 86400).cast("int")
    clock = seconds - days.cast("long") * 86400
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes = F.floor(clock / 3600), F.floor(clock / 60) % 60
    text = F.concat(F.date_add(F.lit(date(1970, 1, 1)), days).cast("string"), F.lit("T"), two(hours), F.lit(":"), two(minutes), F.lit(":"), two(clock % 60))
    return F.concat(text, F.when(rest > 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 3, "0"))).otherwise(""), F.lit(offset_text(zone)))


def sidecar_time(stamp: Column, zone: timezone) -> Column:
    """A sidecar's epoch seconds, given as a string; null where it is no number or too large."""
    seconds = F.trim(stamp).try_cast("long")
    return render_millis(F.when(F.abs(seconds) < 10**15, seconds * 1000), zone)


def best_guess(exif: Column, track: Column, taken: Column, fallback: Column, created_sidecar: Column, modified: Column, created: Column) -> Column:
    """The first known of: shutter, track, sidecar's taken time, EXIF's other dates, sidecar's creation, file times."""
    return F.coalesce(exif, track, taken, fallback, created_sidecar, modified, created)


def sidecar_text(iso: Column, formatted: Column) -> Column:
    both = F.concat(iso, F.lit(" ("), formatted, F.lit(")"))
    return F.coalesce(both, iso, formatted)
