"""Names that a media file's JSON sidecar may have, most specific first, and its strict decoding."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits and names of the exporting service.
NAME_CHARS, TAG, JSON = 51, ".supplemental-metadata", ".json"
STILLS = [".HEIC", ".heic", ".JPG", ".jpg", ".JPEG", ".jpeg", ".PNG", ".png"]
RENDITIONS = ["-ANIMATION", "-COLLAGE", "-EFFECTS", "-ERASER", "-MOTION", "-MOVIE", "-SMILE", "-edited", "-PANO", "-SNOW", "-edit", "-MIX", "-ed"]
CLIPS = {".mp4", ".mov"}
DEPTH = 3

STEM_CHARS = NAME_CHARS - len(JSON)


def _ascii_lower(s: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def _original(stem: str) -> str | None:
    """The stem without one rendition suffix."""
    low = _ascii_lower(stem)
    return next((stem[: -len(x)] for x in RENDITIONS if low.endswith(x.lower())), None)


def _originals(base: str) -> Iterator[str]:
    """Stems of what a rendition was made from, nearest first."""
    found = _original(base)
    for _ in range(DEPTH):
        if found is None:
            return
        yield found
        found = _original(found)


def _parts(name: str) -> tuple[str, str, str, str]:
    """(stem, extension, stem without a counter, counter) of a file name."""
    dot = name.rfind(".")
    stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
    m = re.fullmatch(r"(.*)(\([0-9]+\))", stem, re.S)
    return stem, ext, *((m[1], m[2]) if m else (stem, ""))


def _keys(name: str) -> list[tuple[str, str]]:
    """(described name, counter) pairs, with repeats, the most specific first."""
    stem, ext, base, counter = _parts(name)
    both = [counter, ""] if counter else [""]
    moved = [counter] if counter else []
    rules = [
        ([name], [""]),  # the file itself
        ([base + ext], moved),  # its counter moved behind the name
        ([stem], [""]),  # its bare title
        ([base], moved),
        *(([original + end], both) for original in _originals(base) for end in (ext, *STILLS, "")),  # what a rendition was made from
        *(([base + end], both) for end in STILLS if _ascii_lower(ext) in CLIPS),  # the still of a motion clip
    ]
    return [(described, c) for names, counters in rules for described in names for c in counters]


def sidecar_candidates(name: str) -> list[str]:
    """At the measured limit first; then, where the limit matters, cut anywhere within the tag, longest first."""
    keys = list(dict.fromkeys(_keys(name)))
    out = [(base + TAG)[:STEM_CHARS] + counter + JSON for base, counter in keys]
    for base, counter in keys:
        full = base + TAG
        if len(full) > STEM_CHARS:
            out += [full[:n] + counter + JSON for n in range(len(full), len(base) - 1, -1)]
    return list(dict.fromkeys(out))


@F.pandas_udf(T.ArrayType(T.StringType()))
def candidates(names: pd.Series) -> pd.Series:
    return names.map(sidecar_candidates)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def described_names(names: pd.Series) -> pd.Series:
    """[described name, counter] pairs that a media file's sidecar may go by, most specific first: a bounded number, whatever the name's length."""
    return names.map(lambda n: [list(k) for k in dict.fromkeys(_keys(n))])


GEO = "struct<latitude:double,longitude:double>"
TIME = "struct<timestamp:string,formatted:string>"
SIDECAR = f"struct<geoData:{GEO},geoDataExif:{GEO},people:array<struct<name:string>>,photoTakenTime:{TIME},creationTime:{TIME}>"


def _field(x, kind) -> bool:
    return x is None or isinstance(x, kind) and not isinstance(x, bool)


def parse_sidecar(text: str | bytes | None) -> dict | None:
    """The fields that are known; None where the text is no object or any of them has a wrong type."""
    try:
        raw = json.loads(text or "")
    except (ValueError, RecursionError):
        return None
    if not isinstance(raw, dict):
        return None
    out: dict = {}
    for key, parts, kind in (("geoData", ("latitude", "longitude"), (int, float)), ("geoDataExif", ("latitude", "longitude"), (int, float)), ("photoTakenTime", ("timestamp", "formatted"), str), ("creationTime", ("timestamp", "formatted"), str)):
        x = raw.get(key)
        if x is not None and not (isinstance(x, dict) and all(_field(x.get(p), kind) for p in parts)):
            return None
        out[key] = x and {p: float(x[p]) if kind is not str and x.get(p) is not None else x.get(p) for p in parts}
    people = raw.get("people", [])
    if not isinstance(people, list) or not all(isinstance(p, dict) and _field(p.get("name"), str) for p in people):
        return None
    return out | {"people": [{"name": p.get("name")} for p in people]}
