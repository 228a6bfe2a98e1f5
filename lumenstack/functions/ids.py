"""Stable identifiers from Unicode-normalised strings, and content checksums."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode White_Space; str.strip() would also take U+001C to U+001F.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ENDS = re.compile(f"^[{_SPACE}]+|[{_SPACE}]+\\Z")


def nfc(text: str | None, lower: bool = False) -> str | None:
    if text is None:
        return None
    text = _ENDS.sub("", text)
    return unicodedata.normalize("NFC", text.lower() if lower else text)


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(nfc)


@F.pandas_udf(T.StringType())
def _nfc_lower(s: pd.Series) -> pd.Series:
    return s.map(lambda x: nfc(x, True))


def _id(normal: Column) -> Column:
    return F.substring(F.sha2(normal, 256), 1, 16)


def _plain(column: Column) -> Column:
    """Pure ASCII strings are their own NFC: only others pay for a Python call."""
    return column.rlike(r"\A[\x21-\x7e](?:[\x20-\x7e]*[\x21-\x7e])?\z")


def path_id(path: Column) -> Column:
    """16 hex digits of a path's, album's or item's trimmed NFC form; case matters."""
    return F.when(_plain(path), _id(path)).otherwise(_id(_nfc(path)))


def person_id(name: Column) -> Column:
    """As path_id, for the lower-cased name."""
    return _id(_nfc_lower(name))


def long_checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def short_checksum(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 7)


def same_content(recorded: Column, existing: Column) -> Column:
    """Whether an existing file has the recorded checksum; null where it could not be read."""
    return existing == recorded
