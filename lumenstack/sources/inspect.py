"""Inspection: bytes of listed files to metadata records, in parallel; failures are rows with a status."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import capture_reading, fallback_reading, output_zone, track_reading
from ..functions.media_types import EXIF_TYPES, TRACK_TYPES
from ..operators.balance import balanced
from .files import endpoint_of, open_entry
from .formats import HEAD, View, read_exif, read_track, sniff

RECORD = (
    "path string, file_size long, modified long, created long, quick_file_type string, accurate_file_type string, long_hash string, short_hash string, status string, "
    "tags map<string,string>, exif_latitude double, exif_longitude double, content_identifier string, capture string, fallback string, "
    "track_time string, width long, height long, duration_ms long, track_make string, track_model string, track_software string, track_author string, gps_iso_6709 string"
)
BLOCK = 1 << 16


def _inspect(uri: str, path: str, zone, endpoint: str | None = None) -> dict:
    with open_entry(uri, path, endpoint) as f:
        digest, size = hashlib.sha256(), 0
        while block := f.read(BLOCK):
            digest.update(block)
            size += len(block)
        f.seek(0)
        head = f.read(HEAD)
        whole = View(f, 0, size)
        kind = sniff(head, path, whole)
        out = {"accurate_file_type": kind, "long_hash": digest.hexdigest(), "short_hash": digest.hexdigest()[:7], "status": "Unsupported" if kind == "Unsupported" else "ok"}
        if kind in EXIF_TYPES and (tags := read_exif(whole)):
            out |= {"exif_latitude": tags.pop("latitude", None), "exif_longitude": tags.pop("longitude", None), "content_identifier": tags.pop("content_identifier", None)}
            out |= {"tags": tags, "capture": capture_reading(tags), "fallback": fallback_reading(tags, zone)}
        elif kind in TRACK_TYPES and (track := read_track(f, size)):
            named = {f"track_{k}": track.pop(k, None) for k in ("make", "model", "software", "author")}
            out |= {"track_time": track_reading(track.pop("creation_time", None), zone), **named, **track}
    return out


def inspect(listed: DataFrame, uri: str, timezone: str | None = None) -> DataFrame:
    """RECORD of each listed file of a source. Files are dealt out by bytes; status is ok, Unsupported or the error."""
    zone, endpoint = output_zone(timezone, os.environ.get("TZ", "")), endpoint_of(listed.sparkSession)
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, blank = [], dict.fromkeys(names)
            for row in frame.to_dict("records"):
                try:
                    rows.append(blank | row | _inspect(uri, row["path"], zone, endpoint))
                except Exception as e:  # a file that cannot be read is reported, and the rest goes on
                    rows.append(blank | row | {"status": f"{type(e).__name__}: {e}"[:200]})
            out = pd.DataFrame(rows, columns=names)
            for c in ("file_size", "modified", "created", "width", "height", "duration_ms"):
                out[c] = out[c].astype("Int64")
            yield out

    columns = ["path", "file_size", "modified", "created", "quick_file_type"]
    n = max(int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions")), listed.sparkSession.sparkContext.defaultParallelism)
    # Tasks get like amounts of bytes; a file of more than a task's part is one task's only work.
    dealt = balanced(listed.select(*columns), n, "path", "file_size")
    return dealt.repartitionById(n, F.col("task")).drop("task").mapInPandas(run, RECORD)
