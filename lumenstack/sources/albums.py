"""Album files: CSV lists of bare file names, and JSON descriptions of a directory."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import classify_dir
from ..functions.paths import dir_part, name_part, strip_extension
from ..operators.albums import csv_members, json_members
from .files import endpoint_of, open_entry

READ = "album string, title string, position long, file_name string"


def parse_csv_album(raw: bytes) -> list[str]:
    """Member names; rows whose width differs from the header's or that are not UTF-8 are skipped."""
    text = raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "surrogateescape")
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    if not rows or rows[0][0].strip().lower() != "images":
        return []
    clean = lambda r: not any("\udc80" <= c <= "\udcff" for x in r for c in x)
    return [r[0] for r in rows[1:] if len(r) == len(rows[0]) and clean(r)]


def parse_json_album(raw: bytes) -> str | None:
    """The title, empty where it is blank or no string; None where the file is no album."""
    try:
        found = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    if not isinstance(found, dict) or "title" not in found:
        return None
    return found["title"].strip() if isinstance(found["title"], str) else ""


def _rows(uri: str, path: str, kind: str, endpoint: str | None) -> Iterator[tuple]:
    with open_entry(uri, path, endpoint) as f:
        raw = f.read()
    if kind == "AlbumCsv":
        yield from ((path, None, i, name) for i, name in enumerate(parse_csv_album(raw)))
    elif (title := parse_json_album(raw)) is not None:
        yield path, title, 0, None


def read_albums(listed: DataFrame, uri: str) -> DataFrame:
    """READ of the album files of a listing: one row a member of a CSV album, one row a JSON album.
    Files that cannot be read, and the year folders' descriptions, are no albums."""
    endpoint = endpoint_of(listed.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, kind in frame.itertuples(index=False):
                try:
                    rows += list(_rows(uri, path, kind, endpoint))
                except (OSError, KeyError, csv.Error):  # an unreadable file is no album
                    continue
            yield pd.DataFrame(rows, columns=["album", "title", "position", "file_name"])

    year = F.coalesce(classify_dir(dir_part(F.col("path")))["type"] == "GpPhotosFromYear", F.lit(False))
    wanted = listed.where(F.col("quick_file_type").isin("AlbumCsv", "AlbumJson")).where((F.col("quick_file_type") == "AlbumCsv") | ~year)
    return wanted.select("path", "quick_file_type").repartition(F.col("path")).mapInPandas(run, READ)


def albums(read: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(albums, members) of read_albums: albums (album, title, note_path, album_ordinal), members (album,
    position, path). A CSV album has a member at least; a JSON album may have none."""
    lists, folders = read.where("file_name is not null"), read.where("file_name is null")
    from_csv = csv_members(lists.select("album", "position", "file_name"), listed)
    here = json_members(folders.select("album", F.col("album").alias("album_path")), listed)
    members = from_csv.unionByName(here.join(listed.select("path", F.col("scan_ordinal").alias("position")), "path"))
    stem, folder = strip_extension(name_part(F.col("album"))), name_part(dir_part(F.col("album")))
    named = from_csv.select("album").distinct().select("album", stem.alias("title"), stem.alias("note"))
    folders = folders.select("album", F.when(F.col("title") == "", folder).otherwise(F.col("title")).alias("title"), folder.alias("note"))
    found = named.unionByName(folders).join(listed.select(F.col("path").alias("album"), F.col("scan_ordinal").alias("album_ordinal")), "album")
    return found.select("album", "title", F.concat(F.lit("albums/"), "note", F.lit(".md")).alias("note_path"), "album_ordinal"), members
