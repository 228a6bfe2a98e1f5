"""Writing to an output, a directory that all executors see or an object store: media copies, notes and album lists.

Each function returns one row a file with its status, so a failure stops no other file, and a task that is
run again leaves no half file.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO
from typing import IO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.notes import album_markdown, merged_note
from .files import endpoint_of, open_entry
from .places import Folder, Store, Zip, open_output, zip_end, zip_moved

STATUS = "output_path string, status string"
BLOCK = 1 << 20


def _digest(f: IO[bytes]) -> str:
    digest = hashlib.sha256()
    while block := f.read(BLOCK):
        digest.update(block)
    return digest.hexdigest()


def put(place: Folder | Store, path: str, source: IO[bytes], dry_run: bool = False, modified: int | None = None, known: str | None = None) -> str:
    """written, unchanged (the same bytes are there) or dry-run. known: the recorded checksum of what is there, which is not read then."""
    size = place.size(path)
    if size is not None:
        if known is None:
            with place.open(path) as old:
                known = _digest(old)
        if known == _digest(source):
            return "unchanged"
        source.seek(0)
    if dry_run:
        return "dry-run"
    place.write(path, source, modified)
    return "written"


def _each(rows: DataFrame, schema: str, one: Callable[[dict], tuple]) -> DataFrame:
    """one(row) for each row, in order within a partition; an error becomes the row's status."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                try:
                    out.append(one(row))
                except Exception as e:  # reported, and the rest goes on
                    out.append((row[names[0]], f"error: {type(e).__name__}: {e}"[:200], *[None] * (len(names) - 2)))
            yield pd.DataFrame(out, columns=names).astype({n: "Int64" for n in names[2:]})

    return rows.mapInPandas(run, schema)


def copy_media(plan: DataFrame, uri: str, root: str, dry_run: bool = False) -> DataFrame:
    """STATUS, and size and time as a listing shows them, of plan (path, output_path, modified): bytes of a source, copied with their time where the output keeps one."""
    endpoint = endpoint_of(plan.sparkSession)

    def one(row: dict) -> tuple:
        with open_entry(uri, row["path"], endpoint) as f:
            place = open_output(root, endpoint)
            status = put(place, row["output_path"], f, dry_run, row["modified"] and int(row["modified"]))
            return row["output_path"], status, *((None, None) if dry_run else place.stat(row["output_path"]))

    return _each(plan.select("output_path", "path", "modified").repartition(F.col("output_path")), f"{STATUS}, file_size long, modified long", one)


def _existing(place: Folder | Store, path: str) -> str | None:
    if place.size(path) is None:
        return None
    with place.open(path) as f:
        return f.read().decode("utf-8", "replace")


def _put_text(place: Folder | Store, path: str, text: str | None, dry_run: bool) -> str:
    return "unchanged" if text is None else put(place, path, BytesIO(text.encode()), dry_run)


def note_text(row: dict, existing: str | None) -> str | None:
    """A note's text, or None where nothing changes."""
    arrays = {key: [] if row[c] is None else list(row[c]) for key, c in (("original-paths", "original_path"), ("people", "people"), ("albums", "albums"))}
    scalars = {"datetime": row["datetime"], "checksum": row["long_hash"], "latitude": row["latitude"], "longitude": row["longitude"], "live-photo-video": row["live_photo_video"]}
    return merged_note(existing, row["media_name"], scalars, arrays)


def write_notes(notes: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """STATUS of notes (note_path, media_name, long_hash, datetime, latitude, longitude, original_path, people,
    albums, live_photo_video). Rows that share a note are merged one after the other, in hash order."""
    endpoint = endpoint_of(notes.sparkSession)

    def one(row: dict) -> tuple:
        place = open_output(root, endpoint)
        text = note_text(row, _existing(place, row["note_path"]))
        return row["note_path"], _put_text(place, row["note_path"], text, dry_run)

    dealt = notes.repartition(F.col("note_path")).sortWithinPartitions("note_path", "long_hash")
    return _each(dealt.select("note_path", *(c for c in notes.columns if c != "note_path")), STATUS.replace("output_path", "note_path"), one)


def write_album_notes(albums: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """STATUS of albums (note_path, title, album_ordinal, targets), each with a target; later albums replace
    earlier ones of the same note. Notes below the marker are kept."""
    endpoint = endpoint_of(albums.sparkSession)

    def one(row: dict) -> tuple:
        place = open_output(root, endpoint)
        text = album_markdown(row["title"], list(row["targets"]), _existing(place, row["note_path"]) or "")
        return row["note_path"], _put_text(place, row["note_path"], text, dry_run)

    dealt = albums.repartition(F.col("note_path")).sortWithinPartitions("note_path", "album_ordinal")
    return _each(dealt.select("note_path", "title", "targets"), STATUS.replace("output_path", "note_path"), one)


def stats(paths: DataFrame, root: str) -> DataFrame:
    """(path, file_size, modified), as in a listing, of those of paths (path) that an output has: it is asked for these alone, however much it holds."""
    endpoint = endpoint_of(paths.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = open_output(root, endpoint)
        for frame in frames:
            found = [(path, *place.stat(path)) for path in frame["path"] if place.size(path) is not None]
            yield pd.DataFrame(found, columns=["path", "file_size", "modified"]).astype({"modified": "Int64"})

    return paths.select("path").mapInPandas(run, "path string, file_size long, modified long")


def hashes(paths: DataFrame, root: str, manifest: DataFrame | None = None) -> DataFrame:
    """(path, existing_hash) of files of an output (path, file_size, modified); null where one cannot be read.

    manifest (path, file_size, modified, hash): checksums recorded before. A file of the same size and time is not read again.
    """
    endpoint = endpoint_of(paths.sparkSession)
    known = paths.select("path").withColumn("hash", F.lit(None).cast("string"))
    if manifest is not None:
        known = paths.select("path", "file_size", "modified").join(manifest, ["path", "file_size", "modified"], "left").select("path", "hash")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = open_output(root, endpoint)
        for frame in frames:
            out = []
            for path in frame["path"]:
                try:
                    with place.open(path) as f:
                        out.append((path, _digest(f)))
                except OSError:
                    out.append((path, None))
            yield pd.DataFrame(out, columns=["path", "existing_hash"])

    read = known.where("hash is null").select("path").repartition(F.col("path")).mapInPandas(run, "path string, existing_hash string")
    return read.unionByName(known.where("hash is not null").select("path", F.col("hash").alias("existing_hash")))


def write_zip(rows: DataFrame, path: str, level: int = 1) -> None:
    """rows (name, text) as entries of one zip file, in a folder that all executors see: tasks write zip files of their own rows, then each copies its
    entries and its part of the index to their places. The driver holds a row a part."""
    held = f"{path}.{uuid.uuid4().hex}.parts"
    os.makedirs(held, exist_ok=True)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = f"{held}/{uuid.uuid4().hex}"  # a task that is run again has another one
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as z:
            for frame in frames:
                for name, text in frame.itertuples(index=False):
                    z.writestr(name, text or "")
        with open(part, "rb") as f:
            at, end, _ = Zip(part)._index(f)
            sizes = [(len(r), len(zip_moved(r, 0, True))) for _, r in Zip(part)._records(f, at, end)]
        yield pd.DataFrame([(part, at, len(sizes), sum(a for a, _ in sizes), sum(b for _, b in sizes))], columns=["part", "size", "n", "narrow", "wide"])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, size, to, index, far in frame[["part", "size", "to", "index", "far"]].itertuples(index=False):
                with open(part, "rb") as f, open(path, "r+b") as out:
                    out.seek(to)
                    left = size
                    while left:
                        block = f.read(min(BLOCK, left))
                        out.write(block)
                        left -= len(block)
                    out.seek(index)
                    at, end, _ = Zip(part)._index(f)
                    out.writelines(zip_moved(r, to, far) for _, r in Zip(part)._records(f, at, end))
            yield frame[["n"]]

    spark = rows.sparkSession
    parts = [r for r in rows.select("name", "text").mapInPandas(pack, "part string, size long, n long, narrow long, wide long").collect() if r.n]
    plan, to, index = [], 0, sum(r.size for r in parts)
    for r in parts:
        far = to + r.size > 0xFFFFFFFF - 1
        plan.append((r.part, r.size, r.n, to, index, far))
        to, index = to + r.size, index + (r.wide if far else r.narrow)
    with open(path, "wb") as out:
        out.seek(index)
        out.write(zip_end(sum(r.n for r in parts), to, index - to))
    if plan:
        dealt = spark.createDataFrame([(i, *x) for i, x in enumerate(plan)], "task int, part string, size long, n long, to long, index long, far boolean")
        dealt.repartitionById(len(plan), F.col("task")).mapInPandas(place, "n long").write.format("noop").mode("overwrite").save()
    shutil.rmtree(held, ignore_errors=True)
