"""The commands end to end: db (a source into the catalog), sync (a source into a dated archive), info (one file), sql (a query over the catalog).

python -m lumenstack.plans.commands db|sync|info|sql ... runs them from a shell.
"""

from __future__ import annotations

import argparse
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geo, ids, media_types
from ..functions.classify import classify_dir, classify_file
from ..functions.paths import album_link_name, code, desired_media_path, dir_part, markdown_path, name_part, people_links, table_cell, wikilink
from ..functions.sidecar import SIDECAR, parse_sidecar
from ..operators import albums as album_ops
from ..operators import dedup
from ..sources import sinks
from ..sources.albums import albums, read_albums
from ..sources.catalog import Catalog
from ..sources.files import endpoint_of, listing, open_entry
from ..sources.inspect import inspect
from ..sources.ledger import Ledger
from ..sources.places import open_output
from .staging import counted, staged


def sidecars(scan: DataFrame, media: DataFrame, uri: str) -> DataFrame:
    """(path, supp): the decoded sidecar of each media file that has a valid one."""
    found = album_ops.sidecar_join(media, scan)
    endpoint = endpoint_of(scan.sparkSession)

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for path, name in frame.itertuples(index=False):
                try:
                    with open_entry(uri, name, endpoint) as f:
                        out.append((path, parse_sidecar(f.read())))
                except (OSError, KeyError):  # as if there were none
                    out.append((path, None))
            yield pd.DataFrame(out, columns=["path", "supp"])

    return found.select("path", "sidecar").mapInPandas(run, f"path string, supp {SIDECAR}").where("supp is not null")


def media_records(scan: DataFrame, seen: DataFrame, uri: str, timezone: str | None) -> DataFrame:
    """Of inspected files, those that are supported, with their sidecar, best date and kind."""
    zone = dates.output_zone(timezone, os.environ.get("TZ", ""))
    good = seen.where("status = 'ok'")
    rows = good.join(sidecars(scan, good, uri), "path", "left")
    guess = dates.best_guess(
        F.col("capture"), F.col("track_time"), dates.sidecar_time(F.col("supp.photoTakenTime.timestamp"), zone), F.col("fallback"),
        dates.sidecar_time(F.col("supp.creationTime.timestamp"), zone), dates.render_millis(F.col("modified"), zone), dates.render_millis(F.col("created"), zone),
    )
    kind, ext = media_types.media_kind(F.col("accurate_file_type")), media_types.type_extension(F.col("accurate_file_type"))
    return rows.select("*", guess.alias("guessed"), kind.alias("kind"), ext.alias("ext"))


def _point(name: str):
    return geo.known_point(F.col(f"supp.{name}.latitude"), F.col(f"supp.{name}.longitude"))


def catalog_items(media: DataFrame) -> DataFrame:
    """Rows of media_item."""
    exif = geo.known_point(F.col("exif_latitude"), F.col("exif_longitude"))
    at = geo.best_point(exif, geo.iso_6709(F.col("gps_iso_6709")), _point("geoDataExif"), _point("geoData"))
    rows = media.withColumn("at", at).withColumn("w", F.coalesce(geo.image_size(F.col("tags"), "Width"), "width")).withColumn("h", F.coalesce(geo.image_size(F.col("tags"), "Height"), "height"))
    track = F.struct("width", "height", "duration_ms", F.col("track_time").alias("creation_time"), *(F.col(f"track_{c}").alias(c) for c in ("make", "model", "software", "author")), "gps_iso_6709")
    turn = F.element_at("tags", "Orientation").try_cast("int")
    return rows.select(
        ids.path_id(F.col("path")).alias("media_item_id"), F.col("path").alias("media_path"), "long_hash", "short_hash", "quick_file_type", "accurate_file_type",
        F.to_json(F.struct(F.map_from_entries(F.array_sort(F.map_entries("tags"))).alias("tags"), track.alias("track"), "supp")).alias("media_info"),
        F.col("guessed").alias("guessed_datetime"), F.coalesce("modified", F.lit(0)).alias("modified_at"), F.coalesce("created", F.lit(0)).alias("created_at"), "file_size",
        F.col("at.latitude").alias("latitude"), F.col("at.longitude").alias("longitude"),
        F.coalesce(F.element_at("tags", "Make"), "track_make").alias("camera_make"), F.coalesce(F.element_at("tags", "Model"), "track_model").alias("camera_model"), F.col("w").alias("width"), F.col("h").alias("height"), "duration_ms",
        geo.orientation(F.col("w"), F.col("h")).alias("orientation"), geo.display_mirrored(turn).alias("display_mirrored"), geo.display_rotate(turn).alias("display_rotate"),
        geo.geohash(F.col("at.latitude"), F.col("at.longitude")).alias("geohash"), "kind", "content_identifier",
    )


def classified_files(scan: DataFrame, run_id: int) -> DataFrame:
    """Rows of classified_file."""
    run, known = F.lit(run_id).cast("long"), classify_file(name_part(F.col("path")))
    rows = scan.select("path", "quick_file_type", "file_size", known.alias("known"))
    return rows.select(F.xxhash64(F.lit(run_id), "path").alias("classified_file_id"), run.alias("run_id"), F.col("path").alias("file_path"), "quick_file_type", F.col("known.type").alias("known_file_type"), F.col("known.value").alias("known_file_type_value"), "file_size")


def classified_folders(scan: DataFrame, run_id: int) -> DataFrame:
    """Rows of classified_dir."""
    folders = scan.select(dir_part(F.col("path")).alias("path")).distinct().withColumn("known", classify_dir(F.col("path")))
    return folders.select(F.xxhash64(F.lit(run_id), "path").alias("classified_dir_id"), F.lit(run_id).cast("long").alias("run_id"), F.col("path").alias("dir_path"), F.col("known.type").alias("known_dir_type"), F.col("known.value").alias("known_dir_value"))


def record_media(cat: Catalog, scan: DataFrame, todo: DataFrame, uri: str, timezone: str | None, mark: tuple[str, int] | None = None) -> None:
    """Inspect todo's files, with the sidecars that scan lists, and record them with their people."""
    seen = counted(inspect(todo, uri, timezone), "seen", cat.counters, {"skipped files": F.count_if(F.col("status") != "ok")})
    media = counted(media_records(scan, seen, uri, timezone), "media", cat.counters, {"inspected files": F.count(F.lit(1))})
    cat.upsert("media_item", catalog_items(media), mark)
    named = media.select(ids.path_id(F.col("path")).alias("media_item_id"), F.explode("supp.people.name").alias("name")).where("name is not null").select("media_item_id", ids.person_id(F.col("name")).alias("person_id"), "name")
    cat.insert("person", named.groupBy("person_id").agg(F.min("name").alias("name")), mark)
    cat.insert("media_person", named.select("media_item_id", "person_id"), mark)


def link_albums(cat: Catalog, scan: DataFrame, uri: str) -> None:
    """Albums and their recorded members."""
    found, members = albums(staged(read_albums(scan, uri), "albums"), scan)
    found = counted(found, "found", cat.counters, {"albums": F.count(F.lit(1))})
    key = ids.path_id(F.col("album"))
    cat.insert("album", found.select(key.alias("album_id"), "title", F.col("album").alias("album_path")))
    links = counted(album_ops.album_links(members.select(key.alias("album_id"), "path"), cat.read("media_item")), "links", cat.counters, {"resolved album members": F.count(F.lit(1))})
    cat.insert("album_file", links)


def db(spark: SparkSession, uri: str, root: str, timezone: str | None = None, clear: bool = False, skip_media: bool = False, skip_albums: bool = False) -> Catalog:
    """Scan, classify, inspect what is not recorded with the same size, record; albums are linked in every run.
    What is counted is observed while tables are written: no job runs for it alone."""
    cat, every = Catalog(spark, root, clear), F.count(F.lit(1))
    is_media = F.col("quick_file_type") == "Media"
    scan = counted(listing(spark, uri), "scan", cat.counters, {"files": every, "media files": F.count_if(is_media)})
    run_id = cat.run(uri)
    files = counted(classified_files(scan, run_id), "classified", cat.counters, {"matched files": F.count("known_file_type")})
    cat.refresh("classified_file", files, run_id)
    folders = counted(classified_folders(scan, run_id), "folders", cat.counters, {"folders": every, "matched folders": F.count("known_dir_type")})
    cat.refresh("classified_dir", folders, run_id)
    if not skip_media:
        wanted = scan.where(is_media).withColumn("media_item_id", ids.path_id(F.col("path")))
        todo = counted(album_ops.resume(wanted, cat.recorded()), "todo", cat.counters, {"files to inspect": every})
        record_media(cat, scan, todo, uri, timezone)
        cat.counters["recorded before"] = cat.counters["media files"] - cat.counters["files to inspect"]
    if not skip_albums:
        link_albums(cat, scan, uri)
    return cat


def _before(media: DataFrame, root: str, manifest: DataFrame | None, ledger: Ledger | None, name: str) -> DataFrame:
    """(path, existing_hash, file_size, modified, read) of what is there under the names that media may take. Only files of an item's own size are
    hashed, and of those only such as neither the manifest nor the ledger knows."""
    tried = dedup.candidate_paths(media).select(F.col("try").alias("path")).distinct()
    files = staged(dedup.candidates_there(media, sinks.stats(tried, root)), f"{name}-candidates")
    wanted = files.where("to_read")
    known = [x.select("path", "file_size", "modified", "hash") for x in (manifest, ledger.known(wanted) if ledger else None) if x is not None]
    known = reduce(DataFrame.unionByName, known).groupBy("path", "file_size", "modified").agg(F.min("hash").alias("hash")) if known else None
    hashed = sinks.hashes(wanted, root, known).join(wanted, "path").select("path", "existing_hash", "file_size", "modified")
    other = files.where("not to_read").select("path", F.lit(dedup.OTHER_SIZE).alias("existing_hash"), "file_size", "modified")
    return staged(hashed.unionByName(other), name)


def _placed(media: DataFrame, uri: str, root: str, before: DataFrame, dry_run: bool, name: str) -> DataFrame:
    """(long_hash, output_path, status, file_size, modified) of media with a want: names over what is there, then copies."""
    plan = staged(dedup.names_over_existing(media, before), f"{name}-plan")
    todo = plan.where("action = 'write'").join(media.select("long_hash", "path", "modified"), "long_hash")
    copied = sinks.copy_media(todo, uri, root, dry_run)
    states = plan.join(copied, "output_path", "left").select("long_hash", "output_path", F.coalesce("status", "action").alias("status"), "file_size", "modified")
    failed = F.col("status").startswith("error")
    return staged(states.select("long_hash", F.when(~failed, F.col("output_path")).alias("output_path"), "status", "file_size", "modified"), f"{name}-placed")


def _notes(rows: DataFrame) -> DataFrame:
    """What the note of each placed record says: rows have output_path, original_path, albums and live_photo_video."""
    at = geo.note_point(geo.known_point(F.col("exif_latitude"), F.col("exif_longitude")), _point("geoData"), _point("geoDataExif"))
    return rows.withColumn("at", at).select(
        markdown_path(F.col("output_path")).alias("note_path"), name_part(F.col("output_path")).alias("media_name"), "long_hash", F.col("guessed").alias("datetime"), F.col("at.latitude").alias("latitude"), F.col("at.longitude").alias("longitude"),
        "original_path", people_links(F.filter(F.col("supp.people.name"), lambda x: x.isNotNull())).alias("people"), F.transform("albums", wikilink).alias("albums"), "live_photo_video",
    )


def sync(spark: SparkSession, uri: str, root: str, timezone: str | None = None, dry_run: bool = False, skip_media: bool = False, skip_albums: bool = False, skip_markdown: bool = False, manifest: DataFrame | None = None, ledger: str | None = None) -> DataFrame:
    """(output_path, status) of all files of an archive brought up to date. The output is a directory that
    all executors see, or an object store. Primaries are placed first; the video of a Live Photo then goes by its still's name.
    manifest: checksums of the output that are known (see sinks.hashes). ledger: a folder where checksums are kept from run to run."""
    book = Ledger(spark, ledger) if ledger else None
    output = open_output(root, endpoint_of(spark))
    scan = staged(listing(spark, uri), "scan")
    todo = scan.where("quick_file_type = 'Media'")
    seen = staged(inspect(todo if not skip_media else todo.limit(0), uri, timezone), "seen")
    media = staged(dedup.content_dedup(media_records(scan, seen, uri, timezone)), "media")
    media = media.withColumn("want", desired_media_path(F.col("guessed"), F.col("short_hash")))
    listed, members = (None, None) if skip_albums else albums(staged(read_albums(scan, uri), "albums"), scan)
    output.prepare()
    pairs = dedup.live_photo_pairs(media)
    videos = pairs.select(F.col("video_hash").alias("long_hash"))
    stills = media.join(videos, "long_hash", "left_anti")
    before = _before(stills, root, manifest, book, "before")
    first = _placed(stills, uri, root, before, dry_run, "first")
    clips = media.join(videos, "long_hash", "left_semi")
    attached = dedup.sidecar_videos(pairs, first, clips).select(*media.columns)
    loose = clips.join(attached.select("long_hash"), "long_hash", "left_anti")
    clips = staged(attached.unionByName(loose), "clips")
    made = first.where("output_path is not null").select(F.col("output_path").alias("path"), F.col("long_hash").alias("existing_hash"))
    found = _before(clips, root, manifest, book, "before-clips")
    after = found.select("path", "existing_hash").join(made, "path", "left_anti").unionByName(made)
    second = _placed(clips, uri, root, after.groupBy("path").agg(F.max("existing_hash").alias("existing_hash")), dry_run, "second")
    placed = first.unionByName(second)
    if book and not dry_run:
        read = before.unionByName(found).where(F.col("existing_hash") != dedup.OTHER_SIZE).select("path", "file_size", "modified", F.col("existing_hash").alias("hash"))
        written = placed.where("output_path is not null and modified is not null").select(F.col("output_path").alias("path"), "file_size", "modified", F.col("long_hash").alias("hash"))
        book.record(read.join(written, "path", "left_anti").unionByName(written))
    out = placed.select("output_path", "status")
    items = media.join(placed.where("output_path is not null").select("long_hash", "output_path"), "long_hash")
    if not skip_markdown:
        final = second.where("output_path is not null").join(attached.select("long_hash"), "long_hash", "left_semi")
        shown = pairs.join(final.select(F.col("long_hash").alias("video_hash"), "output_path"), "video_hash").select(F.col("still_hash").alias("long_hash"), name_part(F.col("output_path")).alias("live_photo_video")).groupBy("long_hash").agg(F.min("live_photo_video").alias("live_photo_video"))
        rows = items.join(final.select("long_hash"), "long_hash", "left_anti").join(shown, "long_hash", "left")
        if listed is None:
            rows = rows.withColumn("albums", F.array().cast("array<string>"))
        else:
            by_path = listed.join(members, "album").select(album_link_name(F.col("note_path")).alias("name"), "album_ordinal", "path")
            rows = rows.join(album_ops.album_names(media, by_path), "long_hash", "left")
        notes = _notes(rows)
        out = out.unionByName(staged(sinks.write_notes(notes, root, dry_run), "notes").withColumnRenamed("note_path", "output_path"))
    if listed is not None:
        final = album_ops.final_paths(members, items)
        lists = final.groupBy("album").agg(F.array_sort(F.collect_list(F.struct("position", "output_path"))).alias("x")).select("album", F.col("x.output_path").alias("targets"))
        written = sinks.write_album_notes(listed.join(lists, "album").select("note_path", "title", "album_ordinal", "targets"), root, dry_run)
        out = out.unionByName(staged(written, "lists").withColumnRenamed("note_path", "output_path"))
    return out


def info(spark: SparkSession, uri: str, path: str, timezone: str | None = None) -> str:
    """A report on one file of a source as Markdown: its album, or its metadata and output path. File times do not count."""
    scan = listing(spark, uri)
    one = scan.where(F.col("path") == path).withColumn("modified", F.lit(None).cast("long")).withColumn("created", F.lit(None).cast("long"))
    row = one.first()
    if row is None:
        raise FileNotFoundError(path)
    head = [f"# {path}", "", f"- Kind: {row.quick_file_type}", f"- Size: {row.file_size} bytes"]
    if row.quick_file_type in ("AlbumCsv", "AlbumJson"):
        found, members = albums(read_albums(one, uri), scan)
        titles = [r.title for r in found.limit(1).collect()]
        if not titles:
            return "\n".join([*head, "- Not an album", ""])
        rows = members.orderBy("position").toLocalIterator()
        return "\n".join([*head, f"- Album: {titles[0]}", "", *(f"{i + 1}. {r.path}" for i, r in enumerate(rows)), ""])
    rec = media_records(scan, inspect(one, uri, timezone), uri, timezone).withColumn("want", desired_media_path(F.col("guessed"), F.col("short_hash")))
    zone = dates.output_zone(timezone, os.environ.get("TZ", ""))
    rec = staged(rec, "info")
    sections = {name: [(r.name, r.value) for r in rec.select(F.inline(F.array(*(F.struct(F.lit(k).alias("name"), table_cell(v.cast("string")).alias("value")) for k, v in facts.items())))).where("value is not null").collect()] for name, facts in _facts(zone).items()}
    tags = rec.select(F.explode(F.array_sort(F.map_entries("tags"))).alias("t")).select(table_cell(code(F.col("t.key"))).alias("name"), table_cell(F.col("t.value")).alias("value")).collect()
    sections["EXIF"] = [(r.name, r.value) for r in tags]
    row = rec.first()
    if row is None:
        return "\n".join([*head, "- Not a supported media file", ""])
    lines = head
    for name, facts in sections.items():
        if facts:
            lines += ["", f"## {name}", "", "| Name | Value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in facts)]
    note = rec.withColumn("albums", F.array().cast("array<string>")).withColumn("live_photo_video", F.lit(None).cast("string")).withColumn("output_path", F.concat("want", F.lit("."), "ext")).withColumn("original_path", F.array("path"))
    shown = _notes(note).first().asDict()
    return "\n".join([*lines, "", "## Note", "", "```", sinks.note_text(shown, None) or "", "```", ""])


def _facts(zone) -> dict[str, dict[str, Column]]:
    """What a report shows of a record, by section; what is null is left out."""
    point = lambda p: F.when(p.isNotNull(), F.concat_ws(", ", p["latitude"].cast("string"), p["longitude"].cast("string")))
    time = lambda name: dates.sidecar_text(dates.sidecar_time(F.col(f"supp.{name}.timestamp"), zone), F.col(f"supp.{name}.formatted"))
    c = F.col
    return {
        "Source": {"Type": c("accurate_file_type"), "SHA-256": c("long_hash"), "Metadata": media_types.metadata_type(c("accurate_file_type"))},
        "Output": {"Date": c("guessed"), "Path": F.concat("want", F.lit("."), "ext"), "Note": markdown_path(F.concat("want", F.lit("."), "ext"))},
        "Live Photo": {"Identifier": c("content_identifier"), "Kind": F.when(c("content_identifier").isNotNull(), c("kind"))},
        "Supplemental": {"Taken": time("photoTakenTime"), "Created": time("creationTime"), "Place": point(_point("geoData")), "EXIF place": point(_point("geoDataExif")), "People": F.nullif(F.array_join(F.col("supp.people.name"), ", "), F.lit(""))},
        "Track": {"Width": c("width"), "Height": c("height"), "Duration (ms)": c("duration_ms"), "Created": c("track_time"), "Make": c("track_make"), "Model": c("track_model"), "Software": c("track_software"), "Author": c("track_author"), "Place": c("gps_iso_6709")},
        "Place": {"EXIF": point(geo.known_point(c("exif_latitude"), c("exif_longitude")))},
    }


def sql(spark: SparkSession, root: str, query: str) -> DataFrame:
    """A query over the catalog's tables, as views."""
    Catalog(spark, root).register_views()
    return spark.sql(query)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lumenstack")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, first, last in (("db", "uri", "root"), ("sync", "uri", "root"), ("info", "uri", "path"), ("sql", "root", "query")):
        sub = commands.add_parser(name)
        sub.add_argument(first)
        sub.add_argument(last)
        if name != "sql":
            sub.add_argument("--timezone")
        if name == "sync":
            sub.add_argument("--ledger")
        flags = {"db": ["--clear", "--skip-media", "--skip-albums"], "sync": ["--dry-run", "--skip-media", "--skip-albums", "--skip-markdown"], "info": [], "sql": []}[name]
        for flag in flags:
            sub.add_argument(flag, action="store_true")
    options = vars(parser.parse_args(argv))
    spark = SparkSession.builder.appName("lumenstack").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    command = options.pop("command")
    done = {"db": db, "sync": sync, "info": info, "sql": sql}[command](spark, **options)
    if isinstance(done, str):
        print(done)
    elif command == "sql":
        done.show(1000, truncate=False)
    elif isinstance(done, DataFrame):
        for r in done.groupBy("status").count().orderBy("status").toLocalIterator():
            print(f"{r['status']}: {r['count']}")
    else:
        for name, n in (done.counts() | done.counters).items():
            print(f"{name}: {n}")


if __name__ == "__main__":
    main()
