"""Queries over the readers, namers and writers: the benchmark tables' values are put into media files, sidecars,
albums, notes and paths, and read back. Each has a DuckDB counterpart that says what must come out."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from datetime import timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, geo, ids, media_types, paths, sidecar
from ..operators import dedup, notes
from ..sources import albums, files, formats, places, sinks
from ..sources.catalog import Catalog
from ..sources.inspect import inspect
from . import carriers, synthetic
from .carriers import MEDIA_SQL, media, table
from .staging import shared, staged

WEST = timezone(-timedelta(hours=3, minutes=30))
#: name: (query, SQL)
RECORDS: dict[str, tuple[Callable, str]] = {}


def _register(name: str, sql: str):
    def keep(f):
        RECORDS[name] = f, sql
        return f

    return keep


def _mapped(rows: DataFrame, one: Callable[[dict], tuple], schema: str) -> DataFrame:
    """one(row) of each row, in Python."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([one(r) for r in frame.astype(object).where(frame.notna(), None).to_dict("records")], columns=names)

    return rows.mapInPandas(run, schema)


def _events(spark, sf_dir) -> DataFrame:
    """Event times, as whole milliseconds and as the texts that cameras write."""
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp_ltz")).alias("ms"), F.date_format(ts, "yyyy:MM:dd HH:mm:ss").alias("shown"), F.date_format(ts, "SSS").alias("fraction"))


_EVENTS = "e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS s, (epoch_us(ts) // 1000) % 1000 AS f FROM events)"
_FRACTION = "CASE WHEN f <> 0 THEN '.' || lpad(CAST(f AS VARCHAR), 3, '0') ELSE '' END"


@_register("exif_capture", f"WITH {_EVENTS} SELECT event_id, 'Jpg' AS file_type, 'Canon' AS make, 'ExifTags' AS metadata, strftime(s, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 3 = 0 THEN '' ELSE {_FRACTION} END || CASE event_id % 4 WHEN 0 THEN '+13:00' WHEN 1 THEN '-03:30' WHEN 2 THEN '+00:00' ELSE '+05:45' END AS capture FROM e")
def exif_capture(spark, sf_dir):
    """The shutter's clock, with its fraction and offset, out of EXIF bytes; every fourth file has no DateTimeOriginal."""

    def one(r):
        k, main = r["event_id"], {0x010F: "Canon"}
        main[0x9004 if k % 4 == 3 else 0x9003] = r["shown"]
        if k % 3:
            main[0x9292 if k % 4 == 3 else 0x9291] = r["fraction"]
        offset = {0: (0x9011, "+13:00"), 1: (0x9010, "-03:30"), 3: (0x9012, "+05:45")}.get(k % 4)
        raw = synthetic.exif_jpeg(main | ({offset[0]: offset[1]} if offset else {}))
        tags = formats.read_exif(formats.View(io.BytesIO(raw), 0, len(raw)))
        return k, formats.sniff(raw, "x.jpg"), tags["Make"], dates.capture_reading(tags)

    rows = _mapped(_events(spark, sf_dir), one, "event_id long, file_type string, make string, capture string")
    return rows.withColumn("metadata", media_types.metadata_type(F.col("file_type")))


@_register("gps_readings", f"WITH {_EVENTS} SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(s, '%Y-%m-%dT%H:%M:%S+00:00') WHEN 1 THEN strftime(s - INTERVAL 210 MINUTE, '%Y-%m-%dT%H:%M:%S-03:30') ELSE strftime(s, '%Y-%m-%dT00:00:00+00:00') END AS fallback FROM e")
def gps_readings(spark, sf_dir):
    """ModifyDate stays on its clock; a full GPS reading moves to the output zone; a GPS day alone stays where it is."""

    def one(r):
        k, (day, clock) = r["event_id"], r["shown"].split(" ")
        gps = {29: day} | ({7: tuple(map(int, clock.split(":")))} if k % 3 == 1 else {})
        raw = synthetic.exif_jpeg({0x0132: r["shown"]} if k % 3 == 0 else {}, gps)
        return k, dates.fallback_reading(formats.read_exif(formats.View(io.BytesIO(raw), 0, len(raw))), WEST)

    return _mapped(_events(spark, sf_dir), one, "event_id long, fallback string")


@_register("track_readings", f"WITH {_EVENTS} SELECT event_id, 'Mov' AS file_type, strftime(s - INTERVAL 210 MINUTE, '%Y-%m-%dT%H:%M:%S-03:30') AS track_time, CAST(640 + event_id % 7 AS BIGINT) AS width, CAST(480 + event_id % 5 AS BIGINT) AS height, CAST(event_id % 9000 AS BIGINT) AS duration_ms, CASE WHEN event_id % 2 = 0 THEN 'id-' || event_id END AS content_identifier, 'Apple' AS make, CAST(event_id % 80 + 1 AS DOUBLE) AS latitude FROM e")
def track_readings(spark, sf_dir):
    """A movie's time in the output zone, its size and length, and its metadata keys."""

    def one(r):
        k = r["event_id"]
        keys = {"com.apple.quicktime.make": "Apple", "com.apple.quicktime.location.ISO6709": f"+{k % 80 + 1}.0-100.5+12/"}
        keys |= {"com.apple.quicktime.content.identifier": f"id-{k}"} if k % 2 == 0 else {}
        raw = synthetic.movie(r["ms"] // 1000, k % 9000, 640 + k % 7, 480 + k % 5, keys)
        t = formats.read_track(io.BytesIO(raw), len(raw))
        return k, formats.sniff(raw), dates.track_reading(t["creation_time"], WEST), t["width"], t["height"], t["duration_ms"], t.get("content_identifier"), t["make"], t["gps_iso_6709"]

    rows = _mapped(_events(spark, sf_dir), one, "event_id long, file_type string, track_time string, width long, height long, duration_ms long, content_identifier string, make string, place string")
    return rows.withColumn("latitude", geo.iso_6709(F.col("place"))["latitude"]).drop("place")


@_register("best_dates", f"WITH {_EVENTS}, t AS (SELECT event_id, strftime(s, '%Y-%m-%dT%H:%M:%S+00:00') AS x, CAST(event_id % 8 AS INT) AS k FROM e) SELECT event_id, CASE WHEN k < 7 THEN (['capture ', 'track ', 'taken ', 'fallback ', 'made ', 'modified ', 'created '])[k + 1] || x END AS guessed FROM t")
def best_dates(spark, sf_dir):
    """Each of seven readings is the first that is there, once."""
    x = F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    k = F.col("event_id") % 8
    given = [F.when(k <= i, F.concat(F.lit(f"{name} "), x)) for i, name in enumerate("capture track taken fallback made modified created".split())]
    return table(spark, sf_dir, "events").select("event_id", dates.best_guess(*given).alias("guessed"))


@_register("zone_offsets", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE CASE WHEN n_nationkey % 2 = 0 THEN '+' ELSE '-' END || lpad(CAST(n_nationkey % 15 AS VARCHAR), 2, '0') || ':' || CASE WHEN n_nationkey % 3 = 0 THEN '30' ELSE '00' END END AS zone FROM nation")
def zone_offsets(spark, sf_dir):
    """UTC offsets with and without a colon and with junk behind; names of zones are none."""

    def one(r):
        k = r["n_nationkey"]
        text = "UTC" if k % 5 == 4 else f"{'+-'[k % 2]}{k % 15:02d}{':' if k % 4 else ''}{'30' if k % 3 == 0 else '00'}{' junk' if k % 7 == 0 else ''}"
        zone = dates.parse_offset(text)
        return k, zone and dates.offset_text(zone)

    return _mapped(table(spark, sf_dir, "nation").select("n_nationkey"), one, "n_nationkey int, zone string")


_CUT = "substr({} || '.supplemental-metadata', 1, 46)"


@_register("sidecar_names", f"""WITH p AS (SELECT p_partkey, CAST(p_partkey % 4 AS INT) AS k, replace(p_name, ' ', '_') || p_partkey AS b FROM part)
SELECT p_partkey,
  CASE k WHEN 0 THEN {_CUT.format("b || '(7).jpg'")} WHEN 1 THEN {_CUT.format("b || '-edited.PNG'")} WHEN 2 THEN {_CUT.format("b || '.MP4'")} ELSE {_CUT.format("b || '.m4v'")} END || '.json' AS first,
  CASE k WHEN 0 THEN {_CUT.format("b || '.jpg'")} || '(7)' WHEN 1 THEN {_CUT.format("b || '-edited'")} ELSE {_CUT.format("b")} END || '.json' AS second,
  CASE k WHEN 0 THEN {_CUT.format("b || '(7)'")} || '.json' WHEN 1 THEN {_CUT.format("b || '.PNG'")} || '.json' WHEN 2 THEN {_CUT.format("b || '.HEIC'")} || '.json' END AS third FROM p""")
def sidecar_names(spark, sf_dir):
    """The most specific names of a counted file, a rendition, a motion clip, and a video that is none."""
    k, b = F.col("p_partkey") % 4, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string"))
    name = F.when(k == 0, F.concat(b, F.lit("(7).jpg"))).when(k == 1, F.concat(b, F.lit("-edited.PNG"))).when(k == 2, F.concat(b, F.lit(".MP4"))).otherwise(F.concat(b, F.lit(".m4v")))
    found = table(spark, sf_dir, "part").select("p_partkey", sidecar.candidates(name).alias("x"))
    return found.select("p_partkey", F.get("x", F.lit(0)).alias("first"), F.get("x", F.lit(1)).alias("second"), F.when(F.col("p_partkey") % 4 < 3, F.get("x", F.lit(2))).alias("third"))


@_register("sidecar_decode", "SELECT o_orderkey, CAST(o_orderkey % 6 < 3 AS INT) AS valid, CASE WHEN o_orderkey % 6 < 3 THEN CAST(o_orderkey % 90 AS DOUBLE) END AS latitude, CASE o_orderkey % 6 WHEN 0 THEN 'Ann|Bob' WHEN 1 THEN '' WHEN 2 THEN 'Ann' END AS people FROM orders")
def sidecar_decode(spark, sf_dir):
    """Unknown keys are ignored; a wrong type anywhere rejects the whole file."""
    shapes = ['{{"geoData":{{"latitude":{},"longitude":1}},"people":[{{"name":"Ann"}},{{"name":"Bob"}}],"other":[1]}}', '{{"geoData":{{"latitude":{}.0}}}}', '{{"geoData":{{"latitude":{},"longitude":null}},"people":[{{"name":"Ann","x":2}}]}}', '{{"geoData":{{"latitude":"{}"}}}}', '{{"photoTakenTime":{{"timestamp":{}}}}}', "[{}]"]

    def one(r):
        x = sidecar.parse_sidecar(shapes[r["o_orderkey"] % 6].format(r["o_orderkey"] % 90))
        return r["o_orderkey"], int(x is not None), x and x["geoData"]["latitude"], None if x is None else "|".join(p["name"] for p in x["people"])

    return _mapped(table(spark, sf_dir, "orders").select("o_orderkey"), one, "o_orderkey long, valid int, latitude double, people string")


@_register("album_files", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name || '.jpg|b,' || c_custkey || '.jpg' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN c_name ELSE NULL END AS read FROM customer""")
def album_files(spark, sf_dir):
    """Lists of names with quotes and ragged rows, a list of another kind, and JSON albums with and without a title."""

    def one(r):
        k, name = r["c_custkey"], r["c_name"]
        if k % 5 < 3:
            raw = [f'﻿ Images ,x\r\n{name}.jpg,1\r\nragged\r\n"b,{k}.jpg",2\r\n', f"Names\n{name}\n", ""][k % 5]
            return k, "|".join(albums.parse_csv_album(raw.encode()))
        return k, albums.parse_json_album((f'{{"title": " {name} "}}' if k % 5 == 3 else '{"name": 1}').encode())

    return _mapped(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), one, "c_custkey long, read string")


_NOTE = "'title: \"mine\"' || chr(10) || 'checksum: c' || k || chr(10) || 'people:' || chr(10) || '- \"[[A]]\"' || chr(10) || '- \"[[P' || k || ']]\"' || chr(10)"


@_register("note_merge", f"""WITH k AS (SELECT c_custkey, c_custkey % 10 AS k FROM customer) SELECT c_custkey, CASE c_custkey % 3
  WHEN 0 THEN '---' || chr(10) || 'checksum: c' || k || chr(10) || 'latitude: 1.5' || chr(10) || 'people:' || chr(10) || '  - "[[P' || k || ']]"' || chr(10) || '---' || chr(10) || chr(10) || '![](m.jpg)' || chr(10)
  WHEN 1 THEN '---' || chr(10) || {_NOTE} || 'latitude: 1.5' || chr(10) || '---' || chr(10) || 'my text' || chr(10) END AS note,
  CASE c_custkey % 3 WHEN 0 THEN 'a: 1|b' WHEN 1 THEN '|---a' ELSE '|b' END AS split FROM k""")
def note_merge(spark, sf_dir):
    """A new note, one with its own keys and text, and one that has everything already; and front matter split from bodies."""

    def one(r):
        k = r["c_custkey"] % 10
        scalars, arrays = {"checksum": f"c{k}", "latitude": 1.5, "longitude": None}, {"people": [f"[[P{k}]]"]}
        old = f'---\ntitle: "mine"\nchecksum: old\npeople:\n- "[[A]]"\n---\nmy text\n'
        same = f'---\nlatitude: 1.5 # by hand\nchecksum: "c{k}"\npeople: ["[[P{k}]]"]\n---\nx'
        note = notes.merged_note([None, old, same][r["c_custkey"] % 3], "m.jpg", scalars, arrays)
        return r["c_custkey"], note, "|".join(notes.split_front(["---\na: 1\n---\nb", "---a", "b"][r["c_custkey"] % 3]))

    return _mapped(table(spark, sf_dir, "customer").select("c_custkey"), one, "c_custkey long, note string, split string")


@_register("album_note", f"SELECT n_nationkey, {notes.LIST_NOTE!r} || '# ' || n_name || chr(10) || chr(10) || chr(10) || '![Photo](../a/' || n_regionkey || '.jpg)' || chr(10) || '![Photo](../b.jpg)' || chr(10) || chr(10) || '{notes.MARKER}' || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN 'kept ' || n_nationkey ELSE '' END AS note FROM nation".replace("\\n", "' || chr(10) || '"))
def album_note(spark, sf_dir):
    """The list is rebuilt; what stands below the first marker is kept."""

    def one(r):
        existing = f"# old\n{notes.MARKER}\nkept {r['n_nationkey']}" if r["n_nationkey"] % 2 == 0 else "no marker"
        return r["n_nationkey"], notes.album_markdown(r["n_name"], [f"a/{r['n_regionkey']}.jpg", "b.jpg"], existing)

    return _mapped(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), one, "n_nationkey int, note string")


@_register("type_names", "WITH p AS (SELECT page_id, CAST(page_id % 6 AS INT) AS k FROM pages) SELECT page_id, (['Heic', 'Mov', 'Tif', 'ThreeGpp', 'Unsupported', 'Wmv'])[k + 1] AS file_type, (['heic', 'mov', 'tif', '3gp', 'bin', 'wmv'])[k + 1] AS ext, (['ExifTags', 'Track', 'ExifTags', 'Track', 'NoMetadata', 'NoMetadata'])[k + 1] AS metadata, CASE WHEN k IN (0, 2) THEN 'p' WHEN k <> 4 THEN 'v' END AS kind FROM p")
def type_names(spark, sf_dir):
    named = F.element_at(F.array(*map(F.lit, ["image/heif", "video/quicktime", "image/tiff", "video/3gpp2", "text/plain", "video/x-ms-wmv"])), (F.col("page_id") % 6 + 1).cast("int"))
    kind = media_types.type_of_content_type(named)
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("file_type"), media_types.type_extension(kind).alias("ext"), media_types.metadata_type(kind).alias("metadata"), media_types.media_kind(kind).alias("kind"))


@_register("tag_values", "SELECT l_orderkey, l_linenumber, CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN l_partkey WHEN 1 THEN l_suppkey WHEN 2 THEN NULL ELSE l_partkey END AS width, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS make FROM lineitem")
def tag_values(spark, sf_dir):
    """The Exif tag counts where it is there, whether or not it is a number; else the other one."""
    n = F.col("l_linenumber") % 4
    exif = F.when(n == 0, F.concat(F.lit(" "), F.col("l_partkey").cast("string"))).when(n == 2, "x").when(n == 3, F.col("l_partkey").cast("string"))
    entries = F.array_compact(F.array(F.when(exif.isNotNull(), F.struct(F.lit("ExifImageWidth").alias("k"), exif.alias("v"))), F.struct(F.lit("ImageWidth").alias("k"), F.col("l_suppkey").cast("string").alias("v")), F.when(n % 2 == 0, F.struct(F.lit("Make").alias("k"), F.col("l_returnflag").alias("v")))))
    tags = F.map_from_entries(entries)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geo.image_size(tags, "Width").alias("width"), F.element_at(tags, "Make").alias("make"))


@_register("link_names", r"SELECT c_custkey, 'Trip ' || c_custkey AS album, '[[Trip ' || c_custkey || ']]' AS link, '[[' || c_name || ']]|[[x]]' AS people, 'a/' || c_custkey || '.md' AS note, c_name || '\| b c' AS cell, '`it''s ' || c_custkey || '`' AS code, CASE c_custkey % 3 WHEN 0 THEN c_name || ' (x)' WHEN 1 THEN c_name ELSE 'x' END AS time, c_custkey % 2 = 0 AS same FROM customer")
def link_names(spark, sf_dir):
    """Names of albums, people and notes as links, and text for tables."""
    k = F.col("c_custkey").cast("string")
    album = paths.album_link_name(F.concat(F.lit("albums/Trip "), k, F.lit(".md")))
    people = paths.people_links(F.array(F.concat(F.lit(" 　"), "c_name", F.lit(" \t")), F.lit("   "), F.lit("x")))
    iso, shown = F.when(F.col("c_custkey") % 3 < 2, F.col("c_name")), F.when(F.col("c_custkey") % 3 != 1, F.lit("x"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", album.alias("album"), paths.wikilink(album).alias("link"), F.array_join(people, "|").alias("people"), paths.markdown_path(F.concat(F.lit("a/"), k, F.lit(".jpg"))).alias("note"),
        paths.table_cell(F.concat("c_name", F.lit("| b\r\nc"))).alias("cell"), paths.code(F.concat(F.lit("it`s "), k)).alias("code"), dates.sidecar_text(iso, shown).alias("time"),
        ids.same_content(F.lit("0"), (F.col("c_custkey") % 2).cast("string")).alias("same"),
    )


@_register("track_points", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 90 + 0.5 AS DOUBLE) WHEN 1 THEN CAST(-(event_id % 90) - 0.25 AS DOUBLE) END AS latitude, CASE event_id % 4 WHEN 0 THEN CAST(-100.5 AS DOUBLE) WHEN 1 THEN CAST(7 AS DOUBLE) END AS longitude FROM events")
def track_points(spark, sf_dir):
    """ISO 6709 texts with a height, with a name of a reference system, of the null island, and with a lone number."""
    n = (F.col("event_id") % 90).cast("string")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("+"), n, F.lit(".5-100.5+12/"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("-"), n, F.lit(".25+7CRSWGS_84/"))).when(F.col("event_id") % 4 == 2, F.lit("+0.0-00.00/")).otherwise(F.concat(F.lit("+"), n, F.lit("/")))
    at = geo.iso_6709(text)
    return table(spark, sf_dir, "events").select("event_id", at["latitude"].alias("latitude"), at["longitude"].alias("longitude"))


_PAIRS = f"WITH {MEDIA_SQL}, p AS (SELECT min(long_hash) FILTER (WHERE kind = 'p') AS still, min(long_hash) FILTER (WHERE kind = 'v') AS video FROM media_item WHERE content_identifier IS NOT NULL GROUP BY content_identifier HAVING still IS NOT NULL AND video IS NOT NULL) SELECT DISTINCT video AS long_hash, 'out/' || still AS want, substr(video, 1, 7) AS short_hash FROM p WHERE substr(still, 1, 1) <> '0'"


@_register("paired_video_names", _PAIRS)
def paired_video_names(spark, sf_dir):
    """A Live Photo's video is called like its still, unless that has no place (here: hashes that begin with 0)."""
    m = media(spark, sf_dir)
    hashes = m.select("long_hash", "short_hash").distinct()
    named = hashes.select("long_hash", F.when(~F.col("long_hash").startswith("0"), F.concat(F.lit("out/"), "long_hash", F.lit(".jpg"))).alias("output_path"))
    return dedup.sidecar_videos(dedup.live_photo_pairs(m), named, hashes.withColumn("want", F.lit("dated"))).select("long_hash", "want", "short_hash").distinct()


def _scratch(spark) -> str:
    """A folder of this query's own in the folder that all executors share."""
    return f"{shared(spark)}/records-{uuid.uuid4().hex}"


def _plain(uri: str) -> str:
    return uri.removeprefix("file://") if uri.startswith("file://") else uri


@_register("catalog_merge", "SELECT substr(sha256(nfc_normalize(lower(trim(n_name)))), 1, 16) AS person_id, CASE WHEN n_nationkey % 3 = 0 THEN 'last' WHEN n_nationkey % 2 = 0 THEN 'old' ELSE 'new' END AS name, CAST(2 AS BIGINT) AS runs, (SELECT COUNT(*) FROM nation) AS people FROM nation")
def catalog_merge(spark, sf_dir):
    """Rows inserted where absent, then upserted, over two runs of which one comes again; numbers of rows and runs are read back."""
    cat = Catalog(spark, _scratch(spark))
    person = table(spark, sf_dir, "nation").select(ids.person_id(F.col("n_name")).alias("person_id"), "n_nationkey")
    named = lambda rows, name: rows.select("person_id", F.lit(name).alias("name"))
    first, second = cat.run("in"), cat.run("else")
    cat.insert("person", named(person.where("n_nationkey % 2 = 0"), "old"))
    cat.insert("person", named(person, "new"))
    cat.upsert("person", named(person.where("n_nationkey % 3 = 0"), "last"))
    if (cat.run("in"), cat.run("else")) != (first, second):
        raise ValueError("a run has no id of its own")
    counts = cat.counts()
    return cat.read("person").select("*", F.lit(counts["run"]).cast("long").alias("runs"), F.lit(counts["person"]).cast("long").alias("people"))


@_register("archive_files", "SELECT 'd' || n_regionkey || '/' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN '.jpg' ELSE '.csv' END AS path, CAST(strlen(n_name) + 7 AS BIGINT) AS file_size, CASE WHEN n_nationkey % 2 = 0 THEN 'Media' ELSE 'AlbumCsv' END AS quick_file_type, sha256('content' || n_name) AS hash, 'written' AS first, 'unchanged' AS again FROM nation")
def archive_files(spark, sf_dir):
    """Files written by tasks, written again, listed, and read back: what is there already is left alone."""
    root = _scratch(spark)
    path = F.concat(F.lit("d"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name", F.when(F.col("n_nationkey") % 2 == 0, ".jpg").otherwise(".csv"))
    rows = table(spark, sf_dir, "nation").select(path.alias("path"), F.concat(F.lit("content"), "n_name").alias("text"))
    write = lambda r: (r["path"], sinks.put(places.open_output(_plain(root)), r["path"], io.BytesIO(r["text"].encode())))
    first = _mapped(rows, write, "path string, first string").toPandas()  # one row a nation
    again = _mapped(rows, write, "path string, again string").toPandas()
    listed = files.listing(spark, _plain(root))
    done = spark.createDataFrame(first.merge(again, on="path"))
    return listed.select("path", "file_size", "quick_file_type").join(sinks.hashes(listed, _plain(root)).withColumnRenamed("existing_hash", "hash"), "path").join(done, "path")


@_register("archive_inspect", "SELECT n_nationkey || '.jpg' AS path, 'Jpg' AS accurate_file_type, 'ok' AS status, n_name AS make, '2008-05-' || lpad(CAST(1 + n_nationkey AS VARCHAR), 2, '0') || 'T15:56:01+13:00' AS capture, '2008/05/' || lpad(CAST(1 + n_nationkey AS VARCHAR), 2, '0') || '/1556-01000.jpg' AS want FROM nation UNION ALL SELECT 'bad.png', 'Unsupported', 'Unsupported', NULL, NULL, NULL")
def archive_inspect(spark, sf_dir):
    """Photos in an archive, inspected in tasks: type, tags, date and the path that follows; a file of no known type is reported."""
    root = _scratch(spark)
    place = places.open_output(_plain(root))
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").toLocalIterator():
        place.write(f"{r.n_nationkey}.jpg", io.BytesIO(synthetic.exif_jpeg({0x010F: r.n_name, 0x9003: f"2008:05:{1 + r.n_nationkey:02d} 15:56:01", 0x9011: "+13:00"})))
    place.write("bad.png", io.BytesIO(b"no"))
    seen = inspect(files.listing(spark, _plain(root)), _plain(root), "+00:00")
    want = F.when(F.col("capture").isNotNull(), F.concat(paths.desired_media_path(F.col("capture"), F.col("short_hash")), F.lit("."), media_types.type_extension(F.col("accurate_file_type"))))
    return seen.select("path", "accurate_file_type", "status", F.element_at("tags", "Make").alias("make"), "capture", want.alias("want"))


def _export(spark, sf_dir) -> str:
    """A small photo export, a photo a nation: even ones have a sidecar, and all are in an album."""
    root = _plain(_scratch(spark))
    place = places.open_output(root)
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").toLocalIterator():
        photo = f"Google Photos/Trip/{r.n_name}.jpg"
        place.write(photo, io.BytesIO(synthetic.exif_jpeg({0x010F: r.n_name, 0x9003: f"2008:05:{1 + r.n_nationkey:02d} 15:56:01", 0x9011: "+13:00"})))
        if r.n_nationkey % 2 == 0:
            text = f'{{"geoData":{{"latitude":{r.n_nationkey + 1},"longitude":2}},"people":[{{"name":"Ann"}}]}}'
            place.write(f"{photo}.supplemental-metadata.json", io.BytesIO(text.encode()))
    place.write("Google Photos/Trip/metadata.json", io.BytesIO(b'{"title": "The Trip"}'))
    place.write("Google Photos/Photos from 2012/metadata.json", io.BytesIO(b'{"title": "2012"}'))
    place.write("bad.png", io.BytesIO(b"no"))
    return root


_DAY = "lpad(CAST(1 + n_nationkey AS VARCHAR), 2, '0')"


@_register("archive_db", f"SELECT 'Google Photos/Trip/' || n_name || '.jpg' AS media_path, 'Jpg' AS accurate_file_type, '2008-05-' || {_DAY} || 'T15:56:01+13:00' AS guessed_datetime, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey + 1 AS DOUBLE) END AS latitude, CASE WHEN n_nationkey % 2 = 0 THEN CAST(2 AS DOUBLE) END AS longitude, n_name AS camera_make, 'p' AS kind, CASE WHEN n_nationkey % 2 = 0 THEN 'Ann' END AS person, 'The Trip' AS album, CAST(1 AS BIGINT) AS skipped, (SELECT COUNT(*) FROM nation) AS resolved, (SELECT COUNT(*) FROM nation) AS recorded_before FROM nation")
def archive_db(spark, sf_dir):
    """An export into a catalog, twice: media with sidecars, people and albums joined, and what the runs counted."""
    from . import commands

    source, root = _export(spark, sf_dir), _scratch(spark)
    first = commands.db(spark, source, root, "+00:00").counters
    cat = commands.db(spark, source, root, "+00:00")
    people = cat.read("media_person").join(cat.read("person"), "person_id").select("media_item_id", F.col("name").alias("person"))
    titles = cat.read("album_file").join(cat.read("album"), "album_id").select("media_item_id", F.col("title").alias("album"))
    rows = cat.read("media_item").join(people, "media_item_id", "left").join(titles, "media_item_id", "left")
    counted = {"skipped": first["skipped files"], "resolved": first["resolved album members"], "recorded_before": cat.counters["recorded before"]}
    return rows.select("media_path", "accurate_file_type", "guessed_datetime", "latitude", "longitude", "camera_make", "kind", "person", "album", *(F.lit(n).cast("long").alias(c) for c, n in counted.items()))


@_register("archive_sync", f"WITH p AS (SELECT '2008/05/' || {_DAY} || '/1556-01000' AS stem FROM nation) SELECT stem || '.jpg' AS output_path, 'written' AS first, 'skip' AS again FROM p UNION ALL SELECT stem || '.md', 'written', 'unchanged' FROM p UNION ALL SELECT 'albums/Trip.md', 'written', 'unchanged'")
def archive_sync(spark, sf_dir):
    """An export into a dated archive, twice: photos, their notes and the album's list; the second run changes nothing."""
    from . import commands

    source, root = _export(spark, sf_dir), _plain(_scratch(spark))
    first = commands.sync(spark, source, root, "+00:00").withColumnRenamed("status", "first")
    first = staged(first, "first")
    return first.join(commands.sync(spark, source, root, "+00:00").withColumnRenamed("status", "again"), "output_path")

