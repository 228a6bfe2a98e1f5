"""Albums: members by name or directory, links, and their final paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import dir_part, name_part
from ..functions.sidecar import JSON, STEM_CHARS, TAG, described_names

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def csv_members(members: DataFrame, scan: DataFrame) -> DataFrame:
    """(album, position, path): members (album, position, file_name) by bare name, ASCII case
    ignored; of several media files with the name, the first of the scan."""
    by_name = Window.partitionBy("key").orderBy("scan_ordinal")
    first = scan.where("quick_file_type = 'Media'").select(ascii_lower(name_part(F.col("path"))).alias("key"), "path", "scan_ordinal").withColumn("nth", F.row_number().over(by_name)).where("nth = 1").select("key", "path")
    return members.withColumn("key", ascii_lower(F.col("file_name"))).join(first, "key").select("album", "position", "path")


def json_members(albums: DataFrame, scan: DataFrame) -> DataFrame:
    """(album, path): all media files in the directory of each album file (album, album_path)."""
    here = scan.where("quick_file_type = 'Media'").select(dir_part(F.col("path")).alias("dir"), "path")
    return albums.select("album", dir_part(F.col("album_path")).alias("dir")).join(here, "dir").select("album", "path")


def album_links(members: DataFrame, items: DataFrame) -> DataFrame:
    """(album_id, media_item_id), distinct; members without an item drop out."""
    return members.join(items.select(F.col("media_path").alias("path"), "media_item_id"), "path").select("album_id", "media_item_id").distinct()


def album_names(media: DataFrame, members: DataFrame) -> DataFrame:
    """(long_hash, albums): names of the albums that hold any of an item's paths, each once, in the order
    of paths and then of albums. members has (name, album_ordinal, path)."""
    paths = media.select("long_hash", F.posexplode("original_path").alias("nth", "path"))
    seen = paths.join(members, "path").groupBy("long_hash", "name").agg(F.min(F.struct("nth", "album_ordinal")).alias("at"))
    return seen.groupBy("long_hash").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("x")).select("long_hash", F.col("x.name").alias("albums"))


def final_paths(members: DataFrame, media: DataFrame) -> DataFrame:
    """(album, position, output_path): members (album, position, path) through the item that any of its
    paths belongs to. Paths are exploded, so the join is an equi-join."""
    paths = media.select(F.explode("original_path").alias("path"), "output_path").where("output_path is not null")
    return members.join(paths, "path").select("album", "position", "output_path")


def sidecar_lookup(media: DataFrame, scan: DataFrame, candidates: Column) -> DataFrame:
    """(path, sidecar): the first of an ordered array of names that exists in the same directory."""
    tried = media.select("path", dir_part(F.col("path")).alias("dir"), F.posexplode(candidates).alias("pos", "name"))
    full = tried.select("path", "pos", F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name")).alias("sidecar"))
    return full.join(scan.select(F.col("path").alias("sidecar")), "sidecar").groupBy("path").agg(F.min_by("sidecar", "pos").alias("sidecar"))


def _readings(scan: DataFrame) -> DataFrame:
    """(dir, stem, counter, described, cut, sidecar): what a JSON file's name may say. A stem is a described name and the first `cut` characters
    of the tag; the tag has one dot, its first, so those can only begin at the stem's last dot, or be none. With a counter or without, at most four readings."""
    files = scan.select(F.col("path").alias("sidecar"), dir_part(F.col("path")).alias("dir"), name_part(F.col("path")).alias("name")).where(F.col("name").endswith(JSON))
    whole = files.withColumn("title", F.expr(f"left(name, length(name) - {len(JSON)})"))
    counter = F.regexp_extract("title", r"(?s)(\([0-9]+\))\z", 1)
    as_is = F.struct(F.col("title").alias("stem"), F.lit("").alias("counter"))
    counted = F.struct(F.expr("left(title, length(title) - length(c))").alias("stem"), F.col("c").alias("counter"))
    stems = whole.withColumn("c", counter).select("sidecar", "dir", F.inline(F.when(F.col("c") == "", F.array(as_is)).otherwise(F.array(as_is, counted))))
    tail = F.regexp_extract("stem", r"(?s)(\.[^.]*)\z", 1)
    plain = F.struct(F.col("stem").alias("described"), F.lit(0).alias("cut"))
    tagged = F.struct(F.expr("left(stem, length(stem) - length(tail))").alias("described"), F.length("tail").alias("cut"))
    tags = (F.col("tail") != "") & F.lit(TAG).startswith(F.col("tail"))
    return stems.withColumn("tail", tail).select("sidecar", "dir", "stem", "counter", F.inline(F.when(tags, F.array(plain, tagged)).otherwise(F.array(plain))))


def sidecar_join(media: DataFrame, scan: DataFrame) -> DataFrame:
    """(path, sidecar): each media file's sidecar in its directory, by the same rule as the ordered candidates.

    First, in the order of what may be described, the name cut at the limit; then, where the limit matters, the longest cut within the tag. All cuts
    of one described name are prefixes of one another, so they are not listed: sidecars are read backwards, and both sides meet on what is
    described. A media file takes part with two rows for each name that it may go by, whatever its length, a sidecar with at most four.
    Rows are dealt out by path before they are multiplied, and the joins are merges: names take far more room than the compressed files that they
    come from, by whose size a plan would put all of them into one task or broadcast them.
    """
    media, scan = media.repartition(F.col("path")), scan.repartition(F.col("path"))
    named = media.select("path", dir_part(F.col("path")).alias("dir"), F.posexplode(described_names(name_part(F.col("path")))).alias("nth", "k")).select("path", "dir", "nth", F.col("k")[0].alias("described"), F.col("k")[1].alias("counter"))
    full = F.concat("described", F.lit(TAG))
    cut = named.select("path", "dir", "counter", F.substring(full, 1, STEM_CHARS).alias("stem"), F.struct(F.lit(0).alias("late"), "nth", F.lit(0).alias("short")).alias("rank"))
    read = _readings(scan)
    stems = read.where("cut = 0").select("dir", "counter", "stem", "sidecar")  # each stem is read as a bare name once
    at_limit = cut.join(stems.hint("merge"), ["dir", "counter", "stem"])
    long = named.where(F.length(full) > STEM_CHARS).join(read.select("dir", "counter", "described", "cut", "sidecar").hint("merge"), ["dir", "counter", "described"])
    within = long.select("path", "sidecar", F.struct(F.lit(1).alias("late"), "nth", (-F.col("cut")).alias("short")).alias("rank"))
    return at_limit.select("path", "sidecar", "rank").unionByName(within).groupBy("path").agg(F.min_by("sidecar", "rank").alias("sidecar"))


def resume(scan: DataFrame, recorded: DataFrame) -> DataFrame:
    """Rows of scan (media_item_id, file_size) not recorded with the same size."""
    seen = recorded.select("media_item_id", F.coalesce("file_size", F.lit(-1)).alias("file_size"))
    return scan.join(seen, ["media_item_id", "file_size"], "left_anti")
