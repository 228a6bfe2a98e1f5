"""Content deduplication, Live Photo pairing and collision-free output names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import same_content


def content_dedup(media: DataFrame) -> DataFrame:
    """One row a long_hash: the whole record of the smallest path, and original_path, all paths in order.

    Records are not merged: metadata of other copies is dropped. Paths are aggregated before the shuffle.
    """
    record = F.struct(*media.columns)
    # first the path's own order, so that the record of the smallest path wins
    rolled = media.groupBy("long_hash").agg(F.min_by(record, "path").alias("m"), F.array_sort(F.collect_set("path")).alias("original_path"))
    return rolled.select(*(F.col("m")[c].alias(c) for c in media.columns), "original_path")


def live_photo_pairs(media: DataFrame) -> DataFrame:
    """(content_identifier, still_hash, video_hash): the first still and video by hash, where there are both."""
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("long_hash")))
    halves = media.where("content_identifier is not null").groupBy("content_identifier").agg(first("p").alias("still_hash"), first("v").alias("video_hash"))
    return halves.where("still_hash is not null and video_hash is not null")


def fresh_names(media: DataFrame) -> DataFrame:
    """media (want, ext, short_hash, long_hash) with output_path, for an empty output.

    In hash order the first taker of a name has it bare; of the others, the first with a
    short hash has that as a suffix; the rest take the long one.
    """
    by = Window.partitionBy("want", "ext").orderBy("long_hash")
    first = media.withColumn("bare", F.row_number().over(by) == 1)
    again = Window.partitionBy("want", "ext", "short_hash", "bare").orderBy("long_hash")
    suffix = F.when(F.col("bare"), "").when(F.row_number().over(again) == 1, F.concat(F.lit("-"), F.col("short_hash"))).otherwise(F.concat(F.lit("-"), F.col("long_hash")))
    return first.withColumn("output_path", F.concat("want", suffix, F.lit("."), "ext")).drop("bare")


#: Stands for the checksum of a file that cannot be the same, as its size differs: it equals none.
OTHER_SIZE = "another size"


def candidate_paths(media: DataFrame) -> DataFrame:
    """media with `try`, a row for each of the three names that an item may take."""
    rung = lambda *more: F.concat("want", *more, F.lit("."), "ext")
    return media.withColumn("try", F.explode(F.array(rung(), rung(F.lit("-"), F.col("short_hash")), rung(F.lit("-"), F.col("long_hash")))))


def candidates_there(media: DataFrame, there: DataFrame) -> DataFrame:
    """(path, file_size, modified, to_read) of the files of an output (path, file_size, modified) that any item of media (want, ext, short_hash,
    long_hash, file_size) may be named like. Only where the sizes agree can the bytes: to_read marks those; no others need to be read. A path that there has
    more than once comes once, with its largest size, and is read if any of its sizes agrees."""
    tried = candidate_paths(media.select("want", "ext", "short_hash", "long_hash", F.col("file_size").alias("own_size"))).select(F.col("try").alias("path"), "own_size")
    agrees = F.max((F.col("own_size") == F.col("file_size")).cast("int")) == 1
    found = there.select("path", "file_size", "modified").join(tried, "path").groupBy("path").agg(F.max(F.struct("file_size", "modified")).alias("x"), F.coalesce(agrees, F.lit(True)).alias("to_read"))
    return found.select("path", "x.file_size", "x.modified", "to_read")


def _step(rows: DataFrame, existing: DataFrame, suffix: Column, *by: str) -> DataFrame:
    """rows with the path of one rung, what is there, and the rung's outcome: write, skip, error or null (on to the next).
    Where nothing is there, the first by hash of those that share the path takes it."""
    there = existing.select(F.col("path").alias("try"), F.struct("existing_hash").alias("there"))
    tried = rows.withColumn("try", F.concat("want", suffix, F.lit("."), "ext")).join(there, "try", "left")
    first = F.row_number().over(Window.partitionBy(*by).orderBy("long_hash")) == 1
    held = F.col("there.existing_hash")
    outcome = F.when(F.col("there").isNull(), F.when(first, "write")).when(held.isNull(), "error").when(same_content(F.col("long_hash"), held), "skip")
    return tried.withColumn("action", outcome)


def names_over_existing(media: DataFrame, existing: DataFrame) -> DataFrame:
    """(long_hash, output_path, action) of media (want, ext, short_hash, long_hash, each hash once) where the output has
    files already: existing (path, existing_hash), each path once.

    The rungs are the bare name, the short hash and the long one as a suffix. action is write, skip (the same bytes are there) or error
    (unreadable, or no name is free). A null existing_hash marks a file that cannot be read.
    """
    columns = ["want", "ext", "short_hash", "long_hash"]
    left, done = media.select(*columns), []
    dash = lambda c: F.concat(F.lit("-"), F.col(c))
    for suffix, by in ((F.lit(""), ["want", "ext"]), (dash("short_hash"), ["want", "ext", "short_hash"]), (dash("long_hash"), ["want", "ext", "long_hash"])):
        tried = _step(left, existing, suffix, *by)
        done.append(tried.where("action is not null").select("long_hash", F.when(F.col("action") != "error", F.col("try")).alias("output_path"), "action"))
        left = tried.where("action is null").select(*columns)
    done.append(left.select("long_hash", F.lit(None).cast("string").alias("output_path"), F.lit("error").alias("action")))
    return reduce(DataFrame.unionByName, done)


def sidecar_videos(pairs: DataFrame, named: DataFrame, media: DataFrame) -> DataFrame:
    """What each paired video wants to be called: its still's final path with the video's extension. Stills without a path drop out."""
    stills = named.select(F.col("long_hash").alias("still_hash"), "output_path").where("output_path is not null")
    want = pairs.join(stills, "still_hash").select(F.col("video_hash").alias("long_hash"), F.regexp_replace("output_path", r"\.[^./]*\z", "").alias("want"))
    return media.drop("want").join(want, "long_hash")
