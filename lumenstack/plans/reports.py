"""The catalog's analytical reports over media_item, person, album and their links.

Top-k reports order ties by a unique column; sums are bigint and ratios double, on any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GB, MB = 1073741824.0, 1048576.0


def _items():
    return F.count("*").alias("items")


def _in(column, unit: float, digits: int):
    return F.round(column.cast("double") / F.lit(unit), digits)


def collection_size(media: DataFrame) -> DataFrame:
    total = F.sum("file_size")
    return media.agg(_items(), total.cast("long").alias("total_bytes"), _in(total, GB, 2).alias("total_gb"))


def kind_mix(media: DataFrame) -> DataFrame:
    return media.groupBy("kind").agg(_items())


def file_types(media: DataFrame) -> DataFrame:
    return media.groupBy(F.col("accurate_file_type").alias("file_type")).agg(_items(), _in(F.sum("file_size"), MB, 1).alias("total_mb")).orderBy(F.desc("items"), "file_type")


def items_per_year(media: DataFrame) -> DataFrame:
    return media.where("guessed_datetime is not null").groupBy(F.substring("guessed_datetime", 1, 4).alias("year")).agg(_items()).orderBy("year")


def largest_files(media: DataFrame, k: int = 10) -> DataFrame:
    return media.orderBy(F.desc("file_size"), "media_path").limit(k).select("media_path", _in(F.col("file_size"), MB, 1).alias("size_mb"))


def camera_mix(media: DataFrame, k: int = 10) -> DataFrame:
    return media.where("camera_model is not null").groupBy("camera_make", "camera_model").agg(_items()).orderBy(F.desc("items"), "camera_make", "camera_model").limit(k)


def location_split(media: DataFrame) -> DataFrame:
    return media.agg(F.count_if(F.col("latitude").isNotNull()).alias("with_location"), F.count_if(F.col("latitude").isNull()).alias("without_location"))


def orientation_mix(media: DataFrame) -> DataFrame:
    """Grouped by the raw column: null and a literal 'unknown' would stay two rows."""
    return media.groupBy("orientation").agg(_items()).select(F.coalesce("orientation", F.lit("unknown")).alias("orientation"), "items").orderBy(F.desc("items"))


def people_rank(person: DataFrame, media_person: DataFrame, k: int = 10) -> DataFrame:
    counted = media_person.groupBy("person_id").agg(F.count("*").alias("appears_in"))
    return person.join(counted, "person_id").orderBy(F.desc("appears_in"), "person_id").limit(k).select("name", "appears_in")


def album_sizes(album: DataFrame, album_file: DataFrame) -> DataFrame:
    """All albums, the empty ones too. Links are counted before the join."""
    counted = album_file.groupBy("album_id").agg(F.count("media_item_id").alias("items"))
    return album.join(counted, "album_id", "left").select("title", F.coalesce("items", F.lit(0)).alias("items")).orderBy(F.desc("items"), "title")


def live_photo_join(media: DataFrame, k: int | None = 10) -> DataFrame:
    """Every still with every video of its content identifier; the pipeline itself pairs one with one.

    For the first k pairs only the first k stills that have a video, and each identifier's first k videos, can matter: at most k * k pairs are made. Both
    limits are taken before rows are shuffled.
    """
    named = media.where("content_identifier is not null")
    still = named.where("kind = 'p'").select("content_identifier", F.col("media_path").alias("still"))
    video = named.where("kind = 'v'").select("content_identifier", F.col("media_path").alias("video"), F.round(F.col("duration_ms").cast("double") / 1000, 1).alias("video_seconds"))
    if k:
        nth = F.row_number().over(Window.partitionBy("content_identifier").orderBy("video", "video_seconds"))
        video = video.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
        still = still.join(video.select("content_identifier").distinct(), "content_identifier", "left_semi").orderBy("still", "content_identifier").limit(k)
    pairs = still.join(video, "content_identifier").select("still", "video", "video_seconds")
    return pairs.orderBy("still", "video").limit(k) if k else pairs


def duplicates(media: DataFrame, k: int = 10) -> DataFrame:
    """wasted_bytes counts every copy of a duplicated file."""
    counted = media.where("long_hash is not null").groupBy("long_hash").agg(F.count("*").alias("copies"), F.sum("file_size").cast("long").alias("wasted_bytes"))
    return counted.where("copies > 1").orderBy(F.desc("copies"), "long_hash").limit(k)
