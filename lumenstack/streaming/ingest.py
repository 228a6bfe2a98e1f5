"""Ingestion into the catalog as a stream: files as they arrive, so many at a time, each counted once across restarts.

Spark's file source remembers which files it has handed out, in a checkpoint beside the catalog. Each batch of files is recorded by upserts that carry the
batch's number: a batch that ran half and is run again changes nothing that it had written, and ends as if it had run once.
A sidecar may come in a later batch than its photo: the photos in directories that get a JSON file are inspected again, with all sidecars known by then.
Albums are linked once the files that were there have been read. Files whose names begin with a dot or an underscore are not seen: Spark's source skips them.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media_types import quick_file_type
from ..functions.paths import dir_part
from ..plans.commands import classified_files, classified_folders, link_albums, record_media
from ..plans.staging import staged
from ..sources.catalog import Catalog
from ..sources.files import listing


def _arrivals(rows: DataFrame, uri: str) -> DataFrame:
    """Of files that the source hands out, what a listing says of them."""
    root = F.lit(uri.rstrip("/").removeprefix("file://"))
    full = F.regexp_replace("path", "^file:/+", "/")
    relative = F.substring(full, F.length(root) + 2, F.length(full))
    out = rows.select(relative.alias("path"), F.col("length").alias("file_size"), F.unix_millis("modificationTime").alias("modified"), F.lit(None).cast("long").alias("created"))
    return out.withColumn("quick_file_type", quick_file_type(F.col("path")))


def ingest(spark: SparkSession, uri: str, root: str, timezone: str | None = None, files_per_batch: int = 1000, skip_albums: bool = False) -> Catalog:
    """Record a directory's new files in a catalog and stop; called again, it goes on where it was. uri: a directory that all executors see."""
    cat = Catalog(spark, root)
    run_id = cat.run(uri)
    source = "ingest " + sha256(uri.encode()).hexdigest()[:16]

    def batch(rows: DataFrame, number: int) -> None:
        mark = (source, number)
        scan = staged(_arrivals(rows, uri), "arrivals")
        cat.upsert("classified_file", classified_files(scan, run_id), mark)
        cat.upsert("classified_dir", classified_folders(scan, run_id), mark)
        known = cat.read("classified_file").where(F.col("run_id") == run_id).select(F.col("file_path").alias("path"))
        fed = scan.where("lower(path) like '%.json'").select(dir_part(F.col("path")).alias("dir")).distinct()
        zero = lambda c: F.nullif(F.col(c), F.lit(0)).alias(c.removesuffix("_at"))
        before = cat.read("media_item").select(F.col("media_path").alias("path"), "file_size", zero("modified_at"), zero("created_at"), "quick_file_type")
        again = before.withColumn("dir", dir_part(F.col("path"))).join(fed, "dir", "left_semi").drop("dir")
        new = scan.where("quick_file_type = 'Media'")
        todo = staged(new.unionByName(again.join(new.select("path"), "path", "left_anti").select(*new.columns)), "todo")
        record_media(cat, known, todo, uri, timezone, mark)

    files = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(uri).select("path", "modificationTime", "length")
    query = files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{cat.root}/_streams/{source.split()[1]}").trigger(availableNow=True).start()
    query.awaitTermination()
    if not skip_albums:
        link_albums(cat, staged(listing(spark, uri), "scan"), uri)
    return cat

