"""A ledger of an output's checksums: what was hashed or written once is not read again while its size and time stay.

It is a layered table (see layers) beside the output: each sync adds what it learnt, and buckets are written anew as they grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layers import LayeredTable

SCHEMA = "path string, file_size long, modified long, hash string, recorded_at timestamp"


class Ledger:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.table = LayeredTable(spark, root, SCHEMA, ["path"], buckets)

    def known(self, files: DataFrame) -> DataFrame:
        """(path, file_size, modified, hash) of those of files (path, file_size, modified) that are as they were when they were recorded."""
        return files.select("path", "file_size", "modified").join(self.table.read().drop("recorded_at"), ["path", "file_size", "modified"])

    def record(self, seen: DataFrame) -> None:
        """seen (path, file_size, modified, hash) takes the place of what was known of its paths. Without a checksum or a time nothing is recorded."""
        self.table.upsert(seen.where("hash is not null and modified is not null").select("path", "file_size", "modified", "hash", F.current_timestamp().alias("recorded_at")))
