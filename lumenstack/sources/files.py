"""Listings of sources: directories, object stores and zip files, as a data source whose partitions are key ranges.

Planning walks directories until it knows WIDE of them, keeping their names and, of each, where to cut its files into pieces: a flat directory of any size
is listed by many tasks, and so is a zip file's index. Tasks look at the files, and list whatever lies below the directories that planning did not reach. The
driver holds no rows. An object store's prefix comes in one piece, which one task reads and passes on.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.media_types import quick_file_type
from .places import Folder, S3Uri, Zip, kind_of, open_input, safe_name, walk, zip_times

__all__ = ["S3Uri", "endpoint_of", "kind_of", "listing", "open_entry", "safe_name", "zip_times"]

LISTING = "path string, file_size long, modified long, created long, scan_ordinal long"
#: Directories that planning looks for, rows in one Arrow batch, and files in a piece of a directory.
WIDE, ROWS, PIECE = 256, 10_000, 20_000
#: Numbers of a piece's rows begin at multiples of this; rows of a zip file are numbered by the place of their record in its index.
STRIDE = 1 << 40


def endpoint_of(spark: SparkSession) -> str | None:
    """The object store's endpoint, where it is not the usual one: Spark's own setting for it."""
    return spark.conf.get("spark.hadoop.fs.s3a.endpoint", None)


@dataclass
class Piece(InputPartition):
    """Files of one directory from low to before high, or, if deep, of all directories below it as well; of a zip file, a part of its index."""

    number: int
    folder: str
    low: str | int | None = None
    high: str | int | None = None
    deep: bool = False


class ListingReader(DataSourceReader):
    def __init__(self, uri: str, endpoint: str | None, piece: int):
        self.uri, self.endpoint, self.piece = uri, endpoint, piece

    def partitions(self) -> list[Piece]:
        place = open_input(self.uri, self.endpoint)
        if isinstance(place, Zip):
            return [Piece(i, "", at, end) for i, (at, end) in enumerate(place.cuts(self.piece))]
        if not isinstance(place, Folder):
            return [Piece(0, "", deep=True)]
        found, todo = [], deque([""])
        while todo and len(todo) < WIDE:
            folder = todo.popleft()
            cuts, folders = place.cuts(folder, self.piece)
            found += [(folder, low, high, False) for low, high in zip([None, *cuts], [*cuts, None], strict=True)]
            todo += folders
        found += [(folder, None, None, True) for folder in todo]
        return [Piece(i, *x) for i, x in enumerate(found)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        place = open_input(self.uri, self.endpoint)
        if isinstance(place, Zip):
            rows = place.placed(partition.low, partition.high)
        else:
            rows = enumerate(walk(place, partition.folder) if partition.deep else place.between(partition.folder, partition.low, partition.high), partition.number * STRIDE)
        names = [c.split(" ")[0] for c in LISTING.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 4]
        part: list[tuple] = []
        for i, row in chain(rows, [(0, None)]):
            if part and (row is None or len(part) == ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*part, strict=True), kinds, strict=True)], names)
                part = []
            if row is not None:
                part.append((*row, i))


class Listing(DataSource):
    """options: uri, endpoint, and piece, files in a piece of a directory."""

    @classmethod
    def name(cls) -> str:
        return "lumenstack_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["uri"], self.options.get("endpoint"), int(self.options.get("piece", PIECE)))


def listing(spark: SparkSession, uri: str, piece: int = PIECE) -> DataFrame:
    """(path, file_size, modified, created, scan_ordinal, quick_file_type) of a source, numbered in a fixed order."""
    kind_of(uri)  # what does not exist is an error here, not in a task
    spark.dataSource.register(Listing)
    endpoint = endpoint_of(spark)
    options = {"uri": uri, "piece": str(piece)} | ({"endpoint": endpoint} if endpoint else {})
    found = spark.read.format(Listing.name()).options(**options).load()
    return found.withColumn("quick_file_type", quick_file_type(F.col("path")))


def open_entry(uri: str, path: str, endpoint: str | None = None, ordinal: int | None = None) -> IO[bytes]:
    """A seekable stream of one file of a source. ordinal: its scan_ordinal, by which an entry of a zip file is found without the rest of the index."""
    place = open_input(uri, endpoint)
    return place.open(path, ordinal) if isinstance(place, Zip) else place.open(path)
