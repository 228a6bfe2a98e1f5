"""The relational catalog: eight tables under one folder, with a version beside them.

Parquet has no MERGE: tables are layered (see layers), so a change writes about what it brings, and changes of several writers
are all kept. A run's classified files and folders are a bucket of their own, which the run's next scan replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layers import Files, LayeredTable, inserted, upserted

__all__ = ["Catalog", "inserted", "refreshed", "upserted"]

VERSION = 4
#: How tables are stored; a catalog that is stored otherwise counts as one of another version.
LAYOUT = "layers"
TABLES: dict[str, str] = {
    "media_item": "media_item_id string, media_path string, long_hash string, short_hash string, quick_file_type string, accurate_file_type string, media_info string, guessed_datetime string, modified_at long, created_at long, file_size long, latitude double, longitude double, camera_make string, camera_model string, width long, height long, duration_ms long, orientation string, display_mirrored int, display_rotate int, geohash string, kind string, content_identifier string",
    "person": "person_id string, name string",
    "media_person": "media_item_id string, person_id string",
    "album": "album_id string, title string, album_path string",
    "album_file": "album_id string, media_item_id string",
    "run": "run_id long, run_input string, run_date timestamp",
    "classified_file": "classified_file_id long, run_id long, file_path string, quick_file_type string, known_file_type string, known_file_type_value string, file_size long",
    "classified_dir": "classified_dir_id long, run_id long, dir_path string, known_dir_type string, known_dir_value string",
}
TABLE_COLUMNS = {name: [c.split(" ")[0] for c in ddl.split(", ")] for name, ddl in TABLES.items()}
KEYS = {"media_item": ["media_item_id"], "person": ["person_id"], "media_person": ["media_item_id", "person_id"], "album": ["album_id"], "album_file": ["album_id", "media_item_id"], "run": ["run_id"], "classified_file": ["classified_file_id"], "classified_dir": ["classified_dir_id"]}
#: Tables whose buckets are runs.
BY_RUN = ("run", "classified_file", "classified_dir")


def refreshed(old: DataFrame, new: DataFrame, column: str, value: int) -> DataFrame:
    """The old rows of other runs, and the new ones of this run."""
    return old.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new)


class Catalog:
    """The tables under a folder. An older or newer version is an error, unless it is cleared."""

    def __init__(self, spark: SparkSession, root: str, clear: bool = False, buckets: int = 8):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        #: What the last command counted.
        self.counters: dict = {}
        found, own = self.files.text("version"), f"{VERSION} {LAYOUT}"
        if clear:
            self.files.delete("")
            found = None
        if found is None:
            self.files.put("version", own)
        elif found != own:
            raise ValueError(f"catalog version {found}, expected {own}; clear it to start again")
        self.tables = {name: LayeredTable(spark, f"{self.root}/{name}", ddl, KEYS[name], buckets, "run_id" if name in BY_RUN else None) for name, ddl in TABLES.items()}

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def upsert(self, name: str, new: DataFrame, mark: tuple[str, int] | None = None) -> None:
        self.tables[name].upsert(new, mark)

    def insert(self, name: str, new: DataFrame, mark: tuple[str, int] | None = None) -> None:
        self.tables[name].insert(new, mark)

    def refresh(self, name: str, new: DataFrame, run_id: int) -> None:
        self.tables[name].replace(str(run_id), new)

    def run(self, run_input: str) -> int:
        """The id of the run with exactly this input, made where there is none. Of two that are made at once, one waits for the other and counts on."""
        return self.tables["run"].numbered(F.col("run_input") == run_input, "run_id", lambda n: self.spark.range(1).select(F.lit(n).cast("long").alias("run_id"), F.lit(run_input).alias("run_input"), F.current_timestamp().alias("run_date")))

    def recorded(self) -> DataFrame:
        """(media_item_id, file_size) of what need not be read again."""
        return self.read("media_item").select("media_item_id", "file_size")

    def counts(self) -> dict[str, int]:
        return {name: self.read(name).count() for name in TABLES}

    def register_views(self) -> None:
        for name in TABLES:
            self.read(name).createOrReplaceTempView(name)

    def drop(self) -> None:
        self.files.delete("")
