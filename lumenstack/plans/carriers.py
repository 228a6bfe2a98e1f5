"""The catalog's tables carried by the benchmark tables: documents are files, their texts the bytes.

Each carrier has a DataFrame form, built from the library's own functions, and a DuckDB
form, written independently, that serves as its oracle.
"""

from __future__ import annotations

from datetime import timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geo, ids, media_types
from .staging import staged

ZONE = timezone(timedelta(hours=12))
TYPES = ["Jpg", "Png", "Heic", "Mp4", "Mov", "Unsupported"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text) of documents as files."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", "n_chars")


_items: dict[tuple, DataFrame] = {}


def _written(spark: SparkSession, sf_dir: str) -> tuple[int, ...]:
    """When the tables that media_item comes from were written last."""
    context = spark.sparkContext
    paths = [context._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet") for t in ("documents", "events")]
    return tuple(p.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime() for p in paths)


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_item rows (the columns that reports and operators use), one a document: a table of the catalog, which is
    written when a session first asks for it, and anew when its tables have changed."""
    key = spark.sparkContext.applicationId, sf_dir, _written(spark, sf_dir)
    if key not in _items:
        _items[key] = staged(_media_rows(spark, sf_dir), "media_item")
    return _items[key]


def _media_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    ts = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.unix_millis(F.col("ts").cast("timestamp_ltz")).alias("taken_ms"))
    m = files(spark, sf_dir).join(ts, "doc_id", "left")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (k % 6 + 1).cast("int"))
    make = F.when(k % 3 == 0, "Canon").when(k % 3 == 1, "Apple")
    lat, lon = (k * 7919 % 18000) / 100.0 - 90, (k * 104729 % 36000) / 100.0 - 180
    located = k % 4 != 0
    rows = m.select(
        "doc_id", F.col("path").alias("media_path"),
        ids.path_id(F.col("path")).alias("media_item_id"),
        ids.long_checksum(F.col("text")).alias("long_hash"), ids.short_checksum(F.col("text")).alias("short_hash"),
        F.octet_length("text").cast("long").alias("file_size"),
        kind.alias("accurate_file_type"), "taken_ms", "n_chars",
        F.when(located, lat).alias("latitude"), F.when(located, lon).alias("longitude"),
        make.alias("camera_make"), F.concat(make, F.lit(" "), (k % 7).cast("string")).alias("camera_model"),
        (k % 5 * 100).alias("width"), (k % 4 * 100).alias("height"),
        F.when(k % 5 != 0, F.concat(F.lit("c"), F.floor(k / 4).cast("string"))).alias("content_identifier"),
    )
    typed = rows.withColumn("kind", media_types.media_kind(F.col("accurate_file_type")))
    return typed.select(
        "*",
        F.when(k % 10 != 9, dates.render_millis(F.col("taken_ms"), ZONE)).alias("guessed_datetime"),
        F.when(F.col("kind") == "v", F.col("n_chars") * 10).alias("duration_ms"),
        geo.geohash(F.col("latitude"), F.col("longitude")).alias("geohash"),
        geo.orientation(F.col("width"), F.col("height")).alias("orientation"),
        media_types.type_extension(F.col("accurate_file_type")).alias("ext"),
    )


#: The same rows in DuckDB.
MEDIA_SQL = """
files AS (
  SELECT doc_id, source || '/' || lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text, n_chars FROM documents
), carried AS (
  SELECT f.doc_id, path AS media_path, substr(sha256(nfc_normalize(trim(path))), 1, 16) AS media_item_id,
    sha256(text) AS long_hash, substr(sha256(text), 1, 7) AS short_hash, CAST(strlen(text) AS BIGINT) AS file_size,
    (['Jpg', 'Png', 'Heic', 'Mp4', 'Mov', 'Unsupported'])[1 + f.doc_id % 6] AS accurate_file_type,
    epoch_us(e.ts) // 1000 AS taken_ms, n_chars,
    CASE WHEN f.doc_id % 4 <> 0 THEN (f.doc_id * 7919 % 18000) / CAST(100 AS DOUBLE) - 90 END AS latitude,
    CASE WHEN f.doc_id % 4 <> 0 THEN (f.doc_id * 104729 % 36000) / CAST(100 AS DOUBLE) - 180 END AS longitude,
    CASE f.doc_id % 3 WHEN 0 THEN 'Canon' WHEN 1 THEN 'Apple' END AS camera_make,
    CASE f.doc_id % 3 WHEN 0 THEN 'Canon ' || f.doc_id % 7 WHEN 1 THEN 'Apple ' || f.doc_id % 7 END AS camera_model,
    f.doc_id % 5 * 100 AS width, f.doc_id % 4 * 100 AS height,
    CASE WHEN f.doc_id % 5 <> 0 THEN 'c' || CAST(f.doc_id // 4 AS VARCHAR) END AS content_identifier
  FROM files f LEFT JOIN events e ON e.event_id = f.doc_id
), media_item AS (
  SELECT *,
    CASE WHEN accurate_file_type IN ('Jpg', 'Png', 'Heic') THEN 'p' WHEN accurate_file_type IN ('Mp4', 'Mov') THEN 'v' END AS kind,
    CASE WHEN doc_id % 10 <> 9 THEN
      strftime(make_timestamp((taken_ms + 43200000) * 1000), '%Y-%m-%dT%H:%M:%S')
      || CASE WHEN taken_ms % 1000 <> 0 THEN '.' || lpad(CAST(taken_ms % 1000 AS VARCHAR), 3, '0') ELSE '' END || '+12:00' END AS guessed_datetime,
    CASE WHEN accurate_file_type IN ('Mp4', 'Mov') THEN n_chars * 10 END AS duration_ms,
    CASE WHEN width > 0 AND height > 0 THEN CASE WHEN width > height THEN 'landscape' WHEN width < height THEN 'portrait' ELSE 'square' END END AS orientation,
    CASE accurate_file_type WHEN 'Unsupported' THEN 'bin' ELSE lower(accurate_file_type) END AS ext
  FROM carried
)"""

PEOPLE_SQL = """
person AS (SELECT substr(sha256(nfc_normalize(lower(trim(c_name)))), 1, 16) AS person_id, min(c_name) AS name FROM customer GROUP BY 1),
media_person AS (
  SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS media_item_id, substr(sha256(nfc_normalize(lower(trim(c_name)))), 1, 16) AS person_id
  FROM orders JOIN customer ON c_custkey = o_custkey
)"""


def people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """person and media_person, carried by customers and their orders."""
    c = table(spark, sf_dir, "customer").withColumn("person_id", ids.person_id(F.col("c_name")))
    person = c.groupBy("person_id").agg(F.min("c_name").alias("name"))
    orders = table(spark, sf_dir, "orders")
    linked = orders.join(c, orders.o_custkey == c.c_custkey).select(F.col("o_orderkey").cast("string").alias("media_item_id"), "person_id").distinct()
    return person, linked


def albums(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """album and album_file, carried by customers and their orders: some albums are empty."""
    album = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("album_id"), F.col("c_name").alias("title"))
    return album, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("album_id"), F.col("o_orderkey").alias("media_item_id"))
