"""Queries over what changes and grows: layered tables, ledgers, listings, look-ups and the dealing out of work,
over whole benchmark tables. Each has a DuckDB counterpart."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import functions as F

from ..functions.sidecar import JSON, STEM_CHARS, TAG
from ..operators import albums, balance, dedup
from ..sources import files, places, sinks
from ..sources.catalog import Catalog
from ..sources.layers import LayeredTable
from ..sources.ledger import Ledger
from .carriers import MEDIA_SQL, media, table
from .records import _export, _plain
from .staging import shared

#: name: (query, SQL)
TABLES: dict[str, tuple[Callable, str]] = {}


def _register(name: str, sql: str):
    def keep(f):
        TABLES[name] = f, sql
        return f

    return keep


def _folder(spark) -> str:
    return f"{shared(spark)}/tables-{uuid.uuid4().hex}"


@_register("table_upsert", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 100 = 0 THEN 'changed ' || o_custkey ELSE o_orderstatus || ' ' || o_custkey END AS name, TRUE AS wrote_little FROM orders UNION ALL SELECT -o_orderkey, 'new', TRUE FROM orders WHERE o_orderkey % 50 = 1")
def table_upsert(spark, sf_dir):
    """All orders, then one in a hundred again, then some that are new among others that are not. Both changes write about what they bring:
    at most a twentieth of the table, for three hundredths of its rows."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus")
    held = LayeredTable(spark, _folder(spark), "id long, name string", ["id"], buckets=8)
    held.upsert(orders.select("id", F.concat("o_orderstatus", F.lit(" "), F.col("o_custkey").cast("string")).alias("name")))
    whole, held.written = held.written, 0
    held.upsert(orders.where("id % 100 = 0").select("id", F.concat(F.lit("changed "), F.col("o_custkey").cast("string")).alias("name")))
    fresh = orders.where("id % 50 = 1").select((-F.col("id")).alias("id")).union(orders.where("id % 100 = 0").select("id"))
    held.insert(fresh.select("id", F.lit("new").alias("name")))
    # Of small tables, the footers of Parquet files are most of the bytes.
    return held.read().select("*", F.lit(held.written <= 0.05 * whole + 40_000).alias("wrote_little"))


@_register("table_commits", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 < 3 THEN 'second' ELSE 'first' END AS name FROM orders")
def table_commits(spark, sf_dir):
    """A commit that is made again by its own number counts once, and writers from an old state lose nothing."""
    root = _folder(spark)
    rows = lambda at, name: table(spark, sf_dir, "orders").where(at).select(F.col("o_orderkey").alias("id"), F.lit(name).alias("name"))
    one, other = (LayeredTable(spark, root, "id long, name string", ["id"], buckets=4) for _ in range(2))
    one.upsert(rows("o_orderkey % 7 < 5", "first"), ("stream", 1))
    old = one.snapshot()
    one.insert(rows("o_orderkey % 7 >= 4", "first"), ("stream", 2))
    stale, seen = other.snapshot, [old]
    other.snapshot = lambda *a: seen.pop() if seen else stale(*a)  # as if it had read before the other wrote
    other.upsert(rows("o_orderkey % 7 < 3", "second"))
    one.upsert(rows("o_orderkey % 7 < 5", "again"), ("stream", 1))
    one.compact(0.0)
    return one.read()


@_register("ledger_known", "SELECT 'f' || o_orderkey AS path, o_custkey AS file_size, CASE WHEN o_orderkey % 5 = 0 THEN 'later' ELSE 'first' END AS hash FROM orders WHERE o_orderkey % 3 <> 0")
def ledger_known(spark, sf_dir):
    """Files recorded once, one in five again; one in three has another time when it is looked up, and is not known then."""
    book = Ledger(spark, _folder(spark))
    k = F.col("o_orderkey")
    seen = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), F.col("o_custkey").alias("file_size"), k.alias("modified"), "o_orderkey")
    book.record(seen.withColumn("hash", F.lit("first")))
    book.record(seen.where("o_orderkey % 5 = 0").withColumn("hash", F.lit("later")))
    return book.known(seen.withColumn("modified", F.when(k % 3 == 0, k + 1).otherwise(k))).select("path", "file_size", "hash")


_TITLE = "p_name || ' ' || p_partkey"
_SIDECARS = f"""n AS (SELECT p_partkey, p_brand AS dir, {_TITLE} AS title, {_TITLE} || '.jpg' AS name FROM part),
s AS (SELECT dir || '/' || substr(name || '{TAG}', 1, {STEM_CHARS}) || '{JSON}' AS sidecar FROM n WHERE p_partkey % 4 IN (0, 3)
 UNION SELECT dir || '/' || substr(name || '{TAG}', 1, CAST(length(name) + p_partkey % 20 AS INT)) || '{JSON}' FROM n WHERE p_partkey % 4 = 1
 UNION SELECT dir || '/' || substr(title || '{TAG}', 1, CAST(length(title) + p_partkey % 9 AS INT)) || '{JSON}' FROM n WHERE p_partkey % 4 IN (2, 3))"""


@_register("sidecar_prefixes", f"""WITH {_SIDECARS},
k AS (SELECT dir || '/' || name AS path, dir, 0 AS nth, name AS described FROM n UNION ALL SELECT dir || '/' || name, dir, 1, title FROM n),
c AS (SELECT path, nth AS rank, dir || '/' || substr(described || '{TAG}', 1, {STEM_CHARS}) || '{JSON}' AS sidecar FROM k
 UNION ALL SELECT path, 100 + 100 * nth + {len(TAG)} - cut, dir || '/' || described || substr('{TAG}', 1, CAST(cut AS INT)) || '{JSON}' FROM k, range({len(TAG) + 1}) r(cut) WHERE length(described) + {len(TAG)} > {STEM_CHARS})
SELECT path, arg_min(sidecar, rank) AS sidecar FROM c JOIN s USING (sidecar) GROUP BY path""")
def sidecar_prefixes(spark, sf_dir):
    """Photos called like parts, with sidecars whose names are cut at the limit, or anywhere within the tag, or that go by the bare title."""
    title = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name").repartition(F.col("p_partkey"))  # a small file may hold many rows
    n = parts.select("p_partkey", F.col("p_brand").alias("dir"), title.alias("title"), F.concat(title, F.lit(".jpg")).alias("name"))
    k = F.col("p_partkey") % 4
    full = lambda c: F.concat(F.col(c), F.lit(TAG))
    stems = [n.where(k.isin(0, 3)).select("dir", F.substring(full("name"), 1, STEM_CHARS).alias("stem"))]
    stems += [n.where(k == 1).select("dir", F.substring(full("name"), F.lit(1), (F.length("name") + F.col("p_partkey") % 20).cast("int")).alias("stem"))]
    stems += [n.where(k.isin(2, 3)).select("dir", F.substring(full("title"), F.lit(1), (F.length("title") + F.col("p_partkey") % 9).cast("int")).alias("stem"))]
    photos = n.select(F.concat("dir", F.lit("/"), "name").alias("path"))
    cars = stems[0].union(stems[1]).union(stems[2]).select(F.concat("dir", F.lit("/"), "stem", F.lit(JSON)).alias("path")).distinct()
    return albums.sidecar_join(photos, photos.union(cars))


_THERE = """one AS (SELECT long_hash, substr(long_hash, 1, 7) AS short_hash, min(substr(media_path, 1, 4)) AS want, 'txt' AS ext, max(file_size) AS file_size FROM media_item GROUP BY long_hash),
f AS (SELECT want || '.txt' AS path, max(file_size) AS file_size, arg_max(long_hash, (file_size, long_hash)) AS hash FROM one GROUP BY want
 UNION ALL SELECT want || '-' || short_hash || '.txt', file_size + 1, 'zz' FROM one WHERE long_hash < '4'
 UNION ALL SELECT want || '/' || long_hash || '.txt', file_size, long_hash FROM one)"""


def _there(spark, sf_dir):
    """Items, and an output where one item has each bare name, files of another size have some short ones, and others are nobody's."""
    one = media(spark, sf_dir).groupBy("long_hash").agg(F.min(F.substring("media_path", 1, 4)).alias("want"), F.max("file_size").alias("file_size"))
    one = one.select("long_hash", F.substring("long_hash", 1, 7).alias("short_hash"), "want", F.lit("txt").alias("ext"), "file_size")
    name = lambda *x: F.concat("want", *(F.lit(y) if y in "-/" else F.col(y) for y in x), F.lit(".txt")).alias("path")
    bare = one.groupBy("want").agg(F.max(F.struct("file_size", "long_hash")).alias("x")).select(name(), "x.file_size", F.col("x.long_hash").alias("hash"))
    other = one.where("long_hash < '4'").select(name("-", "short_hash"), (F.col("file_size") + 1).alias("file_size"), F.lit("zz").alias("hash"))
    apart = one.select(name("/", "long_hash"), "file_size", F.col("long_hash").alias("hash"))
    return one, bare.unionByName(other).unionByName(apart).withColumn("modified", F.lit(0))


@_register("existing_reads", f"WITH {MEDIA_SQL}, {_THERE}, c AS (SELECT o.file_size, unnest([want || '.txt', want || '-' || short_hash || '.txt', want || '-' || long_hash || '.txt']) AS path FROM one o) SELECT f.path, bool_or(f.file_size = c.file_size) AS to_read FROM f JOIN c USING (path) GROUP BY 1")
def existing_reads(spark, sf_dir):
    """Which files of an output a sync looks at, and which of those it has to read."""
    return dedup.candidates_there(*_there(spark, sf_dir)).select("path", "to_read")


@_register("existing_names", f"WITH {MEDIA_SQL}, {_THERE}, a AS (SELECT o.*, f.hash FROM one o JOIN f ON f.path = want || '.txt'), b AS (SELECT *, long_hash < '4' OR row_number() OVER (PARTITION BY want, short_hash ORDER BY long_hash) > 1 AS taken FROM a WHERE hash <> long_hash) SELECT long_hash, want || '.txt' AS output_path, 'skip' AS action FROM a WHERE hash = long_hash UNION ALL SELECT long_hash, want || '-' || CASE WHEN taken THEN long_hash ELSE short_hash END || '.txt', 'write' FROM b")
def existing_names(spark, sf_dir):
    """The names that follow, with checksums of those files alone. Items that share a want and a short hash make one path twice: it has one checksum."""
    one, there = _there(spark, sf_dir)
    looked = dedup.candidates_there(one, there).select("path", "to_read").join(there.select("path", "hash").distinct(), "path")
    return dedup.names_over_existing(one, looked.select("path", F.when(F.col("to_read"), F.col("hash")).otherwise(F.lit(dedup.OTHER_SIZE)).alias("existing_hash")))


@_register("balanced_bytes", "SELECT CAST(COUNT(*) AS BIGINT) AS files, CAST(SUM(strlen(COALESCE(text, ''))) AS BIGINT) AS bytes, CAST(40 AS BIGINT) AS tasks, TRUE AS even FROM documents")
def balanced_bytes(spark, sf_dir):
    """Documents dealt out to forty tasks by bytes: the largest task has at most 1.3 times the mean, but for one that holds a larger file alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    loads = balance.balanced(docs, 40, "doc_id", "size").groupBy("task").agg(F.sum("size").alias("load"), F.count("*").alias("n"))
    even = F.max(F.when(F.col("n") > 1, F.col("load"))) <= F.sum("load") / 40 * 1.3
    return loads.agg(F.sum("n").alias("files"), F.sum("load").alias("bytes"), F.count("*").alias("tasks"), even.alias("even"))


@_register("listing_flat", "SELECT 'doc_' || doc_id || '.txt' AS path, CAST(strlen(COALESCE(text, '')) AS BIGINT) AS file_size, 'Unknown' AS quick_file_type FROM documents")
def listing_flat(spark, sf_dir):
    """All documents as files of one directory, listed in ranges of names."""
    root = _plain(_folder(spark))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = places.open_output(root)
        for frame in frames:
            for name, text in frame.itertuples(index=False):
                place.write(name, io.BytesIO((text or "").encode()))
            yield frame[["name"]]

    named = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    named.mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()
    return files.listing(spark, root, piece=100).select("path", "file_size", "quick_file_type")


@_register("archive_stream", "SELECT 'Google Photos/Trip/' || n_name || '.jpg' AS media_path, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey + 1 AS DOUBLE) END AS latitude, CASE WHEN n_nationkey % 2 = 0 THEN 'Ann' END AS person, 'The Trip' AS album FROM nation")
def archive_stream(spark, sf_dir):
    """An export into a catalog as a stream of a few files at a time; called again, it finds nothing new."""
    from ..streaming.ingest import ingest

    source, root = _export(spark, sf_dir), _folder(spark)
    ingest(spark, source, root, "+00:00", files_per_batch=16)
    cat = ingest(spark, source, root, "+00:00", files_per_batch=16)
    people = cat.read("media_person").join(cat.read("person"), "person_id").select("media_item_id", F.col("name").alias("person"))
    titles = cat.read("album_file").join(cat.read("album"), "album_id").select("media_item_id", F.col("title").alias("album"))
    rows = cat.read("media_item").join(people, "media_item_id", "left").join(titles, "media_item_id", "left")
    return rows.select("media_path", "latitude", "person", "album")


@_register("zip_entries", "SELECT lang || '/doc_' || doc_id || '.txt' AS path, CAST(strlen(COALESCE(text, '')) AS BIGINT) AS file_size, sha256(COALESCE(text, '')) AS hash FROM documents")
def zip_entries(spark, sf_dir):
    """All documents as entries of one zip file, written by many tasks; its index is listed in parts, and each part's entries are read by a task."""
    root = _plain(_folder(spark))
    places.open_output(root).prepare()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, size, ordinal in frame.itertuples(index=False):
                with files.open_entry(f"{root}/all.zip", path, ordinal=ordinal) as f:
                    out.append((path, size, sha256(f.read()).hexdigest()))
            yield pd.DataFrame(out, columns=["path", "file_size", "hash"])

    named = table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    sinks.write_zip(named, f"{root}/all.zip")
    listed = files.listing(spark, f"{root}/all.zip", piece=200).select("path", "file_size", "scan_ordinal")
    return listed.mapInPandas(read, "path string, file_size long, hash string")


@_register("catalog_inputs", "SELECT c_mktsegment || '/' || c_custkey AS dir_path, 'in' || c_custkey % 3 AS run_input, CASE WHEN c_custkey % 3 = 1 THEN 'again' ELSE 'once' END AS known FROM customer WHERE c_custkey % 3 <> 1 OR c_custkey % 2 = 0 UNION ALL SELECT 'shared', 'in' || i, CASE WHEN i = 1 THEN 'again' ELSE 'once' END FROM range(3) t(i)")
def catalog_inputs(spark, sf_dir):
    """Three inputs in one catalog, one of them scanned twice, the second time with fewer folders: its rows alone are replaced."""
    cat = Catalog(spark, _folder(spark))
    k = F.col("c_custkey")
    dirs = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit("/"), k.cast("string")).alias("path"))

    def scan(i: int, known: str, rows) -> None:
        run = cat.run(f"in{i}")
        rows = rows.select("path").union(spark.createDataFrame([("shared",)], "path string"))
        cat.refresh("classified_dir", rows.select(F.xxhash64(F.lit(run), "path").alias("classified_dir_id"), F.lit(run).cast("long").alias("run_id"), F.col("path").alias("dir_path"), F.lit(known).alias("known_dir_type"), F.lit(None).cast("string").alias("known_dir_value")), run)

    for i in range(3):
        scan(i, "once", dirs.where(k % 3 == i))
    scan(1, "again", dirs.where((k % 3 == 1) & (k % 2 == 0)))
    return cat.read("classified_dir").join(cat.read("run"), "run_id").select("dir_path", "run_input", F.col("known_dir_type").alias("known"))
