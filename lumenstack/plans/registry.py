"""queries(): every registered query; oracle_sql(): the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, dates, geo, ids, media_types, paths
from ..operators import albums, dedup
from ..sources import catalog
from . import carriers, records, reports, tables
from .carriers import MEDIA_SQL, PEOPLE_SQL, media, table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _oracle[name] = sql
        return f

    return keep


def _media_sql(select: str) -> str:
    return f"WITH {MEDIA_SQL} {select}"


for _name, _report, _select in (
    ("collection_size", reports.collection_size, "SELECT COUNT(*) AS items, CAST(SUM(file_size) AS BIGINT) AS total_bytes, ROUND(CAST(SUM(file_size) AS DOUBLE) / 1073741824.0, 2) AS total_gb FROM media_item"),
    ("kind_mix", reports.kind_mix, "SELECT kind, COUNT(*) AS items FROM media_item GROUP BY kind"),
    ("file_types", reports.file_types, "SELECT accurate_file_type AS file_type, COUNT(*) AS items, ROUND(CAST(SUM(file_size) AS DOUBLE) / 1048576.0, 1) AS total_mb FROM media_item GROUP BY 1"),
    ("items_per_year", reports.items_per_year, "SELECT substr(guessed_datetime, 1, 4) AS year, COUNT(*) AS items FROM media_item WHERE guessed_datetime IS NOT NULL GROUP BY 1"),
    ("largest_files", reports.largest_files, "SELECT media_path, ROUND(CAST(file_size AS DOUBLE) / 1048576.0, 1) AS size_mb FROM media_item ORDER BY file_size DESC, media_path LIMIT 10"),
    ("camera_mix", reports.camera_mix, "SELECT camera_make, camera_model, COUNT(*) AS items FROM media_item WHERE camera_model IS NOT NULL GROUP BY 1, 2 ORDER BY items DESC, camera_make, camera_model LIMIT 10"),
    ("location_split", reports.location_split, "SELECT COUNT(*) FILTER (WHERE latitude IS NOT NULL) AS with_location, COUNT(*) FILTER (WHERE latitude IS NULL) AS without_location FROM media_item"),
    ("orientation_mix", reports.orientation_mix, "SELECT COALESCE(o, 'unknown') AS orientation, items FROM (SELECT orientation AS o, COUNT(*) AS items FROM media_item GROUP BY orientation)"),
    ("live_photo_join", reports.live_photo_join, "SELECT s.media_path AS still, v.media_path AS video, ROUND(CAST(v.duration_ms AS DOUBLE) / 1000.0, 1) AS video_seconds FROM media_item s JOIN media_item v ON v.content_identifier = s.content_identifier AND v.kind = 'v' WHERE s.kind = 'p' ORDER BY 1, 2 LIMIT 10"),
    ("duplicates", reports.duplicates, "SELECT long_hash, COUNT(*) AS copies, CAST(SUM(file_size) AS BIGINT) AS wasted_bytes FROM media_item GROUP BY long_hash HAVING COUNT(*) > 1 ORDER BY copies DESC, long_hash LIMIT 10"),
):
    _register(_name, _media_sql(_select))(lambda spark, sf_dir, f=_report: f(media(spark, sf_dir)))


@_register("people_rank", f"WITH {PEOPLE_SQL} SELECT any_value(p.name) AS name, COUNT(*) AS appears_in FROM person p JOIN media_person m ON m.person_id = p.person_id GROUP BY p.person_id ORDER BY appears_in DESC, p.person_id LIMIT 10")
def people_rank(spark, sf_dir):
    return reports.people_rank(*carriers.people(spark, sf_dir))


@_register("album_sizes", "SELECT any_value(c_name) AS title, COUNT(o_orderkey) AS items FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def album_sizes(spark, sf_dir):
    return reports.album_sizes(*carriers.albums(spark, sf_dir))


@_register("content_dedup", _media_sql("SELECT long_hash, min(media_path) AS path, arg_min(doc_id, media_path) AS doc_id, array_to_string(list_sort(list(DISTINCT media_path)), '|') AS original_path FROM media_item GROUP BY long_hash"))
def content_dedup(spark, sf_dir):
    m = media(spark, sf_dir).select("long_hash", F.col("media_path").alias("path"), "doc_id")
    return dedup.content_dedup(m).select("long_hash", "path", "doc_id", F.array_join("original_path", "|").alias("original_path"))


@_register("path_union", _media_sql("SELECT content_identifier, array_to_string(list_sort(list(DISTINCT media_path)), '|') AS paths FROM media_item WHERE content_identifier IS NOT NULL GROUP BY 1"))
def path_union(spark, sf_dir):
    m = media(spark, sf_dir).where("content_identifier is not null")
    united = m.groupBy("content_identifier").agg(F.collect_list(F.array("media_path")).alias("x"))
    return united.select("content_identifier", F.array_join(F.array_sort(F.array_distinct(F.flatten("x"))), "|").alias("paths"))


@_register("live_photo_pairs", _media_sql("SELECT content_identifier, min(long_hash) FILTER (WHERE kind = 'p') AS still_hash, min(long_hash) FILTER (WHERE kind = 'v') AS video_hash FROM media_item WHERE content_identifier IS NOT NULL GROUP BY 1 HAVING still_hash IS NOT NULL AND video_hash IS NOT NULL"))
def live_photo_pairs(spark, sf_dir):
    return dedup.live_photo_pairs(media(spark, sf_dir))


_LADDER = """, one AS (SELECT long_hash, substr(long_hash, 1, 1) AS short_hash, min(substr(media_path, 1, 4)) AS want, 'txt' AS ext FROM media_item GROUP BY long_hash),
r1 AS (SELECT *, row_number() OVER (PARTITION BY want, ext ORDER BY long_hash) = 1 AS bare FROM one),
r2 AS (SELECT *, row_number() OVER (PARTITION BY want, ext, short_hash, bare ORDER BY long_hash) AS again FROM r1)
SELECT long_hash, want || CASE WHEN bare THEN '' WHEN again = 1 THEN '-' || short_hash ELSE '-' || long_hash END || '.' || ext AS output_path FROM r2"""


@_register("name_ladder", _media_sql("SELECT 1").replace(" SELECT 1", _LADDER))
def name_ladder(spark, sf_dir):
    """Checksums of one digit force collisions."""
    one = media(spark, sf_dir).groupBy("long_hash").agg(F.min(F.substring("media_path", 1, 4)).alias("want"))
    named = dedup.fresh_names(one.select("long_hash", F.substring("long_hash", 1, 1).alias("short_hash"), "want", F.lit("txt").alias("ext")))
    return named.select("long_hash", "output_path")


_EXISTING = """, one AS (SELECT long_hash, substr(long_hash, 1, 7) AS short_hash, min(substr(media_path, 1, 4)) AS want, 'txt' AS ext FROM media_item GROUP BY long_hash),
there AS (SELECT want || '.txt' AS path, CASE WHEN want = (SELECT min(want) FROM one) THEN NULL ELSE max(long_hash) END AS hash FROM one GROUP BY want),
a AS (SELECT o.*, t.path, t.hash FROM one o JOIN there t ON t.path = want || '.' || ext),
b AS (SELECT *, row_number() OVER (PARTITION BY want, ext, short_hash ORDER BY long_hash) AS nth FROM a WHERE hash <> long_hash)
SELECT long_hash, CASE WHEN hash IS NULL THEN NULL ELSE path END AS output_path, CASE WHEN hash IS NULL THEN 'error' ELSE 'skip' END AS action FROM a WHERE hash IS NULL OR hash = long_hash
UNION ALL SELECT long_hash, want || '-' || CASE WHEN nth = 1 THEN short_hash ELSE long_hash END || '.' || ext, 'write' FROM b"""


@_register("name_ladder_existing", _media_sql("SELECT 1").replace(" SELECT 1", _EXISTING))
def name_ladder_existing(spark, sf_dir):
    """The ladder over an output that holds some files already, one of them unreadable."""
    one = media(spark, sf_dir).groupBy("long_hash").agg(F.min(F.substring("media_path", 1, 4)).alias("want")).select("long_hash", F.substring("long_hash", 1, 7).alias("short_hash"), "want", F.lit("txt").alias("ext"))
    least = one.agg(F.min("want").alias("least")).first()["least"]
    there = one.groupBy("want").agg(F.max("long_hash").alias("hash")).select(F.concat("want", F.lit(".txt")).alias("path"), F.when(F.col("want") != F.lit(least), F.col("hash")).alias("existing_hash"))
    return dedup.names_over_existing(one, there)


@_register("desired_path", _media_sql("SELECT doc_id, CASE WHEN guessed_datetime IS NULL THEN 'undated/' || short_hash ELSE substr(guessed_datetime, 1, 4) || '/' || substr(guessed_datetime, 6, 2) || '/' || substr(guessed_datetime, 9, 2) || '/' || substr(guessed_datetime, 12, 2) || substr(guessed_datetime, 15, 2) || '-' || substr(guessed_datetime, 18, 2) || lpad(CAST(taken_ms % 1000 AS VARCHAR), 3, '0') END AS desired FROM media_item"))
def desired_path(spark, sf_dir):
    return media(spark, sf_dir).select("doc_id", paths.desired_media_path(F.col("guessed_datetime"), F.col("short_hash")).alias("desired"))


@_register("render_zone", "SELECT event_id, strftime(make_timestamp(((epoch_us(ts) // 1000) - 12600000) * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN (epoch_us(ts) // 1000) % 1000 <> 0 THEN '.' || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') ELSE '' END || '-03:30' AS at FROM events")
def render_zone(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp_ltz"))
    return table(spark, sf_dir, "events").select("event_id", dates.render_millis(ms, dates.parse_offset("-03:30")).alias("at"))


@_register("sidecar_time", "SELECT event_id, strftime(make_timestamp(CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000000 + 43200000000), '%Y-%m-%dT%H:%M:%S') || '+12:00' AS at FROM events")
def sidecar_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.sidecar_time(F.get_json_object("props", "$.k"), carriers.ZONE).alias("at"))


_GEOHASH = "WITH p AS (SELECT doc_id, doc_id * 7919 % 18000 / CAST(100 AS DOUBLE) - 90 AS lat, doc_id * 104729 % 36000 / CAST(100 AS DOUBLE) - 180 AS lon FROM documents WHERE doc_id % 4 <> 0), c AS (SELECT doc_id, least(greatest(CAST(floor((lat + 90) / 180 * 1073741824) AS BIGINT), 0), 1073741823) AS y, least(greatest(CAST(floor((lon + 180) / 360 * 1073741824) AS BIGINT), 0), 1073741823) AS x FROM p), b AS (SELECT doc_id, i // 5 AS k, sum(((CASE WHEN i % 2 = 0 THEN x ELSE y END) >> CAST(29 - i // 2 AS INT) & 1) << CAST(4 - i % 5 AS INT)) AS v FROM c, range(60) t(i) GROUP BY 1, 2) SELECT doc_id, string_agg(substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(v + 1 AS INT), 1), '' ORDER BY k) AS geohash FROM b GROUP BY 1"


@_register("geohash", _GEOHASH)
def geohash(spark, sf_dir):
    return media(spark, sf_dir).where("latitude is not null").select("doc_id", "geohash")


@_register("coords", "WITH p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0.0 ELSE doc_id % 90 END AS a, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 80 END AS b, CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE doc_id % 70 END AS c, CAST(doc_id % 7 - 3 AS DOUBLE) AS d FROM documents) SELECT doc_id, CAST(CASE WHEN a <> 0 THEN a WHEN b <> 0 THEN b WHEN c <> 0 THEN c WHEN d <> 0 THEN d END AS DOUBLE) AS db_latitude, CAST(CASE WHEN a <> 0 THEN a WHEN d <> 0 THEN d WHEN c <> 0 THEN c END AS DOUBLE) AS note_latitude FROM p")
def coords(spark, sf_dir):
    """Catalog and note precedence differ: notes ask the sidecar's own point first, and never the track."""
    k = F.col("doc_id")
    own = {"a": F.when(k % 2 == 0, 0.0).otherwise(k % 90), "b": F.when(k % 3 == 0, None).otherwise(k % 80), "c": F.when(k % 5 == 0, 0.0).otherwise(k % 70), "d": k % 7 - 3}
    at = {n: geo.known_point(c.cast("double"), F.when(c.isNotNull(), 0.0)) for n, c in own.items()}
    return table(spark, sf_dir, "documents").select("doc_id", geo.best_point(at["a"], at["b"], at["c"], at["d"])["latitude"].alias("db_latitude"), geo.note_point(at["a"], at["d"], at["c"])["latitude"].alias("note_latitude"))


@_register("display_transform", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (2, 4, 5, 7) THEN 1 ELSE 0 END AS mirrored, CASE WHEN l_linenumber IN (3, 4) THEN 180 WHEN l_linenumber IN (5, 8) THEN -90 WHEN l_linenumber IN (6, 7) THEN 90 ELSE 0 END AS rotate FROM lineitem")
def display_transform(spark, sf_dir):
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geo.display_mirrored(n).alias("mirrored"), geo.display_rotate(n).alias("rotate"))


@_register("stable_ids", "SELECT c_custkey, substr(sha256(nfc_normalize(trim(c_name))), 1, 16) AS path_id, substr(sha256(nfc_normalize(lower(trim(c_name)))), 1, 16) AS person_id FROM customer")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", ids.path_id(F.col("c_name")).alias("path_id"), ids.person_id(F.col("c_name")).alias("person_id"))


_NAMES = ["'IMG_' || page_id || '.JPG'", "page_id || '_1.mp4'", "'MVI_' || page_id || '-edited.avi'", "'Trip ' || page_id || '.csv'", "page_id || '-collage.jpg'", "'metadata.json'", "'.DS_Store'", "'IMG_' || page_id || '.jpg.suppl.json'", "'notes.txt'"]


@_register("classify_paths", "WITH n AS (SELECT page_id, CASE CAST(page_id % 9 AS INT) " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_NAMES)) + r""" END AS name FROM pages), l AS (SELECT page_id, name, lower(name) AS s FROM n)
SELECT page_id, name, CASE page_id % 9 WHEN 0 THEN 'Photo' WHEN 1 THEN 'Photo' WHEN 2 THEN 'Photo' WHEN 3 THEN 'IcpAlbumCsv' WHEN 4 THEN 'GpCollage' WHEN 5 THEN 'GpAlbumJson' WHEN 6 THEN 'Ignored' WHEN 7 THEN 'GpMetadataJson' END AS known_type,
CASE page_id % 9 WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN regexp_extract(s, '^([0-9_]+)[.]', 1) WHEN 2 THEN CAST(page_id AS VARCHAR) WHEN 3 THEN regexp_extract(s, '^(.+)[.]csv$', 1) WHEN 4 THEN CAST(page_id AS VARCHAR) WHEN 7 THEN 'img_' || page_id END AS known_value FROM l""")
def classify_paths(spark, sf_dir):
    name = F.expr("case page_id % 9 " + " ".join(f"when {i} then {e}" for i, e in enumerate(_NAMES)) + " end")
    named = table(spark, sf_dir, "pages").select("page_id", name.alias("name")).withColumn("known", classify.classify_file(F.col("name")))
    return named.select("page_id", "name", F.col("known.type").alias("known_type"), F.col("known.value").alias("known_value"))


@_register("quick_types", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Media' WHEN page_id % 4 = 1 THEN 'AlbumCsv' WHEN page_id % 4 = 2 THEN 'AlbumJson' ELSE 'Unknown' END AS quick_file_type FROM pages")
def quick_types(spark, sf_dir):
    name = F.expr("case page_id % 4 when 0 then 'a/b.' || page_id || '.HEIC' when 1 then 'x.y/' || page_id || '.Csv' when 2 then page_id || '/Metadata.JSON' else 'a.jpg/.png' end")
    return table(spark, sf_dir, "pages").select("page_id", media_types.quick_file_type(name).alias("quick_file_type"))


@_register("resume_antijoin", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 7 <> 0)")
def resume_antijoin(spark, sf_dir):
    """Labelled documents are recorded; every seventh with another size, so it is read again."""
    scan = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("media_item_id"), F.col("n_chars").alias("file_size"))
    sizes = scan.select("media_item_id", "file_size").distinct()
    recorded = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("media_item_id")).join(sizes, "media_item_id").select("media_item_id", F.when(F.col("media_item_id") % 7 == 0, -2).otherwise(F.col("file_size")).alias("file_size"))
    return albums.resume(scan, recorded).select("doc_id")


_SCAN = "scan AS (SELECT l || '/' || s || '.' || d AS path, o FROM (SELECT doc_id AS o, lang AS l, source AS s, CASE WHEN doc_id % 2 = 0 THEN 'jpg' ELSE 'JPG' END AS d FROM documents))"


def _scan(spark, sf_dir):
    path = F.concat("lang", F.lit("/"), "source", F.lit("."), F.when(F.col("doc_id") % 2 == 0, "jpg").otherwise("JPG"))
    scan = table(spark, sf_dir, "documents").select(path.alias("path"), F.col("doc_id").alias("scan_ordinal"))
    return scan.withColumn("quick_file_type", media_types.quick_file_type(F.col("path")))


@_register("album_members_csv", f"WITH {_SCAN}, f AS (SELECT lower(split_part(path, '/', 2)) AS k, arg_min(path, o) AS path FROM scan GROUP BY 1) SELECT o_custkey AS album, o_orderkey AS position, path FROM orders JOIN f ON k = 'src' || o_custkey % 25 || '.jpg'")
def album_members_csv(spark, sf_dir):
    members = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("album"), F.col("o_orderkey").alias("position"), F.concat(F.lit("SRC"), (F.col("o_custkey") % 25).cast("string"), F.lit(".Jpg")).alias("file_name"))
    return albums.csv_members(members, _scan(spark, sf_dir))


@_register("album_members_json", f"WITH {_SCAN} SELECT a.lang AS album, path FROM (SELECT DISTINCT lang FROM documents) a JOIN scan ON split_part(path, '/', 1) = a.lang")
def album_members_json(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("lang").alias("album")).distinct().withColumn("album_path", F.concat("album", F.lit("/metadata.json")))
    return albums.json_members(files, _scan(spark, sf_dir))


@_register("album_links", _media_sql("SELECT DISTINCT lang AS album_id, media_item_id FROM media_item m JOIN documents d ON d.doc_id = m.doc_id WHERE m.doc_id % 3 <> 0"))
def album_links(spark, sf_dir):
    files = carriers.files(spark, sf_dir).select(F.split("path", "/")[1].alias("album_id"), F.when(F.col("doc_id") % 3 == 0, "gone").otherwise(F.col("path")).alias("path"))
    return albums.album_links(files, media(spark, sf_dir))


def _deduplicated(spark, sf_dir):
    return dedup.content_dedup(media(spark, sf_dir).select("long_hash", F.col("media_path").alias("path")))


@_register("album_names", _media_sql("SELECT long_hash, array_to_string(list(source ORDER BY p), '|') AS albums FROM (SELECT long_hash, source, min(media_path) AS p FROM media_item m JOIN documents d ON d.doc_id = m.doc_id GROUP BY 1, 2) GROUP BY 1"))
def album_names(spark, sf_dir):
    members = carriers.files(spark, sf_dir).select(F.split("path", "/")[0].alias("name"), F.lit(0).alias("album_ordinal"), "path")
    return albums.album_names(_deduplicated(spark, sf_dir), members).select("long_hash", F.array_join("albums", "|").alias("albums"))


@_register("final_paths", _media_sql("SELECT lang AS album, d.doc_id AS position, 'out/' || long_hash AS output_path FROM media_item m JOIN documents d ON d.doc_id = m.doc_id"))
def final_paths(spark, sf_dir):
    members = carriers.files(spark, sf_dir).select(F.split("path", "/")[1].alias("album"), F.col("doc_id").alias("position"), "path")
    named = _deduplicated(spark, sf_dir).withColumn("output_path", F.concat(F.lit("out/"), "long_hash"))
    return albums.final_paths(members, named)


@_register("sidecar_lookup", "WITH f AS (SELECT doc_id, source || '/' || doc_id || '.jpg' AS path FROM documents), s AS (SELECT source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.a.json' ELSE '.b.json' END AS p FROM documents WHERE doc_id % 2 = 0 UNION SELECT source || '/' || doc_id || '.b.json' FROM documents WHERE doc_id % 3 = 0) SELECT path, COALESCE(a.p, b.p) AS sidecar FROM f LEFT JOIN s a ON a.p = replace(path, '.jpg', '.a.json') LEFT JOIN s b ON b.p = replace(path, '.jpg', '.b.json') WHERE COALESCE(a.p, b.p) IS NOT NULL")
def sidecar_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    k, stem = F.col("doc_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    even = docs.where(k % 2 == 0).select(F.concat(stem, F.when(k % 3 == 0, ".a.json").otherwise(".b.json")).alias("path"))
    scan = even.union(docs.where(k % 3 == 0).select(F.concat(stem, F.lit(".b.json")))).distinct()
    name = F.regexp_extract("path", r"([0-9]+)\.jpg\z", 1)
    return albums.sidecar_lookup(docs.select(F.concat(stem, F.lit(".jpg")).alias("path")), scan, F.array(F.concat(name, F.lit(".a.json")), F.concat(name, F.lit(".b.json"))))


@_register("run_refresh", "SELECT o_orderkey % 3 AS run_id, o_orderkey AS file, 'old' AS version FROM orders WHERE o_orderkey % 3 <> 1 UNION ALL SELECT 1, o_orderkey, 'new' FROM orders WHERE o_orderkey % 3 = 1")
def run_refresh(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.select((F.col("o_orderkey") % 3).alias("run_id"), F.col("o_orderkey").alias("file"), F.lit("old").alias("version"))
    new = o.where("o_orderkey % 3 = 1").select(F.lit(1).cast("long").alias("run_id"), F.col("o_orderkey").alias("file"), F.lit("new").alias("version"))
    return catalog.refreshed(old, new, "run_id", 1)


@_register("upsert_last", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS version FROM orders")
def upsert_last(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    old, new = o.where("id % 4 <> 0 or id % 8 = 0").withColumn("version", F.lit("old")), o.where("id % 4 = 0").withColumn("version", F.lit("new"))
    return catalog.upserted(old, new, ["id"])


@_register("insert_ignore", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 OR o_orderkey % 8 = 0 THEN 'old' ELSE 'new' END AS version FROM orders")
def insert_ignore(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    old, new = o.where("id % 4 <> 0 or id % 8 = 0").withColumn("version", F.lit("old")), o.where("id % 4 = 0").withColumn("version", F.lit("new"))
    return catalog.inserted(old, new, ["id"])


@_register("distinct_dirs", "SELECT DISTINCT source || '/' || lang AS dir_path FROM documents")
def distinct_dirs(spark, sf_dir):
    return carriers.files(spark, sf_dir).select(paths.dir_part(F.col("path")).alias("dir_path")).distinct()


@_register("run_distinct", "SELECT COUNT(DISTINCT user_id) AS runs FROM events")
def run_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("runs"))


@_register("people_media", "SELECT c_custkey, c_name, COUNT(*) AS items, SUM(CAST(l_quantity AS BIGINT)) AS files FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def people_media(spark, sf_dir):
    """person with media_person with media_item, three tables wide; the largest is summed before it is joined."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    per = o.join(lines, o.o_orderkey == lines.l_orderkey).groupBy("o_custkey").agg(F.sum("n").alias("items"), F.sum("q").alias("files"))
    return c.join(per, c.c_custkey == per.o_custkey).select("c_custkey", "c_name", "items", "files")


@_register("path_parts", "SELECT doc_id, source || '/' || lang AS dir, 'doc_' || doc_id || '.txt' AS name, source || '/' || lang || '/doc_' || doc_id AS stem FROM documents")
def path_parts(spark, sf_dir):
    p = F.col("path")
    return carriers.files(spark, sf_dir).select("doc_id", paths.dir_part(p).alias("dir"), paths.name_part(p).alias("name"), paths.strip_extension(p).alias("stem"))


@_register("classification_counts", "SELECT COUNT(*) AS files, COUNT(*) FILTER (WHERE page_id % 9 <> 8) AS matched FROM pages")
def classification_counts(spark, sf_dir):
    return classify_paths(spark, sf_dir).agg(F.count("*").alias("files"), F.count("known_type").alias("matched"))


for _name, (_query, _sql) in (records.RECORDS | tables.TABLES).items():
    _register(_name, _sql)(_query)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)
