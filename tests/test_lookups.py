"""Look-ups that grow with what they find: sidecars by what they describe, existing output by candidates, recorded checksums."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from lumenstack.functions.sidecar import RENDITIONS, TAG, described_names, sidecar_candidates
from lumenstack.operators import albums

from .conftest import canonical

#: Texts whose SHA-256 begin with the same seven digits.
SHARING = ("text 20961", "text 103400")


def _names(rnd):
    """Media names around the limit, with counters, renditions and dots, and sidecars that fit some of them at any cut."""
    media, cars = set(), set()
    for _ in range(500):
        base = "".join(rnd.choice("ab.é😀(1)") for _ in range(rnd.choice((1, 3, 10, 22, 23, 24, 30, 41, 45, 46, 47, 50))))
        name = base + rnd.choice(("", rnd.choice(RENDITIONS), rnd.choice(RENDITIONS).lower())) + rnd.choice(("", "(2)", "(10)")) + rnd.choice((".jpg", ".HEIC", ".mp4", ".MOV", "", ".a.png"))
        media.add(f"{rnd.choice(('', 'd/', 'd/e/'))}{name}")
    for path in sorted(media):
        folder, _, name = path.rpartition("/")
        known = sidecar_candidates(name)
        for car in rnd.sample(known, min(len(known), rnd.choice((0, 1, 2, 4)))):
            cars.add(f"{folder}/{car}" if folder else car)
        cars.add((f"{folder}/" if folder else "") + name + TAG[: rnd.randint(0, 9)] + rnd.choice((".json", ".JSON", "(3).json", "x.json")))
    return sorted(media), sorted(cars)


def test_sidecars_by_what_they_describe(spark):
    media, cars = _names(random.Random(5))
    there, want = set(cars), {}
    for path in media:
        folder, _, name = path.rpartition("/")
        tried = [f"{folder}/{c}" if folder else c for c in sidecar_candidates(name)]
        found = next((c for c in tried if c in there), None)
        if found is not None:
            want[path] = found
    df = spark.createDataFrame([(p,) for p in media], "path string")
    got = albums.sidecar_join(df, spark.createDataFrame([(p,) for p in media + cars], "path string")).collect()
    assert {r.path: r.sidecar for r in got} == want and len(got) == len(want) > 200


def test_sidecars_of_one_file_are_met_by_many_tasks(spark):
    """sidecar_prefixes: a small file may hold many names, so its size must not decide that one task, or a broadcast, takes all of them."""
    n = spark.range(0, 4000, 1, 1)
    media, cars = n.select(F.concat(F.lit("d/"), "id", F.lit(".jpg")).alias("path")), n.select(F.concat(F.lit("d/"), "id", F.lit(f".jpg{TAG}.json")).alias("path"))
    found = albums.sidecar_join(media, media.union(cars).coalesce(1))
    assert found.count() == 4000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 2
    assert plan.count("REPARTITION_BY_COL") >= 2, plan


def test_rows_of_a_name_do_not_grow_with_it(spark):
    """507 and 921 candidates were listed for names of 54 and 221 characters."""
    for n in (54, 221, 2000):
        name = "x" * (n - 14) + "-edited(1).jpg"
        assert spark.createDataFrame([(name,)], "n string").select(F.size(described_names(F.col("n")))).first()[0] <= 48
    read = albums._readings(spark.createDataFrame([("a/b.c.supplemental-metadata(1).json",), ("x.json",), (".json",), ("y.txt",)], "path string")).collect()
    assert sorted((r.described, r.cut, r.counter) for r in read) == sorted([("b.c.supplemental-metadata(1)", 0, ""), ("b.c.supplemental-metadata", 0, "(1)"), ("b.c", 22, "(1)"), ("x", 0, ""), ("", 0, "")])


def test_only_candidates_of_one_size_are_read(spark):
    """Other files of the folder, and candidates of another size, are not; a name of another size is passed over like one of other bytes."""
    from lumenstack.operators import dedup

    media = spark.createDataFrame([("a/x", "jpg", "s1", "l1", 5), ("a/x", "jpg", "s2", "l2", 7), ("b/y", "png", "s3", "l3", None)], "want string, ext string, short_hash string, long_hash string, file_size long")
    there = spark.createDataFrame([("a/x.jpg", 7, 1), ("a/x-s1.jpg", 9, 1), ("a/other.jpg", 5, 1), ("b/y.png", 3, 1), ("b/y-s9.png", 3, 1)], "path string, file_size long, modified long")
    found = {r.path: r.to_read for r in dedup.candidates_there(media, there).collect()}
    assert found == {"a/x.jpg": True, "a/x-s1.jpg": False, "b/y.png": True}
    hashes = [("a/x.jpg", "l2"), ("a/x-s1.jpg", dedup.OTHER_SIZE), ("b/y.png", "zz")]
    got = {r.long_hash: (r.output_path, r.action) for r in dedup.names_over_existing(media, spark.createDataFrame(hashes, "path string, existing_hash string")).collect()}
    assert got == {"l1": ("a/x-l1.jpg", "write"), "l2": ("a/x.jpg", "skip"), "l3": ("b/y-s3.png", "write")}


def _sharing_a_short_hash(spark, folder):
    """Documents of which two share a short hash and a want, with sizes one apart, as they do in large collections; and DuckDB over them."""
    import duckdb

    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(SHARING + ("a", "b", "longer than all others"))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, datetime(2020, 1, 1))], "event_id long, ts timestamp_ntz").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con


def _as_sql(spark, folder, con, name):
    from lumenstack.plans.tables import TABLES

    query, sql = TABLES[name]
    got = query(spark, str(folder))
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert canonical(got.collect(), got.columns) == canonical(want.fetchall(), columns)
    return got


def test_a_path_listed_twice_comes_once(spark, tmp_path):
    """existing_reads: files of two items that want one name, of sizes that one of them has."""
    found = _as_sql(spark, tmp_path, _sharing_a_short_hash(spark, tmp_path), "existing_reads")
    assert found.where("path = 'src1-000ef46.txt' and to_read").count() == 1


def test_items_that_share_a_short_hash_are_named_once(spark, tmp_path):
    """existing_names: both pass over the file that has their short name, and each comes once."""
    found = _as_sql(spark, tmp_path, _sharing_a_short_hash(spark, tmp_path), "existing_names")
    assert found.count() == 5 == found.select("output_path").distinct().count()


def test_ledger(spark, tmp_path):
    from lumenstack.sources.ledger import Ledger

    book = Ledger(spark, f"file://{tmp_path}/ledger")
    rows = lambda *r: spark.createDataFrame(r, "path string, file_size long, modified long, hash string")
    book.record(rows(("a", 1, 5, "h1"), ("b", 2, 5, "h2"), ("c", 3, None, "h3"), ("d", 4, 5, None)))
    book.record(rows(("a", 1, 6, "h4")))
    files = rows(("a", 1, 6, None), ("b", 2, 9, None), ("c", 3, None, None), ("d", 4, 5, None), ("e", 1, 1, None))
    assert [tuple(r) for r in book.known(files).collect()] == [("a", 1, 6, "h4")]


def test_balanced_tasks(spark):
    """A Zipf table, equal weights, heavy rows alone, nulls and an empty table."""
    from lumenstack.operators.balance import balanced

    def loads(rows, tasks):
        df = spark.createDataFrame(rows, "k string, w long")
        got = balanced(df, tasks, "k", "w").collect()
        assert sorted(map(str, ((r.k, r.w) for r in got))) == sorted(map(str, rows))
        out = [0] * tasks
        for r in got:
            out[r.task] += max(r.w or 0, 0)
        return out

    for tasks in (4, 16):
        for rows in ([(f"f{i}", 10_000_000 // (i + 10)) for i in range(5000)], [(f"f{i}", 7) for i in range(3000)], [(f"g{i % 50}", i % 13) for i in range(2000)]):
            got = loads(rows, tasks)
            assert max(got) <= 1.3 * sum(got) / tasks
    got = loads([("big", 10**9), *((f"f{i}", 1000) for i in range(900))], 4)
    assert sorted(got)[-1] == 10**9 and sorted(got)[2] <= 1.3 * 300_000
    assert sum(loads([("a", None), (None, 3), ("b", -5), ("b", 0)], 3)) == 3
    assert loads([], 3) == [0, 0, 0]


def test_first_pairs_of_one_identifier(spark):
    """A hundred thousand stills and as many videos of one identifier: no more than k * k pairs are made."""
    from lumenstack.plans.reports import live_photo_join

    n = 100_000
    rows = spark.range(2 * n).select(F.lit("one").alias("content_identifier"), F.when(F.col("id") < n, "p").otherwise("v").alias("kind"), F.format_string("%07d", F.col("id")).alias("media_path"), F.col("id").alias("duration_ms"))
    alone = spark.createDataFrame([("x", "p", "0", 1), (None, "p", "00", 1), (None, "v", "01", 1)], "content_identifier string, kind string, media_path string, duration_ms long")
    got = [(r.still, r.video) for r in live_photo_join(rows.unionByName(alone), 10).collect()]
    assert got == [("0000000", f"{n + i:07d}") for i in range(10)]


def test_flat_folder_is_listed_in_pieces(spark, tmp_path):
    """A directory of many files, with hidden ones, others below and links, comes in ranges of names that leave nothing out."""
    from lumenstack.sources import files

    names = {f"{i * 7919 % 10_007:05d}.jpg" for i in range(3000)} | {".hidden", "é.png", "z z.txt"}
    for n in names:
        (tmp_path / n).write_bytes(b"x" * (len(n) % 7))
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "sub" / "deep" / "a.mov").write_bytes(b"abc")
    (tmp_path / "link").symlink_to(tmp_path / "sub")
    reader = files.ListingReader(str(tmp_path), None, 250)
    pieces = reader.partitions()
    assert len(pieces) >= 12 and all(sum(b.num_rows for b in reader.read(p)) <= 600 for p in pieces)
    rows = files.listing(spark, str(tmp_path), piece=250).collect()
    assert {r.path: r.file_size for r in rows} == {n: len(n) % 7 for n in names} | {"sub/deep/a.mov": 3}
    assert len(rows) == len({r.scan_ordinal for r in rows})
    top = [r.path for r in sorted(rows, key=lambda r: r.scan_ordinal) if "/" not in r.path]
    assert top == sorted(top)
    (tmp_path / "empty").mkdir()
    assert files.listing(spark, str(tmp_path / "empty")).count() == 0


def test_pieces_of_a_flat_folder_are_bounded(spark, tmp_path):
    """listing_flat: each piece passes by all names, so there were as many passes as pieces, and time grew with the square of the files."""
    from lumenstack.sources import files, places

    for i in range(2000):
        (tmp_path / f"{i}.jpg").write_bytes(b"x" * (i % 5))
    assert 32 <= len(files.ListingReader(str(tmp_path), None, 5).partitions()) <= places.PIECES
    rows = files.listing(spark, str(tmp_path), piece=5).collect()
    assert sorted((r.path, r.file_size) for r in rows) == sorted((f"{i}.jpg", i % 5) for i in range(2000))


def test_zip_index_is_read_in_parts(spark, tmp_path):
    """Names and sizes as zipfile has them: folders, odd names, a comment, entries of the wide kind, and bytes before the first entry."""
    import zipfile

    from lumenstack.sources import files

    path = tmp_path / "in.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(2500):
            z.writestr(f"d{i % 7}/\u00e9 {i}.jpg" if i % 2 else f"plain{i}.mov", b"x" * (i % 50))
        for bad in ("../out.jpg", "/abs.jpg", "dir/"):
            z.writestr(bad, b"")
        with z.open("wide.bin", "w", force_zip64=True) as f:
            f.write(b"12345")
        z.comment = b"a comment of the whole " * 9
    plain = path.read_bytes()
    (tmp_path / "late.zip").write_bytes(b"#!/bin/sh\n" * 9 + plain)
    for name in ("in.zip", "late.zip"):
        with zipfile.ZipFile(tmp_path / name) as z:
            want = [(i.filename, i.file_size) for i in z.infolist() if i.filename not in ("../out.jpg", "/abs.jpg", "dir/")]
        assert len(files.ListingReader(str(tmp_path / name), None, 300).partitions()) == 9
        rows = sorted(files.listing(spark, str(tmp_path / name), piece=300).collect(), key=lambda r: r.scan_ordinal)
        assert [(r.path, r.file_size) for r in rows] == want
        with files.open_entry(str(tmp_path / name), "wide.bin") as f:
            assert f.read() == b"12345"
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    assert files.listing(spark, str(tmp_path / "none.zip")).count() == 0


def test_zip_is_written_by_many_tasks(spark, tmp_path):
    """zip_entries: one task wrote all entries. Each task now writes its own, none of them all; zipfile reads the whole as one file."""
    import zipfile

    from lumenstack.sources import files, sinks

    texts = {f"d{i % 3}/\u00e9 {i}.txt": None if i == 7 else f"text {i} " * (i % 40) for i in range(3000)}
    rows = spark.createDataFrame(list(texts.items()), "name string, text string").repartition(7, "name")
    path = str(tmp_path / "all.zip")
    sinks.write_zip(rows, path)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and {n: z.read(n).decode() for n in z.namelist()} == {n: t or "" for n, t in texts.items()}
    assert [x.name for x in tmp_path.iterdir()] == ["all.zip"]
    listed = files.listing(spark, path, piece=100).collect()
    assert len(listed) == 3000
    for r in listed[::100]:
        with files.open_entry(path, "", ordinal=r.scan_ordinal) as f:
            assert f.read().decode() == (texts[r.path] or "")
    sinks.write_zip(rows.limit(0), path)
    assert files.listing(spark, path).count() == 0


def test_records_beyond_4_gb(tmp_path):
    """An index whose entries stand beyond 4 GB, in a file with a hole before them, is read by zipfile and by this package."""
    import zipfile

    from lumenstack.sources.places import Zip, zip_end, zip_moved

    part, path, far = tmp_path / "part.zip", tmp_path / "far.zip", 5 << 30
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "abc" * 99)
        with z.open("wide.bin", "w", force_zip64=True) as f:
            f.write(b"12345")
    with open(part, "rb") as f, open(path, "wb") as out:
        at, end, _ = Zip(str(part))._index(f)
        moved = b"".join(zip_moved(r, far, True) for _, r in Zip(str(part))._records(f, at, end))
        f.seek(0)
        out.seek(far)
        out.write(f.read(at) + moved + zip_end(2, far + at, len(moved)))
    with zipfile.ZipFile(path) as z:
        assert z.read("a.txt") == b"abc" * 99 and z.read("wide.bin") == b"12345"
    place = Zip(str(path))
    found = [x for part in place.cuts(1) for x in place.placed(*part)]
    assert [(e[0], e[1]) for _, e in found] == [("a.txt", 297), ("wide.bin", 5)]
    assert [place.open("", at).read() for at, _ in found] == [b"abc" * 99, b"12345"]
