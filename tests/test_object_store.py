"""Sources and outputs in an object store, over its own protocol, against the same files in a directory."""

import json

import pytest

from lumenstack.plans import commands
from lumenstack.sources import files, places, sinks

from .object_store import ObjectStore
from .test_sources import jpeg, movie

EXPORT = {
    "Google Photos/Trip/one.jpg": jpeg(), "Google Photos/Trip/copy.jpg": jpeg(), "Google Photos/Trip/other é+&.jpg": jpeg(make=b"Other\0"), "Google Photos/Trip/clip.mov": movie(),
    "Google Photos/Trip/one.jpg.supplemental-metadata.json": json.dumps({"people": [{"name": "Ann"}], "geoData": {"latitude": 1.5, "longitude": 2}}).encode(),
    "Google Photos/Trip/metadata.json": b'{"title": "The Trip"}', "lists/Best.csv": b"Images\nONE.JPG\n", "bad.png": b"no", ".DS_Store": b"x",
}


@pytest.fixture
def store(spark):
    held = ObjectStore()
    spark.conf.set("spark.hadoop.fs.s3a.endpoint", held.endpoint)
    yield held
    spark.conf.unset("spark.hadoop.fs.s3a.endpoint")
    held.close()


def test_store_is_listed_and_read_like_a_directory(spark, store, tmp_path):
    for name, raw in EXPORT.items():
        store.put(f"bucket/in/{name}", raw)
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    store.put("bucket/in/Google Photos/", b"")  # a placeholder of a prefix
    store.put("bucket/inner/elsewhere.jpg", b"x")
    seen = [sorted((r.path, r.file_size, r.quick_file_type) for r in files.listing(spark, uri).collect()) for uri in ("s3://bucket/in", str(tmp_path))]
    assert seen[0] == seen[1] and len(seen[0]) == len(EXPORT)
    assert all(r.modified and r.modified % 1000 == 0 for r in files.listing(spark, "s3://bucket/in/").collect())
    with files.open_entry("s3://bucket/in", "Google Photos/Trip/one.jpg", store.endpoint) as f:
        f.seek(2)
        assert f.read(4) == EXPORT["Google Photos/Trip/one.jpg"][2:6]


def test_catalog_of_a_store(spark, store, tmp_path):
    for name, raw in EXPORT.items():
        store.put(f"bucket/in/{name}", raw)
    cat = commands.db(spark, "s3://bucket/in", f"file://{tmp_path}/catalog", "+00:00")
    rows = {r.media_path: (r.latitude, r.camera_make) for r in cat.read("media_item").collect()}
    assert len(rows) == 4 and rows["Google Photos/Trip/one.jpg"] == (1.5, "Canon") and rows["Google Photos/Trip/other é+&.jpg"][1] == "Other"
    assert {r.title for r in cat.read("album").collect()} == {"The Trip", "Best"} and cat.read("person").count() == 1


def test_archive_in_a_store(spark, store, tmp_path):
    """Written once, then found as it is; with a ledger, no media file is read again."""
    root = tmp_path / "in"
    for name, raw in EXPORT.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)
    run = lambda **more: {r.output_path: r.status for r in commands.sync(spark, str(root), "s3://bucket/out", "+00:00", **more).collect()}
    first = run(ledger=f"file://{tmp_path}/ledger")
    assert set(first.values()) == {"written"} and {k.removeprefix("bucket/out/") for k in store.objects} == set(first)
    assert "2008/05/30/1556-01000.jpg" in first and store.objects["bucket/out/2008/05/30/1556-01000.jpg"][0] in EXPORT.values()
    before = {k: v[0] for k, v in store.objects.items()}
    store.asked.clear()
    again = run(ledger=f"file://{tmp_path}/ledger")
    assert set(again.values()) <= {"skip", "unchanged"} and before == {k: v[0] for k, v in store.objects.items()}
    read = {k for m, k, q in store.asked if m == "GET" and "list-type" not in q}
    assert not [k for k in read if not k.endswith(".md")] and not [k for m, k, _ in store.asked if m in ("PUT", "POST")]


def test_large_objects_go_in_parts(store, tmp_path):
    place, body = places.open_output("s3://bucket/big", store.endpoint), bytes(range(256)) * 50_000
    (tmp_path / "big").write_bytes(body)
    with open(tmp_path / "big", "rb") as f:
        assert sinks.put(place, "a/b.bin", f) == "written"
    assert store.objects["bucket/big/a/b.bin"][0] == body and any(m == "PUT" and "partNumber" in q for m, _, q in store.asked)
    assert place.size("a/b.bin") == len(body) and place.size("a/none") is None
