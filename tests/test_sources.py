"""Sources and parsers on synthetic files, names and dates on tables of cases, the catalog on scenarios."""

import io
import struct
import zipfile
from datetime import timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lumenstack.functions import dates, ids, paths, sidecar
from lumenstack.sources import catalog, files, formats, inspect


CONTENT_KEY = b"com.apple.quicktime.content.identifier"


def atom(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def movie(identifier=b"AB-12"):
    mvhd = atom(b"mvhd", bytes(4) + struct.pack(">IIII", 2082844800, 0, 1000, 5000) + bytes(80))
    tkhd = atom(b"tkhd", bytes(76) + struct.pack(">II", 854 << 16, 480 << 16))
    keys = atom(b"keys", bytes(4) + struct.pack(">I", 1) + struct.pack(">I", 8 + len(CONTENT_KEY)) + b"mdta" + CONTENT_KEY)
    ilst = atom(b"ilst", atom(struct.pack(">I", 1), atom(b"data", bytes(8) + identifier)))
    return atom(b"ftyp", b"qt  " + bytes(4)) + atom(b"moov", mvhd + atom(b"trak", tkhd) + atom(b"meta", keys + ilst))


def jpeg(make=b"Canon\0", date=b"2008:05:30 15:56:01\0"):
    rows = [(0x010F, make), (0x9003, date)]
    data, at = b"", 8 + 2 + 12 * len(rows) + 4
    ifd = struct.pack("<H", len(rows))
    for tag, value in rows:
        ifd += struct.pack("<HHII", tag, 2, len(value), at + len(data))
        data += value
    tiff = b"II*\0" + struct.pack("<I", 8) + ifd + bytes(4) + data
    app = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xd9"


def test_formats():
    raw = movie()
    track = formats.read_track(io.BytesIO(raw), len(raw))
    assert (track["width"], track["height"], track["duration_ms"], track["content_identifier"]) == (854, 480, 5000, "AB-12")
    assert track["creation_time"] == "1970-01-01T00:00:00+00:00"
    assert formats.sniff(raw) == "Mov" and formats.sniff(jpeg()) == "Jpg" and formats.sniff(b"") == "Unsupported" and formats.sniff(b"\0\0\0\x14pnot") == "Mov"
    assert formats.read_tiff(formats.exif_block(jpeg())) == {"Make": "Canon", "DateTimeOriginal": "2008:05:30 15:56:01"}
    for cut in range(0, len(raw), 7):
        formats.read_track(io.BytesIO(raw[:cut]), cut)
    for cut in range(0, len(jpeg()), 3):
        formats.read_tiff(formats.exif_block(jpeg()[:cut]) or b"")


def tiff(make=b"NIKON CORPORATION\0", gap=0):
    """A TIFF file whose directory and value follow a gap."""
    at = 8 + gap
    return b"II*\0" + struct.pack("<I", at) + bytes(gap) + struct.pack("<HHHIII", 1, 0x010F, 2, len(make), at + 18, 0) + make


def test_exif_past_the_head(tmp_path):
    """Metadata that lies past the first 64 KB of each kind of file."""
    gap, block = 3 * formats.HEAD, tiff()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    segment = lambda n, body: b"\xff" + bytes([n]) + struct.pack(">H", len(body) + 2) + body
    heif = lambda at: atom(b"ftyp", b"heic" + bytes(4)) + atom(b"meta", bytes(4) + atom(b"iinf", bytes(4) + b"\0\1" + atom(b"infe", b"\2\0\0\0\0\7\0\0Exif\0")) + atom(b"iloc", bytes(4) + b"\x44\0\0\1" + struct.pack(">HHHII", 7, 0, 1, at, len(block) + 10)))
    start = len(heif(0)) + 8 + gap
    jpg = b"\xff\xd8" + segment(0xE2, bytes(65000)) * 2 + segment(0xE1, b"Exif\0\0" + block) + b"\xff\xd9"
    boxes = atom(b"uuid", bytes.fromhex("85c0b687820f11e08111f4ce462b6a48") + atom(b"CMT1", block))
    found = {
        "a.tif": tiff(b"Canon\0", gap), "b.nef": tiff(gap=gap), "c.png": b"\x89PNG\r\n\x1a\n" + chunk(b"IDAT", bytes(gap)) + chunk(b"eXIf", block), "d.jpg": jpg,
        "e.heic": heif(start) + atom(b"mdat", bytes(gap) + struct.pack(">I", 6) + b"Exif\0\0" + block),
        "f.cr3": atom(b"ftyp", b"crx " + bytes(4)) + atom(b"free", bytes(gap)) + atom(b"moov", boxes),
        "g.raf": b"FUJIFILMCCD-RAW".ljust(84) + struct.pack(">II", 92 + gap, len(jpg)) + bytes(gap) + jpg,
    }
    for name, raw in found.items():
        (tmp_path / name).write_bytes(raw)
        got = inspect._inspect(str(tmp_path), name, dates.output_zone("+00:00"))
        assert got.get("tags") == {"Make": "Canon" if name == "a.tif" else "NIKON CORPORATION"}, name
        assert got["accurate_file_type"] == name[2:].capitalize()
        for cut in [*range(0, 400, 7), *range(len(raw) - 200, len(raw), 7)]:
            formats.read_exif(formats.View(io.BytesIO(raw[:cut]), 0, cut))


def test_directory_and_zip_agree(spark, tmp_path):
    root = tmp_path / "in"
    (root / "a").mkdir(parents=True)
    content = {"a/one.jpg": jpeg(), "a/two.mov": movie(), ".DS_Store": b"x", "a/bad.png": b"no", "a/copy.jpg": jpeg()}
    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        for name, raw in content.items():
            (root / name).write_bytes(raw)
            z.writestr(name, raw)
        z.writestr("../escape.jpg", b"x")
    seen = []
    for uri in (str(root), str(tmp_path / "in.zip")):
        rows = inspect.inspect(files.listing(spark, uri).where("quick_file_type = 'Media'"), uri, "+12:00").collect()
        seen.append(sorted((r.path, r.accurate_file_type, r.long_hash, r.capture, r.duration_ms, r.content_identifier, r.status) for r in rows))
    assert seen[0] == seen[1] and [x[0] for x in seen[0]] == ["a/bad.png", "a/copy.jpg", "a/one.jpg", "a/two.mov"]
    assert seen[0][2][3] == "2008-05-30T15:56:01+00:00" and seen[0][0][6] == "Unsupported"


def test_uris():
    s3 = files.S3Uri.parse("s3://b/some/prefix")
    assert (s3.key_for("x"), s3.relative_of("some/prefix/x"), s3.relative_of("other")) == ("some/prefix/x", "x", None)
    for bad in ("s3://", "s3:/x"):
        with pytest.raises(ValueError):
            files.kind_of(bad)
    with pytest.raises(FileNotFoundError):
        files.kind_of("/no/such/place")
    assert files.zip_times(b"\x55\x54\x05\x00\x01" + struct.pack("<i", 1749874162)) == (1749874162000, None)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("2008:05:30 15:56:01", "2008-05-30T15:56:01+00:00"), ("2025-02-09T18:17:01.183+13:00", "2025-02-09T18:17:01.183+13:00"), ("2015:04:17", "2015-04-17T00:00:00+00:00"), ("2008-05-30 15:56:01.5", "2008-05-30T15:56:01.500+00:00"), ("", None), ("0000:00:00 00:00:00", None), ("nonsense", None)],
)
def test_exif_dates(raw, want):
    t = dates.parse_exif_date(raw)
    assert (dates.rfc_3339(t) if t else None) == want


def test_sub_seconds_and_zones():
    assert [dates.sub_second_millis(x) for x in ("07", "9", "1234", " 5 \0", "x", "", None)] == [70, 900, 123, 500, None, None, None]
    zone = timezone(timedelta(hours=12))
    assert dates.gps_reading({"GPSDateStamp": "2015:04:17", "GPSTimeStamp": "23:00:00"}, zone) == "2015-04-18T11:00:00+12:00"
    assert dates.gps_reading({"GPSDateStamp": "2015:04:17"}, zone) == "2015-04-17T00:00:00+00:00"
    assert dates.output_zone("+0545") == timezone(timedelta(hours=5, minutes=45)) and dates.output_zone(None, "-04:00") == timezone(timedelta(hours=-4))
    with pytest.raises(ValueError):
        dates.output_zone("UTC")


def test_rendering(spark):
    rows = [(0,), (1739078221183,), (-1,), (None,), (10**17,)]
    out = [r[0] for r in spark.createDataFrame(rows, "ms long").select(dates.render_millis(F.col("ms"), timezone(timedelta(hours=13)))).collect()]
    assert out == ["1970-01-01T13:00:00+13:00", "2025-02-09T18:17:01.183+13:00", "1970-01-01T12:59:59.999+13:00", None, None]


def test_sidecar_names():
    first = lambda n: sidecar.sidecar_candidates(n)[0]
    assert first("IMG_1.jpg") == "IMG_1.jpg.supplemental-metadata.json"
    assert len(first("x" * 40 + ".jpg")) == 51
    assert "FullSizeRender.jpg.supplemental-metadata(42).json" in sidecar.sidecar_candidates("FullSizeRender(42).jpg")
    assert "IMG_2.HEIC.supplemental-metadata.json" in sidecar.sidecar_candidates("IMG_2.MP4")
    assert "IMG_3.jpg.supplemental-metadata.json" in sidecar.sidecar_candidates("IMG_3-ERASER-edited.jpg")
    assert sidecar.parse_sidecar('{"people":[{"name":"A"}],"photoTakenTime":{"timestamp":"5"}}')["people"] == [{"name": "A"}]
    for bad in ('{"photoTakenTime":{"timestamp":5}}', "[]", "", '{"people":{}}'):
        assert sidecar.parse_sidecar(bad) is None


def test_ids_and_paths(spark):
    rows = [("e\u0301 ",), ("\u00e9",), ("A",)]
    got = spark.createDataFrame(rows, "s string").select(ids.path_id(F.col("s")).alias("p"), ids.person_id(F.col("s")).alias("q")).collect()
    assert got[0].p == got[1].p and got[2].p != got[2].q
    out = spark.createDataFrame([("2025-02-09T18:17:01.183+13:00", "abc1234"), ("2008-05-30T15:56:01+00:00", "abc1234"), (None, "abc1234"), ("junk", "abc1234")], "d string, h string").select(paths.desired_media_path(F.col("d"), F.col("h"))).collect()
    assert [r[0] for r in out] == ["2025/02/09/1817-01183", "2008/05/30/1556-01000", "undated/abc1234", "undated/abc1234"]


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/c")
    person = lambda *rows: spark.createDataFrame(rows, "person_id string, name string")
    c.insert("person", person(("1", "a"), ("2", "b")))
    c.insert("person", person(("2", "other"), ("3", "c")))
    assert sorted(tuple(r) for r in c.read("person").collect()) == [("1", "a"), ("2", "b"), ("3", "c")]
    c.upsert("person", person(("3", "d")))
    assert c.read("person").where("name = 'd'").count() == 1 and c.counts()["person"] == 3
    assert (c.run("in"), c.run("in"), c.run("else")) == (1, 1, 2)
    c.files.put("version", "3 layers")
    with pytest.raises(ValueError):
        catalog.Catalog(spark, f"file://{tmp_path}/c")
    assert catalog.Catalog(spark, f"file://{tmp_path}/c", clear=True).counts()["person"] == 0


def exif_jpeg(tags):
    """A JPEG whose main directory has ASCII tags."""
    rows = sorted((t, v.encode() + b"\0") for t, v in tags.items())
    data, at = b"", 8 + 2 + 12 * len(rows) + 4
    ifd = struct.pack("<H", len(rows))
    for tag, value in rows:
        short = len(value) <= 4
        ifd += struct.pack("<HHI", tag, 2, len(value)) + (value.ljust(4, b"\0") if short else struct.pack("<I", at + len(data)))
        data += b"" if short else value
    app = b"Exif\0\0II*\0" + struct.pack("<I", 8) + ifd + bytes(4) + data
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xd9"


@pytest.mark.parametrize(
    ("tags", "capture"),
    [
        ({0x9003: "2025:02:09 18:17:01", 0x9011: "+13:00", 0x9291: "183"}, "2025-02-09T18:17:01.183+13:00"),
        ({0x9003: "2025:02:09 18:17:01", 0x9291: "183"}, "2025-02-09T18:17:01.183+00:00"),
        ({0x9003: "2008:05:30 15:56:01", 0x9010: "+13:00"}, "2008-05-30T15:56:01+13:00"),
        ({0x9003: "nonsense", 0x9004: "2008:05:30 15:56:01", 0x9012: "-03:30", 0x9011: "+01:00"}, "2008-05-30T15:56:01-03:30"),
        ({0x9003: "2025-02-09T18:17:01+05:00", 0x9011: "+13:00"}, "2025-02-09T18:17:01+05:00"),
        ({0x9003: "2008:05:30 15:56:01", 0x9011: "   "}, "2008-05-30T15:56:01+00:00"),
    ],
)
def test_capture_has_its_offset(tags, capture):
    read = formats.read_tiff(formats.exif_block(exif_jpeg(tags)))
    assert dates.capture_reading(read) == capture


def test_exif_tags_of_all_directories():
    """Lens, exposure and thumbnail tags; numbers keep their digits."""
    order, entries = "<", []
    place = 8 + 2 + 12 * 3 + 4
    exif = struct.pack("<H", 3) + struct.pack("<HHII", 0x829A, 5, 1, place + 2 + 36 + 4) + struct.pack("<HHII", 0x8827, 3, 1, 400) + struct.pack("<HHI4s", 0xA434, 2, 4, b"50m\0") + bytes(4) + struct.pack("<II", 1, 125)
    second = place + len(exif)
    entries = struct.pack("<HHII", 0x0100, 4, 1, 1234567) + struct.pack("<HHI4s", 0x0110, 2, 4, b"40D\0") + struct.pack("<HHII", 0x8769, 4, 1, place)
    raw = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + entries + struct.pack("<I", second) + exif + struct.pack("<H", 1) + struct.pack("<HHII", 0x0103, 3, 1, 6) + bytes(4)
    got = formats.read_tiff(raw)
    assert got == {"ImageWidth": "1234567", "Model": "40D", "ExifOffset": str(place), "ExposureTime": "0.008", "ISOSpeedRatings": "400", "LensModel": "50m", "Compression": "6"}
    assert len(formats.TAGS) > 90 and len(formats.GPS_TAGS) == 32
    assert dates.gps_time(19, 5, 7.0009) == "19:05:07.001" and dates.gps_time(0, 0, 60.9999) == "00:00:60.999" and dates.gps_time(24, 0, 0) is None


def test_track_metadata():
    """Keys, user data and Matroska headers."""
    known = {b"com.apple.quicktime.make": b"Apple", b"com.apple.quicktime.location.ISO6709": b"+27.5916+086.5640+8850/", b"com.apple.quicktime.creationdate": b"2024-02-02T08:09:57+0800"}
    keys = atom(b"keys", bytes(4) + struct.pack(">I", len(known)) + b"".join(struct.pack(">I", 8 + len(k)) + b"mdta" + k for k in known))
    ilst = atom(b"ilst", b"".join(atom(struct.pack(">I", i + 1), atom(b"data", bytes(8) + v)) for i, v in enumerate(known.values())))
    user = atom(b"udta", atom(b"\xa9mod", struct.pack(">HH", 6, 0) + b"iPhone") + atom(b"\xa9mak", struct.pack(">HH", 5, 0) + b"Other"))
    raw = atom(b"ftyp", b"qt  " + bytes(4)) + atom(b"moov", atom(b"mvhd", bytes(4) + struct.pack(">IIII", 0, 0, 1000, 5000) + bytes(80)) + atom(b"meta", keys + ilst) + user)
    got = formats.read_track(io.BytesIO(raw), len(raw))
    assert got == {"duration_ms": 5000, "make": "Apple", "gps_iso_6709": "+27.5916+086.5640+8850/", "creation_time": "2024-02-02T08:09:57+0800", "model": "iPhone"}
    assert dates.track_reading(got["creation_time"], timezone.utc) == "2024-02-02T00:09:57+00:00"
    ebml = lambda number, body: bytes.fromhex(number) + struct.pack(">Q", len(body) | 1 << 56) + body
    info = ebml("1549a966", ebml("2ad7b1", b"\x0f\x42\x40") + ebml("4489", struct.pack(">d", 5000.0)) + ebml("4461", struct.pack(">q", 86400 * 10**9)))
    tracks = ebml("1654ae6b", ebml("ae", ebml("86", b"V_VP9") + ebml("e0", ebml("b0", struct.pack(">H", 854)) + ebml("ba", struct.pack(">H", 480)))))
    raw = ebml("1a45dfa3", ebml("4282", b"webm")) + ebml("18538067", info + tracks)
    assert formats.sniff(raw) == "Webm"
    assert formats.read_track(io.BytesIO(raw), len(raw)) == {"duration_ms": 5000, "creation_time": "2001-01-02T00:00:00+00:00", "width": 854, "height": 480}
    for cut in range(0, len(raw), 3):
        formats.read_track(io.BytesIO(raw[:cut]), cut)


def test_stores_are_places(spark, tmp_path, monkeypatch):
    """An object store, stood in for by a file:// URI, as source and output; many directories are listed in tasks."""
    from lumenstack.sources import places, sinks

    root = tmp_path / "in"
    for i in range(12):
        (root / f"d{i}/e").mkdir(parents=True)
        (root / f"d{i}/e/{i}.jpg").write_bytes(jpeg() + bytes(i))
    (root / "top.jpg").write_bytes(jpeg())
    want = sorted(str(p.relative_to(root)) for p in root.rglob("*.jpg"))
    for uri in (str(root), f"file://{root}"):
        for wide in (256, 4):
            monkeypatch.setattr(files, "WIDE", wide)
            rows = files.listing(spark, uri).collect()
            assert sorted(r.path for r in rows) == want and len({r.scan_ordinal for r in rows}) == len(want)
            assert all(r.file_size and r.modified for r in rows)
    assert inspect.inspect(files.listing(spark, f"file://{root}"), f"file://{root}").where("status = 'ok'").count() == 13
    out = f"file://{tmp_path}/out"
    place = places.open_output(out)
    assert [sinks.put(place, "a/b.txt", io.BytesIO(x)) for x in (b"1", b"1", b"2")] == ["written", "unchanged", "written"]
    assert sinks.put(place, "a/c.txt", io.BytesIO(b"3"), dry_run=True) == "dry-run" and place.size("a/c.txt") is None
    listed = files.listing(spark, out)
    manifest = listed.select("path", "file_size", "modified", F.lit("known").alias("hash"))
    assert [r.existing_hash for r in sinks.hashes(listed, out, manifest).collect()] == ["known"]
    assert len(sinks.hashes(listed, out).first().existing_hash) == 64
    with pytest.raises(PermissionError):
        place.size("../x")
    with pytest.raises(NotADirectoryError):
        places.open_output(str(root / "top.jpg"))
    with pytest.raises(ValueError):
        places.open_output("s3:nothing")


def _ladder(takers, existing):
    """The ladder, one taker after the other, in plain words."""
    held, out = dict(existing), set()
    for want, ext, short, long in sorted(takers, key=lambda x: x[3]):
        for suffix in ("", f"-{short}", f"-{long}"):
            path = f"{want}{suffix}.{ext}"
            if path not in held:
                held[path] = long
                out.add((long, path, "write"))
            elif held[path] is None:
                out.add((long, None, "error"))
            elif held[path] == long:
                out.add((long, path, "skip"))
            else:
                continue
            break
        else:
            out.add((long, None, "error"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_names_over_existing(spark, seed):
    import random

    from lumenstack.operators.dedup import names_over_existing

    rnd = random.Random(seed)
    longs = [f"{rnd.randrange(4)}{i:03d}" for i in range(60)]
    takers = [(rnd.choice("ab"), rnd.choice(("jpg", "mov")), h[0], h) for h in longs]
    paths = [f"{w}{s}.{e}" for w, e, short, h in takers for s in ("", f"-{short}", f"-{h}")]
    existing = {p: rnd.choice([None, rnd.choice(longs), "other", next(h for w, e, s, h in takers if p in (f"{w}.{e}", f"{w}-{s}.{e}", f"{w}-{h}.{e}"))]) for p in rnd.sample(sorted(set(paths)), 25)}
    got = names_over_existing(spark.createDataFrame(takers, "want string, ext string, short_hash string, long_hash string"), spark.createDataFrame(list(existing.items()), "path string, existing_hash string"))
    assert {tuple(r) for r in got.collect()} == _ladder(takers, existing)
