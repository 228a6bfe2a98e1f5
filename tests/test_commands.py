"""Notes and album readers on tables of cases; the commands end to end on a small synthetic export."""

import json
import re

import pytest

from lumenstack.operators import notes
from lumenstack.plans import commands
from lumenstack.sources.albums import parse_csv_album, parse_json_album

from .test_sources import jpeg, movie


@pytest.mark.parametrize(
    "text, front, body",
    [
        ("", "", ""), ("hello", "", "hello"), ("---\na: 1\n---\nbody\n", "a: 1", "body\n"), ("---\r\na: 1\r\n---\r\nbody", "a: 1", "body"), ("\n\n---\na: 1\n---\n", "a: 1", "\n"),
        ("---\na: 1\n---", "a: 1", ""), ("---\na: 1\n---body", "a: 1", "\nbody"), ("---\n\n---\nbody", "", "---\n\n---\nbody"), ("---\na: 1\nbody", "", "---\na: 1\nbody"), ("---a", "", "---a"),
    ],
)
def test_split_front(text, front, body):
    assert notes.split_front(text) == (front, body)


def test_merge_front():
    front = "title: Mine # by hand\nchecksum: old\npeople:\n- '[[A]]'\nalbums: [\"[[X]]\"]\nlatitude: 1.5"
    text, changed = notes.merge_front(front, {"checksum": "abc", "latitude": 1.5, "longitude": 45.0}, {"people": ["[[A]]", "[[B]]"], "albums": ["[[X]]"], "original-paths": ["a b.jpg", "1e5"]})
    assert changed
    assert text == "title: Mine # by hand\nchecksum: abc\npeople:\n- '[[A]]'\n- \"[[B]]\"\nalbums: [\"[[X]]\"]\nlatitude: 1.5\nlongitude: 45\noriginal-paths:\n  - a b.jpg\n  - \"1e5\"\n"
    again, changed = notes.merge_front(text, {"checksum": "abc", "longitude": 45.0}, {"people": ["[[B]]"], "original-paths": ["1e5"]})
    assert not changed and again == text
    assert notes.merge_front("people: none", {}, {"people": ["x"]}) == ("people: none\n", False)
    for bad in ("", "- a\n- b", "just words"):
        with pytest.raises(ValueError):
            notes.merge_front(bad, {"checksum": "x"}, {})
    for s in ("", "a: b", "null", "0x1f", "12", " a", "a ", "-x", "it's", 'say "x"', "back\\slash", "line\nline", "plain"):
        assert notes.unquoted(notes.quoted(s)) == s


def test_album_notes():
    first = notes.album_markdown("T", ["2020/a.jpg"])
    again = notes.album_markdown("T", ["2020/b.jpg"], first + "mine\n")
    assert again.endswith(f"\n![Photo](../2020/b.jpg)\n\n{notes.MARKER}\nmine\n") and "a.jpg" not in again
    assert notes.album_notes("no marker") == ""


def test_album_parsers():
    assert parse_csv_album(b"\xef\xbb\xbf Images \nA.jpg\n\nb,c\n\"d,e.jpg\"\n\xff.jpg\n") == ["A.jpg", "d,e.jpg"]
    assert parse_csv_album(b"Other\nA.jpg\n") == [] and parse_csv_album(b"") == []
    assert [parse_json_album(x) for x in (b'{"title": " T "}', b'{"title": 3}', b'{"title": ""}', b"{}", b"[]", b"no")] == ["T", "", "", None, None, None]


@pytest.fixture
def export(tmp_path):
    root = tmp_path / "in"
    files = {
        "Google Photos/Trip/one.jpg": jpeg(), "Google Photos/Trip/copy.jpg": jpeg(), "Google Photos/Trip/other.jpg": jpeg(make=b"Other\0"), "Google Photos/Trip/clip.mov": movie(),
        "Google Photos/Trip/one.jpg.json": json.dumps({"people": [{"name": "Ann"}, {"name": " "}], "geoData": {"latitude": 1.5, "longitude": 2}}).encode(),
        "Google Photos/Trip/metadata.json": b'{"title": "The Trip"}', "Google Photos/Photos from 2012/metadata.json": b'{"title": "2012"}',
        "lists/Best.csv": b"Images\nONE.JPG\nmissing.jpg\n", "lists/None.csv": b"Images\nmissing.jpg\n", "bad.png": b"no",
    }
    for name, raw in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)
    return root


def test_db(spark, export, tmp_path):
    root = f"file://{tmp_path}/catalog"
    cat = commands.db(spark, str(export), root, "+00:00")
    counts = cat.counts()
    assert (counts["media_item"], counts["album"], counts["run"], counts["classified_file"]) == (4, 2, 1, 10)
    assert {r.title for r in cat.read("album").collect()} == {"The Trip", "Best"}
    assert counts["album_file"] == 5
    assert commands.db(spark, str(export), root, "+00:00").counts() == counts


def test_sync_twice(spark, export, tmp_path):
    out = tmp_path / "out"
    dry = commands.sync(spark, str(export), str(out), "+00:00", dry_run=True)
    assert {r.status for r in dry.collect()} == {"dry-run"} and not list(out.rglob("*.*"))
    done = {r.output_path: r.status for r in commands.sync(spark, str(export), str(out), "+00:00").collect()}
    assert set(done.values()) == {"written"}
    made = {str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()}
    assert made == set(done) and {"2008/05/30/1556-01000.jpg", "1970/01/01/0000-00000.mov", "albums/Trip.md", "albums/Best.md"} <= made
    assert len([p for p in made if re.fullmatch(r"2008/05/30/1556-01000(-[0-9a-f]{7})?\.jpg", p)]) == 2
    both = "".join((out / p).read_text() for p in sorted(made) if p.startswith("2008") and p.endswith(".md"))
    assert "  - Google Photos/Trip/copy.jpg\n" in both and "  - Google Photos/Trip/one.jpg\n" in both and '"[[Trip]]"' in both and '"[[Best]]"' in both
    best = out / "albums/Best.md"
    best.write_text(best.read_text() + "my words\n")
    before = {p: (out / p).read_bytes() for p in made}
    again = {r.status for r in commands.sync(spark, str(export), str(out), "+00:00").collect()}
    assert again <= {"skip", "unchanged"} and before == {p: (out / p).read_bytes() for p in made}


def test_info(spark, export):
    text = commands.info(spark, str(export), "Google Photos/Trip/one.jpg", "+00:00")
    assert "| Path | 2008/05/30/1556-01000.jpg |" in text and "| `Make` | Canon |" in text and "![](1556-01000.jpg)" in text
    assert "- Album: The Trip" in commands.info(spark, str(export), "Google Photos/Trip/metadata.json")
    assert "- Not an album" in commands.info(spark, str(export), "lists/None.csv")
    with pytest.raises(FileNotFoundError):
        commands.info(spark, str(export), "nowhere.jpg")


def test_second_sync_reads_nothing_that_is_recorded(spark, export, tmp_path):
    """With a ledger, files of the output whose size and time are as recorded are not opened: here they hold other bytes by then."""
    import os

    out, ledger = tmp_path / "out", f"file://{tmp_path}/ledger"
    commands.sync(spark, str(export), str(out), "+00:00", skip_markdown=True, skip_albums=True, ledger=ledger).collect()
    for p in (p for p in out.rglob("*") if p.is_file()):
        s = p.stat()
        p.write_bytes(bytes(s.st_size))
        os.utime(p, ns=(s.st_atime_ns, s.st_mtime_ns))
    again = commands.sync(spark, str(export), str(out), "+00:00", skip_markdown=True, skip_albums=True, ledger=ledger)
    assert {r.status for r in again.collect()} == {"skip"}
    for p in (p for p in out.rglob("*") if p.is_file()):
        os.utime(p, (1, 1))
    once_more = commands.sync(spark, str(export), str(out), "+00:00", skip_markdown=True, skip_albums=True, ledger=ledger)
    assert {r.status for r in once_more.collect()} == {"written"}


def _state(cat):
    people = cat.read("media_person").join(cat.read("person"), "person_id").select("media_item_id", "name")
    links = cat.read("album_file").join(cat.read("album"), "album_id").select("media_item_id", "title")
    return [sorted(map(str, t.collect())) for t in (cat.read("media_item"), people, links, cat.read("classified_file").drop("run_id"), cat.read("classified_dir").drop("run_id"))]


def test_stream_killed_and_restarted_equals_one_run(spark, export, tmp_path, monkeypatch):
    """Four files at a time, killed at two places, a sidecar that comes after its photo, and then nothing new."""
    import os

    from lumenstack.sources.catalog import Catalog
    from lumenstack.streaming.ingest import ingest

    for i, p in enumerate(sorted(p for p in export.rglob("*") if p.is_file())):
        os.utime(p, (10**9 + 60 * i, 10**9 + 60 * i))
    late = (export / "Google Photos/Trip/one.jpg.json").rename(export / "Google Photos/Trip/one.jpg.supplemental-metadata.json")
    os.utime(late, (15 * 10**8, 15 * 10**8))  # the stream takes files by age
    want = _state(commands.db(spark, str(export), f"file://{tmp_path}/whole", "+00:00"))
    assert len(want[1]) == 2 and "latitude=1.5" in str(want[0])
    root, calls = f"file://{tmp_path}/stream", {"insert": 0, "upsert": 0}
    for name, at in (("insert", 1), ("upsert", 5)):
        plain = getattr(Catalog, name)

        def broken(self, *args, plain=plain, name=name, at=at):
            calls[name] += 1
            if calls[name] == at:
                raise OSError("killed")
            return plain(self, *args)

        monkeypatch.setattr(Catalog, name, broken)
    failed = 0
    for _ in range(4):
        try:
            cat = ingest(spark, str(export), root, "+00:00", files_per_batch=4)
            break
        except Exception as e:
            assert "killed" in str(e)
            failed += 1
    assert failed == 2 and _state(cat) == want
    version = cat.tables["media_item"].snapshot().version
    assert _state(ingest(spark, str(export), root, "+00:00", files_per_batch=4)) == want and cat.tables["media_item"].snapshot().version == version
