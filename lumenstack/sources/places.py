"""Where files lie: a folder that all executors see, an object store, or a zip file, behind one set of calls.

Bytes are read and written by the tasks that need them, through seekable streams: no file has to fit into memory.
Object stores go through Arrow's file systems (S3: region by the bucket, endpoint and addressing by the options below).
"""

from __future__ import annotations

import os
import shutil
import struct
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from random import Random
from typing import IO
from urllib.parse import urlsplit

import pyarrow.fs as pafs

#: Entries of zip files above this size are read through a temporary file.
IN_MEMORY = 100 << 20
BLOCK = 1 << 20
#: Names of a directory that are held at once to find where to cut it.
SAMPLE = 4096
#: Pieces of one directory at most: each passes by all its names, so that more would cost time with the square of their number.
PIECES = 64
#: (path, size, modified in ms, created in ms)
Entry = tuple[str, int, int | None, int | None]


@dataclass(frozen=True)
class S3Uri:
    """A bucket and a prefix, which ends with a slash unless empty."""

    bucket: str
    prefix: str

    @classmethod
    def parse(cls, uri: str) -> S3Uri:
        parts = urlsplit(uri)
        if parts.scheme != "s3" or not parts.netloc:
            raise ValueError(f"{uri!r} is not of the form s3://bucket/prefix")
        prefix = parts.path.strip("/")
        return cls(parts.netloc, f"{prefix}/" if prefix else "")

    def key_for(self, relative: str) -> str:
        return self.prefix + relative

    def relative_of(self, key: str) -> str | None:
        return key[len(self.prefix) :] if key.startswith(self.prefix) else None


def safe_name(name: str) -> bool:
    """Whether a relative name stays below its root."""
    return bool(name) and not name.startswith(("/", "\\")) and ":" not in name.split("/")[0] and ".." not in name.replace("\\", "/").split("/")


def _checked(path: str) -> str:
    if not safe_name(path):
        raise PermissionError(path)
    return path


class Folder:
    """A directory."""

    def __init__(self, root: str):
        self.root = root

    def children(self, folder: str) -> tuple[list[Entry], list[str]]:
        """Files and directories of a directory, in order; one that cannot be read has none, a failed stat has no times."""
        files, folders = [], []
        try:
            found = sorted(os.scandir(os.path.join(self.root, folder) if folder else self.root), key=lambda e: e.name)
        except OSError:
            return [], []
        for e in found:
            path = f"{folder}/{e.name}" if folder else e.name
            try:
                if e.is_dir():
                    folders += [] if e.is_symlink() else [path]
                    continue
            except OSError:
                pass
            if entry := self._entry(path, e):
                files.append(entry)
        return files, folders

    def cuts(self, folder: str, most: int) -> tuple[list[str], list[str]]:
        """(names that part a directory's files into pieces of about `most`, or into PIECES larger ones, directories in it). Names are drawn from those
        that pass by; no more than SAMPLE of them are held."""
        drawn, seen, folders, random = [], 0, [], Random(0)
        try:
            with os.scandir(os.path.join(self.root, folder) if folder else self.root) as entries:
                for e in entries:
                    try:
                        if e.is_dir():
                            folders += [] if e.is_symlink() else [f"{folder}/{e.name}" if folder else e.name]
                            continue
                    except OSError:
                        pass
                    seen += 1
                    if len(drawn) < SAMPLE:
                        drawn.append(e.name)
                    elif (at := random.randrange(seen)) < SAMPLE:
                        drawn[at] = e.name
        except OSError:
            return [], []
        drawn.sort()
        pieces = min(-(-seen // most), PIECES, len(drawn))
        return sorted({drawn[i * len(drawn) // pieces] for i in range(1, pieces)}), sorted(folders)

    def between(self, folder: str, low: str | None, high: str | None) -> Iterator[Entry]:
        """Files of a directory whose names are from low to before high, in order. Only these are looked at closely."""
        full = os.path.join(self.root, folder) if folder else self.root
        try:
            with os.scandir(full) as entries:
                found = sorted((e for e in entries if (low is None or e.name >= low) and (high is None or e.name < high)), key=lambda e: e.name)
        except OSError:
            return
        for e in found:
            entry = self._entry(f"{folder}/{e.name}" if folder else e.name, e)
            if entry:
                yield entry

    @staticmethod
    def _entry(path: str, e: os.DirEntry) -> Entry | None:
        """Null for a directory; a failed stat has no times."""
        try:
            if e.is_dir():
                return None
            s = e.stat()
            birth = getattr(s, "st_birthtime", None)
            return path, s.st_size, s.st_mtime_ns // 1_000_000, int(birth * 1000) if birth else None
        except OSError:
            return path, 0, None, None

    def open(self, path: str) -> IO[bytes]:
        full = os.path.realpath(os.path.join(self.root, path))
        if not full.startswith(os.path.realpath(self.root) + os.sep):
            raise PermissionError(path)
        return open(full, "rb")

    def size(self, path: str) -> int | None:
        """Null where there is no such file."""
        full = os.path.join(self.root, _checked(path))
        return os.path.getsize(full) if os.path.isfile(full) else None

    def stat(self, path: str) -> tuple[int, int | None]:
        """(size, modified in ms), as in a listing."""
        s = os.stat(os.path.join(self.root, _checked(path)))
        return s.st_size, s.st_mtime_ns // 1_000_000

    def write(self, path: str, source: IO[bytes], modified: int | None = None) -> None:
        """A file is written beside its place and moved there: a task that is run again leaves no half file."""
        full = os.path.join(self.root, _checked(path))
        os.makedirs(os.path.dirname(full), exist_ok=True)
        beside = f"{full}.{uuid.uuid4().hex}.part"
        try:
            with open(beside, "wb") as out:
                shutil.copyfileobj(source, out, BLOCK)
            if modified is not None:
                os.utime(beside, (modified / 1000, modified / 1000))
            os.replace(beside, full)
        finally:
            if os.path.exists(beside):
                os.remove(beside)

    def prepare(self) -> None:
        os.makedirs(self.root, exist_ok=True)


class Store:
    """A prefix of an object store, or of any of Arrow's file systems. Times of writing cannot be set; an object appears when it is whole."""

    def __init__(self, fs: pafs.FileSystem, root: str):
        self.fs, self.root = fs, root.rstrip("/")

    def _full(self, path: str) -> str:
        return f"{self.root}/{path}" if path else self.root

    def children(self, folder: str) -> tuple[list[Entry], list[str]]:
        """Objects right below a prefix, in key order, and prefixes below it; placeholders of prefixes are no files."""
        files, folders = [], []
        try:
            found = self.fs.get_file_info(pafs.FileSelector(self._full(folder), allow_not_found=True))
        except OSError:
            return [], []
        for x in sorted(found, key=lambda x: x.path):
            path = x.path[len(self.root) :].lstrip("/")
            if not path or x.path.endswith("/"):
                continue
            if x.type == pafs.FileType.Directory:
                folders.append(path)
            else:
                files.append((path, x.size or 0, x.mtime_ns // 10**9 * 1000 if x.mtime_ns is not None else None, None))
        return files, folders

    def open(self, path: str) -> IO[bytes]:
        return self.fs.open_input_file(self._full(_checked(path)))

    def size(self, path: str) -> int | None:
        found = self.fs.get_file_info(self._full(_checked(path)))
        return found.size if found.type == pafs.FileType.File else None

    def stat(self, path: str) -> tuple[int, int | None]:
        x = self.fs.get_file_info(self._full(_checked(path)))
        return x.size or 0, x.mtime_ns // 10**9 * 1000 if x.mtime_ns is not None else None

    def write(self, path: str, source: IO[bytes], modified: int | None = None) -> None:
        full = self._full(_checked(path))
        if not isinstance(self.fs, pafs.S3FileSystem):
            self.fs.create_dir(full.rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(full) as out:
            shutil.copyfileobj(source, out, BLOCK)

    def prepare(self) -> None:
        pass


class Zip:
    """A zip file. Its index is a run of records of unlike lengths at its end: planning steps over them to find where to cut it, and tasks read their own parts.
    Directories and names that lead out of it are left out. An entry is opened by the place of its record, or else through an index that a process makes once."""

    def __init__(self, path: str):
        self.path = path

    @cached_property
    def zip(self) -> zipfile.ZipFile:
        return zipfile.ZipFile(self.path)

    def _index(self, f: IO[bytes]) -> tuple[int, int, int]:
        """Where the index begins and ends, and how many bytes stand before the first entry that places do not count. The end record is the last thing in the file but for a comment of up to 64 KB; large files have a wider one before it."""
        size = f.seek(0, os.SEEK_END)
        f.seek(max(0, size - 22 - 0xFFFF))
        base, tail = f.tell(), f.read()
        at = tail.rfind(b"PK\5\6")
        if at < 0 or at + 22 > len(tail):
            raise zipfile.BadZipFile(self.path)
        (length, start), end = struct.unpack("<II", tail[at + 12 : at + 20]), base + at
        if tail[max(at - 20, 0) : at].startswith(b"PK\6\7"):
            f.seek(end - 20 - 56)
            wide = f.read(56)
            if wide.startswith(b"PK\6\6"):
                (length, start), end = struct.unpack("<QQ", wide[40:56]), end - 76
        return end - length, end, end - length - start  # not where the record says: bytes may stand before the first entry

    def _records(self, f: IO[bytes], at: int, end: int) -> Iterator[tuple[int, bytes]]:
        """(place, record) of the index from one record on, read in blocks."""
        f.seek(at)
        held, taken = b"", 0
        while at < end:
            while len(held) - taken < 46 + (sum(struct.unpack("<HHH", held[taken + 28 : taken + 34])) if len(held) - taken >= 46 else 0):
                more = f.read(BLOCK)
                if not more:
                    raise zipfile.BadZipFile(self.path)
                held, taken = held[taken:] + more, 0
            length = 46 + sum(struct.unpack("<HHH", held[taken + 28 : taken + 34]))
            yield at, held[taken : taken + length]
            at, taken = at + length, taken + length

    def cuts(self, most: int) -> list[tuple[int, int]]:
        """(first byte, end) of parts of the index with `most` records each, but for the last."""
        with open(self.path, "rb") as f:
            at, end, _ = self._index(f)
            starts = [place for i, (place, _) in enumerate(self._records(f, at, end)) if i % most == 0]
        return list(zip(starts, [*starts, end][1:], strict=True)) or [(end, end)]

    def between(self, at: int, end: int) -> Iterator[Entry]:
        return (entry for _, entry in self.placed(at, end))

    def placed(self, at: int, end: int) -> Iterator[tuple[int, Entry]]:
        """(place of the record, entry) of a part of the index."""
        with open(self.path, "rb") as f:
            for place, r in self._records(f, at, end):
                flags, (size,), (n, extra) = r[9], struct.unpack("<I", r[24:28]), struct.unpack("<HH", r[28:32])
                name, more = r[46 : 46 + n].decode("utf-8" if flags & 8 else "cp437").split("\0")[0], r[46 + n : 46 + n + extra]
                if name and not name.endswith("/") and safe_name(name):
                    yield place, (name, _wide_size(more) if size == 0xFFFFFFFF else size, *zip_times(more))

    def children(self, folder: str) -> tuple[list[Entry], list[str]]:
        """All entries, in their order."""
        return [x for part in self.cuts(1 << 30) for x in self.between(*part)], []

    @cached_property
    def before(self) -> int:
        with open(self.path, "rb") as f:
            return self._index(f)[2]

    def open(self, path: str, at: int | None = None) -> IO[bytes]:
        """at: the place of the entry's record; no more of the index is read then."""
        out = tempfile.SpooledTemporaryFile(max_size=IN_MEMORY)
        with self.zip.open(path) if at is None else self._entry(at) as entry:
            shutil.copyfileobj(entry, out, BLOCK)
        out.seek(0)
        return out

    def _entry(self, at: int) -> IO[bytes]:
        f = open(self.path, "rb")
        f.seek(at)
        r = f.read(46)
        r += f.read(sum(struct.unpack("<HHH", r[28:34])))
        info = zipfile.ZipInfo(r[46 : 46 + struct.unpack("<H", r[28:30])[0]].decode("utf-8" if r[9] & 8 else "cp437"))
        info.flag_bits, info.compress_type = struct.unpack("<HH", r[8:12])
        info.CRC, *small = struct.unpack("<III", r[16:28])
        info.file_size, info.compress_size, head = _wide(r, small[1], small[0], struct.unpack("<I", r[42:46])[0])
        if info.flag_bits & 1:
            raise RuntimeError(f"{info.filename} is encrypted")
        f.seek(self.before + head)
        local = f.read(30)
        if not local.startswith(b"PK\3\4"):
            raise zipfile.BadZipFile(self.path)
        f.seek(sum(struct.unpack("<HH", local[26:30])), os.SEEK_CUR)
        return zipfile.ZipExtFile(f, "r", info, None, True)


def _wide(record: bytes, *values: int) -> list[int]:
    """Sizes and place of an entry's record, those that do not fit into 32 bits from its extra field."""
    n, extra = struct.unpack("<HH", record[28:32])
    found = [x for tag, body in zip_extra(record[46 + n : 46 + n + extra]) if tag == 1 for (x,) in struct.iter_unpack("<Q", body[: len(body) // 8 * 8])]
    return [found.pop(0) if x == 0xFFFFFFFF and found else x for x in values]


def zip_extra(extra: bytes) -> Iterator[tuple[int, bytes]]:
    """(tag, body) of an extra field's parts."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack("<HH", extra[at : at + 4])
        yield tag, extra[at + 4 : at + 4 + size]
        at += 4 + size


def zip_moved(record: bytes, by: int, far: bool) -> bytes:
    """A record of an index, of an entry that stands so many bytes later; far: its place goes into the extra field, as beyond 4 GB it must."""
    n, extra = struct.unpack("<HH", record[28:32])
    size, packed, old = struct.unpack("<I", record[24:28])[0], struct.unpack("<I", record[20:24])[0], struct.unpack("<I", record[42:46])[0]
    *_, head = _wide(record, size, packed, old)
    if not far:
        return record[:42] + struct.pack("<I", head + by) + record[46:]
    parts = list(zip_extra(record[46 + n : 46 + n + extra]))
    sizes = next((body for tag, body in parts if tag == 1), b"")[: 8 * ((size == 0xFFFFFFFF) + (packed == 0xFFFFFFFF))]
    kept = b"".join(struct.pack("<HH", tag, len(body)) + body for tag, body in [(1, sizes + struct.pack("<Q", head + by)), *(x for x in parts if x[0] != 1)])
    return record[:30] + struct.pack("<H", len(kept)) + record[32:42] + b"\xff" * 4 + record[46 : 46 + n] + kept + record[46 + n + extra :]


def zip_end(n: int, start: int, length: int) -> bytes:
    """The end of a zip file of n entries: the wide record and its locator, and the usual one."""
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, length, start)
    return wide + struct.pack("<4sIQI", b"PK\6\7", 0, start + length, 1) + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(length, 0xFFFFFFFF), min(start, 0xFFFFFFFF), 0)


def _wide_size(extra: bytes) -> int:
    """The size of an entry of 4 GB or more."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack("<HH", extra[at : at + 4])
        if tag == 1 and size >= 8:
            return int.from_bytes(extra[at + 4 : at + 12], "little")
        at += 4 + size
    return 0xFFFFFFFF


def zip_times(extra: bytes) -> tuple[int | None, int | None]:
    """(modified, created) in ms from the extended timestamp field; the DOS time has no zone and is not used."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = int.from_bytes(extra[at : at + 2], "little"), int.from_bytes(extra[at + 2 : at + 4], "little")
        body = extra[at + 4 : at + 4 + size]
        if tag == 0x5455 and body:
            out, pos = [None, None, None], 1
            for bit in range(3):
                if body[0] >> bit & 1 and pos + 4 <= len(body):
                    out[bit] = int.from_bytes(body[pos : pos + 4], "little", signed=True) * 1000
                    pos += 4
            return out[0], out[2]
        at += 4 + size
    return None, None


@lru_cache(maxsize=8)
def _s3(bucket: str, endpoint: str | None) -> pafs.S3FileSystem:
    """One client a bucket and process. A custom endpoint is addressed by path, its region is not asked for."""
    if endpoint:
        scheme, _, host = endpoint.rpartition("://")
        return pafs.S3FileSystem(endpoint_override=host, scheme=scheme or "https", force_virtual_addressing=False)
    return pafs.S3FileSystem(region=pafs.resolve_s3_region(bucket))


@lru_cache(maxsize=4)
def _zip(path: str, size: int, modified: int) -> Zip:
    return Zip(path)


def kind_of(uri: str) -> str:
    """s3, store (file:// and other URIs that Arrow knows), dir or zip; what does not exist is an error."""
    if uri.startswith("s3:"):
        S3Uri.parse(uri)
        return "s3"
    if "://" in uri:
        return "store"
    if os.path.isdir(uri):
        return "dir"
    if os.path.isfile(uri):
        return "zip"
    raise FileNotFoundError(uri)


def _store(uri: str, endpoint: str | None) -> Store:
    if uri.startswith("s3:"):
        s3 = S3Uri.parse(uri)
        return Store(_s3(s3.bucket, endpoint), f"{s3.bucket}/{s3.prefix}")
    return Store(*pafs.FileSystem.from_uri(uri))


def open_input(uri: str, endpoint: str | None = None) -> Folder | Store | Zip:
    """The place that a URI or path names; a malformed s3 URI and a missing path are errors."""
    kind = kind_of(uri)
    if kind == "dir":
        return Folder(uri)
    if kind == "zip":
        s = os.stat(uri)
        return _zip(os.path.realpath(uri), s.st_size, s.st_mtime_ns)
    return _store(uri, endpoint)


def open_output(uri: str, endpoint: str | None = None) -> Folder | Store:
    """A directory, made where there is none, or an object store. A file is an error."""
    if "://" in uri or uri.startswith("s3:"):
        return _store(uri, endpoint)
    if os.path.isfile(uri):
        raise NotADirectoryError(uri)
    return Folder(uri)


def walk(place: Folder | Store, folder: str) -> Iterator[Entry]:
    """All files below a directory, hidden ones too."""
    todo = [folder]
    while todo:
        files, folders = place.children(todo.pop())
        yield from files
        todo += reversed(folders)
