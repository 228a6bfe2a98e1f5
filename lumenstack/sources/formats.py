"""Media types by content, and metadata from EXIF blocks, QuickTime headers and maker notes.

Readers take bytes from hostile files: they check every bound, never raise, and give
up with None.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from typing import IO

from ..functions.dates import gps_time, rfc_3339

HEAD = 1 << 16
#: Limits of the QuickTime metadata reader.
META_MAX, VALUE_MAX = 1 << 20, 4096
#: Directories of a TIFF file that are read at most; more are hostile.
DIRECTORIES = 16
# ISO base media brands.
BRANDS = {b"heic": "Heic", b"heix": "Heic", b"hevc": "Heic", b"hevx": "Heic", b"heim": "Heic", b"heis": "Heic", b"mif1": "Heic", b"msf1": "Heic", b"avif": "Avif", b"avis": "Avif", b"crx ": "Cr3", b"qt  ": "Mov", b"M4V ": "M4v", b"M4VH": "M4v", b"M4VP": "M4v"}
# EXIF tags by number (hexadecimal), of the main and Exif directories, and of the GPS directory.
TAGS = {int(n, 16): name for n, name in (x.split() for x in """
000b ProcessingSoftware, 0100 ImageWidth, 0101 ImageHeight, 0102 BitsPerSample, 0103 Compression, 0106 PhotometricInterpretation, 010e ImageDescription,
010f Make, 0110 Model, 0111 StripOffsets, 0112 Orientation, 0115 SamplesPerPixel, 0116 RowsPerStrip, 0117 StripByteCounts, 011a XResolution, 011b YResolution,
011c PlanarConfiguration, 0128 ResolutionUnit, 012d TransferFunction, 0131 Software, 0132 ModifyDate, 013b Artist, 013c HostComputer, 013e WhitePoint,
013f PrimaryChromaticities, 0201 ThumbnailOffset, 0202 ThumbnailLength, 0211 YCbCrCoefficients, 0212 YCbCrSubSampling, 0213 YCbCrPositioning, 0214 ReferenceBlackWhite,
8298 Copyright, 829a ExposureTime, 829d FNumber, 8769 ExifOffset, 8822 ExposureProgram, 8824 SpectralSensitivity, 8825 GPSInfo, 8827 ISOSpeedRatings, 8830 SensitivityType,
8831 StandardOutputSensitivity, 8832 RecommendedExposureIndex, 8833 ISOSpeed, 9003 DateTimeOriginal, 9004 CreateDate, 9010 OffsetTime, 9011 OffsetTimeOriginal,
9012 OffsetTimeDigitized, 9102 CompressedBitsPerPixel, 9201 ShutterSpeedValue, 9202 ApertureValue, 9203 BrightnessValue, 9204 ExposureBiasValue, 9205 MaxApertureValue,
9206 SubjectDistance, 9207 MeteringMode, 9208 LightSource, 9209 Flash, 920a FocalLength, 9214 SubjectArea, 9290 SubSecTime, 9291 SubSecTimeOriginal, 9292 SubSecTimeDigitized,
9400 AmbientTemperature, 9401 Humidity, 9402 Pressure, a001 ColorSpace, a002 ExifImageWidth, a003 ExifImageHeight, a004 RelatedSoundFile, a005 InteropOffset, a20b FlashEnergy,
a20e FocalPlaneXResolution, a20f FocalPlaneYResolution, a210 FocalPlaneResolutionUnit, a214 SubjectLocation, a215 ExposureIndex, a217 SensingMethod, a401 CustomRendered,
a402 ExposureMode, a403 WhiteBalanceMode, a404 DigitalZoomRatio, a405 FocalLengthIn35mmFilm, a406 SceneCaptureType, a407 GainControl, a408 Contrast, a409 Saturation,
a40a Sharpness, a40c SubjectDistanceRange, a420 ImageUniqueID, a430 CameraOwnerName, a431 BodySerialNumber, a432 LensSpecification, a433 LensMake, a434 LensModel,
a435 LensSerialNumber, a460 CompositeImage, a500 Gamma""".replace("\n", " ").split(","))}
GPS_TAGS = dict(enumerate("GPSVersionID GPSLatitudeRef GPSLatitude GPSLongitudeRef GPSLongitude GPSAltitudeRef GPSAltitude GPSTimeStamp GPSSatellites GPSStatus GPSMeasureMode GPSDOP GPSSpeedRef GPSSpeed GPSTrackRef GPSTrack GPSImgDirectionRef GPSImgDirection GPSMapDatum GPSDestLatitudeRef GPSDestLatitude GPSDestLongitudeRef GPSDestLongitude GPSDestBearingRef GPSDestBearing GPSDestDistanceRef GPSDestDistance GPSProcessingMethod GPSAreaInformation GPSDateStamp GPSDifferential GPSHPositioningError".split()))
# QuickTime metadata keys and user data atoms, and what they are called here.
TRACK_KEYS = {b"com.apple.quicktime.content.identifier": "content_identifier", b"com.apple.quicktime.make": "make", b"com.apple.quicktime.model": "model", b"com.apple.quicktime.software": "software", b"com.apple.quicktime.author": "author", b"com.apple.quicktime.location.ISO6709": "gps_iso_6709", b"com.apple.quicktime.creationdate": "creation_time"}
USER_DATA = {b"\xa9mak": "make", b"\xa9mod": "model", b"\xa9swr": "software", b"\xa9aut": "author", b"\xa9xyz": "gps_iso_6709"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


class View:
    """A part of a seekable file, read slice by slice as bytes are."""

    def __init__(self, f: IO[bytes], start: int, end: int):
        self.f, self.start, self.end = f, start, max(start, end)

    def __len__(self) -> int:
        return self.end - self.start

    def __getitem__(self, part: slice) -> bytes:
        a, b, _ = part.indices(len(self))
        self.f.seek(self.start + a)
        return self.f.read(max(0, b - a))

    def part(self, a: int, b: int) -> View:
        return View(self.f, min(self.start + a, self.end), min(self.start + b, self.end))


def sniff(head: bytes, name: str = "", data: View | None = None) -> str:
    """The accurate file type of a file's first bytes; .json goes by name, the maker of a TIFF by the whole file if given."""
    if name.lower().endswith(".json"):
        return "Json"
    if head[4:8] == b"pnot":
        return "Mov"
    if head.startswith(b"\xff\xd8\xff"):
        return "Jpg"
    if head.startswith(b"\x89PNG\r\n\x1a\n"):
        return "Png"
    if head[:6] in (b"GIF87a", b"GIF89a"):
        return "Gif"
    if head[:4] == b"RIFF":
        return {b"WEBP": "Webp", b"AVI ": "Avi"}.get(head[8:12], "Unsupported")
    if head[:2] == b"BM" and len(head) > 14:
        return "Bmp"
    if head.startswith(b"FUJIFILMCCD-RAW"):
        return "Raf"
    if head[:4] in (b"IIRO", b"IIRS", b"MMOR"):
        return "Orf"
    if head[:4] == b"IIU\0":
        return "Rw2"
    if head[:4] in (b"II*\0", b"MM\0*"):
        if head[8:10] == b"CR":
            return "Cr2"
        maker = (read_tiff(head if data is None else data) or {}).get("Make", "").upper()
        return "Nef" if maker.startswith("NIKON") and name.lower().endswith(".nef") else "Arw" if maker.startswith("SONY") else "Tif"
    if head[4:8] == b"ftyp":
        brand = head[8:12]
        return BRANDS.get(brand) or ("ThreeGpp" if brand[:2] == b"3g" else "Unsupported" if brand[:3] == b"M4A" else "Mp4")
    if head[4:8] in (b"moov", b"mdat", b"free", b"skip", b"wide"):
        return "Mov"
    if head.startswith(b"\x1aE\xdf\xa3"):
        return "Webm" if b"webm" in head[:64] else "Mkv" if b"V_" in head else "Unsupported"
    if head[:4] in (b"\0\0\x01\xba", b"\0\0\x01\xb3"):
        return "Mpg"
    if head.startswith(b"\x30\x26\xb2\x75\x8e\x66\xcf\x11"):  # video stream header GUID
        return "Wmv" if b"\xc0\xef\x19\xbc\x4d\x5b\xcf\x11" in head else "Unsupported"
    if head[:1] == b"\x47" and head[188:189] == b"\x47" or head[4:5] == b"\x47" and head[196:197] == b"\x47":
        return "Mts"
    return "Csv" if name.lower().endswith(".csv") and head[:512].isascii() and b"," in head[:512] else "Unsupported"


def _entries(data: bytes | View, base: int, offset: int, order: str) -> Iterator[tuple[int, int, int, bytes]]:
    """(tag, kind, count, value bytes) of one directory; offsets count from base."""
    at = base + offset
    if not 0 <= at <= len(data) - 2:
        return
    # What follows the entries is the next directory's place: the entries' own count is all that is needed here.
    (n,) = struct.unpack(order + "H", data[at : at + 2])
    table = data[at + 2 : at + 2 + 12 * n]
    for i in range(len(table) // 12):
        tag, kind, count = struct.unpack_from(order + "HHI", table, 12 * i)
        size = SIZES.get(kind, 0) * count
        if not 0 < size <= META_MAX:
            continue
        where = at + 10 + 12 * i if size <= 4 else base + struct.unpack_from(order + "I", table, 12 * i + 8)[0]
        if where + size <= len(data):
            yield tag, kind, count, data[where : where + size]


def _numbers(kind: int, count: int, raw: bytes, order: str) -> list[float]:
    if kind in (5, 10):
        v = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * count, raw)
        return [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True)]
    code = {1: "B", 3: "H", 4: "I", 9: "i"}.get(kind)
    return list(struct.unpack(order + code * count, raw)) if code else []


def _text(kind: int, count: int, raw: bytes, order: str) -> str:
    """A value as text: whole numbers as they are, fractions with up to ten digits."""
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace")
    return " ".join(f"{x:.10g}" if isinstance(x, float) else str(x) for x in _numbers(kind, count, raw, order))


def _degrees(values: list[float], ref: str | None) -> float | None:
    if len(values) < 3:
        return None
    d = values[0] + values[1] / 60 + values[2] / 3600
    return -d if ref in ("S", "W") else d


def maker_note_identifier(note: bytes) -> str | None:
    """The content identifier of an Apple maker note: ASCII tag 17 of its directory."""
    if not note.startswith(b"Apple iOS\0"):
        return None
    order = {b"MM": ">", b"II": "<"}.get(note[12:14])
    for tag, kind, _, raw in _entries(note, 0, 14, order) if order else ():
        if tag == 0x11 and kind == 2 and len(raw) <= 128:
            return raw.rstrip(b"\0").decode("ascii", "replace") or None
    return None


def read_tiff(data: bytes | View, gps_first: bool = False) -> dict | None:
    """Tags by name, with latitude, longitude and content_identifier where known; undefined and long values are dropped. gps_first: its first directory holds the place."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        return None
    out: dict = {}
    todo, seen = [(struct.unpack(order + "I", data[4:8])[0], "gps" if gps_first else "main")], set()
    while todo:
        offset, role = todo.pop()
        if offset in seen or len(seen) == DIRECTORIES:
            continue
        seen.add(offset)
        place: dict[int, tuple[int, int, bytes]] = {}
        if role == "main" and (follows := _following(data, offset, order)):
            todo.append((follows, "thumbnail"))
        for tag, kind, count, raw in _entries(data, 0, offset, order):
            if role == "gps":
                place[tag] = kind, count, raw
            elif tag == 0x927C:
                out["content_identifier"] = maker_note_identifier(raw)
                continue
            elif tag in (0x8769, 0x8825) and kind == 4 and role != "thumbnail":
                todo.append((struct.unpack(order + "I", raw[:4])[0], "gps" if tag == 0x8825 else "exif"))
            name = (GPS_TAGS if role == "gps" else TAGS).get(tag)
            if name and kind != 7 and len(raw) <= 1024:
                out.setdefault(name, _text(kind, count, raw, order))
        if place:
            text = lambda t: place[t][2].rstrip(b"\0 ").decode("ascii", "replace") if t in place and place[t][0] == 2 else None  # noqa: E731, B023
            nums = lambda t: _numbers(*place[t], order) if t in place else []  # noqa: E731, B023
            out["latitude"], out["longitude"] = _degrees(nums(2), text(1)), _degrees(nums(4), text(3))
            if len(nums(7)) == 3 and (clock := gps_time(*nums(7))):
                out["GPSTimeStamp"] = clock
    return out


def _following(data: bytes | View, offset: int, order: str) -> int:
    """The place of the directory after this one, 0 without one."""
    head = data[offset : offset + 2]
    at = offset + 2 + 12 * struct.unpack(order + "H", head)[0] if len(head) == 2 else len(data)
    raw = data[at : at + 4]
    return struct.unpack(order + "I", raw)[0] if len(raw) == 4 else 0


def exif_block(data: bytes | View) -> View | None:
    """The TIFF block within a JPEG, PNG, RAF or HEIF file, or the data itself if it is TIFF."""
    if not isinstance(data, View):
        data = View(io.BytesIO(data), 0, len(data))
    head = data[:HEAD]
    if head[:2] in (b"II", b"MM"):
        return data
    if head.startswith(b"\xff\xd8"):
        at = 2
        while at + 4 <= len(data):
            mark = data[at : at + 10]
            if mark[0] != 0xFF or mark[1] in (0xDA, 0xD9):
                return None
            size = int.from_bytes(mark[2:4], "big")
            if mark[1] == 0xE1 and mark[4:10] == b"Exif\0\0":
                return data.part(at + 10, at + 2 + size)
            at += 2 + max(size, 2)
        return None
    if head.startswith(b"\x89PNG"):
        at = 8
        while at + 8 <= len(data):
            mark = data[at : at + 8]
            size = int.from_bytes(mark[:4], "big")
            if mark[4:] == b"eXIf":
                return data.part(at + 8, at + 8 + size)
            at += 12 + size
        return None
    if head.startswith(b"FUJIFILMCCD-RAW") and len(head) >= 92:
        at, size = struct.unpack_from(">II", head, 84)
        inner = data.part(at, at + size)
        if inner[:2] == b"\xff\xd8" and (block := exif_block(inner)):
            return block
    if head[4:8] == b"ftyp" and (block := _heif_item(data)):
        return block
    at = head.find(b"Exif\0\0")
    return data.part(at + 6, len(data)) if at >= 0 else None


def _heif_item(data: View) -> View | None:
    """The TIFF block of a HEIF file's Exif item: its number from iinf, its place from iloc."""
    meta = _inside(data.f, data.start, data.end, b"meta")
    if not meta:
        return None
    iinf, iloc, idat = (_inside(data.f, meta[0] + 4, meta[1], k) for k in (b"iinf", b"iloc", b"idat"))
    if not iinf or not iloc:
        return None
    wide, wanted = _read(data.f, *iinf, 1) != b"\0", None
    for kind, a, b in _atoms(data.f, iinf[0] + (8 if wide else 6), iinf[1]):
        raw = _read(data.f, a, b, 16)
        at = 4 + (4 if raw[:1] == b"\3" else 2)
        if kind == b"infe" and raw[:1] in (b"\2", b"\3") and raw[at + 2 : at + 6] == b"Exif":
            wanted = int.from_bytes(raw[4:at], "big")
            break
    raw = _read(data.f, *iloc, META_MAX)
    if wanted is None or len(raw) < 8:
        return None
    version, at = raw[0], 6

    def number(n: int) -> int:
        nonlocal at
        at += n
        return int.from_bytes(raw[at - n : at], "big")

    offset_size, length_size, base_size, index_size = raw[4] >> 4, raw[4] & 15, raw[5] >> 4, raw[5] & 15 if version else 0
    for _ in range(number(4 if version == 2 else 2)):
        item, method = number(4 if version == 2 else 2), number(2) & 15 if version else 0
        number(2)
        base, extents = number(base_size), number(2)
        if at > len(raw):
            return None
        if item != wanted:
            at += extents * (index_size + offset_size + length_size)
            continue
        number(index_size)
        start, size = base + number(offset_size), number(length_size)
        if method > 1 or extents != 1 or method == 1 and not idat:
            return None
        start += idat[0] - data.start if method == 1 else 0
        whole = data.part(start, start + size if size else len(data))
        skip = int.from_bytes(whole[:4], "big")
        return whole.part(4 + skip, len(whole))
    return None


CANON = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")


def read_exif(data: View) -> dict | None:
    """The tags of a photo's file. CR3 files hold a TIFF block for each directory, in boxes of their own."""
    if data[4:12] != b"ftypcrx ":
        block = exif_block(data)
        return read_tiff(block) if block else None
    out: dict = {}
    moov = _inside(data.f, data.start, data.end, b"moov")
    for kind, a, b in _atoms(data.f, *moov) if moov else ():
        if kind == b"uuid" and _read(data.f, a, b, 16) == CANON:
            for name, c, d in _atoms(data.f, a + 16, b):
                if name in (b"CMT1", b"CMT2", b"CMT4"):
                    out = (read_tiff(View(data.f, c, d), name == b"CMT4") or {}) | out
    return out or ((block := exif_block(data)) and read_tiff(block)) or None


def _atoms(f: IO[bytes], at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of the atoms between two places; sizes of 64 bits and "to the end" are allowed."""
    while at + 8 <= end:
        f.seek(at)
        head = f.read(16)
        if len(head) < 8:
            return
        size, skip = int.from_bytes(head[:4], "big"), 8
        if size == 1 and len(head) == 16:
            size, skip = int.from_bytes(head[8:16], "big"), 16
        elif size == 0:
            size = end - at
        if size < skip or at + size > end:
            return
        yield head[4:8], at + skip, at + size
        at += size


def _inside(f: IO[bytes], at: int, end: int, *kinds: bytes) -> tuple[int, int] | None:
    for kind in kinds:
        found = next(((a, b) for k, a, b in _atoms(f, at, end) if k == kind), None)
        if found is None:
            return None
        at, end = found
    return at, end


def _read(f: IO[bytes], at: int, end: int, most: int) -> bytes:
    f.seek(at)
    return f.read(min(end - at, most))


def quicktime_values(f: IO[bytes], size: int) -> dict[str, str]:
    """Known values of moov/meta: a key's place among the keys names its entry in the list. Then user data of moov, where keys lack it."""
    moov = _inside(f, 0, size, b"moov")
    out: dict[str, str] = {}
    meta = moov and (_inside(f, *moov, b"meta"))
    for skip in (0, 4) if meta and meta[1] - meta[0] <= META_MAX else ():  # with or without a version and flags
        keys, values = _inside(f, meta[0] + skip, meta[1], b"keys"), _inside(f, meta[0] + skip, meta[1], b"ilst")
        if keys and values:
            out = _keyed_values(f, keys, values)
            break
    udta = moov and _inside(f, *moov, b"udta")
    for kind, a, b in _atoms(f, *udta) if udta else ():
        if kind in USER_DATA and b - a <= VALUE_MAX:
            raw = _read(f, a, b, VALUE_MAX)
            out.setdefault(USER_DATA[kind], raw[4 : 4 + int.from_bytes(raw[:2], "big")].decode("utf-8", "replace").strip("\0 "))
    return {k: v for k, v in out.items() if v}


def _keyed_values(f: IO[bytes], keys: tuple[int, int], values: tuple[int, int]) -> dict[str, str]:
    raw, at, wanted, out = _read(f, *keys, META_MAX), 8, {}, {}
    for i in range(1, int.from_bytes(raw[4:8], "big") + 1):
        n = int.from_bytes(raw[at : at + 4], "big")
        if n < 8 or at + n > len(raw):
            break
        if raw[at + 8 : at + n] in TRACK_KEYS:
            wanted.setdefault(i, TRACK_KEYS[raw[at + 8 : at + n]])
        at += n
    for kind, a, b in _atoms(f, *values) if wanted else ():
        name = wanted.get(int.from_bytes(kind, "big"))
        if name and (data := _inside(f, a, b, b"data")) and data[1] - data[0] <= VALUE_MAX:
            out.setdefault(name, _read(f, data[0] + 8, data[1], VALUE_MAX).decode("utf-8", "replace").strip("\0 "))
    return out


def read_track(f: IO[bytes], size: int) -> dict | None:
    """Of a movie: width, height, creation_time, duration_ms, make, model, software, author, gps_iso_6709 and content_identifier, where known."""
    if _read(f, 0, size, 4) == b"\x1aE\xdf\xa3":
        return read_matroska(f, size)
    moov = _inside(f, 0, size, b"moov")
    head = moov and _inside(f, *moov, b"mvhd")
    if not head:
        return None
    raw = _read(f, *head, 64)
    wide = raw[:1] == b"\1"
    need = 32 if wide else 20
    if len(raw) < need:
        return None
    created, scale, length = struct.unpack_from(">QxxxxxxxxIQ" if wide else ">IxxxxII", raw, 4)
    out: dict = {"duration_ms": length * 1000 // scale if scale else None, "creation_time": _since(1904, created)} | quicktime_values(f, size)
    for kind, a, b in _atoms(f, *moov):
        if kind == b"trak" and (tkhd := _inside(f, a, b, b"tkhd")):
            end = _read(f, tkhd[1] - 8, tkhd[1], 8)
            w, h = (int.from_bytes(end[i : i + 4], "big") >> 16 for i in (0, 4))
            if w and h:
                out["width"], out["height"] = w, h
                break
    return out


def _since(year: int, seconds: float) -> str | None:
    try:
        return rfc_3339(datetime(year, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds))
    except OverflowError:
        return None


def _elements(f: IO[bytes], at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(number, body start, body end) of the elements between two places; one of unknown size goes to the end."""
    while at < end:
        head = _read(f, at, end, 12)
        n = 9 - head[0].bit_length() if head and head[0] else 9
        if n > 4 or len(head) <= n or not head[n]:
            return
        m = 9 - head[n].bit_length()
        if len(head) < n + m:
            return
        size = int.from_bytes(head[n : n + m], "big") & (1 << 7 * m) - 1
        start = at + n + m
        stop = end if size == (1 << 7 * m) - 1 else start + size
        if stop > end:
            return
        yield int.from_bytes(head[:n], "big"), start, stop
        at = stop


# Numbers of Matroska elements.
SEGMENT, INFO, SCALE, DURATION, DATE, TRACKS, ENTRY, VIDEO, WIDTH, HEIGHT, CLUSTER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4461, 0x1654AE6B, 0xAE, 0xE0, 0xB0, 0xBA, 0x1F43B675


def read_matroska(f: IO[bytes], size: int) -> dict | None:
    """width, height, duration_ms and creation_time of a Matroska or WebM file, from what comes before its frames."""
    segment = next(((a, b) for n, a, b in _elements(f, 0, size) if n == SEGMENT), None)
    out: dict = {}
    for number, a, b in _elements(f, *segment) if segment else ():
        if number == CLUSTER:
            break
        if number == INFO:
            values = {n: _read(f, c, d, 8) for n, c, d in _elements(f, a, b) if d - c <= 8}
            ticks = values.get(DURATION, b"")
            if len(ticks) in (4, 8):
                length = struct.unpack(">f" if len(ticks) == 4 else ">d", ticks)[0] * int.from_bytes(values.get(SCALE, b"\x0f\x42\x40"), "big") / 1e6
                out["duration_ms"] = int(length) if 0 <= length < 1e15 else None
            if len(values.get(DATE, b"")) == 8:
                out["creation_time"] = _since(2001, int.from_bytes(values[DATE], "big", signed=True) // 10**9)
        for n, c, d in _elements(f, a, b) if number == TRACKS else ():
            for m, e, g in _elements(f, c, d) if n == ENTRY and "width" not in out else ():
                sides = {x: int.from_bytes(_read(f, y, z, 8), "big") for x, y, z in _elements(f, e, g) if x in (WIDTH, HEIGHT) and z - y <= 8} if m == VIDEO else {}
                if sides.get(WIDTH) and sides.get(HEIGHT):
                    out["width"], out["height"] = sides[WIDTH], sides[HEIGHT]
    return out or None
