"""Small media files made of given values, as carriers for the readers of bytes."""

from __future__ import annotations

import struct
from collections.abc import Mapping


def exif_jpeg(main: Mapping[int, str], gps: Mapping[int, str | tuple[int, int, int]] | None = None) -> bytes:
    """A JPEG whose EXIF directories hold text tags, and in the GPS directory triples of whole numbers too."""
    main_size = 2 + 12 * (len(main) + bool(gps)) + 4
    gps_at = 8 + main_size
    data_at = gps_at + (2 + 12 * len(gps) + 4 if gps else 0)
    data = b""

    def entry(tag: int, value: str | tuple[int, int, int] | int) -> bytes:
        nonlocal data
        if isinstance(value, int):
            return struct.pack("<HHII", tag, 4, 1, value)
        if isinstance(value, tuple):
            kind, count, raw = 5, len(value), b"".join(struct.pack("<II", x, 1) for x in value)
        else:
            raw = value.encode() + b"\0"
            kind, count = 2, len(raw)
        if len(raw) <= 4:
            return struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
        out = struct.pack("<HHII", tag, kind, count, data_at + len(data))
        data += raw
        return out

    def directory(entries: Mapping[int, str | tuple[int, int, int] | int]) -> bytes:
        return struct.pack("<H", len(entries)) + b"".join(entry(t, v) for t, v in sorted(entries.items())) + bytes(4)

    first = directory({**main, **({0x8825: gps_at} if gps else {})})
    tiff = b"II*\0" + struct.pack("<I", 8) + first + (directory(gps) if gps else b"") + data
    app = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xd9"


def _atom(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", 8 + len(body)) + kind + body


def movie(created: int, millis: int, width: int, height: int, keys: Mapping[str, str]) -> bytes:
    """A QuickTime movie's header, created seconds after 1970, with metadata keys."""
    mvhd = _atom(b"mvhd", bytes(4) + struct.pack(">IIII", created + 2082844800, 0, 1000, millis) + bytes(80))
    tkhd = _atom(b"tkhd", bytes(76) + struct.pack(">II", width << 16, height << 16))
    names = _atom(b"keys", bytes(4) + struct.pack(">I", len(keys)) + b"".join(struct.pack(">I", 8 + len(k)) + b"mdta" + k.encode() for k in keys))
    values = _atom(b"ilst", b"".join(_atom(struct.pack(">I", i + 1), _atom(b"data", bytes(8) + v.encode())) for i, v in enumerate(keys.values())))
    return _atom(b"ftyp", b"qt  " + bytes(4)) + _atom(b"moov", mvhd + _atom(b"trak", tkhd) + _atom(b"meta", names + values))
