"""File types by name, their kinds, extensions and metadata."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, type names and content types.
PHOTO_EXTENSIONS = "jpg jpeg jfif jpe png gif webp heic heif avif tif tiff bmp cr2 cr3 nef arw orf raf rw2".split()
VIDEO_EXTENSIONS = "mp4 m4v mov avi mpg mpeg wmv asf mts m2ts 3gp 3g2 mkv webm".split()
PHOTO_TYPES = "Jpg Png Heic Gif Webp Avif Tif Bmp Cr2 Cr3 Nef Arw Orf Raf Rw2".split()
VIDEO_TYPES = "Mp4 Mov M4v Avi Mpg Wmv Mts ThreeGpp Mkv Webm".split()
TYPE_EXTENSIONS = {t: t.lower() for t in PHOTO_TYPES + VIDEO_TYPES + ["Json", "Csv"]} | {"ThreeGpp": "3gp", "Unsupported": "bin"}
CONTENT_TYPES = {
    "image/jpeg": "Jpg", "image/gif": "Gif", "image/png": "Png", "image/heic": "Heic", "image/heif": "Heic",
    "image/heic-sequence": "Heic", "image/heif-sequence": "Heic", "image/webp": "Webp", "image/avif": "Avif",
    "image/avif-sequence": "Avif", "image/tiff": "Tif", "image/bmp": "Bmp", "image/x-canon-cr2": "Cr2",
    "image/x-canon-cr3": "Cr3", "image/x-nikon-nef": "Nef", "image/x-sony-arw": "Arw", "image/x-olympus-orf": "Orf",
    "image/x-fuji-raf": "Raf", "image/x-panasonic-rw2": "Rw2", "video/mp4": "Mp4", "application/mp4": "Mp4",
    "video/quicktime": "Mov", "video/x-m4v": "M4v", "video/x-msvideo": "Avi", "video/mpeg": "Mpg",
    "video/x-ms-wmv": "Wmv", "video/mp2t": "Mts", "video/3gpp": "ThreeGpp", "video/3gpp2": "ThreeGpp",
    "video/matroska": "Mkv", "video/webm": "Webm", "text/csv": "Csv",
}
#: Photos whose metadata is EXIF, and videos whose header holds track metadata; the rest has none.
EXIF_TYPES = sorted(set(PHOTO_TYPES) - {"Bmp", "Webp"})
TRACK_TYPES = "Mp4 Mov M4v ThreeGpp Mkv Webm".split()


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(d.items())))


def quick_file_type(path: Column) -> Column:
    """Media, AlbumCsv, AlbumJson or Unknown, from the name alone. A leading dot begins no extension."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)\z", 1))
    ext = F.regexp_extract(name, r"(?s)\A.+\.([^.]*)\z", 1)
    return (
        F.when(name == "metadata.json", "AlbumJson")
        .when(ext.isin(PHOTO_EXTENSIONS + VIDEO_EXTENSIONS), "Media")
        .when(ext == "csv", "AlbumCsv")
        .otherwise("Unknown")
    )


def media_kind(accurate: Column) -> Column:
    """p for photos, v for videos, else null."""
    return F.when(accurate.isin(PHOTO_TYPES), "p").when(accurate.isin(VIDEO_TYPES), "v")


def type_extension(accurate: Column) -> Column:
    return F.element_at(_map(TYPE_EXTENSIONS), accurate)


def type_of_content_type(content_type: Column) -> Column:
    return F.coalesce(F.element_at(_map(CONTENT_TYPES), content_type), F.lit("Unsupported"))


def metadata_type(accurate: Column) -> Column:
    return F.when(accurate.isin(EXIF_TYPES), "ExifTags").when(accurate.isin(TRACK_TYPES), "Track").otherwise("NoMetadata")
