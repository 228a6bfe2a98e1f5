"""Known export files and directories, by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in order of priority. A dot that is not escaped, and an end that is
# not anchored, are part of what they match.
EXT = "(?:heic|heif|avif|jpg|jpeg|jfif|jpe|png|gif|webp|tif|tiff|bmp|cr2|cr3|nef|arw|orf|raf|rw2|mov|mp4|m4v|avi|mpg|mpeg|wmv|asf|mts|m2ts|3gp|3g2|mkv|webm)"
GUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
FILE_PATTERNS: list[tuple[str, str]] = [
    ("Photo", rf"^img_([\d_]+)\.{EXT}$"),
    ("Photo", rf"^([\d_]+)\.{EXT}$"),
    ("Photo", rf"^img_([\d_]+)-edited\.{EXT}$"),
    ("Photo", rf"^image_([\d_]+)\.{EXT}$"),
    ("Photo", rf"^mvi_([\d_]+)\.{EXT}$"),
    ("Photo", rf"^mvi_([\d_]+)-edited\.{EXT}$"),
    ("PhotoWithGuid", rf"^({GUID})\.{EXT}$"),
    ("PhotoWithGuid", rf"^([0-9]{{11}}__[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{9}})\.{EXT}$"),
    ("PhotoWithGuid", rf"^image_({GUID})\.{EXT}$"),
    ("GpMetadataJson", rf"^image_({GUID})\.{EXT}\.json$"),
    ("GpMetadataJson", rf"^(.+)\.{EXT}\.suppl\.json$"),
    ("GpMetadataJson", rf"^(.+)\.{EXT}\.supplemental-meta\.json$"),
    ("GpMetadataJson", rf"^(.+)\.{EXT}\.supplemental-metadata\([0-9]+\)\.json$"),
    ("GpMetadataJson", rf"^(.+)\.{EXT}\.supplemental-metadata.json$"),
    ("GpPicasaSyncMetadataJson", r"^picasasync\.supplemental-metadata\([0-9]+\).json$"),
    ("GpSharedAlbumComments", r"^shared_album_comments.json$"),
    ("GpArchiveBrowser", r"^archive_browser.html$"),
    ("GpUserGeneratedMemoryTitles", r"^user-generated-memory-titles.json$"),
    ("GpAnimation", r"^([\d_]+)-animation.gif$"),
    ("GpAnimation", r"^img_([\d_]+)-animation.gif$"),
    ("GpCollage", r"^([\d_]+)-collage.jpg$"),
    ("GpPrintSubscription", r"^print-subscriptions.json$"),
    ("GpAlbumJson", r"^metadata.json$"),
    ("IcpAlbumCsv", r"^(.+)\.csv$"),
    ("IcpSharedAlbumsZip", r"^icloud shared albums.zip$"),
    ("Ignored", r"^\.ds_store$"),
    ("Ignored", r"^.+\.thm$"),
]
DIR_PATTERNS: list[tuple[str, str]] = [
    ("GpPhotosFromYear", r"^google photos/photos from (\d{4})$"),
    ("IcpPhotos", r"^photos$"),
    ("IcpAlbums", r"^albums$"),
    ("IcpMemories", r"^memories$"),
    ("GpArchive", r"^archive"),
    ("GpBin", r"^bin"),
    ("IcpMemories", r"^memories/(.+)$"),
    ("IcpRecentlyDeleted", r"^recently deleted"),
]
#: Types that carry what their pattern captured.
VALUED = {"Photo", "PhotoWithGuid", "GpMetadataJson", "GpPicasaSyncMetadataJson", "GpAnimation", "GpCollage", "IcpAlbumCsv", "GpPhotosFromYear"}


def _java(pattern: str) -> str:
    """Digits of any script, only a line feed ends a line, and the end is the end."""
    return "(?Ud)" + (pattern[:-1] + r"\z" if pattern.endswith("$") else pattern)


def _classified(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """type and captured value of the first pattern that matches, as one chain: patterns are tried in order, once."""
    low = F.lower(text)

    def found(name: str, pattern: str) -> Column:
        captures = name in VALUED and "(" in pattern.replace("(?:", "") and not pattern.startswith("^picasasync")
        value = F.regexp_extract(low, _java(pattern), 1) if captures else F.lit("" if name in VALUED else None).cast("string")
        return F.struct(F.lit(name).alias("type"), value.alias("value"))

    return reduce(lambda c, p: c.when(low.rlike(_java(p[1])), found(*p)), patterns[1:], F.when(low.rlike(_java(patterns[0][1])), found(*patterns[0])))


def classify_file(name: Column) -> Column:
    """type and captured value of a file name, in a struct; null where nothing matches."""
    return _classified(name, FILE_PATTERNS)


def classify_dir(path: Column) -> Column:
    """type and captured value of a whole directory path, in a struct; null where nothing matches."""
    return _classified(path, DIR_PATTERNS)
