"""Coordinates, geohashes, orientation and display transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_32 = "0123456789bcdefghjkmnpqrstuvwxyz"
GEO = "struct<latitude:double,longitude:double>"


def known_point(latitude: Column, longitude: Column) -> Column:
    """The point, or null where a part is missing or both are 0."""
    return F.when((latitude != 0) | (longitude != 0), F.struct(latitude.alias("latitude"), longitude.alias("longitude")))


def iso_6709(text: Column) -> Column:
    """The point of a string such as +27.5-113.5+12/, or null under two numbers; the first may lack its sign."""
    shape = r"\A\s*([+-]?[0-9.]+)([+-][0-9.]+)"
    parts = F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2)
    lat, lon = (p.try_cast("double") for p in parts)
    return known_point(lat, lon)


def best_point(exif: Column, track: Column, geo_exif: Column, geo: Column) -> Column:
    """For the catalog: EXIF, then track, then the sidecar's EXIF point, then its own."""
    return F.coalesce(exif, track, geo_exif, geo)


def note_point(exif: Column, geo: Column, geo_exif: Column) -> Column:
    """For notes: EXIF, then the sidecar's own point, then its EXIF point."""
    return F.coalesce(exif, geo, geo_exif)


def geohash(latitude: Column, longitude: Column, length: int = 12) -> Column:
    """Interleaved bits of longitude and latitude, longitude first, in base 32."""
    scale = 1 << 30
    cell = lambda x, low, span: F.least(F.greatest(F.floor((x - low) / span * scale), F.lit(0)), F.lit(scale - 1)).cast("long")
    lon, lat = cell(longitude, F.lit(-180.0), F.lit(360.0)), cell(latitude, F.lit(-90.0), F.lit(180.0))
    chars = []
    for c in range(length):
        index = F.lit(0).cast("long")
        for j in range(5):
            i = 5 * c + j
            bit = F.shiftright(lat if i % 2 else lon, 29 - i // 2).bitwiseAND(F.lit(1))
            index = index * 2 + bit
        chars.append(F.substring(F.lit(BASE_32), index.cast("int") + 1, F.lit(1)))
    return F.when(latitude.isNotNull() & longitude.isNotNull(), F.concat(*chars))


def orientation(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), F.when(width > height, "landscape").when(width < height, "portrait").otherwise("square"))


def display_mirrored(exif_orientation: Column) -> Column:
    return F.when(exif_orientation.isin(2, 4, 5, 7), 1).otherwise(0)


def display_rotate(exif_orientation: Column) -> Column:
    return F.when(exif_orientation.isin(3, 4), 180).when(exif_orientation.isin(5, 8), -90).when(exif_orientation.isin(6, 7), 90).otherwise(0)


def image_size(tags: Column, side: str) -> Column:
    """Width or Height of the image: the EXIF tag where it is present, whether or not it is a number."""
    return F.coalesce(F.element_at(tags, f"ExifImage{side}"), F.element_at(tags, f"Image{side}")).try_cast("long")
