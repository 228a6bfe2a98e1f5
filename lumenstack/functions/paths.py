"""Slash-separated paths, desired output paths and link names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for the name of a path that has none.
BROKEN = "@@broken"
#: Unicode White_Space, as a class of regular expressions.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def dir_part(path: Column) -> Column:
    """The parent, without a slash at its end; empty at the root."""
    return F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)


def name_part(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]+)/*\z", 1)
    return F.when((name == "") | name.isin(".."), BROKEN).otherwise(name)


def strip_extension(path: Column) -> Column:
    """Without what follows the last dot of the last component."""
    return F.regexp_replace(path, r"\.[^./]*\z", "")


def desired_media_path(guessed: Column, short_hash: Column) -> Column:
    """Y/MM/DD/HHMM-SSmmm on the reading's own wall clock, without extension; without a reading, by checksum."""
    shape = r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:[+-]\d\d:\d\d|Z)\z"
    millis = F.rpad(F.substring(F.regexp_extract(guessed, r"\.(\d+)", 1), 1, 3), 3, "0")
    at = lambda start, n: F.substring(guessed, start, n)
    dated = F.concat(at(1, 4), F.lit("/"), at(6, 2), F.lit("/"), at(9, 2), F.lit("/"), at(12, 2), at(15, 2), F.lit("-"), at(18, 2), millis)
    return F.when(guessed.rlike(shape), dated).otherwise(F.concat(F.lit("undated/"), short_hash))


def album_link_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\Aalbums/", ""), r"\.md\z", "")


def wikilink(name: Column) -> Column:
    return F.concat(F.lit("[["), name, F.lit("]]"))


def people_links(names: Column) -> Column:
    """Links for an array of names, trimmed, blanks dropped."""
    ends = rf"(?U)\A{SPACE}+|{SPACE}+\z"
    return F.transform(F.filter(F.transform(names, lambda x: F.regexp_replace(x, ends, "")), lambda x: x != ""), wikilink)


def markdown_path(media_path: Column) -> Column:
    return F.when(media_path != "", F.concat(strip_extension(media_path), F.lit(".md")))


def table_cell(text: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")


def code(text: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(text, F.lit("`"), F.lit("'")), F.lit("`"))
