"""String normalisation and lists in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(c: Column) -> Column:
    """Trimmed, lower case, hyphens and underscores as spaces."""
    return F.translate(F.lower(F.trim(c)), "-_", "  ")


def letters_only(c: Column) -> Column:
    """Lower-case letters a-z alone, as a join key for names."""
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def title(name: str) -> str:
    return " ".join(x.capitalize() for x in name.split(" "))


def json_array(c: Column, element: str = "bigint") -> Column:
    """A JSON list as an array; null where it is none."""
    return F.from_json(c, f"array<{element}>")


def json_map(c: Column, value: str = "double") -> Column:
    return F.from_json(c, f"map<string,{value}>")


def zone_of(name: Column) -> Column:
    """The first p<digits> of a name, else its first s<digits>."""
    part = lambda letter: F.nullif(F.regexp_extract(name, rf"{letter}\d+", 0), F.lit(""))
    return F.coalesce(part("p"), part("s"))


def class_of(category: Column) -> Column:
    """The number after the last underscore."""
    return F.try_element_at(F.split(category, "_"), F.lit(-1)).try_cast("int")
