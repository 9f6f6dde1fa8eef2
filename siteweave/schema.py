"""Soft schema checks: required columns, aliases and coordinate detection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The table itself; an error names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def rename_absent(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Renames old to new unless new is there already; of repeated names the first column stays."""
    seen, picked = set(), []
    for c in df.columns:
        new = names[c] if c in names and names[c] not in df.columns else c
        if new not in seen:
            seen.add(new)
            picked.append(F.col(f"`{c}`").alias(new))
    return df.select(*picked)


def rename_prefixes(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Renames the one column that starts with each prefix; it is an error if several do."""
    for prefix, new in names.items():
        found = [c for c in df.columns if c.lower().startswith(prefix)]
        if len(found) > 1:
            raise ValueError(f"several columns start with {prefix}: {', '.join(found)}")
        df = df.withColumnsRenamed({c: new for c in found})
    return df


def select_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The columns that exist, in the order asked for."""
    return df.select(*[c for c in columns if c in df.columns])


def coordinate_columns(df: DataFrame) -> tuple[str, str]:
    """The one column that starts with lat and the one that starts with lon, in any case."""
    found = [[c for c in df.columns if c.lower().startswith(p)] for p in ("lat", "lon")]
    if any(len(x) != 1 for x in found):
        raise ValueError(f"coordinate columns are not unique: {found}")
    return found[0][0], found[1][0]
