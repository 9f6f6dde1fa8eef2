"""All queries of the library, by name, and their SQL."""

from siteweave.plans import grid, profiles, rasters, shapes, siting, spatial, tables
from siteweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "grid", "profiles", "rasters", "shapes", "siting", "spatial", "tables"]
